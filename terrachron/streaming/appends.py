"""New yearly composites as a stream: the regions that they touch are computed anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from terrachron.functions.dims import Params
from terrachron.plans.engine import LandHistory, layers

SCHEMA = "region int, r int, c int, year int, src int"


def follow(spark: SparkSession, landing: str, observations: str, output: str, checkpoint: str, params: Params | None = None) -> StreamingQuery:
    """Reads Parquet files that land in ``landing``, adds them to ``observations`` and rewrites the touched regions of ``output``.

    Each micro-batch goes to its own folder of ``observations``, so that a batch that is run again replaces itself; the
    last delivery of a pixel and year wins. Only touched regions are read (partition pruning) and written.
    """

    def add(batch: DataFrame, number: int) -> None:
        s = batch.sparkSession
        batch.withColumn("region_key", F.col("region")).write.mode("overwrite").partitionBy("region_key").parquet(f"{observations}/batch={number:08d}")
        touched = batch.select("region").distinct()
        every = s.read.parquet(observations).withColumn("region", F.col("region_key"))
        ours = every.join(F.broadcast(touched), "region", "left_semi")
        last = ours.groupBy("region", "r", "c", "year").agg(F.max_by("src", "batch").alias("src"))
        years = sorted(r[0] for r in last.select("year").distinct().collect())
        if len(years) <= (params or Params()).persistence:
            return
        s.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        layers(LandHistory(last, params, years).pixels).write.mode("overwrite").partitionBy("region").parquet(output)

    return spark.readStream.schema(SCHEMA).parquet(landing).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
