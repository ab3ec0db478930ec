"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from terrachron.llm.shared import forget, settle


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b): the smallest node reachable.

    Large-star then small-star until nothing changes; each round is written to the shared folder. A node's
    neighbours are never gathered: both steps need only their minimum. Null ends and loops are ignored; an empty
    table gives an empty result.
    """
    def written(e: DataFrame) -> tuple[DataFrame, tuple]:
        """The distinct edges from the larger to the smaller end, with their number and checksum."""
        seen = Observation()
        e = e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        out = settle(e.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")))
        return out, (seen.get["n"], seen.get["s"])

    e, stats = written(edges.select("a", "b"))
    for _ in range(max_rounds):
        both = e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = large.distinct()
        # small star: every node links its smaller neighbours, and itself, to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        last, before = e, stats
        e, stats = written(small)
        forget(last)
        if before == stats:  # stars stay as they are, so one round is enough for them
            roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
