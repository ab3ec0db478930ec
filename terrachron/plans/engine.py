"""One lazy graph from observations to all results, for many regions at once."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrachron.functions.dims import SECOND_TO_STATE, Params
from terrachron.operators import blocks, history, states, summary, validation


def tuned(spark: SparkSession) -> SparkSession:
    """The session with stages split where generated methods would exceed 8000 bytes, which the JVM never compiles.

    The unrolled sequence facts do, and run several times slower as one stage; a limit that was set before is kept.
    """
    name = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(name, "65535") == "65535":
        spark.conf.set(name, "8000")
    return spark


class LandHistory:
    """Results of an observation table (region, r, c, year, src); each is a DataFrame, built when it is asked for.

    Years are columns of the wide pixel table, so they are fixed when the graph is built: given, or read from the
    table once.
    """

    def __init__(self, observations: DataFrame, params: Params | None = None, years: list[int] | None = None) -> None:
        self.observations, self.params = observations, params or Params()
        self.years = years or sorted(r[0] for r in observations.select("year").distinct().collect())

    def persisted(self) -> "LandHistory":
        """The same with the pixel facts kept in memory and on disk, for a result that reads them many times; see ``release``."""
        out = LandHistory(self.observations, self.params, self.years)
        out.pixels = out.scored = out.facts = self.pixels.persist()
        out.wide = out.pixels.select(*history.KEY, *(f"s{i}" for i in range(len(self.years))))
        return out

    def release(self) -> None:
        self.pixels.unpersist()

    @cached_property
    def states(self) -> DataFrame:
        return states.canonical(self.observations)

    @cached_property
    def wide(self) -> DataFrame:
        return history.wide(self.states, self.years)

    @cached_property
    def grid(self) -> DataFrame:
        return history.extent(self.observations)

    @cached_property
    def facts(self) -> DataFrame:
        return history.facts(self.wide, self.years, self.params)

    @cached_property
    def scored(self) -> DataFrame:
        return history.scored(self.facts, self.grid, len(self.years), self.params)

    @cached_property
    def trends(self) -> DataFrame:
        return states.trends(self.states)

    @cached_property
    def transitions(self) -> DataFrame:
        return states.transitions(self.wide, "s0", f"s{len(self.years) - 1}")

    @cached_property
    def volumes(self) -> DataFrame:
        return summary.volumes(self.facts)

    @cached_property
    def signatures(self) -> DataFrame:
        return summary.signatures(self.facts, self.params)

    @cached_property
    def rare(self) -> DataFrame:
        return summary.rare_signatures(self.signatures, self.params)

    @cached_property
    def pixels(self) -> DataFrame:
        """All facts of each pixel."""
        return summary.with_anomaly(self.scored, self.rare, self.params)

    @cached_property
    def features(self) -> DataFrame:
        return blocks.features(self.facts, self.years, self.params)

    @cached_property
    def hotspots(self) -> DataFrame:
        return blocks.hotspots(self.scored, self.params)

    def compare(self, second: DataFrame) -> DataFrame:
        return validation.paired(self.states, states.canonical(second, SECOND_TO_STATE))

    def checked(self, second: DataFrame, year: int) -> DataFrame:
        return validation.checked(self.scored, states.canonical(second, SECOND_TO_STATE), year, self.years.index(year))

    def before(self, held: int = 2) -> DataFrame:
        """Scored facts of the years without the last ``held``, whose states stay as columns."""
        years = self.years[:-held]
        return history.scored(history.facts(self.wide, years, self.params), self.grid, len(years), self.params)

    def holdout(self, held: int = 2, least: int = 200) -> DataFrame | None:
        if len(self.years) < self.params.persistence + 1 + held + 1:
            return None
        return validation.holdout(self.before(held), [f"s{i}" for i in range(len(self.years) - held, len(self.years))], least)

    def benchmark(self) -> DataFrame:
        """A row of headline figures for each region."""
        p, t = self.params, len(self.years)
        area = self.grid.select("region", (F.col("h") * F.col("w") * 100 / 1e6).alias("area_km2"))
        change = summary.change_fractions(self.pixels, t).withColumnRenamed("mean_score", "mean_confidence")
        raw = states.raw_change(self.transitions).select("region", F.col("fraction").alias("raw_fraction"))
        delta = states.deltas(self.trends, self.years[0], self.years[-1]).groupBy("region").agg(F.max_by(F.struct("name", "delta"), F.struct(F.abs("delta"), -F.col("state"))).alias("d"))
        tiers = summary.tiers(self.scored).select("region", "events", F.col("high_pct").alias("high_confidence_pct"))
        out = area
        for part in (change, raw, delta.select("region", F.col("d.name").alias("biggest_delta_state"), F.col("d.delta").alias("biggest_delta")), summary.stable_changed(self.facts, p).select("region", "stable"), tiers):
            out = out.join(part, "region", "left")
        return out.join(summary.peak(self.volumes).select("region", F.col("stop").alias("peak_year")), "region", "left")

    def write(self, path: str) -> None:
        """The pixel facts as Parquet by region, and the raster layers' values with them; each write replaces the last."""
        layers(self.pixels).write.mode("overwrite").partitionBy("region").parquet(f"{path}/pixels")
        self.trends.write.mode("overwrite").parquet(f"{path}/trends")


def layers(pixels: DataFrame) -> DataFrame:
    """Values of the seven raster layers; confidence is the score in hundredths, cut."""
    return pixels.select("region", "r", "c", F.col("yoc").alias("year_of_change"), "from_state", "to_state", F.floor(F.col("score") * 100 + 1e-9).cast("int").alias("confidence"), F.col("tier").alias("confidence_tier"), "archetype", F.col("anomaly").cast("int").alias("anomaly"))
