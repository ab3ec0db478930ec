"""States by year: shares, trends, transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrachron.functions.dims import CLASS_TO_STATE, STATES
from terrachron.functions.pixel import name_of, remap


def canonical(obs: DataFrame, table: dict[int, int] = CLASS_TO_STATE) -> DataFrame:
    """(region, r, c, year, state)."""
    return obs.select("region", "r", "c", "year", remap(F.col("src"), table).alias("state"))


def share(part: Column, whole: Column) -> Column:
    """part / whole, null if there is nothing."""
    return part / F.nullif(whole, F.lit(0))


def trends(states: DataFrame) -> DataFrame:
    """(region, year, state, name, fraction) for every state: its share of the observed pixels, null if none is.

    One hash aggregate with a count for each state, then turned to rows.
    """
    counts = states.groupBy("region", "year").agg(F.count_if(F.col("state") != 0).alias("observed"), *(F.count_if(F.col("state") == k).alias(f"n{k}") for k in STATES))
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("state"), F.lit(v).alias("name"), F.col(f"n{k}").alias("n")) for k, v in STATES.items()))).alias("x")
    return counts.select("region", "year", "observed", rows).select("region", "year", "x.state", "x.name", share(F.col("x.n"), F.col("observed")).alias("fraction"))


def fractions(states: DataFrame, year: int) -> DataFrame:
    return trends(states.where(F.col("year") == year)).drop("year")


def deltas(trend: DataFrame, first: int, last: int) -> DataFrame:
    """(region, state, name, delta): last minus first year."""
    at = lambda y: F.max(F.when(F.col("year") == y, F.col("fraction")))
    return trend.groupBy("region", "state", "name").agg((at(last) - at(first)).alias("delta"))


def top_deltas(delta: DataFrame, k: int = 4, least: float = 0.001) -> DataFrame:
    """The largest changes of each region by size, without those under ``least``."""
    w = Window.partitionBy("region").orderBy(F.desc(F.abs("delta")), "state")
    return delta.where(F.abs("delta") >= least).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def visible(trend: DataFrame, least: float = 0.005) -> DataFrame:
    """Trends of states that exceed ``least`` in any year."""
    keep = trend.groupBy("region", "state").agg(F.max("fraction").alias("m")).where(F.col("m") > least)
    return trend.join(keep.drop("m"), ["region", "state"], "left_semi")


def transitions(wide: DataFrame, first: str, last: str) -> DataFrame:
    """(region, from_state, to_state, pixels, fraction) between two years of the wide table, of pixels observed in both."""
    n = wide.where((F.col(first) != 0) & (F.col(last) != 0)).groupBy("region", F.col(first).alias("from_state"), F.col(last).alias("to_state")).agg(F.count("*").alias("pixels"))
    return n.withColumn("fraction", F.col("pixels") / F.sum("pixels").over(Window.partitionBy("region")))


def top_transitions(matrix: DataFrame, k: int = 5) -> DataFrame:
    """The largest transitions of each region between different states; (from, to) decides ties."""
    w = Window.partitionBy("region").orderBy(F.desc("pixels"), "from_state", "to_state")
    return matrix.where("from_state <> to_state").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def raw_change(matrix: DataFrame) -> DataFrame:
    """(region, pixels, changed, fraction) of two-date change."""
    out = matrix.groupBy("region").agg(F.sum("pixels").alias("pixels"), F.sum(F.when(F.col("from_state") != F.col("to_state"), F.col("pixels")).otherwise(0)).alias("changed"))
    return out.withColumn("fraction", share(F.col("changed"), F.col("pixels")))


def present(states: DataFrame) -> DataFrame:
    return states.select("region", "state").distinct().withColumn("name", F.when(F.col("state") == 0, "nodata").otherwise(name_of(F.col("state"))))
