"""The wide pixel table, and facts by pixel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrachron.functions.dims import STATES, Params
from terrachron.functions.pixel import tier, with_events, with_trajectories

KEY = ["region", "r", "c"]


def wide(states: DataFrame, years: list[int]) -> DataFrame:
    """(region, r, c, s0..): one row for each pixel and a column for each year, 0 where it isn't observed; one shuffle."""
    cols = [F.coalesce(F.max(F.when(F.col("year") == y, F.col("state"))), F.lit(0)).alias(f"s{i}") for i, y in enumerate(years)]
    return states.groupBy(*KEY).agg(*cols)


def computed_once(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with its columns computed before anything that reads them; ``keys`` come first and stay as they are.

    Without it the optimizer moves a filter on a fact below its projections and writes out the fact's whole expression
    in each place that names it; rows stay in generated code. A partitioning by ``keys`` is kept for later joins.
    """
    rest = [c for c in df.columns if c not in keys]
    return df.select(*keys, F.explode(F.array(F.struct(*rest))).alias("_row")).select(*keys, "_row.*")


def facts(history: DataFrame, years: list[int], p: Params) -> DataFrame:
    """All sequence facts of each pixel; no shuffle."""
    return computed_once(with_trajectories(computed_once(with_events(history, years, p), KEY), len(years), p), KEY)


def extent(history: DataFrame) -> DataFrame:
    """(region, h, w)."""
    return history.groupBy("region").agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"))


def supported(pixel: DataFrame, grid: DataFrame) -> DataFrame:
    """``pixel`` with neighbours, inside and support: the share of a pixel's neighbours with an event to the same state; 0 without an event.

    Each event counts for its eight neighbours, in one hash aggregate with a row for each position, joined by position;
    the number of neighbours inside the grid follows from the position alone.
    """
    around = F.array(*(F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if dr or dc))
    votes = pixel.where("event").select(*KEY, "to_state").withColumn("o", F.explode(around)).select("region", (F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c"), "to_state")
    votes = votes.groupBy(*KEY).agg(*(F.count(F.when(F.col("to_state") == k, 1)).alias(f"_v{k}") for k in STATES))
    out = pixel.join(votes, KEY, "left").join(grid, "region")
    edge = lambda x, size: 3 - (F.col(x) == 0).cast("int") - (F.col(x) == F.col(size) - 1).cast("int")
    same = F.coalesce(*(F.when(F.col("to_state") == k, F.col(f"_v{k}")) for k in STATES), F.lit(0))
    out = out.withColumns({"neighbours": same, "inside": edge("r", "h") * edge("c", "w") - 1})
    share = F.when(F.col("event") & (F.col("inside") > 0), F.col("neighbours") / F.col("inside")).otherwise(0.0)
    return out.withColumn("support", share).drop("h", "w", *(f"_v{k}" for k in STATES))


def spatial_support(pixel: DataFrame, grid: DataFrame) -> DataFrame:
    """(region, r, c, to_state, neighbours, inside, support) of event pixels."""
    return supported(pixel, grid).where("event").select(*KEY, "to_state", "neighbours", "inside", "support")


def scored(pixel: DataFrame, grid: DataFrame, t: int, p: Params) -> DataFrame:
    """``pixel`` with support, score and tier; 0 where there is no event."""
    out = supported(pixel, grid).drop("neighbours", "inside")
    lasting = F.least(F.col("trail") / min(p.persistence + 2, t - 1), F.lit(1.0))
    a, b, c, d = p.weights
    score = lasting * a + F.col("pre_mode_frac") * b + F.col("purity") * c + F.col("support") * d
    out = out.withColumn("score", F.when(F.col("event"), score).otherwise(0.0))
    return computed_once(out.withColumn("tier", F.when(F.col("event"), tier(F.col("score"), p)).otherwise(0)), KEY)
