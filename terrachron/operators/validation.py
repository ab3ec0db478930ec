"""Agreement with a second product, and a temporal holdout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrachron.functions.dims import STATES
from terrachron.operators.states import share

POSITION = ["region", "r", "c", "year"]


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """(region, year, a, b, pixels) of states that both products observe, counted; one equi-join on position and year."""
    both = a.where("state <> 0").withColumnRenamed("state", "a").join(b.where("state <> 0").withColumnRenamed("state", "b"), POSITION)
    return both.groupBy("region", "year", "a", "b").agg(F.count("*").alias("pixels"))


def agreement(pairs: DataFrame) -> DataFrame:
    out = pairs.groupBy("region", "year").agg(F.sum("pixels").alias("pixels"), F.sum(F.when(F.col("a") == F.col("b"), F.col("pixels")).otherwise(0)).alias("equal"))
    return out.select("region", "year", "pixels", share(F.col("equal"), F.col("pixels")).alias("agreement"))


def iou(pairs: DataFrame) -> DataFrame:
    """Intersection over union of each state, and its pixels in either product."""
    rows = pairs.withColumn("s", F.explode(F.array_distinct(F.array("a", "b"))))
    is_a, is_b = F.col("a") == F.col("s"), F.col("b") == F.col("s")
    count = lambda c: F.sum(F.when(c, F.col("pixels")).otherwise(0))
    out = rows.groupBy("region", "year", F.col("s").alias("state")).agg(count(is_a).alias("first_pixels"), count(is_b).alias("second_pixels"), count(is_a & is_b).alias("i"))
    return out.select("region", "year", "state", "first_pixels", "second_pixels", (F.col("i") / (F.col("first_pixels") + F.col("second_pixels") - F.col("i"))).alias("iou"))


def checked(scored: DataFrame, second: DataFrame, year: int, index: int) -> DataFrame:
    """``scored`` pixels that the second product observes in ``year`` (the ``index``-th): ``done`` events, ``calm`` pixels, ``here`` and ``other`` states."""
    other = second.where((F.col("year") == year) & (F.col("state") != 0)).select("region", "r", "c", F.col("state").alias("other"))
    out = scored.join(other, ["region", "r", "c"])
    return out.withColumns({"done": F.col("event") & (F.col("yoc") <= year), "calm": ~F.col("event"), "here": F.col(f"s{index}")})


def baselines(check: DataFrame, least: int = 100) -> DataFrame:
    """(region, state, pixels, baseline): how often unchanged pixels of a state agree, for states with enough pixels."""
    out = check.where(F.col("calm") & F.col("here").isin(*STATES)).groupBy("region", F.col("here").alias("state")).agg(F.count("*").alias("pixels"), F.count_if(F.col("other") == F.col("here")).alias("equal"))
    return out.where(F.col("pixels") >= least).select("region", "state", "pixels", (F.col("equal") / F.col("pixels")).alias("baseline"))


def relative(events: DataFrame, base: DataFrame, by: list[str], least: int = 50, floor: float = 0.05) -> DataFrame:
    """Agreement of events with the second product against the baseline of their new states.

    States without a baseline, or under ``floor``, aren't evaluated; groups under ``least`` events give nothing.
    """
    per = events.groupBy(*by, F.col("to_state").alias("state")).agg(F.count("*").alias("n"), F.count_if(F.col("other") == F.col("to_state")).alias("equal"))
    per = per.join(base.where(F.col("baseline") >= floor).select("region", "state", "baseline"), ["region", "state"], "left")
    ok = F.col("baseline").isNotNull()
    out = per.groupBy(*by).agg(F.sum("n").alias("events"), F.sum(F.when(ok, F.col("n")).otherwise(0)).alias("evaluated"), F.sum(F.when(ok, F.col("equal")).otherwise(0)).alias("equal"), F.sum(F.when(ok, F.col("baseline") * F.col("n"))).alias("expected"))
    out = out.where((F.col("events") >= least) & (F.col("expected") > 0))
    return out.select(*by, "events", "evaluated", (F.col("equal") / F.col("evaluated")).alias("agreement"), F.round(F.col("expected") / F.col("evaluated"), 6).alias("baseline"), F.round(F.col("equal") / F.col("expected"), 6).alias("ratio"))


def between(low: Column, high: Column, part: Column) -> Column:
    """low * (1 - part) + high * part for quarters, where the first product isn't rounded, as in SQL's ``quantile_cont`` (a fused multiplication)."""
    x, y = low * (1 - part), high * part
    lost = F.when(part == 0.25, low * 0.25 - (x - low * 0.5)).otherwise(0.0)  # by the first product; others are exact
    t = x + y
    z = t - x
    return t + (lost + ((x - (t - z)) + (y - z)))


def quartiles(events: DataFrame) -> DataFrame:
    """(region, events, q1, q2, q3): exact quartiles of the score from its histogram, interpolated as SQL does to the last bit.

    Between two scores that differ in their last bit only, another rounding moves an edge from one to the other, with
    all events that have that score.
    """
    by = Window.partitionBy("region")
    rows = events.groupBy("region", "score").agg(F.count("*").alias("n"))
    rows = rows.withColumns({"upto": F.sum("n").over(by.orderBy("score").rowsBetween(Window.unboundedPreceding, Window.currentRow)), "events": F.sum("n").over(by)})
    at = {f"q{k}": (F.col("events") - 1) * (k / 4) for k in (1, 2, 3)}
    reached = lambda i: F.min(F.when(F.col("upto") > i, F.col("score")))
    rows = rows.groupBy("region", "events").agg(*(reached(f(x)).alias(f"{q}_{end}") for q, x in at.items() for end, f in (("low", F.floor), ("high", F.ceil))))
    return rows.select("region", "events", *(between(F.col(f"{q}_low"), F.col(f"{q}_high"), x - F.floor(x)).alias(q) for q, x in at.items()))


def binned(events: DataFrame, edges: DataFrame, least: int = 200) -> DataFrame:
    """``events`` with their bin 1 to 4 of the score, in regions with at least ``least`` events; an edge belongs to the bin below."""
    s: Column = F.col("score")
    kind = F.when(s <= F.col("q1"), 1).when(s <= F.col("q2"), 2).when(s <= F.col("q3"), 3).otherwise(4)
    return events.join(edges.where(F.col("events") >= least).drop("events"), "region").withColumn("bin", kind)


def holdout(scored: DataFrame, held: list[str], least: int = 200) -> DataFrame:
    """(region, bin, events, verified) of events from the years before: how many new states last through all ``held`` columns; bin 0 is all."""
    lasts = None
    for c in held:
        one = F.col(c) == F.col("to_state")
        lasts = one if lasts is None else lasts & one
    ev = scored.where("event").withColumn("lasts", lasts)
    bins = binned(ev, quartiles(ev), least)
    rows = bins.withColumn("bin", F.explode(F.array(F.lit(0), F.col("bin"))))
    return rows.groupBy("region", "bin").agg(F.count("*").alias("events"), (F.count_if("lasts") / F.count("*")).alias("verified"))
