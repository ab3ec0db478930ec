"""Aggregates over pixel facts: volumes, signatures, rarity, tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrachron.functions.dims import ARCHETYPES, CHANGE_ARCHETYPES, TIERS, Params
from terrachron.functions.pixel import name_of, sig_label
from terrachron.operators.states import share


def volumes(pixel: DataFrame) -> DataFrame:
    return pixel.where("event").groupBy("region", "yoc", "from_state", "to_state").agg(F.count("*").alias("pixels"))


def volumes_by_destination(pixel: DataFrame) -> DataFrame:
    """Area by year of change and new state, in square kilometres."""
    return volumes(pixel).groupBy("region", "yoc", "to_state").agg((F.sum("pixels") * 100 / 1e6).alias("km2"))


def yearly_totals(volume: DataFrame) -> DataFrame:
    """Pixels changed in each year, and its largest transition ((from, to) decides ties)."""
    best = F.max_by(F.struct("from_state", "to_state"), F.struct(F.col("pixels"), -F.col("from_state"), -F.col("to_state")))
    out = volume.groupBy("region", "yoc").agg(F.sum("pixels").alias("pixels"), best.alias("b"))
    return out.select("region", "yoc", "pixels", F.col("b.from_state").alias("dominant_from"), F.col("b.to_state").alias("dominant_to"))


def peak(volume: DataFrame) -> DataFrame:
    """The year with most change, the earliest on a tie, as a period that starts the year before."""
    per = volume.groupBy("region", "yoc").agg(F.sum("pixels").alias("n"))
    top = per.groupBy("region").agg(F.max_by("yoc", F.struct(F.col("n"), -F.col("yoc"))).alias("year"))
    return top.select("region", (F.col("year") - 1).alias("start"), F.col("year").alias("stop"))


def analysed(p: Params) -> Column:
    return F.col("observed") >= p.min_observed


def signatures(pixel: DataFrame, p: Params) -> DataFrame:
    """(region, sig, states, label, pixels, fraction) of analysed pixels."""
    n = pixel.where(analysed(p)).groupBy("region", "sig").agg(F.count("*").alias("pixels"), F.first("n_states").alias("states"))
    return n.select("region", "sig", "states", sig_label(F.col("sig")).alias("label"), "pixels", (F.col("pixels") / F.sum("pixels").over(Window.partitionBy("region"))).alias("fraction"))


def top_signatures(stats: DataFrame, k: int = 10) -> DataFrame:
    w = Window.partitionBy("region").orderBy(F.desc("pixels"), "sig")
    return stats.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rare_signatures(stats: DataFrame, p: Params) -> DataFrame:
    """Histories with several states under the rarity threshold, the rarest first within the budget of pixels; the first always.

    The windows run over the histogram of one region's signatures, not over pixels.
    """
    w = Window.partitionBy("region")
    total = stats.withColumn("total", F.sum("pixels").over(w))
    rare = total.where((F.col("states") >= 2) & (F.col("fraction") < p.rarity_threshold))
    order = w.orderBy("pixels", "sig")
    rare = rare.withColumns({"rank": F.row_number().over(order), "so_far": F.sum("pixels").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    return rare.where((F.col("rank") == 1) | (F.col("so_far") <= F.floor(F.col("total") * p.anomaly_budget))).drop("total")


def with_anomaly(pixel: DataFrame, rare: DataFrame, p: Params) -> DataFrame:
    """``pixel`` with the column anomaly, by a join with the few rare signatures of its region."""
    marks = rare.select("region", "sig", F.lit(True).alias("_rare"))
    return pixel.join(marks, ["region", "sig"], "left").withColumn("anomaly", F.coalesce(F.col("_rare") & analysed(p), F.lit(False))).drop("_rare")


def archetypes(pixel: DataFrame, p: Params) -> DataFrame:
    n = pixel.groupBy("region", "archetype").agg(F.count("*").alias("pixels"), F.count_if(analysed(p)).alias("a"))
    n = n.withColumn("all", F.sum("a").over(Window.partitionBy("region"))).where("archetype <> 0")
    return n.select("region", "archetype", name_of(F.col("archetype"), ARCHETYPES).alias("name"), "pixels", share(F.col("pixels"), F.col("all")).alias("fraction"))


def stable_changed(pixel: DataFrame, p: Params) -> DataFrame:
    """Shares of analysed pixels that are stable (with or without flicker) and changed."""
    kind = F.col("archetype")
    out = pixel.where(analysed(p)).groupBy("region").agg(F.count("*").alias("n"), F.count_if(kind.isin(1, 2)).alias("s"), F.count_if(kind.isin(*CHANGE_ARCHETYPES)).alias("c"))
    return out.select("region", share(F.col("s"), F.col("n")).alias("stable"), share(F.col("c"), F.col("n")).alias("changed"))


def tiers(pixel: DataFrame) -> DataFrame:
    """Events of each tier (all three, 0 included), and their share."""
    out = pixel.groupBy("region").agg(F.count_if("event").alias("events"), *(F.count_if(F.col("tier") == k).alias(TIERS[k]) for k in (1, 2, 3)))
    return out.withColumns({f"{TIERS[k]}_pct": F.col(TIERS[k]) * 100 / F.greatest(F.col("events"), F.lit(1)) for k in (1, 2, 3)})


def tier_percentages(tiers: DataFrame) -> DataFrame:
    """(region, tier, pct_floor, pct_round, pct_tenth) of :func:`tiers`: whole percentages cut or rounded, and with one place."""
    rows = tiers.select("region", "events", F.explode(F.array(*(F.struct(F.lit(TIERS[k]).alias("tier"), F.col(TIERS[k]).alias("n")) for k in (1, 2, 3)))).alias("t")).where("events > 0")
    pct = F.col("t.n") * 100 / F.col("events")
    return rows.select("region", "t.tier", F.floor(pct).alias("pct_floor"), F.floor(pct + 0.5).alias("pct_round"), (F.floor(pct * 10 + 0.5) / 10).alias("pct_tenth"))


def event_fraction(pixel: DataFrame, t: int) -> DataFrame:
    """Events, the pixels that the first and last years observe, and their ratio."""
    out = pixel.groupBy("region").agg(F.count_if("event").alias("events"), F.count_if((F.col("s0") != 0) & (F.col(f"s{t - 1}") != 0)).alias("pixels"))
    return out.withColumn("fraction", F.col("events") / F.greatest("pixels", F.lit(1)))


def change_fractions(pixel: DataFrame, t: int) -> DataFrame:
    """Shares of events and anomalies in the pixels that the first and last years observe, and the mean score of events."""
    both = F.greatest(F.count_if((F.col("s0") != 0) & (F.col(f"s{t - 1}") != 0)), F.lit(1))
    return pixel.groupBy("region").agg((F.count_if("event") / both).alias("event_fraction"), (F.count_if("anomaly") / both).alias("anomaly_fraction"), F.round(F.coalesce(F.avg(F.when(F.col("event"), F.col("score"))), F.lit(0.0)), 6).alias("mean_score"))
