"""Coarse blocks: features, hotspots, clusters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrachron.functions.dims import STATES, Params
from terrachron.functions.geo import from_utm
from terrachron.functions.pixel import name_of

FEATURES = [*(f"first_{v}" for v in STATES.values()), *(f"final_{v}" for v in STATES.values()), "changed", "change_timing", "volatility"]
BLOCK = ["region", "br", "bc"]


def block(px: int) -> dict[str, Column]:
    return {"br": F.floor(F.col("r") / px).cast("int"), "bc": F.floor(F.col("c") / px).cast("int")}


def features(pixel: DataFrame, years: list[int], p: Params) -> DataFrame:
    """Fifteen means over each block's pixels, in one hash aggregate; blocks at the border use the pixels they have."""
    timing = F.when(F.col("event"), (F.col("yoc") - years[0]) / max(years[-1] - years[0], 1)).otherwise(0.0)
    layer = {f"first_{v}": F.col("first_state") == k for k, v in STATES.items()} | {f"final_{v}": F.col("fin") == k for k, v in STATES.items()} | {"changed": F.col("event")}
    means = [(F.count_if(c) / F.count("*")).alias(n) for n, c in layer.items()]
    means += [F.round(F.avg(timing), 9).alias("change_timing"), (F.sum("switches") / max(len(years) - 1, 1) / F.count("*")).alias("volatility")]
    return pixel.withColumns(block(p.block_px)).groupBy(*BLOCK).agg(*means)


def densest(pixel: DataFrame, p: Params, mask: str = "event") -> DataFrame:
    """The block of each region with the largest share of ``mask``, the first in row order on a tie."""
    per = pixel.withColumns(block(p.block_px)).groupBy(*BLOCK).agg((F.count_if(mask) / F.count("*")).alias("fraction"))
    return per.groupBy("region").agg(F.max_by(F.struct("br", "bc", "fraction"), F.struct(F.col("fraction"), -F.col("br"), -F.col("bc"))).alias("b")).select("region", "b.*")


def hotspots(pixel: DataFrame, p: Params) -> DataFrame:
    """The blocks of each region with most change, with their commonest transition and year and their mean score.

    Ties go to the smallest (br, bc), transition and year. ``row`` and ``col`` are the block's centre in pixels; it is
    half a pixel up and left of where the old result put it.
    """
    px = pixel.withColumns(block(p.block_px))
    per = px.groupBy(*BLOCK).agg((F.count_if("event") / F.count("*")).alias("change_fraction"), F.avg(F.when(F.col("event"), F.col("score"))).alias("mean_score"))
    w = Window.partitionBy("region").orderBy(F.desc("change_fraction"), "br", "bc")
    top = per.withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= p.n_hotspots) & (F.col("change_fraction") > 0))
    ev = px.where("event").withColumn("pair", F.col("from_state") * 100 + F.col("to_state"))
    most = lambda c: ev.groupBy(*BLOCK, c).agg(F.count("*").alias("n")).groupBy(*BLOCK).agg(F.max_by(c, F.struct(F.col("n"), -F.col(c))).alias(f"top_{c}"))
    out = top.join(most("pair"), BLOCK).join(most("yoc"), BLOCK)
    half = p.block_px / 2
    return out.select(
        *BLOCK, "rank", F.lit(p.block_px * 10).alias("block_m"), "change_fraction", name_of(F.floor(F.col("top_pair") / 100).cast("int")).alias("dominant_from"), name_of(F.col("top_pair") % 100).alias("dominant_to"),
        F.col("top_yoc").alias("dominant_year"), F.round("mean_score", 6).alias("mean_score"), (F.col("br") * p.block_px + half).alias("row"), (F.col("bc") * p.block_px + half).alias("col"),
    )


def located(spots: DataFrame, x0: float, y1: float, zone: int, north: bool = True, legacy_center: bool = False) -> DataFrame:
    """Hotspots with lon and lat for a grid whose upper left corner is (x0, y1), 10 m pixels."""
    more = 0.5 if legacy_center else 0.0
    lon, lat = from_utm(F.lit(x0) + (F.col("col") + more) * 10, F.lit(y1) - (F.col("row") + more) * 10, F.lit(zone), F.lit(north))
    return spots.withColumns({"lon": F.round(lon, 6), "lat": F.round(lat, 6)})


def scaled(feats: DataFrame) -> DataFrame:
    """Features of each region with mean 0 and population deviation 1; constant features are 0."""
    of = feats.groupBy("region").agg(*(F.avg(c).alias(f"m_{c}") for c in FEATURES), *(F.nullif(F.round(F.stddev_pop(c), 12), F.lit(0.0)).alias(f"d_{c}") for c in FEATURES))
    return feats.join(of, "region").select(*BLOCK, *(F.round(F.coalesce((F.col(c) - F.col(f"m_{c}")) / F.col(f"d_{c}"), F.lit(0.0)), 6).alias(c) for c in FEATURES))


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 100) -> tuple[float, np.ndarray]:
    """Cost and labels of one fit from centres that are drawn far from each other."""
    centres = [x[rng.integers(len(x))]]
    far = ((x - centres[0]) ** 2).sum(1)
    for _ in range(k - 1):
        centres.append(x[rng.choice(len(x), p=far / far.sum())] if far.sum() > 0 else x[rng.integers(len(x))])
        far = np.minimum(far, ((x - centres[-1]) ** 2).sum(1))
    c, label = np.array(centres), None
    for _ in range(rounds):
        d = (x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)
        new = d.argmin(1)
        if label is not None and (new == label).all():
            break
        label = new
        c = np.array([x[label == j].mean(0) if (label == j).any() else c[j] for j in range(k)])
    return float(((x - c[label]) ** 2).sum()), label


def silhouette(x: np.ndarray, label: np.ndarray, rows: int = 1024) -> float:
    """Mean silhouette on Euclidean distances, a slice of rows at a time; 0 for a cluster of one."""
    kinds, label = np.unique(label, return_inverse=True)
    size = np.bincount(label)
    total = 0.0
    for a in range(0, len(x), rows):
        part, own = x[a : a + rows], label[a : a + rows]
        d = np.sqrt(np.maximum((part**2).sum(1)[:, None] - 2 * part @ x.T + (x**2).sum(1), 0))
        per = np.stack([d[:, label == j].sum(1) for j in range(len(kinds))], 1)
        at = np.arange(len(part))
        inner = per[at, own] / np.maximum(size[own] - 1, 1)
        mean = per / size
        mean[at, own] = np.inf
        outer = mean.min(1)
        total += np.where(size[own] > 1, (outer - inner) / np.maximum(np.maximum(inner, outer), 1e-12), 0.0).sum()
    return total / len(x)


def clusters(feats: DataFrame, p: Params, seed: int = 42, starts: int = 10) -> DataFrame:
    """(region, br, bc, label, k, silhouette): each region's blocks by k-means, with the k of the best silhouette.

    The best of ``starts`` fits counts, and the smallest k wins ties; labels are numbered by their first block in row
    order, so reruns agree. A region without variance, or with too few blocks, is one cluster of silhouette 0. A
    region's blocks are one group in one task: a region is at most MAX_AREA_KM2, some ten thousand blocks.
    """
    z = scaled(feats)
    schema = T.StructType([*z.select(*BLOCK).schema.fields, *T.StructType.fromDDL("label int, k int, silhouette double").fields])

    def fit(group: pa.Table) -> pa.Table:
        group = group.sort_by([("br", "ascending"), ("bc", "ascending")])
        x = np.stack([group.column(c).to_numpy() for c in FEATURES], 1)
        best = (0.0, 1, np.zeros(len(x), dtype=np.int64))
        if len(x) > p.k_min and x.std(0).max() >= 1e-6:
            rng, found = np.random.default_rng(seed), []
            for k in range(p.k_min, min(p.k_max, len(x) - 1) + 1):
                label = min((k_means(x, k, rng) for _ in range(starts)), key=lambda f: f[0])[1]
                if len(np.unique(label)) > 1:
                    found.append((round(silhouette(x, label), 9), k, label))
            best = max(found, key=lambda f: (f[0], -f[1]), default=best)
        _, first, label = np.unique(best[2], return_index=True, return_inverse=True)
        label = np.argsort(np.argsort(first))[label]
        out = [pa.array(label, pa.int32()), pa.array([best[1]] * len(x), pa.int32()), pa.array([best[0]] * len(x), pa.float64())]
        return pa.table([*(group.column(c) for c in BLOCK), *out], names=schema.names)

    return z.groupBy("region").applyInArrow(fit, schema)


def profiles(feats: DataFrame, labels: DataFrame) -> DataFrame:
    """Size, means and commonest first and final state of each region's clusters; the first state in order wins ties."""
    each = feats.join(labels.select(*BLOCK, "label"), BLOCK)
    out = each.groupBy("region", "label").agg(F.count("*").alias("blocks"), *(F.avg(c).alias(c) for c in FEATURES))
    top = lambda stem: F.greatest(*(F.struct(F.col(f"{stem}_{v}").alias("m"), F.lit(-k).alias("k")) for k, v in STATES.items()))["k"]
    return out.select("region", "label", "blocks", F.round("changed", 3).alias("changed_fraction"), name_of(-top("first")).alias("dominant_initial_state"), name_of(-top("final")).alias("dominant_final_state"), F.round("change_timing", 3).alias("mean_change_timing"), F.round("volatility", 3).alias("volatility"))


def to_pixels(pixel: DataFrame, labels: DataFrame, p: Params) -> DataFrame:
    """(region, r, c, layer): each pixel's cluster plus one."""
    return pixel.select("region", "r", "c", *(v.alias(k) for k, v in block(p.block_px).items())).join(labels, BLOCK).select("region", "r", "c", (F.col("label") + 1).alias("layer"))
