"""Yearly class observations (region, r, c, year, src), their checks, mosaics, resampling and scenes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrachron.operators.history import computed_once

GRID_WIDTH, REGION_ROWS = 50, 20
# Class by the index of the derived fixture; -1 is a gap and -2 a cloud.
FIXTURE_CLASSES = {-1: 0, -2: 10, 0: 1, 1: 2, 2: 4, 3: 5, 4: 7, 5: 8, 6: 9}


def _floor(c: Column) -> Column:
    return F.floor(c).cast("int")


def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations derived from the parts and line items of a star schema; rows count within their region.

    A part is a pixel, 50 in a row and 20 rows in a region. Blocks share a base and a target class and a year of
    change; counts of line items add noise, clouds and gaps.
    """
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", F.year("l_shipdate").alias("y"), "l_linenumber")
    n = items.groupBy(F.col("l_partkey").alias("k"), "y").agg(F.count("*").alias("cnt"), F.sum("l_linenumber").alias("s"))
    years = items.agg(F.array_sort(F.collect_set("y"))).first()[0]
    k = F.col("p_partkey")
    grid = spark.read.parquet(f"{sf_dir}/part.parquet").select(k.alias("k"), _floor(k / GRID_WIDTH).alias("row"), (k % GRID_WIDTH).cast("int").alias("c"), F.explode(F.array(*map(F.lit, years))).alias("y"))
    b = grid.join(n, ["k", "y"], "left").fillna(0, ["cnt", "s"])
    r8, c8, r4, c4 = (_floor(F.col(x) / w) for w in (8, 4) for x in ("row", "c"))
    index = (
        F.when((F.col("cnt") == 0) | ((F.col("k") % 97 == 0) & (F.col("y") < 1999)), -1).when(F.col("cnt") % 11 == 0, -2).when(F.col("cnt") % 7 == 0, (F.col("s") % 8).cast("int"))
        .when(F.col("y") >= 1995 + (r4 * 2 + c4) % 9, (r8 * 3 + c8 + 3) % 8).otherwise((r8 + c8) % 8)
    )
    src = F.lit(11)
    for i, code in FIXTURE_CLASSES.items():
        src = F.when(F.col("ix") == i, code).otherwise(src)
    region = _floor(F.col("row") / REGION_ROWS)
    return computed_once(b.select("row", "c", "y", index.alias("ix"))).select(region.alias("region"), (F.col("row") - REGION_ROWS * region).alias("r"), "c", F.col("y").cast("int").alias("year"), src.alias("src"))


def second_product(obs: DataFrame, years: tuple[int, ...] = (1998, 1999)) -> DataFrame:
    """A second product over the same pixels, which disagrees on a fifth of them."""
    row, src = F.col("r") + REGION_ROWS * F.col("region"), F.col("src")
    code = (
        F.when(src.isin(0, 10), 0).when((row * 7 + F.col("c") * 3 + F.col("year")) % 5 == 0, 30).when(src == 1, 80).when(src.isin(2, 4, 11), 30)
        .when(src == 5, 40).when(src == 7, 50).when(src == 8, 60).when(src == 9, 70).otherwise(0)
    )
    return obs.where(F.col("year").isin(*years)).select("region", "r", "c", "year", code.alias("src"))


def window(obs: DataFrame, r0: int, r1: int, c0: int, c1: int, years: list[int] | None = None) -> DataFrame:
    """Rows r0 to r1 and columns c0 to c1, both included; ranges and years reach the scan."""
    out = obs.where(F.col("r").between(r0, r1) & F.col("c").between(c0, c1))
    return out.where(F.col("year").isin(*years)) if years else out


def coregistration(obs: DataFrame) -> DataFrame:
    """Pixels and extent of each region and year, and whether all years of the region agree."""
    per = obs.groupBy("region", "year").agg(F.count("*").alias("pixels"), (F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"))
    same = per.groupBy("region").agg((F.count_distinct("pixels", "h", "w") == 1).alias("aligned"))
    return per.join(same, "region")


def require_aligned(obs: DataFrame) -> DataFrame:
    bad = coregistration(obs).where("NOT aligned").select("region").distinct().limit(5).collect()
    if bad:
        raise ValueError(f"years are not co-registered in regions {[r[0] for r in bad]}")
    return obs


def mosaic(tiles: DataFrame) -> DataFrame:
    """One class for each pixel and year from tiles with a ``rank``: the first that isn't 0, in one hash aggregate."""
    first = F.min_by("src", F.when(F.col("src") != 0, F.col("rank")))
    return tiles.groupBy("region", "r", "c", "year").agg(F.coalesce(F.when(F.max(F.col("src") != 0), first), F.lit(0)).alias("src"))


def resample_nearest(source: DataFrame, target: DataFrame, scale: float, shift_r: float = 0.0, shift_c: float = 0.0) -> DataFrame:
    """Classes of ``target`` pixels (region, r, c, year) whose centre lies in a source pixel ``scale`` times as large; 0 outside."""
    at = lambda c, shift: F.floor((F.col(c) + 0.5 + shift) / scale).cast("int")
    t = target.withColumns({"_r": at("r", shift_r), "_c": at("c", shift_c)})
    s = source.select("region", "year", F.col("r").alias("_r"), F.col("c").alias("_c"), "src")
    return t.join(s, ["region", "year", "_r", "_c"], "left").select("region", "r", "c", "year", F.coalesce("src", F.lit(0)).alias("src"))


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue of scenes (scene_id, day, cloud) from the event table."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("event_id").alias("scene_id"), F.col("ts").cast("date").alias("day"), F.col("value").alias("cloud"))


def best_scene(wanted: DataFrame, catalogue: DataFrame, start: str, end: str, max_cloud: float = 20.0) -> DataFrame:
    """The clearest scene of each row of ``wanted`` between its dates ``start`` and ``end``, the smallest id on a tie; rows without are dropped.

    Dates are exploded to days and hash-joined with the best scene of each day, which is far smaller than the catalogue.
    """
    daily = catalogue.where(F.col("cloud") < max_cloud).groupBy("day").agg(F.min(F.struct("cloud", "scene_id")).alias("s"))
    days = wanted.select(*wanted.columns, F.explode(F.sequence(start, end)).alias("day"))
    best = days.join(daily, "day").groupBy(*wanted.columns).agg(F.min("s").alias("s"))
    return best.select(*wanted.columns, "s.scene_id", "s.cloud")


def evidence_pairs(hotspots: DataFrame, catalogue: DataFrame, year: str = "dominant_year", max_cloud: float = 20.0) -> DataFrame:
    """``hotspots``, all of them, with the scenes ``before`` and ``after`` their year; both null unless both are found.

    Before: the first half of the year before, else from the year before that. After: the year after, else from July.
    If both tables have a box (west, south, east, north), a scene must meet the hotspot's. Scenes and hotspots meet by
    month and, with boxes, by square degree, in one equi-join; then the clearest is taken, the smallest id on a tie.
    """
    sides, y = ("west", "south", "east", "north"), F.col(year)
    placed = all(s in t.columns for t in (hotspots, catalogue) for s in sides)
    day = lambda dy, m, d: F.make_date(y + dy, F.lit(m), F.lit(d))
    spans = {"b1": (day(-1, 1, 1), day(-1, 6, 30)), "b2": (day(-2, 1, 1), day(-1, 6, 30)), "a1": (day(1, 1, 1), day(1, 12, 31)), "a2": (day(0, 7, 1), day(1, 12, 31))}

    def cells(df: DataFrame) -> DataFrame:
        """A row for each square degree of the row's box."""
        if not placed:
            return df.withColumns({"_x": F.lit(0), "_y": F.lit(0)})
        across = [F.explode(F.sequence(F.floor(a), F.greatest(F.floor(a), F.ceil(b) - 1))) for a, b in (("west", "east"), ("south", "north"))]
        return df.withColumn("_x", across[0]).withColumn("_y", across[1])

    key = ["region", "rank"]
    asked = hotspots.select(*key, *(sides if placed else ()), F.explode(F.array(*(F.struct(F.lit(n).alias("span"), a.alias("start"), b.alias("stop")) for n, (a, b) in spans.items()))).alias("s")).select("*", "s.*").drop("s")
    asked = cells(asked.withColumn("_month", F.explode(F.sequence("start", "stop", F.expr("interval 1 month")))))
    shown = cells(catalogue.where(F.col("cloud") < max_cloud)).select(*(F.col(s).alias(f"_{s}") for s in sides if placed), "_x", "_y", "day", "cloud", "scene_id", F.trunc("day", "month").alias("_month"))
    met = asked.join(shown, ["_month", "_x", "_y"]).where(F.col("day").between(F.col("start"), F.col("stop")))
    if placed:
        met = met.where("west < _east AND _west < east AND south < _north AND _south < north")
    best = met.groupBy(*key).agg(*(F.min(F.when(F.col("span") == n, F.struct("cloud", "scene_id")))["scene_id"].alias(n) for n in spans))
    best = best.select(*key, F.coalesce("b1", "b2").alias("before"), F.coalesce("a1", "a2").alias("after")).where("before IS NOT NULL AND after IS NOT NULL")
    return hotspots.join(best, key, "left")


def product_path(template: str, tile: str, year: int, years: tuple[int, ...]) -> str:
    """Where a tile's raster of a year is: ``template`` with {tile} and {year}; only for ``years`` that the product has."""
    if year not in years:
        raise ValueError(f"the product has no year {year}: {min(years)} to {max(years)}")
    return template.format(tile=tile, year=year)


def product_paths(wanted: DataFrame, template: str, years: tuple[int, ...]) -> DataFrame:
    """``wanted`` (tile, year) with the ``path`` of each raster, as :func:`product_path` gives it; fails on a year that the product lacks."""
    known = F.when(F.col("year").isin(*years), F.col("year")).otherwise(F.raise_error(F.concat(F.lit("the product has no year "), F.col("year").cast("string"))).cast("int"))
    path = F.replace(F.replace(F.lit(template), F.lit("{tile}"), F.col("tile")), F.lit("{year}"), known.cast("string"))
    return wanted.withColumn("path", path)


def stale(cached: DataFrame, wanted: DataFrame) -> DataFrame:
    """(region) of those whose cached pixels don't cover the wanted grid (region, h, w) exactly."""
    have = cached.groupBy("region").agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"), F.count_distinct("r", "c").alias("n"))
    same = wanted.join(have.where("n = h * w").drop("n"), ["region", "h", "w"], "left_semi")
    return wanted.select("region").join(same.select("region"), "region", "left_anti")
