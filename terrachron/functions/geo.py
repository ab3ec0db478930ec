"""Grid and tile geometry as column expressions."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Latitude bands from 80 degrees south.
BANDS = "CDEFGHJKLMNPQRSTUVWX"
# WGS84 ellipsoid and UTM scale.
A, FLAT, K0 = 6378137.0, 1 / 298.257223563, 0.9996
# Length of a degree, limits of an area and of an overlay, and the pattern of names.
KM_PER_DEGREE = 111.32
MAX_AREA_KM2 = 1500.0
MAX_OVERLAY_PX = 1600
NAME = r"^[a-z0-9_\-]{1,64}$"


def utm_zone(lon: Column) -> Column:
    zone = F.least(F.floor((lon + 180) / 6).cast("int") + 1, F.lit(60))
    return F.when((lon < -180) | (lon > 180), F.raise_error(F.concat(F.lit("longitude out of range: "), lon.cast("string"))).cast("int")).otherwise(zone)


def lat_band(lat: Column) -> Column:
    letter = F.substring(F.lit(BANDS), F.least(F.floor((lat + 80) / 8).cast("int"), F.lit(19)) + 1, F.lit(1))
    return F.when((lat < -80) | (lat > 84), F.raise_error(F.concat(F.lit("latitude out of range: "), lat.cast("string")))).otherwise(letter)


def tile_id(lon: Column, lat: Column) -> Column:
    return F.concat(F.lpad(utm_zone(lon).cast("string"), 2, "0"), lat_band(lat))


def band_south(letter: Column) -> Column:
    return -80 + 8 * (F.position(letter, F.lit(BANDS)) - 1)


def band_north(letter: Column) -> Column:
    return F.when(letter == "X", 84).otherwise(band_south(letter) + 8)


def zone_west(zone: Column) -> Column:
    return -180 + 6 * (zone - 1)


def tiles_for_bbox(boxes: DataFrame) -> DataFrame:
    """A row for each tile that a box (west, south, east, north) meets: bands from the south, then zones from the west (``seq``)."""
    band = lambda lat: F.least(F.floor((lat + 80) / 8).cast("int"), F.lit(19))
    b = boxes.withColumns({"_b0": band(F.col("south")), "_b1": band(F.col("north")), "_z0": utm_zone(F.col("west")), "_z1": utm_zone(F.col("east"))})
    b = b.withColumn("_band", F.explode(F.sequence("_b0", "_b1"))).withColumn("_zone", F.explode(F.sequence("_z0", "_z1")))
    tile = F.concat(F.lpad(F.col("_zone").cast("string"), 2, "0"), F.substring(F.lit(BANDS), F.col("_band") + 1, F.lit(1)))
    seq = (F.col("_band") - F.col("_b0")) * (F.col("_z1") - F.col("_z0") + 1) + F.col("_zone") - F.col("_z0")
    return b.withColumns({"tile": tile, "seq": seq}).drop("_b0", "_b1", "_z0", "_z1", "_band", "_zone")


def single_tile(boxes: DataFrame) -> DataFrame:
    """The tile of each box; fails if a box meets several."""
    per = tiles_for_bbox(boxes).groupBy(*boxes.columns).agg(F.min("tile").alias("tile"), F.count("*").alias("n"))
    return per.withColumn("tile", F.when(F.col("n") > 1, F.raise_error(F.lit("the box meets several tiles"))).otherwise(F.col("tile"))).drop("n")


def degree_tiles(boxes: DataFrame, step: int = 3) -> DataFrame:
    """Names of the ``step`` degree tiles, after their south-west corners, that a box meets."""
    start = lambda x: (F.floor(x / step) * step).cast("int")
    end = lambda x: (F.ceil(x / step) * step - step).cast("int")
    b = boxes.withColumn("lat_sw", F.explode(F.sequence(start(F.col("south")), F.greatest(end(F.col("north")), start(F.col("south"))), F.lit(step))))
    b = b.withColumn("lon_sw", F.explode(F.sequence(start(F.col("west")), F.greatest(end(F.col("east")), start(F.col("west"))), F.lit(step))))
    half = lambda c, plus, minus, n: F.concat(F.when(c >= 0, plus).otherwise(minus), F.lpad(F.abs(c).cast("string"), n, "0"))
    return b.withColumn("tile", F.concat(half(F.col("lat_sw"), "N", "S", 2), half(F.col("lon_sw"), "E", "W", 3)))


def clipped(boxes: DataFrame, margin: float = 0.003) -> DataFrame:
    """Boxes with their tile's bounds (t_west, ...) cut to these plus a margin; without those that don't meet them."""
    out = boxes.select(
        *(c for c in boxes.columns if c not in ("west", "south", "east", "north", "t_west", "t_south", "t_east", "t_north")),
        F.greatest(F.col("west"), F.col("t_west") - margin).alias("west"), F.greatest(F.col("south"), F.col("t_south") - margin).alias("south"),
        F.least(F.col("east"), F.col("t_east") + margin).alias("east"), F.least(F.col("north"), F.col("t_north") + margin).alias("north"),
    )
    return out.where("west < east AND south < north")


def epsg(lon: Column, lat: Column) -> Column:
    return F.when(lat >= 0, 32600).otherwise(32700) + utm_zone(lon)


def area_km2(west: Column, south: Column, east: Column, north: Column) -> Column:
    return (east - west) * (north - south) * F.lit(KM_PER_DEGREE * KM_PER_DEGREE) * F.cos(F.radians((south + north) / 2))


def grid_area_km2(h: Column, w: Column) -> Column:
    return h * w * 100 / 1e6


def to_utm(lon: Column, lat: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing in metres, by the usual series."""
    e2 = FLAT * (2 - FLAT)
    ep2 = e2 / (1 - e2)
    phi, dl = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    n = A / F.sqrt(1 - e2 * F.sin(phi) ** 2)
    t, c, a = F.tan(phi) ** 2, ep2 * F.cos(phi) ** 2, F.cos(phi) * dl
    m = A * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi) + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi) - (35 * e2**3 / 3072) * F.sin(6 * phi))
    x = K0 * n * (a + (1 - t + c) * a**3 / 6 + (5 - 18 * t + t**2 + 72 * c - 58 * ep2) * a**5 / 120) + 500000
    y = K0 * (m + n * F.tan(phi) * (a**2 / 2 + (5 - t + 9 * c + 4 * c**2) * a**4 / 24 + (61 - 58 * t + t**2 + 600 * c - 330 * ep2) * a**6 / 720))
    return x, y + F.when(lat < 0, 10_000_000.0).otherwise(0.0)


def from_utm(x: Column, y: Column, zone: Column, north: Column) -> tuple[Column, Column]:
    """Longitude and latitude of an easting and northing, by the usual series."""
    e2 = FLAT * (2 - FLAT)
    ep2 = e2 / (1 - e2)
    m = (y - F.when(north, 0.0).otherwise(10_000_000.0)) / K0
    mu = m / (A * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
    e1 = (1 - (1 - e2) ** 0.5) / (1 + (1 - e2) ** 0.5)
    p1 = mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu) + (151 * e1**3 / 96) * F.sin(6 * mu) + (1097 * e1**4 / 512) * F.sin(8 * mu)
    c1, t1 = ep2 * F.cos(p1) ** 2, F.tan(p1) ** 2
    n1, r1 = A / F.sqrt(1 - e2 * F.sin(p1) ** 2), A * (1 - e2) / F.pow(1 - e2 * F.sin(p1) ** 2, F.lit(1.5))
    d = (x - 500000) / (n1 * K0)
    lat = p1 - (n1 * F.tan(p1) / r1) * (d**2 / 2 - (5 + 3 * t1 + 10 * c1 - 4 * c1**2 - 9 * ep2) * d**4 / 24 + (61 + 90 * t1 + 298 * c1 + 45 * t1**2 - 252 * ep2 - 3 * c1**2) * d**6 / 720)
    lon = (d - (1 + 2 * t1 + c1) * d**3 / 6 + (5 - 2 * c1 + 28 * t1 - 3 * c1**2 + 8 * ep2 + 24 * t1**2) * d**5 / 120) / F.cos(p1)
    return F.degrees(lon) + (zone * 6 - 183), F.degrees(lat)


def target_grid(boxes: DataFrame, res: float = 10.0) -> DataFrame:
    """x0, y1, width and height of projected boxes (x0, y0, x1, y1), snapped outwards to the lattice of ``res`` metres."""
    down = lambda c: F.floor(F.col(c) / res) * res
    up = lambda c: F.ceil(F.col(c) / res) * res
    keep = [c for c in boxes.columns if c not in ("x0", "y0", "x1", "y1")]
    return boxes.select(*keep, down("x0").cast("double").alias("x0"), up("y1").cast("double").alias("y1"), F.round((up("x1") - down("x0")) / res).cast("int").alias("width"), F.round((up("y1") - down("y0")) / res).cast("int").alias("height"))


def utm_box(boxes: DataFrame) -> DataFrame:
    """Projected bounds (x0, y0, x1, y1, zone) of boxes in the zone of their centre: the extremes of corners and sides' middles."""
    mid = lambda a, b: (F.col(a) + F.col(b)) / 2
    zone = utm_zone(mid("west", "east"))
    lons, lats = (F.col("west"), mid("west", "east"), F.col("east")), (F.col("south"), mid("south", "north"), F.col("north"))
    at = [to_utm(x, y, zone) for i, x in enumerate(lons) for j, y in enumerate(lats) if (i, j) != (1, 1)]
    xs, ys = zip(*at)
    keep = [F.col(c) for c in boxes.columns if c not in ("west", "south", "east", "north")]
    return boxes.select(*keep, zone.alias("zone"), F.least(*xs).alias("x0"), F.least(*ys).alias("y0"), F.greatest(*xs).alias("x1"), F.greatest(*ys).alias("y1"))


def overlay_grid(h: Column, w: Column, most: int = MAX_OVERLAY_PX) -> tuple[Column, Column]:
    """Height and width of an overlay: at most ``most`` pixels, in proportion, halves rounded to even."""
    scale = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(h, w))
    return tuple(F.greatest(F.bround(x * scale).cast("int"), F.lit(1)) for x in (h, w))


def hex_rgb(colour: Column) -> Column:
    part = lambda k: F.conv(F.substring(F.ltrim(colour, F.lit("#")), F.lit(k), F.lit(2)), 16, 10).cast("int")
    return F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b"))


def box_name(west: Column, south: Column, east: Column, north: Column) -> Column:
    return F.concat(F.lit("bbox_"), F.translate(F.format_string("%.3f_%.3f_%.3f_%.3f", west, south, east, north), "-.", "mp"))


def display_name(lon: Column, lat: Column) -> Column:
    return F.format_string("AOI %.3f°%s %.3f°%s", F.abs(lat), F.when(lat >= 0, "N").otherwise("S"), F.abs(lon), F.when(lon >= 0, "E").otherwise("W"))


def aoi_name(west: float, south: float, east: float, north: float, years: tuple[int, ...]) -> str:
    """A name that is the same for the same box and years."""
    return "aoi_" + uuid.uuid5(uuid.NAMESPACE_URL, f"{west:.4f},{south:.4f},{east:.4f},{north:.4f},{years}").hex[:10]


def aoi_names(west: Column, south: Column, east: Column, north: Column, years: tuple[int, ...]) -> Column:
    """``aoi_name`` as an expression: its digits come before those that a UUID's version replaces."""
    name = F.format_string(f"%.4f,%.4f,%.4f,%.4f,{years}", west, south, east, north)
    return F.concat(F.lit("aoi_"), F.substring(F.sha1(F.concat(F.unhex(F.lit(uuid.NAMESPACE_URL.hex)), F.encode(name, "UTF-8"))), 1, 10))


def fingerprint(values: dict) -> str:
    return hashlib.sha256(json.dumps(values, sort_keys=True).encode()).hexdigest()[:16]
