"""Raster layers as GeoTIFF and overlays as PNG, encoded in tiles of a fixed size where the pixels are."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrachron.functions.dims import STATE_COLOURS, STATES
from terrachron.operators.history import KEY

#: Rows and columns of a tile; a task holds one tile of all layers at a time.
TILE = 512
YEAR_COLOURS = ("#440154", "#443a83", "#31688e", "#20908d", "#35b779", "#8fd744", "#fde725")
TIER_COLOURS = ("#c7c7c7", "#f4a259", "#2a9d8f")
ANOMALY_COLOURS = ("#e6007e",)
# TIFF tags and field types.
TIFF_TYPES = {"ascii": (2, "c"), "short": (3, "H"), "long": (4, "I"), "double": (12, "d")}
NODATA = 42113
PIXEL_SCALE, TIE_POINT, GEO_KEYS = 33550, 33922, 34735


def tiff(values: np.ndarray, place: tuple[float, float, float, int] | None = None) -> bytes:
    """One band of unsigned integers as a deflated TIFF with 0 as nodata; ``place`` is (left, top, resolution, EPSG code)."""
    h, w = values.shape
    data = zlib.compress(values.astype(values.dtype.newbyteorder("<")).tobytes())
    data += b"\0" * (len(data) % 2)
    tags: list[tuple[int, str, list]] = [
        (256, "long", [w]), (257, "long", [h]), (258, "short", [8 * values.itemsize]), (259, "short", [8]), (262, "short", [1]), (273, "long", [8]),
        (277, "short", [1]), (278, "long", [h]), (279, "long", [len(data)]), (339, "short", [1]),
    ]
    if place:
        left, top, res, code = place
        tags += [(PIXEL_SCALE, "double", [res, res, 0.0]), (TIE_POINT, "double", [0.0, 0.0, 0.0, left, top, 0.0]), (GEO_KEYS, "short", [1, 1, 0, 3, 1024, 0, 1, 1, 1025, 0, 1, 1, 3072, 0, 1, code])]
    tags.append((NODATA, "ascii", [b"0", b"\0"]))
    at = 8 + len(data)
    after = at + 2 + 12 * len(tags) + 4
    entries, extra = b"", b""
    for tag, kind, v in tags:
        number, code_of = TIFF_TYPES[kind]
        raw = struct.pack(f"<{len(v)}{code_of}", *v)
        if len(raw) > 4:
            field, extra = struct.pack("<I", after + len(extra)), extra + raw
        else:
            field = raw.ljust(4, b"\0")
        entries += struct.pack("<HHI", tag, number, len(v)) + field
    return struct.pack("<2sHI", b"II", 42, at) + data + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0) + extra


def read_tiff(blob: bytes) -> tuple[np.ndarray, dict[int, tuple]]:
    """The band of a file that ``tiff`` made, and its tags."""
    at = struct.unpack_from("<I", blob, 4)[0]
    kinds = {number: code for number, code in TIFF_TYPES.values()}
    tags = {}
    for k in range(struct.unpack_from("<H", blob, at)[0]):
        tag, number, n = struct.unpack_from("<HHI", blob, at + 2 + 12 * k)
        form, where = f"<{n}{kinds[number]}", at + 10 + 12 * k
        tags[tag] = struct.unpack_from(form, blob, where if struct.calcsize(form) <= 4 else struct.unpack_from("<I", blob, where)[0])
    raw = zlib.decompress(blob[tags[273][0] : tags[273][0] + tags[279][0]])
    return np.frombuffer(raw, f"<u{tags[258][0] // 8}").reshape(tags[257][0], tags[256][0]), tags


def png(index: np.ndarray, colours: tuple[str, ...]) -> bytes:
    """An image of palette positions: 0 is transparent, k is the k-th colour."""
    h, w = index.shape
    rows = np.zeros((h, w + 1), np.uint8)
    rows[:, 1:] = index
    part = lambda name, raw: struct.pack(">I", len(raw)) + name + raw + struct.pack(">I", zlib.crc32(name + raw))
    palette = b"\0\0\0" + b"".join(bytes.fromhex(c.lstrip("#")) for c in colours)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 3, 0, 0, 0)) + part(b"PLTE", palette) + part(b"tRNS", b"\0") + part(b"IDAT", zlib.compress(rows.tobytes())) + part(b"IEND", b"")


def _tiles(layered: DataFrame, size: int, encode: Callable[[str, np.ndarray, dict], bytes], places: DataFrame | None = None) -> DataFrame:
    """(region, tr, tc, layer, height, width, image): one shuffle by tile, which bounds a group to ``size`` squared rows."""
    names = [c for c in layered.columns if c not in KEY]
    at = lambda c: F.floor(F.col(c) / size).cast("int")
    keyed = layered.select("region", at("r").alias("tr"), at("c").alias("tc"), (F.col("r") % size).cast("int").alias("i"), (F.col("c") % size).cast("int").alias("j"), *names)
    if places is not None:
        keyed = keyed.join(places.select("region", "left", "top", "res", "epsg"), "region", "left")

    def run(t: pa.Table) -> pa.Table:
        i, j = (t.column(c).to_numpy() for c in "ij")
        one = t.slice(0, 1).select([c for c in t.column_names if c not in names]).to_pylist()[0]
        out = []
        for name in names:
            grid = np.zeros((i.max() + 1, j.max() + 1), np.int64)
            grid[i, j] = t.column(name).fill_null(0).to_numpy()
            out.append((name, *grid.shape, encode(name, grid, one)))
        n = len(names)
        layer, height, width, image = zip(*out)
        of = [pa.array([one[c]] * n, t.schema.field(c).type) for c in ("region", "tr", "tc")]
        return pa.table([*of, pa.array(layer), pa.array(height, pa.int32()), pa.array(width, pa.int32()), pa.array(image, pa.binary())], ["region", "tr", "tc", "layer", "height", "width", "image"])

    schema = T.StructType([layered.schema["region"], *T.StructType.fromDDL("tr int, tc int, layer string, height int, width int, image binary").fields])
    return keyed.groupBy("region", "tr", "tc").applyInArrow(run, schema)


def raster_tiles(layered: DataFrame, size: int = TILE, places: DataFrame | None = None) -> DataFrame:
    """GeoTIFF tiles of each layer of ``layered`` (region, r, c, layers of small integers).

    ``places`` (region, left, top, res, epsg) puts them on the map. Years are 16 bits wide, the rest 8; a tile ends
    where its pixels end, and pixels without a row are nodata.
    """

    def encode(name: str, grid: np.ndarray, one: dict) -> bytes:
        place = None
        if one.get("epsg") is not None:
            place = (one["left"] + one["tc"] * size * one["res"], one["top"] - one["tr"] * size * one["res"], one["res"], one["epsg"])
        return tiff(grid.astype(np.uint16 if name == "year_of_change" else np.uint8), place)

    return _tiles(layered, size, encode, places)


def overlays(pixels: DataFrame, years: list[int]) -> tuple[DataFrame, dict[str, dict[str, str]]]:
    """(region, r, c, a palette position for each overlay) and the legends, label to colour, in the order of the positions."""
    state = {STATES[k]: c for k, c in STATE_COLOURS.items()}
    when = {str(y): YEAR_COLOURS[round((y - years[0]) * (len(YEAR_COLOURS) - 1) / max(1, years[-1] - years[0]))] for y in years}
    legends = {f"states_{y}": state for y in years} | {"change": state, "year_of_change": when, "confidence": dict(zip(("low", "medium", "high"), TIER_COLOURS)), "anomalies": {"rare history": ANOMALY_COLOURS[0]}}
    event = F.col("event")
    position = F.when(event, F.array_position(F.array(*map(F.lit, years)), F.col("yoc")).cast("int")).otherwise(0)
    columns = [F.col(f"s{k}").alias(f"states_{y}") for k, y in enumerate(years)]
    columns += [F.when(event, F.col("to_state")).otherwise(0).alias("change"), position.alias("year_of_change"), F.col("tier").alias("confidence"), F.col("anomaly").cast("int").alias("anomalies")]
    return pixels.select(*KEY, *columns), legends


def overlay_tiles(pixels: DataFrame, years: list[int], size: int = TILE) -> DataFrame:
    """PNG tiles of all overlays."""
    layered, legends = overlays(pixels, years)
    return _tiles(layered, size, lambda name, grid, _: png(grid.astype(np.uint8), tuple(legends[name].values())))


def tile_totals(tiles: DataFrame) -> DataFrame:
    """(region, tr, tc, layer, height, width, total): the sum of each GeoTIFF's values, read back from the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total = pa.array([int(read_tiff(x.as_py())[0].sum(dtype=np.int64)) for x in b.column("image")], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names if c != "image"), total], [*(c for c in b.schema.names if c != "image"), "total"])

    return tiles.mapInArrow(run, T.StructType([*(f for f in tiles.schema.fields if f.name != "image"), T.StructField("total", T.LongType())]))
