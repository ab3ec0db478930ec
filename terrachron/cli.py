"""Command line: run, benchmark and validate over observation tables in Parquet, and serve their bundles."""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrachron.functions.dims import Params, load_region
from terrachron.functions.geo import fingerprint
from terrachron.plans.engine import LandHistory, layers, tuned
from terrachron.plans.report import benchmark_table, evidences, story, summaries, validation_text, validations
from terrachron.sinks.bundles import Bundles
from terrachron.sinks.images import overlay_tiles, overlays, raster_tiles


def observed(spark: SparkSession, path: str, regions: list[str] | None = None, years: list[int] | None = None) -> DataFrame:
    """An observation table; regions and years reach the scan."""
    out = spark.read.parquet(path)
    if regions:
        out = out.where(F.col("region").isin(*[r if dict(out.dtypes)["region"] == "string" else int(r) for r in regions]))
    return out.where(F.col("year").isin(*years)) if years else out


def data_mark(df: DataFrame) -> str:
    """Files, sizes and times of what ``df`` reads, so that new observations are seen; no column is read."""
    files = df.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    r = files.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*files.columns).cast("decimal(38,0)")).alias("s")).first()
    return f"{r.n}:{r.s}"


def run(engine: LandHistory, bundles: Bundles, images: bool = False, scenes: DataFrame | None = None) -> None:
    """Pixel facts as Parquet, and a bundle for each region; rows come to the driver one region or tile at a time.

    Bundles are whole without evidence, so scenes that can't be read are only reported.
    """
    kept = engine.persisted()
    kept.write(str(bundles.root / "tables"))
    for region, text in summaries(kept).toLocalIterator():
        bundles.write(region, "summary.json", text)
        bundles.write(region, "summary.md", story(text))
        if images:
            bundles.write(region, "overlays/overlays.json", json.dumps({"layers": overlays(kept.pixels, kept.years)[1]}, indent=2))
    if images:
        bundles.write_tiles(raster_tiles(layers(kept.pixels)).toLocalIterator(), "rasters", "tif")
        bundles.write_tiles(overlay_tiles(kept.pixels, kept.years).toLocalIterator(), "overlays", "png")
    if scenes is not None:
        try:
            for region, text in evidences(kept, scenes).toLocalIterator():
                bundles.write(region, "evidence/evidence.json", text)
        except PySparkException as e:
            logging.getLogger(__name__).warning("no evidence: %s", e)
    kept.release()


def validate(engine: LandHistory, bundles: Bundles, second: DataFrame | None = None) -> None:
    for region, text in validations(engine, second).toLocalIterator():
        bundles.write(region, "validation.json", text)
        bundles.write(region, "validation.md", validation_text(text))


def benchmark(engine: LandHistory, bundles: Bundles, asked: list[str]) -> list[str]:
    """One row for each region, all of them in one job; returns the ``asked`` regions that have none."""
    rows = [r.asDict() for r in engine.benchmark().orderBy("region").toLocalIterator()]
    bundles.root.mkdir(parents=True, exist_ok=True)
    (bundles.root / "benchmark.json").write_text(json.dumps(rows, indent=2))
    (bundles.root / "benchmark.md").write_text(benchmark_table(rows))
    return sorted(set(asked) - {str(r["region"]) for r in rows})


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="terrachron")
    ap.add_argument("command", choices=["run", "benchmark", "validate", "serve"])
    ap.add_argument("observations", help="Parquet with region, r, c, year, src")
    ap.add_argument("output", help="folder of the bundles")
    ap.add_argument("--region", action="append", help="only these regions, by name or by YAML file, whose years are used too")
    ap.add_argument("--years", type=int, nargs="+", help="only these years")
    ap.add_argument("--second", help="Parquet of a second product, to validate against")
    ap.add_argument("--scenes", help="Parquet of scenes (scene_id, day, cloud), for evidence")
    ap.add_argument("--images", action="store_true", help="write GeoTIFF and PNG tiles too")
    ap.add_argument("--block-px", type=int, default=25)
    ap.add_argument("--port", type=int, default=8000)
    ap.add_argument("--prewarm", nargs="+", default=[], help="regions to analyse when the service starts without bundles")
    ap.add_argument("--force", action="store_true")
    a = ap.parse_args(argv)
    files = [load_region(r) for r in a.region or [] if r.endswith((".yaml", ".yml"))]
    regions = [r for r in a.region or [] if not r.endswith((".yaml", ".yml"))] + [f.name for f in files]
    years = a.years or sorted({y for f in files for y in f.years}) or None
    spark = tuned(SparkSession.builder.appName("terrachron").getOrCreate())
    bundles, params = Bundles(a.output), Params(block_px=a.block_px)
    scenes = spark.read.parquet(a.scenes) if a.scenes else None
    if a.command == "serve":
        from terrachron.service import Service, serve

        def analyse(region: str, years: list[int] | None) -> None:
            engine = LandHistory(observed(spark, a.observations, [region], years), params)
            if not engine.years:
                raise ValueError(f"no observations of region {region}")
            run(engine, bundles, a.images, scenes)

        service = Service(bundles, analyse)
        service.prewarm(a.prewarm)
        serve(service, a.port)
        return 0
    engine = LandHistory(observed(spark, a.observations, regions, years), params)
    mark = fingerprint({"command": a.command, "input": a.observations, "regions": regions, "second": a.second, "scenes": a.scenes, "images": a.images, "data": [data_mark(spark.read.parquet(x)) for x in (a.observations, a.second, a.scenes) if x], "years": engine.years, "params": repr(engine.params)})
    seen = Path(a.output) / f"{a.command}.fingerprint"
    if not a.force and seen.exists() and seen.read_text() == mark:
        return 0
    if a.command == "run":
        run(engine, bundles, a.images, scenes)
    elif a.command == "benchmark":
        if missing := benchmark(engine, bundles, regions):
            logging.getLogger(__name__).error("no observations of regions %s", ", ".join(missing))
            return 1
    else:
        validate(engine, bundles, observed(spark, a.second, regions) if a.second else None)
    seen.parent.mkdir(parents=True, exist_ok=True)
    seen.write_text(mark)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
