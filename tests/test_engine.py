"""The whole engine on drawn grids, reports, streaming and geometry."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from terrachron.functions import geo
from terrachron.functions.dims import BBox, Params, Region
from terrachron.operators import blocks, validation
from terrachron.plans import catalogue
from terrachron.plans.engine import LandHistory
from terrachron.plans.report import benchmark_table, story, summaries
from terrachron.sources import observations as source
from terrachron.streaming.appends import follow

SF = "/root/testdata/sf0.001"


def grid(spark, n, changed):
    rows = [(0, r, c, 2017 + y, 7 if changed and c >= n // 2 and y >= 3 else 2) for r in range(n) for c in range(n) for y in range(7)]
    return spark.createDataFrame(rows, "region int, r int, c int, year int, src int")


def test_changing_region(spark):
    e = LandHistory(grid(spark, 20, True), Params(block_px=5)).persisted()
    text = summaries(e).first().summary
    s = json.loads(text)
    assert s["change"]["event_fraction"] == 0.5 and s["peak_change_period"] == [2019, 2020]
    assert s["hotspots"][0]["dominant_to"] == "built" and "vegetation → built" in story(text)
    row = e.benchmark().first().asDict()
    assert row["raw_fraction"] == 0.5 and "| 0 |" in benchmark_table([row])
    e.release()


def test_stable_region(spark):
    e = LandHistory(grid(spark, 8, False), Params(block_px=4)).persisted()
    text = summaries(e).first().summary
    assert "No persistent change" in story(text) and "hotspots" not in json.loads(text)
    assert e.volumes.count() == 0 and blocks.clusters(e.features, Params()).select("label").distinct().count() == 1
    e.release()


def test_clusters_separate_halves(spark):
    e = LandHistory(grid(spark, 24, True), Params(block_px=4, k_min=2, k_max=3))
    got = {(r.br, r.bc): r.label for r in blocks.clusters(e.features, e.params).collect()}
    assert len({got[b, c] for b in range(6) for c in range(3)}) == 1 and got[0, 0] != got[0, 5]


def test_misaligned_years_are_refused(spark):
    obs = grid(spark, 4, False).where("NOT (year = 2019 AND r = 3)")
    with pytest.raises(ValueError):
        source.require_aligned(obs)


def test_stream_recomputes_touched_regions(spark, tmp_path):
    obs = grid(spark, 6, True)
    d = {k: str(tmp_path / k) for k in ("landing", "obs", "out", "cp")}
    for part, name in ((obs.where("year < 2022"), "a"), (obs.where("year >= 2022"), "b")):
        part.coalesce(1).write.mode("append").parquet(d["landing"])
        follow(spark, d["landing"], d["obs"], d["out"], d["cp"]).awaitTermination()
    got = spark.read.parquet(d["out"])
    assert got.count() == 36 and got.where("year_of_change = 2020").count() == 18


def test_write_and_cli(spark, tmp_path):
    from terrachron.cli import main

    grid(spark, 6, True).write.parquet(str(tmp_path / "obs"))
    for _ in range(2):
        assert main(["benchmark", str(tmp_path / "obs"), str(tmp_path / "out")]) == 0
    assert json.loads((tmp_path / "out" / "benchmark.json").read_text())[0]["event_fraction"] == 0.5


def test_tiles(spark):
    df = spark.createDataFrame([(77.68, 13.22), (-180.0, -80.0), (180.0, 84.0), (-63.25, -9.3)], "lon double, lat double")
    assert [r[0] for r in df.select(geo.tile_id(F.col("lon"), F.col("lat"))).collect()] == ["43P", "01C", "60X", "20L"]
    box = spark.createDataFrame([(77.9, 13.0, 78.1, 13.2), (10.0, 15.9, 10.1, 16.1)], "west double, south double, east double, north double")
    assert sorted(r.tile for r in geo.tiles_for_bbox(box).collect()) == ["32P", "32Q", "43P", "44P"]
    with pytest.raises(Exception, match="several tiles"):
        geo.single_tile(box).collect()
    with pytest.raises(Exception, match="out of range"):
        spark.range(1).select(geo.utm_zone(F.lit(181.0))).collect()


def test_utm_round_trip(spark):
    got = catalogue.queries()["utm_round_trip"](spark, SF).join(catalogue.points(spark, SF).toDF("id", "lon0", "lat0"), "id").where("abs(lon - lon0) > 1e-5 OR abs(lat - lat0) > 1e-5").count()
    assert got == 0


def test_config_validation():
    with pytest.raises(ValueError):
        BBox(10, 0, 5, 1)
    with pytest.raises(ValueError):
        Params(weights=(0.5, 0.5, 0.5, 0.5))
    with pytest.raises(ValueError):
        Region("a", BBox(0, 0, 1, 1), (2020, 2019))
    assert geo.aoi_name(1, 2, 3, 4, (2017, 2018)) == geo.aoi_name(1, 2, 3, 4, (2017, 2018)) != geo.aoi_name(1, 2, 3, 5, (2017, 2018))


FAST = ["fraction_trends", "transition_matrix", "change_events", "archetypes", "rare_signatures", "confidence_tiers", "hotspots", "block_features", "holdout_rates", "mosaic_first_nonzero", "tiles_for_bbox", "utm_round_trip", "projected_boxes", "hotspot_places", "tier_percentages", "stale_regions", "product_paths", "single_tile", "aoi_names", "first_evidence"]


@pytest.mark.parametrize("name", FAST)
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "part", "customer", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalogue.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({catalogue.oracle_sql()[name]})").fetchall()
    near = lambda rows: sorted(str([round(float(v), 9) if isinstance(v, (int, float)) else v for v in r]) for r in rows)
    assert near(df.select(*cols).collect()) == near(want)


def test_state_filter_reaches_the_scan(spark, tmp_path):
    grid(spark, 4, False).write.parquet(str(tmp_path / "o"))
    from terrachron.functions.pixel import state_is

    df = spark.read.parquet(str(tmp_path / "o")).where(state_is(F.col("src"), 2)).select("r")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(src" in plan and "year" not in plan.split("ReadSchema")[1]


def test_names_and_paths_as_expressions(spark):
    row = spark.range(1).select(geo.aoi_names(*map(F.lit, (1.0, 2.0, 3.0, 4.0)), (2017, 2018)).alias("name")).first()
    assert row.name == geo.aoi_name(1, 2, 3, 4, (2017, 2018))
    tiles = spark.createDataFrame([("33N", 2017), ("33N", 2016)], "tile string, year int")
    paths = source.product_paths(tiles.where("year = 2017"), "a/{tile}/{year}", (2017,))
    assert paths.first().path == source.product_path("a/{tile}/{year}", "33N", 2017, (2017,)) == "a/33N/2017"
    with pytest.raises(Exception, match="no year 2016"):
        source.product_paths(tiles, "a/{tile}/{year}", (2017,)).collect()
    with pytest.raises(Exception, match="several tiles"):
        geo.single_tile(spark.createDataFrame([(0.0, 1.0, 13.0, 2.0)], "west double, south double, east double, north double")).collect()


def test_benchmark_reports_missing_regions(spark, tmp_path):
    from terrachron.cli import main

    grid(spark, 8, True).write.parquet(str(tmp_path / "o"))
    args = ["benchmark", str(tmp_path / "o"), str(tmp_path / "out"), "--block-px", "4", "--region"]
    assert main([*args, "0"]) == 0
    assert main([*args, "0", "--region", "7"]) == 1
    assert json.loads((tmp_path / "out" / "benchmark.json").read_text())[0]["region"] == 0


def test_summary_names_grid_and_parameters(spark):
    s = json.loads(summaries(LandHistory(grid(spark, 8, True), Params(block_px=4))).first().summary)
    assert s["grid"] == {"height": 8, "width": 8} and s["params"]["block_px"] == 4
    assert s["raw_change_fraction"] == s["changed_fraction"] == 0.5 and s["stable_fraction"] == 0.5


def test_quartiles_between_scores_that_differ_in_the_last_bit(spark):
    low, high = 0.9249999999999999, 0.925
    rows = [(k, x) for k, counts in enumerate(((0, 1, 1), (0, 3, 1), (1, 5, 2), (2, 7, 3), (4, 0, 0))) for x, n in zip((0.1, low, high), counts) for _ in range(n)] + [(5, 0.3)]
    df = spark.createDataFrame(rows, "region int, score double")
    got = {r.region: tuple(r)[1:] for r in validation.quartiles(df).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t (region INT, score DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    want = con.execute("SELECT region, count(*), quantile_cont(score, 0.25), quantile_cont(score, 0.5), quantile_cont(score, 0.75) FROM t GROUP BY 1").fetchall()
    assert got == {r[0]: r[1:] for r in want}
    bins = validation.binned(df, validation.quartiles(df), 1).groupBy("region", "bin").count().collect()
    assert {(r.region, r.bin, r["count"]) for r in bins} == set(con.execute("SELECT region, CASE WHEN score <= q1 THEN 1 WHEN score <= q2 THEN 2 WHEN score <= q3 THEN 3 ELSE 4 END b, count(*) FROM t JOIN (SELECT region, quantile_cont(score, 0.25) q1, quantile_cont(score, 0.5) q2, quantile_cont(score, 0.75) q3 FROM t GROUP BY 1) USING (region) GROUP BY 1, 2").fetchall())


def test_holdout_bins_between_scores_that_differ_in_the_last_bit(spark):
    low, high = 0.9249999999999999, 0.925
    rows = [(0, x, True, 4, s) for x, s, n in ((low, 4, 4), (low, 2, 2), (high, 4, 1), (high, 2, 1)) for _ in range(n)] + [(0, 0.0, False, 0, 2)]
    got = validation.holdout(spark.createDataFrame(rows, "region int, score double, event boolean, to_state int, s5 int"), ["s5"], 1)
    # the third quartile lies a quarter of the way from low to high, which rounds to low
    assert sorted(map(tuple, got.collect())) == [(0, 0, 8, 0.625), (0, 1, 6, 4 / 6), (0, 4, 2, 0.5)]


def test_quartiles_round_as_in_sql(spark):
    pairs = [(0.8500000000000001, 0.865), (0.7000000000000001, 0.7058333333333333), (0.8049999999999999, 0.8089285714285714), (0.2, 0.9), (0.1, 0.30000000000000004), (0.3, 0.3)]
    rows = [(4 * i + n, x) for i, p in enumerate(pairs) for n in range(4) for x in (*p, *[1.0] * n)]
    got = {r.region: tuple(r)[1:] for r in validation.quartiles(spark.createDataFrame(rows, "region int, score double")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t (region INT, score DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    assert got == {r[0]: r[1:] for r in con.execute("SELECT region, count(*), quantile_cont(score, 0.25), quantile_cont(score, 0.5), quantile_cont(score, 0.75) FROM t GROUP BY 1").fetchall()}
