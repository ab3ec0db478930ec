"""Images, bundles, the command line's files and the HTTP service."""

import json
import threading
import time
import urllib.error
import urllib.request
import zlib

import numpy as np
import pytest

from terrachron.cli import main, run
from terrachron.functions.dims import Params
from terrachron.plans.engine import LandHistory, layers
from terrachron.plans.report import validation_text, validations
from terrachron.service import Places, Service, server
from terrachron.sinks.bundles import Bundles, Refused
from terrachron.sinks.images import GEO_KEYS, NODATA, PIXEL_SCALE, TIE_POINT, overlay_tiles, png, raster_tiles, read_tiff, tiff


def grid(spark, n, region=0, second=False):
    code = lambda c, y: (50 if second else 7) if c >= n // 2 and y >= 3 else (30 if second else 2)
    rows = [(region, r, c, 2017 + y, code(c, y)) for r in range(n) for c in range(n) for y in range(7) if not second or y in (3, 4)]
    return spark.createDataFrame(rows, "region int, r int, c int, year int, src int")


def test_tiff_round_trip():
    for kind, place in ((np.uint8, None), (np.uint16, (500000.0, 4000000.0, 10.0, 32643))):
        a = np.arange(35, dtype=kind).reshape(5, 7) * 6
        got, tags = read_tiff(tiff(a, place))
        assert (got == a).all() and got.dtype == kind and tags[NODATA] == (b"0", b"\0")
        assert (PIXEL_SCALE in tags) == (place is not None)
    assert tags[PIXEL_SCALE] == (10, 10, 0) and tags[TIE_POINT][3:5] == (500000, 4000000) and tags[GEO_KEYS][-1] == 32643
    assert read_tiff(tiff(np.zeros((1, 1), np.uint8)))[0].tolist() == [[0]]


def test_png_holds_the_palette_positions():
    a = np.array([[0, 1, 2], [2, 1, 0]], np.uint8)
    blob = png(a, ("#010203", "#040506"))
    assert blob[:8] == b"\x89PNG\r\n\x1a\n" and blob[16:24] == (3).to_bytes(4, "big") + (2).to_bytes(4, "big")
    at = blob.index(b"IDAT")
    raw = zlib.decompress(blob[at + 4 : at + 4 + int.from_bytes(blob[at - 4 : at], "big")])
    assert raw == b"\0\0\1\2\0\2\1\0" and b"PLTE\0\0\0\1\2\3\4\5\6" in blob


def test_tiles_put_together_are_the_layers(spark):
    e = LandHistory(grid(spark, 10), Params(block_px=5))
    whole = layers(e.pixels)
    places = spark.createDataFrame([(0, 1000.0, 2000.0, 10.0, 32643)], "region int, left double, top double, res double, epsg int")
    got = raster_tiles(whole, 4, places).collect()
    assert len(got) == 9 * 7 and {(t.height, t.width) for t in got} == {(4, 4), (4, 2), (2, 4), (2, 2)}
    years = np.zeros((10, 10), int)
    for t in got:
        a, tags = read_tiff(t.image)
        assert tags[TIE_POINT][3:5] == (1000 + 40 * t.tc, 2000 - 40 * t.tr)
        if t.layer == "year_of_change":
            years[4 * t.tr : 4 * t.tr + t.height, 4 * t.tc : 4 * t.tc + t.width] = a
    assert (years[:, 5:] == 2020).all() and (years[:, :5] == 0).all()
    assert {t.layer for t in overlay_tiles(e.pixels, e.years).collect()} == {*(f"states_{y}" for y in range(2017, 2024)), "change", "year_of_change", "confidence", "anomalies"}
    assert raster_tiles(whole.limit(0), 4).count() == 0


def test_validation_report(spark):
    e = LandHistory(grid(spark, 24), Params(block_px=6))
    text = validations(e, grid(spark, 24, second=True)).first().validation
    v = json.loads(text)
    assert [a["agreement"] for a in v["agreement"]] == [1, 1] and v["holdout"][0]["verified"] == 1 and v["baselines"][0]["baseline"] == 1
    assert "100.0 % of 576 pixels" in validation_text(text) and "events last" in validation_text(text)
    assert "No second product" in validation_text(validations(e).first().validation)


def test_run_validate_and_service(spark, tmp_path):
    obs, out = str(tmp_path / "obs"), tmp_path / "out"
    grid(spark, 6).union(grid(spark, 6, 1)).write.parquet(obs)
    spark.sql("SELECT 1L AS scene_id, DATE'2019-03-01' AS day, 5.0D AS cloud UNION ALL SELECT 2L, DATE'2021-03-01', 9.0D").write.parquet(str(tmp_path / "scenes"))
    (tmp_path / "one.yaml").write_text('name: "1"\nbbox: [10, 10, 10.1, 10.1]\nyears: [2017, 2018, 2019, 2020, 2021, 2022, 2023]\n')
    assert main(["run", obs, str(out), "--region", str(tmp_path / "one.yaml"), "--images", "--scenes", str(tmp_path / "scenes")]) == 0 and main(["validate", obs, str(out)]) == 0
    assert not (out / "0" / "summary.json").exists() and len(list((out / "1" / "rasters").glob("*.tif"))) == 7
    bundles = Bundles(out)
    (out / "broken").mkdir()
    (out / "broken" / "summary.json").write_text("{")
    assert [b["region"] for b in bundles.listing()] == [1]

    def analyse(region, years):
        run(LandHistory(spark.read.parquet(obs).where(f"region = {int(region)}"), Params(block_px=3), years), bundles)

    http = server(Service(bundles, analyse), 0)
    threading.Thread(target=http.serve_forever, daemon=True).start()

    def ask(path, body=None):
        try:
            r = urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{http.server_port}{path}", json.dumps(body).encode() if body is not None else None), timeout=60)
            return r.status, r.read()
        except urllib.error.HTTPError as e:
            return e.code, e.read()

    try:
        assert json.loads(ask("/api/health")[1]) == {"status": "ok"}
        assert json.loads(ask("/api/region/1/summary")[1])["change"]["event_fraction"] == 0.5
        assert json.loads(ask("/api/region/1/overlays")[1])["layers"]["confidence"]["high"]
        assert json.loads(ask("/api/region/1/evidence")[1])["pairs"][0] == {"rank": 1, "dominant_year": 2020, "before": 1, "after": 2}
        assert ask("/api/region/1/overlays/change_0_0.png")[1][:4] == b"\x89PNG"
        assert json.loads(ask("/api/analyze", {"name": "1"})[1])["status"] == "done"
        job = json.loads(ask("/api/analyze", {"name": "0"})[1])["job"]
        for _ in range(600):
            state = json.loads(ask(f"/api/jobs/{job}")[1])
            if state["status"] in ("done", "error"):
                break
            time.sleep(0.1)
        assert state["status"] == "done" and ask("/api/region/0/summary")[0] == 200
        box = {"west": 10, "south": 10, "east": 20, "north": 20}
        bad = [ask("/api/analyze", b)[0] for b in (box, box | {"east": 5}, {"name": "A B"}, {}, [])]
        assert bad == [400] * 5
        lost = ["/api/region/1/rasters/..%2F..%2F..%2Fobs", "/api/region/A/summary", "/api/region/9/summary", "/api/jobs/x", "/api/nothing", "/api/geocode?q=paris"]
        assert [ask(p)[0] for p in lost] == [400, 400, 404, 404, 404, 502] and ask("/api/geocode?q=p")[1] == b"[]"
    finally:
        http.shutdown()


def test_places_are_remembered_and_spaced():
    asked = []
    places = Places(lambda text, most: asked.append(text) or [{"display_name": text}] * 9, spacing=0.05)
    assert len(places.find(" Paris ")) == 5 and places.find("paris") == places.find("PARIS") and asked == ["Paris"]
    began = time.monotonic()
    places.find("x" * 300)
    assert time.monotonic() - began > 0.03 and len(asked[1]) == 200

    def fails(text, most):
        raise OSError("down")

    with pytest.raises(Refused, match="down"):
        Places(fails).find("Rome")
