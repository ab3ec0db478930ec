"""All queries of the land-history engine by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrachron.functions import geo
from terrachron.functions.dims import SECOND_TO_STATE, STATE_COLOURS, STATES, Params
from terrachron.functions.pixel import name_of, stable_change, state_is
from terrachron.operators import blocks, history, states, summary, validation
from terrachron.plans.engine import LandHistory, layers, tuned
from terrachron.plans.oracle import SQL
from terrachron.plans.report import summaries
from terrachron.sinks.images import raster_tiles, tile_totals
from terrachron.sources import observations as source

PARAMS = Params(block_px=10)
CHECK_YEAR = 1999
FIXTURE_TILE = 16
PRODUCT_YEARS = (2017, 2018, 2019)
PATH_TEMPLATE = "products/{tile}/{tile}_{year}.tif"


def engine(spark: SparkSession, d: str) -> LandHistory:
    return LandHistory(source.derived(tuned(spark), d), PARAMS)


def second(spark: SparkSession, d: str) -> DataFrame:
    return source.second_product(source.derived(spark, d))


def points(spark: SparkSession, d: str) -> DataFrame:
    """(id, lon, lat) spread over the globe, from customer keys."""
    k = F.col("c_custkey")
    return spark.read.parquet(f"{d}/customer.parquet").select(k.alias("id"), ((k * 37) % 3600 / 10 - 180).alias("lon"), ((k * 53) % 1600 / 10 - 80).alias("lat"))


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """(id, west, south, east, north) of up to 8 by 9 degrees."""
    p, k = points(spark, d).withColumns({"lon": F.least("lon", F.lit(170.0)), "lat": F.least("lat", F.lit(70.0))}), F.col("id")
    return p.select("id", F.col("lon").alias("west"), F.col("lat").alias("south"), (F.col("lon") + (k % 80 + 1) / 10).alias("east"), (F.col("lat") + (k % 90 + 1) / 10).alias("north"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Change events by transition, year, archetype and tier."""
    return engine(spark, d).scored.where("event").groupBy("from_state", "to_state", "yoc", "archetype", "tier").agg(F.count("*").alias("pixels"))


def _mosaic(spark: SparkSession, d: str) -> DataFrame:
    obs = source.derived(spark, d)
    left = obs.where("c < 30").select("*", F.lit(1).alias("rank"))
    right = obs.where("c >= 20").select("region", "r", "c", "year", F.when(F.col("src") == 0, 2).otherwise(F.col("src")).alias("src"), F.lit(2).alias("rank"))
    return source.mosaic(left.unionByName(right))


def _resampled(spark: SparkSession, d: str) -> DataFrame:
    obs = source.derived(spark, d)
    coarse = obs.where("r % 3 = 0 AND c % 3 = 0").select("region", (F.col("r") / 3).cast("int").alias("r"), (F.col("c") / 3).cast("int").alias("c"), "year", "src")
    return source.resample_nearest(coarse, obs.select("region", "r", "c", "year"), 3.0)


def _best_scene(spark: SparkSession, d: str) -> DataFrame:
    weeks = source.scenes(spark, d).select(F.trunc("day", "week").alias("start")).distinct().withColumn("stop", F.date_add("start", 6))
    return source.best_scene(weeks, source.scenes(spark, d), "start", "stop").select(F.col("start").cast("string").alias("start"), "scene_id", "cloud")


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    """Hotspots at a hundredth of a degree for each pixel, and scenes whose days and places follow from their ids."""
    k, px = F.col("scene_id"), PARAMS.block_px / 100
    west, south = F.col("region") + F.col("bc") * px, F.col("br") * px
    spots = engine(spark, d).hotspots.withColumns({"west": west, "south": south, "east": west + px, "north": south + px})
    west, south = (k * 37 % 2000) / 100, (k * 11 % 40) / 100 - 0.3
    shown = source.scenes(spark, d).withColumns({"day": F.date_add(F.lit("1993-01-01").cast("date"), (k * 13 % 2900).cast("int")), "west": west, "south": south, "east": west + 0.4, "north": south + 0.3})
    return source.evidence_pairs(spots, shown).select("region", "rank", F.col("dominant_year").alias("year"), "before", "after")


def _tile_ranges(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d).select(geo.lat_band(F.col("lat")).alias("band"), geo.utm_zone(F.col("lon")).alias("zone")).distinct()
    return p.select("band", "zone", geo.band_south(F.col("band")).alias("south"), geo.band_north(F.col("band")).alias("north"), geo.zone_west(F.col("zone")).alias("west"), (geo.zone_west(F.col("zone")) + 6).alias("east"))


def _clipped(spark: SparkSession, d: str) -> DataFrame:
    t = geo.tiles_for_bbox(boxes(spark, d))
    band, zone = F.substring("tile", 3, 1), F.substring("tile", 1, 2).cast("int")
    b = t.withColumns({"t_west": geo.zone_west(zone), "t_east": geo.zone_west(zone) + 6, "t_south": geo.band_south(band), "t_north": geo.band_north(band)})
    return geo.clipped(b.drop("seq")).select("id", "tile", *(F.round(c, 6).alias(c) for c in ("west", "south", "east", "north")))


def _target_grid(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    b = points(spark, d).select("id", (500000 + (k * 7919 % 100000) / 4).alias("x0"), (4000000 + (k * 104729 % 100000) / 4).alias("y0"))
    return geo.target_grid(b.select("id", "x0", "y0", (F.col("x0") + 1000 + k % 77 / 2).alias("x1"), (F.col("y0") + 1500 + k % 55 / 4).alias("y1")))


def _overlay(spark: SparkSession, d: str) -> DataFrame:
    sizes = points(spark, d).select("id", (F.col("id") * 13 % 5000 + 1).alias("h"), (F.col("id") * 29 % 7000 + 1).alias("w"))
    h, w = geo.overlay_grid(F.col("h"), F.col("w"))
    return sizes.select("id", h.alias("height"), w.alias("width"))


def _colours(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d)
    colour = F.element_at(F.array(*(F.lit(STATE_COLOURS[k]) for k in STATES)), F.col("state"))
    n = e.states.where("state <> 0").groupBy("year", "state").agg(F.count("*").alias("pixels"))
    rgb = geo.hex_rgb(colour)
    return n.select("year", "state", "pixels", colour.alias("colour"), rgb["r"].alias("red"), rgb["g"].alias("green"), rgb["b"].alias("blue"))


def _utm(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d).withColumn("zone", geo.utm_zone(F.col("lon")))
    x, y = geo.to_utm(F.col("lon"), F.col("lat"), F.col("zone"))
    p = p.withColumns({"x": x, "y": y})
    lon, lat = geo.from_utm(F.col("x"), F.col("y"), F.col("zone"), F.col("lat") >= 0)
    return p.select("id", "zone", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


def _checked(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark, d).checked(second(spark, d), CHECK_YEAR)


def _relative(spark: SparkSession, d: str) -> DataFrame:
    c = _checked(spark, d)
    return validation.relative(c.where("done"), validation.baselines(c, 50), ["region"])


def _relative_bins(spark: SparkSession, d: str) -> DataFrame:
    c = _checked(spark, d)
    ev = c.where("done")
    return validation.relative(validation.binned(ev, validation.quartiles(ev), 100), validation.baselines(c, 50), ["region", "bin"], 20)


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    return blocks.clusters(engine(spark, d).features, PARAMS)


def _box_of(spark: SparkSession, d: str) -> DataFrame:
    """Boxes that aren't wider than their zone and keep off the poles, for projections."""
    return boxes(spark, d).withColumns({"east": F.least("east", F.col("west") + 4.0), "north": F.least("north", F.lit(80.0))})


def _projected(spark: SparkSession, d: str) -> DataFrame:
    return geo.utm_box(_box_of(spark, d)).select("id", "zone", *(F.round(c, 3).alias(c) for c in ("x0", "y0", "x1", "y1")))


def _paths(spark: SparkSession, d: str) -> DataFrame:
    tiles = points(spark, d).select(geo.tile_id(F.col("lon"), F.col("lat")).alias("tile")).distinct()
    wanted = tiles.select("tile", F.explode(F.array(*map(F.lit, PRODUCT_YEARS))).alias("year"))
    return source.product_paths(wanted, PATH_TEMPLATE, PRODUCT_YEARS)


def _stale(spark: SparkSession, d: str) -> DataFrame:
    """Regions whose first year lacks pixels in a cache that lost row 3 of every second region."""
    e = engine(spark, d)
    cached = e.observations.where((F.col("year") == e.years[0]) & ~((F.col("region") % 2 == 1) & (F.col("r") == 3)))
    return source.stale(cached, e.grid)


def _single(spark: SparkSession, d: str) -> DataFrame:
    lon, lat = F.col("lon").alias, F.col("lat").alias
    return geo.single_tile(points(spark, d).select("id", lon("west"), lat("south"), lon("east"), lat("north"))).select("id", "tile")


KEY = ["region", "r", "c"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One query for each operator; all run over whole tables."""
    last = 6

    def on(f: Callable[[LandHistory], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, d: f(engine(spark, d))

    def at(f: Callable[[DataFrame], DataFrame], table: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, d: f(table(spark, d))

    lon, lat = F.col, F.col
    sig = lambda e: e.facts.select(*KEY, "sig")
    west, south, east, north = "west", "south", "east", "north"
    return {
        "observations": source.derived,
        "second_product": second,
        "scan_window": at(lambda o: source.window(o, 3, 11, 10, 30, [1996, 1998]), source.derived),
        "coregistration_check": at(source.coregistration, source.derived),
        "mosaic_first_nonzero": _mosaic,
        "resample_nearest": _resampled,
        "wc_tiles": at(lambda b: geo.degree_tiles(b).select("id", "tile"), boxes),
        "product_paths": _paths,
        "stale_regions": _stale,
        "best_scene": _best_scene,
        "evidence_pairs": _evidence,
        "first_evidence": lambda s, d: _evidence(s, d).where("rank <= 3"),
        "raster_layers": on(lambda e: layers(e.pixels)),
        "raster_tiles": on(lambda e: tile_totals(raster_tiles(layers(e.pixels), FIXTURE_TILE))),
        "overlay_colors": _colours,
        "remap_states": on(lambda e: e.states),
        "remap_states_alt": at(lambda o: states.canonical(o, SECOND_TO_STATE), second),
        "state_predicate": at(lambda o: o.where(state_is(F.col("src"), 2)).groupBy("region", "year").agg(F.count("*").alias("pixels")), source.derived),
        "jointly_observed": on(lambda e: e.wide.where("s0 <> 0 AND s6 <> 0").groupBy("region").agg(F.count("*").alias("pixels"))),
        "analysed_pixels": on(lambda e: e.facts.where(summary.analysed(PARAMS)).groupBy("region").agg(F.count("*").alias("pixels"))),
        "change_layer": on(lambda e: e.facts.select(*KEY, F.when(F.col("event"), F.col("to_state")).otherwise(0).alias("layer"))),
        "target_grid": _target_grid,
        "utm_zone": at(lambda p: p.select("id", geo.utm_zone(lon("lon")).alias("zone")), points),
        "lat_band": at(lambda p: p.select("id", geo.lat_band(lat("lat")).alias("band")), points),
        "tile_id": at(lambda p: p.select("id", geo.tile_id(lon("lon"), lat("lat")).alias("tile")), points),
        "tiles_for_bbox": at(lambda b: geo.tiles_for_bbox(b).select("id", "tile", "seq"), boxes),
        "single_tile": _single,
        "projected_boxes": _projected,
        "aoi_names": at(lambda b: b.select("id", geo.aoi_names(*map(F.col, (west, south, east, north)), PRODUCT_YEARS).alias("name")), boxes),
        "hotspot_places": on(lambda e: blocks.located(e.hotspots, 500000.0, 4100000.0, 33).select("region", "rank", "lon", "lat")),
        "tile_ranges": _tile_ranges,
        "bbox_intersect": _clipped,
        "epsg_code": at(lambda p: p.select("id", geo.epsg(lon("lon"), lat("lat")).alias("epsg")), points),
        "utm_round_trip": _utm,
        "aoi_area": at(lambda b: b.select("id", F.round(geo.area_km2(*map(F.col, (west, south, east, north))), 6).alias("km2"), (F.round(geo.area_km2(*map(F.col, (west, south, east, north))), 6) <= geo.MAX_AREA_KM2).alias("allowed")), boxes),
        "grid_area": on(lambda e: e.grid.select("region", "h", "w", geo.grid_area_km2(F.col("h"), F.col("w")).alias("km2"))),
        "overlay_grid": _overlay,
        "bbox_name": at(lambda b: b.select("id", geo.box_name(*map(F.col, (west, south, east, north))).alias("name")), boxes),
        "display_name": at(lambda p: p.select("id", geo.display_name(lon("lon"), lat("lat")).alias("name")), points),
        "name_check": at(lambda c: c.select("c_custkey", F.lower("c_name").rlike(geo.NAME).alias("as_lower"), F.col("c_name").rlike(geo.NAME).alias("as_is")), lambda s, d: s.read.parquet(f"{d}/customer.parquet")),
        "fingerprint": at(lambda b: b.select("id", F.substring(F.sha2(F.concat_ws(",", *(F.format_string("%.3f", F.col(c)) for c in (west, south, east, north))), 256), 1, 16).alias("fingerprint")), boxes),
        "state_fractions": on(lambda e: states.fractions(e.states, e.years[-1])),
        "fraction_trends": on(lambda e: e.trends),
        "fraction_deltas": on(lambda e: states.deltas(e.trends, e.years[0], e.years[-1])),
        "top_deltas": on(lambda e: states.top_deltas(states.deltas(e.trends, e.years[0], e.years[-1])).select("region", "rank", "name", "delta")),
        "visible_trends": on(lambda e: states.visible(e.trends, 0.05)),
        "transition_matrix": on(lambda e: e.transitions),
        "top_transitions": on(lambda e: states.top_transitions(e.transitions)),
        "raw_change": on(lambda e: states.raw_change(e.transitions)),
        "stable_change": on(lambda e: e.wide.groupBy("region").agg(F.count_if(stable_change(last + 1, 2)).alias("changed"), F.count_if((F.col("s0") != 0) & (F.col("s6") != 0)).alias("pixels"))),
        "present_states": on(lambda e: states.present(e.states)),
        "pixel_history": on(lambda e: e.wide),
        "observed_years": on(lambda e: e.facts.select(*KEY, "observed")),
        "trailing_run": on(lambda e: e.facts.select(*KEY, "fin", "trail")),
        "change_events": on(lambda e: e.facts.where("event").select(*KEY, "yoc", "from_state", "to_state", "pre_mode_frac", "purity")),
        "change_volumes": on(lambda e: e.volumes),
        "yearly_change_totals": on(lambda e: summary.yearly_totals(e.volumes)),
        "volumes_by_destination": on(lambda e: summary.volumes_by_destination(e.facts)),
        "peak_period": on(lambda e: summary.peak(e.volumes)),
        "signatures": on(sig),
        "signature_labels": on(lambda e: e.signatures.select("region", "sig", "label")),
        "signature_stats": on(lambda e: e.signatures.select("region", "sig", "states", "pixels", "fraction")),
        "top_signatures": on(lambda e: summary.top_signatures(e.signatures.drop("label", "states"))),
        "switch_count": on(lambda e: e.facts.select(*KEY, "switches")),
        "first_state": on(lambda e: e.facts.select(*KEY, "first_state")),
        "distinct_states": on(lambda e: e.facts.select(*KEY, "n_states", "excursion")),
        "archetypes": on(lambda e: e.facts.select(*KEY, "archetype")),
        "archetype_fractions": on(lambda e: summary.archetypes(e.facts, PARAMS)),
        "stable_changed_share": on(lambda e: summary.stable_changed(e.facts, PARAMS)),
        "rare_signatures": on(lambda e: e.rare.select("region", "sig", "pixels", "rank", "so_far")),
        "anomaly_pixels": on(lambda e: summary.with_anomaly(e.facts, e.rare, PARAMS).where("anomaly").select(*KEY, "sig")),
        "spatial_support": on(lambda e: history.spatial_support(e.facts, e.grid)),
        "confidence_scores": on(lambda e: e.scored.where("event").select(*KEY, F.round("score", 9).alias("score"))),
        "confidence_tiers": on(lambda e: e.scored.select(*KEY, "tier")),
        "tier_summary": on(lambda e: summary.tiers(e.scored)),
        "tier_percentages": on(lambda e: summary.tier_percentages(summary.tiers(e.scored))),
        "event_fraction": on(lambda e: summary.event_fraction(e.facts, last + 1)),
        "change_fractions": on(lambda e: summary.change_fractions(e.pixels, last + 1)),
        "block_features": on(lambda e: e.features),
        "scaled_features": on(lambda e: blocks.scaled(e.features)),
        "densest_block": on(lambda e: blocks.densest(e.facts, PARAMS)),
        "hotspots": on(lambda e: e.hotspots),
        "block_clusters": _clusters,
        "cluster_profiles": lambda s, d: blocks.profiles(engine(s, d).features, _clusters(s, d)),
        "cluster_pixels": lambda s, d: blocks.to_pixels(engine(s, d).facts, engine(s, d).features.select("region", "br", "bc", F.floor(F.col("changed") * 4).cast("int").alias("label")), PARAMS),
        "product_agreement": lambda s, d: validation.agreement(engine(s, d).compare(second(s, d))),
        "product_confusion": lambda s, d: engine(s, d).compare(second(s, d)),
        "product_iou": lambda s, d: validation.iou(engine(s, d).compare(second(s, d))),
        "state_baseline": at(lambda c: validation.baselines(c, 50), _checked),
        "relative_agreement": _relative,
        "score_quartiles": on(lambda e: validation.quartiles(e.scored.where("event")).select("region", "events", *(F.round(q, 9).alias(q) for q in ("q1", "q2", "q3")))),
        "relative_by_quartile": _relative_bins,
        "holdout_rates": on(lambda e: e.holdout(least=50)),
        "benchmark_rows": on(lambda e: e.persisted().benchmark()),
        "summary_json": on(lambda e: summaries(e.persisted())),
        "state_names": on(lambda e: e.states.select("state", F.when(F.col("state") == 0, "nodata").otherwise(name_of(F.col("state"))).alias("name")).distinct()),
        "flagship": flagship,
    }


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
