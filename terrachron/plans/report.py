"""Bundles: a nested summary of each region as JSON, and a text from templates."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrachron.functions.dims import STATES
from terrachron.functions.pixel import name_of
from terrachron.operators import blocks, states, summary, validation
from terrachron.plans.engine import LandHistory
from terrachron.sources.observations import evidence_pairs


def _rows(df: DataFrame, name: str, *order: str, columns: list[str] | None = None) -> DataFrame:
    """(region, name): the rows of each region as an ordered array of structs; df has few rows for each region."""
    cols = columns or [c for c in df.columns if c != "region"]
    return df.groupBy("region").agg(F.array_sort(F.collect_list(F.struct(*(F.col(c) if not c.startswith("-") else (-F.col(c[1:])).alias(f"_{c[1:]}") for c in (*order, *(c for c in cols if c not in order)))))).alias(name))


def summaries(engine: LandHistory, top: int = 10) -> DataFrame:
    """(region, summary): JSON with years, area, grid, parameters, shares, transitions, volumes, archetypes, signatures, anomalies, confidence, hotspots."""
    p, last = engine.params, len(engine.years) - 1
    r4 = lambda c: F.bround(F.col(c), 4).alias(c)
    parts = [
        _rows(engine.trends.select("region", "name", "year", "state", r4("fraction")), "state_fractions", "year", "state"),
        _rows(states.deltas(engine.trends, engine.years[0], engine.years[-1]).select("region", "state", "name", r4("delta")), "deltas", "state"),
        _rows(states.top_transitions(engine.transitions).select("region", "rank", name_of(F.col("from_state")).alias("from"), name_of(F.col("to_state")).alias("to"), r4("fraction")), "top_transitions", "rank"),
        _rows(engine.volumes.select("region", "yoc", "pixels", name_of(F.col("from_state")).alias("from"), name_of(F.col("to_state")).alias("to")), "change_volumes", "yoc", "-pixels"),
        _rows(summary.archetypes(engine.facts, p).select("region", "archetype", "name", r4("fraction")), "archetypes", "archetype"),
        _rows(summary.top_signatures(engine.signatures, top).select("region", "rank", "label", "pixels", "fraction"), "top_signatures", "rank"),
        _rows(summary.top_signatures(engine.rare.drop("rank"), 8).select("region", "rank", "label", "pixels"), "rare_signatures", "rank"),
        _rows(blocks.hotspots(engine.scored, p).drop("row", "col"), "hotspots", "rank"),
    ]
    tiers = summary.tiers(engine.scored).select("region", F.struct("low", "medium", "high").alias("tier_counts"))
    change = summary.change_fractions(engine.pixels, last + 1).select("region", F.struct(r4("event_fraction"), F.bround("anomaly_fraction", 5).alias("anomaly_fraction"), F.bround("mean_score", 3).alias("mean_score")).alias("change"))
    raw = states.raw_change(engine.transitions).select("region", r4("fraction")).withColumnRenamed("fraction", "raw_change_fraction")
    still = summary.stable_changed(engine.facts, p).select("region", F.bround("stable", 4).alias("stable_fraction"), F.bround("changed", 4).alias("changed_fraction"))
    peak = summary.peak(engine.volumes).select("region", F.array("start", "stop").alias("peak_change_period"))
    settings = F.struct(*((F.array(*map(F.lit, v)) if isinstance(v, tuple) else F.lit(v)).alias(k) for k, v in asdict(p).items()))
    out = engine.grid.select("region", F.bround(F.col("h") * F.col("w") * 100 / 1e6, 1).alias("area_km2"), F.struct(F.col("h").alias("height"), F.col("w").alias("width")).alias("grid"), F.array(*map(F.lit, engine.years)).alias("years"), settings.alias("params"))
    for part in (*parts, tiers, change, raw, still, peak):
        out = out.join(part, "region", "left")
    return out.select("region", F.to_json(F.struct(*out.columns)).alias("summary"))


def validations(engine: LandHistory, second: DataFrame | None = None) -> DataFrame:
    """(region, validation): JSON with the holdout and, against a second product, agreement, IoU, baselines and relative agreement.

    Events are judged on the last year that both products have; without such a year only the holdout is there.
    """
    shared = sorted({r[0] for r in second.select("year").distinct().collect()} & set(engine.years)) if second is not None else []
    parts = []
    if shared:
        pairs, check = engine.compare(second), engine.checked(second, shared[-1])
        base, done = validation.baselines(check), check.where("done")
        parts += [
            _rows(validation.agreement(pairs), "agreement", "year"),
            _rows(validation.iou(pairs).withColumn("name", name_of(F.col("state"))), "iou", "year", "-iou", "state"),
            _rows(pairs, "confusion", "year", "a", "b"),
            _rows(base, "baselines", "state"),
            validation.relative(done, base, ["region"]).select("region", F.struct("events", "evaluated", "agreement", "baseline", "ratio").alias("relative")),
            _rows(validation.relative(validation.binned(done, validation.quartiles(done)), base, ["region", "bin"]), "relative_by_quartile", "bin"),
        ]
    held = engine.holdout()
    if held is not None:
        parts.append(_rows(held, "holdout", "bin"))
    out = engine.grid.select("region", F.array(*map(F.lit, engine.years)).alias("years"))
    for part in parts:
        out = out.join(part, "region", "left")
    return out.select("region", F.to_json(F.struct(*out.columns)).alias("validation"))


def evidences(engine: LandHistory, scenes: DataFrame, most: int = 3) -> DataFrame:
    """(region, evidence): JSON with the scenes (scene_id, day, cloud) before and after each of the first ``most`` hotspots."""
    found = evidence_pairs(engine.hotspots.where(F.col("rank") <= most), scenes).where("before IS NOT NULL").select("region", "rank", "dominant_year", "before", "after")
    return _rows(found, "pairs", "rank").select("region", F.to_json(F.struct("region", "pairs")).alias("evidence"))


def validation_text(validation_json: str) -> str:
    """Markdown of one region's validation."""
    v = json.loads(validation_json)
    pct = lambda x: f"{100 * x:.1f} %"
    lines = [f"# Validation of {v['region']}", "", "## Agreement with the second product", ""]
    lines += [f"- {a['year']}: {pct(a['agreement'])} of {a['pixels']} pixels" for a in v.get("agreement", [])] or ["No second product."]
    lines += [f"- {a['year']}, {a['name']}: IoU {a['iou']:.2f}" for a in v.get("iou", [])]
    if "relative" in v:
        lines += ["", "## Events against unchanged land", "", f"{v['relative']['evaluated']} events agree {v['relative']['ratio']:.2f} times as often as unchanged pixels of their new states."]
        lines += [f"- quarter {b['bin']} by score: {b['ratio']:.2f}" for b in v.get("relative_by_quartile", [])]
    lines += ["", "## Holdout", ""] + ([f"- {'all' if b['bin'] == 0 else 'quarter ' + str(b['bin']) + ' by score'}: {pct(b['verified'])} of {b['events']} events last" for b in v.get("holdout", [])] or ["Too few years or events."])
    return "\n".join([*lines, ""])


def story(summary_json: str) -> str:
    """Markdown of one region's summary."""
    s = json.loads(summary_json)
    pct = lambda x: f"{100 * x:.1f} %"
    change = s["change"]
    lines = [f"# Land history of {s['region']}", "", f"{s['area_km2']} km², {s['years'][0]} to {s['years'][-1]}.", "", "## What changed", ""]
    if change["event_fraction"] == 0:
        lines.append("No persistent change was found.")
    else:
        lines.append(f"{pct(change['event_fraction'])} of the area changed for good; most of it in {s['peak_change_period'][0]} to {s['peak_change_period'][1]}.")
    lines += ["", "## Shares", ""] + [f"- {d['name']}: {100 * d['delta']:+.1f} pp" for d in sorted(s.get("deltas", []), key=lambda d: (-abs(d.get("delta") or 0), d["state"])) if abs(d.get("delta") or 0) >= 0.001]
    lines += ["", "## Main transitions", ""] + [f"- {t['from']} → {t['to']}: {pct(t['fraction'])}" for t in s.get("top_transitions", [])]
    lines += ["", "## Histories", ""] + [f"- {t['label']}: {pct(t['fraction'])}" for t in s.get("top_signatures", [])[:6]]
    lines += ["", "## Rare histories", ""] + [f"- {t['label']}: {t['pixels']} px" for t in s.get("rare_signatures", [])[:5]]
    n = s["tier_counts"]
    lines += ["", "## Confidence", "", f"{n['high']} events of high, {n['medium']} of medium and {n['low']} of low confidence; mean score {change['mean_score']}."]
    lines += ["", "## Hotspots", ""] + [f"{h['rank']}. {h['dominant_from']} → {h['dominant_to']} about {h['dominant_year']}: {pct(h['change_fraction'])}" for h in s.get("hotspots", [])]
    lines += ["", "Scores are evidence heuristics, not probabilities; classes may be wrong in all years alike.", ""]
    return "\n".join(lines)


def benchmark_table(rows: list[dict]) -> str:
    """Markdown table of benchmark rows."""
    head = ["region", "area_km2", "event_fraction", "raw_fraction", "stable", "anomaly_fraction", "peak_year", "biggest_delta_state", "high_confidence_pct", "mean_confidence"]
    cell = lambda v: f"{v:.4g}" if isinstance(v, float) else "–" if v is None else str(v)
    return "\n".join(["| " + " | ".join(head) + " |", "|" + " --- |" * len(head), *("| " + " | ".join(cell(r.get(c)) for c in head) + " |" for r in rows)]) + "\n"


__all__ = ["STATES", "benchmark_table", "evidences", "story", "summaries", "validation_text", "validations"]
