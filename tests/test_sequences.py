"""Pixel sequences with known histories."""

import random

import pytest

from terrachron.functions.dims import Params
from terrachron.operators import history, summary

CODES = {"V": 2, "C": 3, "B": 4, "A": 5, "W": 1, "0": 0}
KINDS = ["unobserved", "stable", "stable_with_flicker", "direct_change", "staged_change", "reverted", "fluctuating", "unstable", "noisy_change"]


def facts(spark, sequences, p=Params()):
    t = len(sequences[0])
    rows = [(0, 0, i, *(CODES[x] if isinstance(x, str) else x for x in s)) for i, s in enumerate(sequences)]
    wide = spark.createDataFrame(rows, "region int, r int, c int, " + ", ".join(f"s{i} int" for i in range(t)))
    return {r.c: r for r in history.facts(wide, list(range(2017, 2017 + t)), p).collect()}


CASES = [
    ("VVVBBBB", ("V", "B", 2020), "direct_change"), ("CVCCBBB", ("C", "B", 2021), None), ("VVVVVVB", None, "unstable"), ("VVWWVVV", None, "reverted"),
    ("VWWVVVV", ("W", "V", 2020), "direct_change"), ("0000VBB", None, None), ("0000BBB", None, "unobserved"), ("VVVBB0B", None, None), ("VVVABBB", ("V", "B", 2021), "staged_change"),
    ("CVCVBBB", None, None), ("CCVCCCC", None, "stable_with_flicker"), ("WVWVWVW", None, "fluctuating"), ("VVVVVVV", None, "stable"),
]


def test_known_sequences(spark):
    got = facts(spark, [c[0] for c in CASES])
    for i, (s, event, kind) in enumerate(CASES):
        r = got[i]
        if event:
            assert (r.event, r.from_state, r.to_state, r.yoc) == (True, CODES[event[0]], CODES[event[1]], event[2]), s
        elif s != "CVCVBBB":
            assert not r.event and r.yoc == 0, s
        if kind:
            assert KINDS[r.archetype] == kind, s
    assert got[1].pre_mode_frac == 0.75


def test_gaps_break_runs_but_not_signatures(spark):
    a, b = facts(spark, ["V0VBBBB", "VVVBBBB"]).values()
    assert a.sig == b.sig == 0o24
    assert facts(spark, ["VVVBB0B"])[0].trail == 1


def brute(s, years, p):
    t, fin = len(s), s[-1]
    trail = 0
    while fin and trail < t and s[t - 1 - trail] == fin:
        trail += 1
    pre = [x for x in s[: t - trail] if x]
    n = {k: pre.count(k) for k in range(1, 7)}
    mode = max(n, key=lambda k: (n[k], -k)) if pre else 0
    obs = sum(x > 0 for x in s)
    ev = bool(fin and trail >= p.persistence and trail < obs and mode and mode != fin and n[mode] > n.get(fin, 0) and obs >= p.min_observed)
    runs = []
    for x in s:
        if x and (not runs or runs[-1] != x):
            runs.append(x)
    sig = 0
    for x in runs:
        sig = sig * 8 + x
    return (obs, trail, ev, years[t - trail] if ev else 0, mode if ev else 0, fin if ev else 0, n[mode] / len(pre) if ev else 0.0, sum(x in (mode, fin) and x > 0 for x in s) / obs if ev else 0.0, sig, max(len(runs) - 1, 0), len(set(runs)))


@pytest.mark.parametrize("t", [3, 5, 7, 8])
def test_random_sequences(spark, t):
    rng, p = random.Random(t), Params(min_observed=min(4, t - 1))
    seqs = [[rng.choice((0, 1, 1, 2, 2, 2, 4)) for _ in range(t)] for _ in range(300)]
    got, years = facts(spark, seqs, p), list(range(2017, 2017 + t))
    for i, s in enumerate(seqs):
        r = got[i]
        assert (r.observed, r.trail, r.event, r.yoc, r.from_state, r.to_state, r.pre_mode_frac, r.purity, r.sig, r.switches, r.n_states) == brute(s, years, p), s


def test_too_few_years(spark):
    with pytest.raises(ValueError):
        facts(spark, ["VB"])


@pytest.mark.parametrize(("h", "w"), [(1, 1), (1, 6), (5, 1), (7, 9)])
def test_spatial_support(spark, h, w):
    rng = random.Random(h * w)
    cell = {(r, c): (rng.random() < 0.6, rng.choice((2, 4))) for r in range(h) for c in range(w)}
    df = spark.createDataFrame([(0, r, c, e, s) for (r, c), (e, s) in cell.items()], "region int, r int, c int, event boolean, to_state int")
    got = {(x.r, x.c): x.support for x in history.spatial_support(df, history.extent(df)).collect()}
    for (r, c), (e, s) in cell.items():
        near = [cell[r + a, c + b] for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (r + a, c + b) in cell]
        assert got.get((r, c)) == ((sum(x == (True, s) for x in near) / len(near) if near else 0.0) if e else None)


def test_rare_histories_stay_in_budget(spark):
    rows = [(0, 0o2, 1, 5000), (0, 0o24, 2, 60), (0, 0o242, 2, 20), (0, 0o31, 2, 5), (0, 0o13, 2, 4)]
    stats = spark.createDataFrame(rows, "region int, sig long, states int, pixels long").selectExpr("*", "pixels / 5089 AS fraction")
    got = {r.sig for r in summary.rare_signatures(stats, Params(anomaly_budget=0.002)).collect()}
    assert got == {0o13, 0o31}
    assert {r.sig for r in summary.rare_signatures(stats, Params(anomaly_budget=0.0)).collect()} == {0o13}
