"""Per-pixel sequence logic as unrolled column expressions over the yearly states, so that it stays in generated code.

A state of 0 is "not observed". It breaks a trailing run, but signatures and switch counts skip it.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrachron.functions.dims import CLASS_TO_STATE, EPS, SECOND_TO_STATE, STATES, Params


def remap(src: Column, table: dict[int, int] = CLASS_TO_STATE) -> Column:
    """The state of a class code; unknown codes are 0."""
    by: dict[int, list[int]] = {}
    for code, state in table.items():
        by.setdefault(state, []).append(code)
    out = None
    for state in sorted(set(by) - {0}):
        out = (F if out is None else out).when(src.isin(*by[state]), state)
    return out.otherwise(0)


def state_is(src: Column, state: int, table: dict[int, int] = CLASS_TO_STATE) -> Column:
    """Whether a class is ``state``, as a predicate on the class that reaches the scan (states from 1)."""
    return src.isin(*(c for c, s in table.items() if s == state))


def total(columns: list[Column]) -> Column:
    return reduce(add, columns)


def flag(c: Column) -> Column:
    return c.cast("int")


def with_runs(wide: DataFrame, t: int) -> DataFrame:
    """observed, fin, trail and first_state of s0..s{t-1}."""
    s = [F.col(f"s{i}") for i in range(t)]
    trail = F.when(s[-1] == 0, 0)
    for i in range(t - 2, -1, -1):
        trail = trail.when(s[i] != s[-1], t - 1 - i)
    first = F.coalesce(*(F.nullif(x, F.lit(0)) for x in s), F.lit(0))
    return wide.withColumns({"observed": total([flag(x != 0) for x in s]), "fin": s[-1], "trail": trail.otherwise(t), "first_state": first})


def with_events(wide: DataFrame, years: list[int], p: Params) -> DataFrame:
    """The persistent change of each pixel, if any: event, yoc, from_state, to_state, pre_mode_frac, purity.

    Before the trailing run of the last state, one other state must have a strict majority over it, and its mode is
    where the change comes from (the smallest state wins ties).
    """
    t = len(years)
    if t < p.persistence + 1:
        raise ValueError(f"{t} years are too few for persistence {p.persistence}")
    s = [F.col(f"s{i}") for i in range(t)]
    before = [F.lit(i) < t - F.col("trail") for i in range(t)]
    out = with_runs(wide, t).withColumns({f"_n{k}": total([flag((x == k) & b) for x, b in zip(s, before)]) for k in STATES})
    out = out.withColumn("_mode", F.greatest(*(F.struct(F.col(f"_n{k}").alias("n"), F.lit(-k).alias("k")) for k in STATES)))
    fin_before = F.coalesce(*(F.when(F.col("fin") == k, F.col(f"_n{k}")) for k in STATES), F.lit(0))
    out = out.withColumns({"_from": F.when(F.col("_mode.n") > 0, -F.col("_mode.k")).otherwise(0), "_pre": total([F.col(f"_n{k}") for k in STATES]), "_back": fin_before})
    event = (F.col("fin") != 0) & (F.col("trail") >= p.persistence) & (F.col("trail") < F.col("observed")) & (F.col("_from") != 0) & (F.col("_from") != F.col("fin")) & (F.col("_mode.n") > F.col("_back")) & (F.col("observed") >= p.min_observed)
    out = out.withColumn("event", event)
    e = lambda c, other: F.when(F.col("event"), c).otherwise(other)
    yoc = F.element_at(F.array(*map(F.lit, years)), t - F.col("trail") + 1)
    pure = total([flag((x != 0) & ((x == F.col("_from")) | (x == F.col("fin")))) for x in s])
    out = out.withColumns({"yoc": e(yoc, 0), "from_state": e(F.col("_from"), 0), "to_state": e(F.col("fin"), 0), "pre_mode_frac": e(F.col("_mode.n") / F.col("_pre"), 0.0), "purity": e(pure / F.col("observed"), 0.0)})
    return out.drop(*(f"_n{k}" for k in STATES), "_mode", "_from", "_pre", "_back")


def with_trajectories(wide: DataFrame, t: int, p: Params) -> DataFrame:
    """sig, switches, n_states, excursion and archetype; needs the columns of :func:`with_events`.

    A signature is the states without repeats and gaps, three bits each, the first in the highest place.
    """
    s = [F.col(f"s{i}") for i in range(t)]
    last, out = F.lit(0), wide
    changes: dict[str, Column] = {}
    for i in range(t):
        changes[f"_c{i}"] = (s[i] != 0) & (s[i] != last)
        last = F.when(s[i] != 0, s[i]).otherwise(last)
    out = out.withColumns(changes)
    c = [flag(F.col(f"_c{i}")) for i in range(t)]
    later = {f"_l{i}": total([*c[i + 1 :], F.lit(0)]) for i in range(t)}
    out = out.withColumns(later)
    sig = total([F.when(F.col(f"_c{i}"), F.expr(f"shiftleft(bigint(s{i}), 3 * _l{i})")).otherwise(F.lit(0).cast("long")) for i in range(t)])
    n = {k: total([flag(x == k) for x in s]) for k in STATES}
    out = out.withColumns({"sig": sig, "switches": F.greatest(total(c) - 1, F.lit(0)), "n_states": total([flag(x > 0) for x in n.values()]), "excursion": F.col("observed") - F.greatest(*n.values())})
    ev, sw, ns = F.col("event"), F.col("switches"), F.col("n_states")
    back = ~ev & (F.col("fin") != 0) & (F.col("fin") == F.col("first_state")) & (sw == 2)
    kind = (
        F.when(F.col("observed") < p.min_observed, 0).when(sw == 0, 1).when(ev & (sw >= 3), 8).when(ev & (sw == 2) & (ns == 2), 3).when(ev & (sw == 2) & (ns == 3), 4).when(ev & (sw == 1), 3)
        .when(back & (F.col("excursion") < 2), 2).when(back, 5).when((sw >= 3) & (ns == 2) & ~ev, 6).otherwise(7)
    )
    return out.withColumn("archetype", kind).drop(*changes, *later)


def stable_change(t: int, persistence: int) -> Column:
    """First and last observed and different, and the last ``persistence`` years equal."""
    if t < persistence + 1:
        raise ValueError(f"{t} years are too few for persistence {persistence}")
    first, last = F.col("s0"), F.col(f"s{t - 1}")
    same = reduce(lambda a, b: a & b, [F.col(f"s{i}") == last for i in range(t - persistence, t)])
    return (first != 0) & (last != 0) & (first != last) & same


def tier(score: Column, p: Params) -> Column:
    return F.when(score >= p.high - EPS, 3).when(score >= p.medium - EPS, 2).otherwise(1)


def sig_label(sig: Column) -> Column:
    """A signature as state names with arrows, 'unobserved' if there are none; only for results, not for pixels."""
    n = F.length(F.conv(sig.cast("string"), 10, 8))
    names = F.transform(F.split(F.conv(sig.cast("string"), 10, 8), ""), lambda d: F.element_at(F.array(*(F.lit(STATES[k]) for k in STATES)), F.greatest(d.cast("int"), F.lit(1))))
    return F.when(sig <= 0, "unobserved").when(n > 0, F.array_join(names, "→"))


def name_of(state: Column, names: dict[int, str] = STATES) -> Column:
    out = None
    for k, v in names.items():
        out = (F if out is None else out).when(state == k, v)
    return out.otherwise(state.cast("string"))


__all__ = ["SECOND_TO_STATE", "flag", "name_of", "remap", "sig_label", "stable_change", "state_is", "tier", "total", "with_events", "with_runs", "with_trajectories"]
