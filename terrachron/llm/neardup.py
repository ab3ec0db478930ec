"""Near-duplicates by an inverted join over MinHash coordinates.

Texts with the same shingle set are one class. Each class posts its id under each coordinate and value of its
signature; lists of one are dropped. A class keeps only its rarest lists, as many as any partner with enough equal
coordinates must share one of (prefix), and none if too few lists are left (skip). Then

1. in every list all members meet its least member: linear in the list, and enough for groups around one original;
2. lists whose members are still in different components are merged: members of different components with enough
   equal coordinates become candidates, in blocks, so that no list is gathered whole. A member can only be linked
   through shingles that it shares with other components; how many these are is counted first, and skips the many
   members of a group that differ from its original in words of their own.

Candidates are confirmed on their full shingle sets (in step 2 where the list is merged, so that only links leave
it), and the links' connected components are the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrachron.llm.components import components
from terrachron.llm.shared import forget, lean, settle, small
from terrachron.llm.textcore import as_text, chunks, mix, shingles, words

COORDINATES = 40
BLOCK = 1024
_seeds = mix(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_MULT, _XOR = _seeds[:COORDINATES] | np.uint64(1), _seeds[COORDINATES:]


def least_matches(percent: int) -> int:
    """Equal coordinates that a pair at the threshold has all but surely: 5.2 standard deviations below the mean."""
    t = percent / 100
    return max(1, math.floor(COORDINATES * t - 5.2 * math.sqrt(COORDINATES * t * (1 - t))))


def _each(col: pa.Array, size: int) -> Iterator[list[np.ndarray]]:
    for i, j, data, off in chunks(as_text(col), 1 << 18):
        h, doc = words(data, off)
        yield shingles(h, doc, j - i, size)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, COORDINATES) least hashes, each mixed with its coordinate; sets must not be empty."""
    flat = np.concatenate(sets)
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), COORDINATES), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(COORDINATES):
            out[:, k] = mix(np.minimum.reduceat((flat ^ _XOR[k]) * _MULT[k], first) + np.uint64(k))
    return out


def profile(docs: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """(doc_id, n, h1, h2, sig): the size of each row's shingle set, a hash of it in 128 bits, and its signature (null if empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for sets in _each(b.column(1), size):
                full = [k for k, s in enumerate(sets) if len(s)]
                sig: list = [None] * len(sets)
                if full:
                    for k, row in zip(full, signatures([sets[k] for k in full]).view(np.int64)):
                        sig[k] = row
                with np.errstate(over="ignore"):
                    h = [np.array([int(mix(s ^ np.uint64(c)).sum(dtype=np.uint64)) for s in sets], dtype=np.uint64).view(np.int64) for c in (1, 0x5851F42D4C957F2D)]
                yield pa.RecordBatch.from_arrays([b.column(0)[at : at + len(sets)], pa.array([len(s) for s in sets], pa.int64()), pa.array(h[0]), pa.array(h[1]), pa.array(sig, pa.list_(pa.int64()))], ["doc_id", "n", "h1", "h2", "sig"])
                at += len(sets)

    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), *T.StructType.fromDDL("n bigint, h1 bigint, h2 bigint, sig array<bigint>").fields])
    return lean(docs.select(doc_id, text), run, schema)


def full_sets(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """(id, set) of the documents whose ids are in ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for sets in _each(b.column(1), size):
                yield pa.RecordBatch.from_arrays([b.column(0)[at : at + len(sets)], pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["id", "set"])
                at += len(sets)

    schema = T.StructType([T.StructField("id", docs.schema[doc_id].dataType), T.StructField("set", T.ArrayType(T.LongType()))])
    few = small(wanted.withColumnRenamed("id", "_id"), wanted.count())
    return lean(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(few, F.col("id") == F.col("_id"), "left_semi"), run, schema)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) with 100 * intersection >= percent * union of their full ``sets``."""
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b").join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
    n = F.size(F.array_intersect("sa", "sb"))
    return settle(both.where(100 * n >= percent * (F.size("sa") + F.size("sb") - n)).select("a", "b").distinct())


def alike(pairs: DataFrame, classes: DataFrame, matches: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose signatures have enough equal coordinates and whose sizes allow the threshold."""
    one = lambda c: classes.select(F.col("id").alias(c), F.col("sig").alias(f"s{c}"), F.col("n").alias(f"n{c}"))
    both = pairs.join(one("a"), "a").join(one("b"), "b")
    fit = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    same = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda x: x))
    return both.where(fit & (same >= matches)).select("a", "b")


def shared_sets(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(id, shared): the sorted shingles that each of ``members`` (id, component) shares with members of other components."""
    each = members.join(sets, "id").select("id", "component", F.explode("set").alias("sh"))
    across = each.groupBy("sh").agg((F.min("component") != F.max("component")).alias("x")).where("x").select("sh")
    return each.join(across, "sh").groupBy("id").agg(F.array_sort(F.collect_list("sh")).alias("shared"))


def merge_lists(lists: DataFrame, matches: int, percent: int) -> DataFrame:
    """(a, b) of linked members of one list (key, i, j) in different components.

    A pair is checked in the first list that it shares, if both have enough equal coordinates and the intersection
    that a link needs, percent / (100 + percent) of both sizes, is at most what either shares with other components;
    the check counts common shingles among these. ``lists`` has key, i, j, side, id, component, n, shared, sig, keys;
    rows are streamed in the order of their lists, and of a list a block pair at a time is held.
    """
    schema = T.StructType([T.StructField("a", lists.schema["id"].dataType), T.StructField("b", lists.schema["id"].dataType)])

    def pairs_of(t: pa.Table) -> list[tuple[int, int]]:
        ids, comp, side, n = (t.column(c).to_numpy() for c in ("id", "component", "side", "n"))
        here = t.column("key")[0].as_py()
        nested = {c: t.column(c).combine_chunks() for c in ("sig", "shared", "keys")}
        nested = {c: x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for c, x in nested.items()}
        sig = nested["sig"].flatten().to_numpy().reshape(len(t), -1)
        shared, own = nested["shared"].flatten().to_numpy(), np.diff(nested["shared"].offsets.to_numpy())
        first = np.append(0, np.cumsum(own))
        n_keys = np.diff(nested["keys"].offsets.to_numpy())
        keys = np.full((len(t), n_keys.max()), np.iinfo(np.int64).max)
        keys[np.arange(keys.shape[1])[None, :] < n_keys[:, None]] = nested["keys"].flatten().to_numpy()
        left, right = np.flatnonzero(side <= 0), np.flatnonzero(side >= 0)
        out = []
        for x in left:
            y = right[(comp[right] != comp[x]) & ((100 + percent) * np.minimum(own[x], own[right]) >= percent * (n[x] + n[right]))]
            y = y[(sig[y] == sig[x]).sum(1) >= matches]
            before = keys[x][keys[x] < here]
            if len(before) and len(y):
                y = y[~np.isin(keys[y], before).any(1)]
            if not len(y):
                continue
            other = np.concatenate([shared[first[k] : first[k + 1]] for k in y])
            mine = shared[first[x] : first[x + 1]]
            hit = mine[np.minimum(np.searchsorted(mine, other), len(mine) - 1)] == other
            both = np.add.reduceat(hit, np.append(0, np.cumsum(own[y])[:-1]), dtype=np.int64)
            y = y[100 * both >= percent * (n[x] + n[y] - both)]
            out += [(min(ids[x], k), max(ids[x], k)) for k in ids[y]]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            names = np.stack([held.column(c).to_numpy() for c in ("key", "i", "j")], 1)
            cut = np.flatnonzero((names[1:] != names[:-1]).any(1)) + 1
            if len(cut):
                yield from emit(held.slice(0, cut[-1]), np.append(0, cut))
                held = held.slice(cut[-1]).combine_chunks()
        if held is not None and len(held):
            yield from emit(held, np.array([0, len(held)]))

    def emit(t: pa.Table, cut: np.ndarray) -> Iterator[pa.RecordBatch]:
        for x, y in zip(cut, cut[1:]):
            found = pairs_of(t.slice(x, y - x)) if y - x > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([int(c[k]) for c in found], schema_of) for k in (0, 1)], ["a", "b"])

    schema_of = pa.int64() if schema[0].dataType == T.LongType() else pa.int32()
    return lean(lists.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j"), run, schema).distinct()


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row.

    Two documents are linked if 100 * intersection >= percent * union of their distinct ``size``-word shingles; a
    shorter text is one shingle, and a null or empty text or one without words has none and no links.
    ``component_id`` is the smallest id reachable over links, the document's own included; ``kept`` marks it. One row
    per row; rows of one id are one document with several texts. A null id has no links, a null component, and is
    kept. Ids must be integers; no rows give no rows. Every pair with ``least_matches`` equal coordinates is checked on
    the full sets; a pair at the threshold has fewer with a probability of about one in a million.
    """
    matches = least_matches(percent)
    rows = settle(profile(docs, doc_id, text, size))
    classes = settle(rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("id"), F.min_by("sig", "doc_id").alias("sig")))
    posts = classes.select("id", F.explode("sig").alias("key"))
    often = posts.groupBy("key").agg(F.count("*").alias("posted")).where("posted > 1")
    by = posts.join(often, "key").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("posted", "key"))).alias("lists"))
    by = by.where(F.size("lists") >= matches).select("id", F.explode(F.slice("lists", F.lit(1), F.size("lists") - (matches - 1))).alias("l")).select("id", F.col("l.key").alias("key"))
    prefix = settle(by)
    hubs = prefix.groupBy("key").agg(F.min("id").alias("a"))
    star = settle(alike(prefix.join(hubs, "key").where("id <> a").select("a", F.col("id").alias("b")).distinct(), classes, matches, percent))
    wanted = settle(star.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    sets = settle(full_sets(docs, wanted, doc_id, text, size))
    near = confirmed(star, sets, percent)
    forget(star, wanted, sets)
    # several texts of one id join their classes
    several = rows.where("n > 0").groupBy("doc_id").agg((F.min(F.struct("h1", "h2")) != F.max(F.struct("h1", "h2"))).alias("s")).where("s").select("doc_id")
    own = rows.select("doc_id", "h1", "h2", "n").join(several, "doc_id").join(classes.drop("sig"), ["h1", "h2", "n"]).where("doc_id <> id")
    first = settle(components(near.unionAll(own.select(F.col("doc_id").alias("a"), F.col("id").alias("b")))))
    forget(near)
    labelled = settle(prefix.join(first.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("component")))
    mixed = labelled.groupBy("key").agg((F.min("component") != F.max("component")).alias("open")).where("open")
    open_lists = settle(labelled.join(mixed.select("key"), "key"))
    forget(labelled, prefix)
    members = settle(open_lists.select("id", "component").distinct())
    sets = settle(full_sets(docs, members.select("id"), doc_id, text, size))
    able = members.select("id").join(classes.select("id", "n", "sig"), "id").join(shared_sets(members, sets), "id")
    # the smallest partner that a link allows has percent / 100 of its size
    able = settle(able.where(100 * F.size("shared") >= percent * F.col("n")))
    forget(sets, members)
    dealt = open_lists.join(able.select("id"), "id")
    dealt = settle(dealt.join(dealt.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "key"))
    with_keys = able.join(dealt.groupBy("id").agg(F.collect_list("key").alias("keys")), "id")
    blocks = dealt.withColumn("blocks", F.ceil(F.col("m") / BLOCK)).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    # a member of block k meets the blocks k.. as the left side, and the blocks ..k as the right
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    blocks = blocks.select("key", "id", "component", "own", other).select("key", "id", "component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), -1).otherwise(1).alias("side"))
    more = settle(merge_lists(blocks.join(with_keys, "id"), matches, percent))
    forget(open_lists, able, dealt)
    if not more.isEmpty():  # components of components
        last, first = first, settle(components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more)))
        forget(last)
    of_class = classes.join(first.withColumnRenamed("node", "id"), "id", "left").select("h1", "h2", "n", F.coalesce("component", "id").alias("component_id"))
    out = rows.drop("sig").join(of_class, ["h1", "h2", "n"], "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
