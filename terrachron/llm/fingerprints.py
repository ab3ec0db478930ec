"""Document fingerprints by locally consistent parsing.

A text is cut where only a few neighbours decide: runs of one symbol are joined, deterministic coin tossing turns each
symbol and the one before into a small label, and local maxima of the labels start phrases. A phrase is named by a
hash of its symbols; names are the symbols of the next level. So equal substrings get the same phrases inside, at any
offset. A fingerprint keeps, in 64 bins, the least name of the first, the second and all higher levels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrachron.llm.shared import settle
from terrachron.llm.textcore import chunks, mix, powers

#: Bins of the levels 1, 2, and 3 and above.
BINS = (16, 24, 24)
N_BINS = sum(BINS)
EMPTY = np.uint32(0xFFFFFFFF)
ENOUGH = 12
#: Bytes of text in a block, blocks at most (they get larger then), sampled rows for each block, and bytes read at a time.
BLOCK_BYTES, MOST_BLOCKS, SAMPLED, SLICE_BYTES = 4 << 20, 20_000, 50, 4 << 20
_NAMES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _toss(x: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Twice the lowest bit in which x differs from the symbol before, plus that bit of x."""
    d = x ^ before
    low = np.bitwise_count((d & (~d + d.dtype.type(1))) - d.dtype.type(1))
    return (low.astype(np.uint8) << 1) | ((x >> low.astype(x.dtype)) & x.dtype.type(1)).astype(np.uint8)


def _table(symbols: int) -> np.ndarray:
    x, before = np.meshgrid(np.arange(symbols, dtype=np.uint8), np.arange(symbols, dtype=np.uint8))
    return _toss(x.ravel(), before.ravel()) & 0x1F


_PAIR, _WIDE, _LABEL = _table(256), _table(128), _table(32)


def _starts(label: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where phrases start: local maxima of labels that were tossed again until they are few, and first symbols."""
    for _ in range(2):
        before = np.empty_like(label)
        before[0], before[1:] = 31, label[:-1]
        before[first] = 31
        label = _LABEL[(before.astype(np.uint16) << 5) | label]
    up = np.empty(len(label), dtype=bool)
    up[0], up[1:] = True, label[1:] > label[:-1]
    down = np.empty(len(label), dtype=bool)
    down[-1], down[:-1] = True, label[:-1] > label[1:]
    down[first[1:] - 1] = True
    out = up & down
    out[first] = True
    return np.flatnonzero(out)


def _joined(x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of runs of equal symbols, and their lengths."""
    new = np.empty(len(x), dtype=bool)
    new[0], new[1:] = True, x[1:] != x[:-1]
    new[first] = True
    at = np.flatnonzero(new)
    return at, np.diff(np.append(at, len(x)))


def sketches(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(texts, N_BINS) least names, EMPTY where a bin has none, of the UTF-8 texts between ``off``."""
    n = len(off) - 1
    out = np.full((n, N_BINS), EMPTY, dtype=np.uint32)
    some = np.flatnonzero(np.diff(off))  # texts with symbols
    if not len(some):
        return out
    first = off[some]  # first symbols
    flat = out.reshape(-1)
    x, label, level = data, None, 0
    while level < 12 and len(x):
        at, run = _joined(x, first)
        first = np.searchsorted(at, first)
        x = x[at]
        before = np.empty_like(x)
        before[0], before[1:] = x.dtype.type(0), x[:-1]
        before[first] = x.dtype.type(0)
        if x.dtype == np.uint8:
            label = _PAIR[(before.astype(np.uint16) << 8) | x]
            name = _NAMES[x]
        else:
            tossed = _toss(x, before) & np.uint8(0x7F)
            label = np.empty_like(tossed)
            label[0], label[1:] = 0x7F, tossed[:-1]
            label[first] = 0x7F
            label = _WIDE[(label.astype(np.uint16) << 7) | tossed]
            name = x
        with np.errstate(over="ignore"):
            name = np.where(run > 1, mix(name + run.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), name)
            start = _starts(label, first)
            up, down = powers(len(name) + 1)
            total = np.zeros(len(name) + 1, dtype=np.uint64)
            np.cumsum(name * up[: len(name)], out=total[1:])
            end = np.append(start[1:], len(name))
            x = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
        first = np.searchsorted(start, first)
        level += 1
        of = np.zeros(len(x), dtype=np.int64)
        of[first[1:]] = 1
        of = some[np.cumsum(of)]
        group = min(level, 3) - 1
        bins = sum(BINS[:group]) + ((x >> np.uint64(32)) * np.uint64(BINS[group]) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(flat, of * N_BINS + bins, (x & np.uint64(0xFFFFFFFE)).astype(np.uint32))
        more = np.diff(np.append(first, len(x))) > 1  # texts that are one phrase are done
        if not more.any():
            break
        keep = np.repeat(more, np.diff(np.append(first, len(x))))
        size = np.diff(np.append(first, len(x)))[more]
        x, some = x[keep], some[more]
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
    return out


def as_strings(sketch: np.ndarray) -> list[str]:
    """Four characters for each bin: its least name's low half in hex, dots if it is empty."""
    table = [["...." if v == EMPTY else f"{(int(v) >> 1) & 0xFFFF:04x}" for v in row] for row in sketch]
    return ["".join(row) for row in table]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of the bins filled in either that agree, from 0 to 1; the first level only counts for short texts. Two empty ones are alike."""
    rest = slice(BINS[0], None)
    have = lambda s, cols: (s[:, cols] != EMPTY).sum(1)
    long = (have(a, rest) >= ENOUGH) & (have(b, rest) >= ENOUGH)
    fill = (a != EMPTY) | (b != EMPTY)
    fill[long, : BINS[0]] = False
    same = (((a >> 1) & 0xFFFF) == ((b >> 1) & 0xFFFF)) & (a != EMPTY) & (b != EMPTY) & fill
    n = fill.sum(1)
    return np.where(n > 0, same.sum(1) / np.maximum(1, n), 1.0)


def sketch_texts(texts: list[str]) -> np.ndarray:
    column = pa.array(texts, pa.large_string())
    return np.concatenate([sketches(data, off) for _, _, data, off in chunks(column, 1 << 19)]) if texts else np.zeros((0, N_BINS), np.uint32)


def bounds_of(rows: DataFrame) -> tuple[list[int], list[int]]:
    """Where blocks of about BLOCK_BYTES begin, as (at, h) in order: quantiles of a sample, at most MOST_BLOCKS - 1 of them."""
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    blocks = int(min(MOST_BLOCKS, -(-size // BLOCK_BYTES)))
    if blocks < 2:
        return [], []
    share = min(1.0, SAMPLED * blocks / n)
    t = rows.where(F.rand(7) < share).select("at", "h", "bytes").toArrow()  # about SAMPLED * MOST_BLOCKS rows at most
    at, h = t.column("at").to_numpy(), t.column("h").to_numpy()
    order = np.lexsort((h, at))
    weight = np.cumsum(t.column("bytes").to_numpy()[order] + 1)
    cut = order[np.searchsorted(weight, weight[-1] * np.arange(1, blocks) / blocks)] if len(order) else order
    return at[cut].tolist(), h[cut].tolist()


def block_of(bounds: tuple[list[int], list[int]]) -> Column:
    """The block of a row (at, h) by binary search; rows that several bounds equal are dealt out among their blocks."""
    n = len(bounds[0])
    if not n:
        return F.lit(0)
    a, h = (f"cast(split('{','.join(map(str, b))}', ',') AS array<bigint>)" for b in bounds)  # folded to one constant (a transform isn't)
    steps = n.bit_length()

    def found(less: str) -> str:
        """How many bounds are less than the row, or (``<=``) not above it."""
        j = f"(lo + shiftleft(1, {steps - 1} - k))"
        here = lambda b: f"element_at({b}, {j})"
        return f"aggregate(sequence(0, {steps - 1}), 0, (lo, k) -> if({j} <= {n} and ({here(a)} < at or ({here(a)} = at and {here(h)} {less} h)), {j}, lo))"

    return F.transform(
        F.array(F.struct(F.expr(found("<")).alias("a"), F.expr(found("<=")).alias("b"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(MOST_BLOCKS * 1000)).alias("r"))),
        lambda x: F.when(x["b"] - x["a"] > 1, x["a"] + 1 + (x["r"] % (x["b"] - x["a"])).cast("int")).otherwise(x["b"]),
    )[0]


def with_following(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(block, tail, at, h, doc_id, text): blocks of neighbouring rows, each with the first row of the block that follows as its tail.

    Rows are in the order of their ids (null last), then of a hash of their text. The block after the last is the first.
    Blocks have about the same bytes, however ids are spread; many equal rows make several blocks.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumns({"at": F.coalesce("doc_id", F.lit((1 << 63) - 1)), "h": F.xxhash64(F.coalesce("text", F.lit(""))), "bytes": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")})
    rows = rows.withColumn("block", block_of(bounds_of(rows)))
    heads = settle(rows.groupBy("block").agg(F.min(F.struct("at", "h")).alias("head")).select("block", "head.at", "head.h"))  # a row for each block, at most MOST_BLOCKS
    order = Window.orderBy("block")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.withColumn("to", F.coalesce(F.lag("block").over(order), F.max("block").over(whole)))
    wanted = F.broadcast(heads.select(F.col("at").alias("_at"), F.col("h").alias("_h")).distinct())
    first = rows.join(wanted, (F.col("at") == F.col("_at")) & (F.col("h") == F.col("_h"))).groupBy("at", "h").agg(F.first("doc_id").alias("doc_id"), F.min(F.coalesce("text", F.lit(""))).alias("text"))
    tails = settle(first.join(F.broadcast(heads.select("at", "h", F.col("to").alias("block"))), ["at", "h"]).select("block", F.lit(True).alias("tail"), "at", "h", "doc_id", "text"))
    return rows.select("block", F.lit(False).alias("tail"), "at", "h", "doc_id", "text").unionByName(tails)


def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of about SLICE_BYTES of text each."""
    size = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False) + 1)
    cut = np.flatnonzero(np.diff(size // SLICE_BYTES, prepend=0))
    for i, j in zip([0, *cut], [*cut, b.num_rows]):
        if j > i:
            yield b.slice(i, j - i)


def fingerprint_edits(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of it with its last quarter replaced by the start of the next document.

    The next document is that with the next id, after the last the first; rows of one id are ordered by a hash of their
    text and null ids come last. Null texts are empty. Ids must be integers. One row per row: doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. A lone row is its own next; no rows give no
    rows. Texts are shuffled once, to blocks of about the same bytes, and streamed through Python in order.
    """
    kind = docs.schema[doc_id].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"{doc_id} must be a whole number, not {kind.simpleString()}")
    schema = T.StructType.fromDDL("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")

    def emitted(own: list[tuple[int, str]], after: list[str]) -> pa.RecordBatch:
        texts = [t for _, t in own]
        edited = [t[: len(t) - len(t) // 4] + u[: len(t) // 4] for t, u in zip(texts, after)]
        n = len(texts)
        # the next text of a row is the row after it, but at the end of a block
        at = np.arange(1, n + 1)
        odd = [k for k in range(n) if k + 1 == n or after[k] is not texts[k + 1]]
        at[odd] = n + np.arange(len(odd))
        a, e = sketch_texts([*texts, *(after[k] for k in odd)]), sketch_texts(edited)
        return pa.RecordBatch.from_arrays(
            [pa.array([i for i, _ in own], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()), pa.array(as_strings(a[:n]), pa.string()), pa.array(as_strings(e), pa.string()), pa.array(likeness(a[:n], e), pa.float64()), pa.array(likeness(a[:n], a[at]), pa.float64())],
            names=schema.names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, int, str] | None = None  # block, id and text of a row whose next hasn't come
        for b in batches:
            for s in _slices(b):
                own, after = [], []
                for block, tail, i, t in zip(s.column("block").to_pylist(), s.column("tail").to_pylist(), s.column("doc_id").to_pylist(), s.column("text").to_pylist()):
                    t = t or ""
                    if held is not None and held[0] == block:
                        own.append(held[1:])
                        after.append(t)
                    held = None if tail else (block, i, t)
                if own:
                    yield emitted(own, after)

    rows = with_following(docs, doc_id, text)
    return rows.repartition("block").sortWithinPartitions("block", "tail", "at", "h").select("block", "tail", "doc_id", "text").mapInArrow(run, schema)
