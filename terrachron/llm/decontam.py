"""Benchmark decontamination by template windows.

Numbers, names and units become typed placeholders, so that a question with other parameters keeps its template.
Windows of template tokens of the benchmark are hash-joined with those of the documents; windows that line up form a
passage, and in a passage equal slots of the item must hold equal values in the document. Items that differ in their
slots' values only are searched once, and by their rarest windows first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrachron.llm.shared import columns_free, lean, settle, small
from terrachron.llm.textcore import LOWER, as_text, chunks, hash_spans, mix, spans, windows

WIDTH = 8
SHORTEST = 5
#: Items with fewer tokens, but so many, are searched inside texts by their values; shorter ones must be the whole text.
INSIDE = 3
LITERALS = 4
#: Literal tokens of a window of an item that has no window with LITERALS.
FEW = 3
#: 13 words in a row.
RUN = 6
COVERED = 0.5
#: Bits of the filter for each window of the benchmark, and at least and at most in all; beyond, it lets more through.
BITS_PER_WINDOW, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 26
UNITS = "mm cm m km mg g kg t ml cl l ms s sec min h hr hrs hours hour minutes minute seconds second days day weeks week months month years year percent pct dollars dollar euros euro cents usd eur gbp miles mile feet foot ft inches inch in yards yard pounds lbs lb oz ounces ounce tons ton kb mb gb tb hz khz mhz ghz w kw kwh v a k c f j n pa bar mph kmh rpm".split()
NUMBER, NAME, UNIT = np.uint64(11), np.uint64(12), np.uint64(13)
EXACT = np.uint64(0x5851F42D4C957F2D)
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True
_STOP = np.zeros(256, dtype=np.int32)
_STOP[[ord(c) for c in ".!?:;\n|"]] = 1


def _unit_hashes() -> np.ndarray:
    text = " ".join(UNITS).encode()
    data = np.frombuffer(text, dtype=np.uint8)
    start, end, _ = spans(_WORD[data], np.array([0, len(data)]))
    return np.sort(hash_spans(data, start, end))


_UNITS = _unit_hashes()


def template(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Template hash, value hash and text number of each token of a run of texts.

    A token is a run of letters, digits or characters beyond ASCII. One that starts with a digit is a number (digit
    groups joined by one other character are one number), a known unit after a number is a unit, and one that starts
    with A-Z, goes on with a small letter and doesn't start a sentence is a name. All others are literal, with A-Z and the capitals of Latin-1 lowered.
    """
    start, end, doc = spans(_WORD[data], off)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), doc
    low = LOWER[data]
    low[1:] += np.where((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97), 32, 0).astype(np.uint8)
    value = hash_spans(low, start, end)
    head = data[start]
    number = (head >= 48) & (head <= 57)
    same = np.append(False, doc[1:] == doc[:-1])
    after = np.append(False, number[:-1]) & same
    joined = number & after & (np.append(0, start[1:] - end[:-1]) == 1) & ~np.isin(data[start - 1], (32, 10))
    stops = np.append(0, np.cumsum(_STOP[data]))
    opens = ~same | (np.append(0, stops[start[1:]] - stops[end[:-1]]) > 0)
    second = data[np.minimum(start + 1, len(data) - 1)]
    name = (head >= 65) & (head <= 90) & ~opens & (end - start > 1) & (((second >= 97) & (second <= 122)) | (second >= 128))
    at = np.minimum(np.searchsorted(_UNITS, value), len(_UNITS) - 1)
    unit = after & ~number & (_UNITS[at] == value)
    out = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, value)))
    keep = ~joined
    return out[keep], value[keep], doc[keep]


def _probes(h: np.ndarray, bits: int) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        return [mix(h + np.uint64(k)) & np.uint64(bits - 1) for k in (1, 2, 3)]


def _passes(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the filter, in words of 64 bits, may hold each hash."""
    return np.logical_and.reduce([(words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) for p in _probes(h, 64 * len(words))]).astype(bool)


def _kinds(t: np.ndarray, v: np.ndarray, doc: np.ndarray, n_docs: int, copied: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A value for each token, and two hashes for each text that are equal where its passages are met alike.

    What decides are the template and which slots hold equal values, so a slot's value is its first position in the
    text; in texts that are ``copied`` (searched by their values too) it is the value itself.
    """
    first = np.searchsorted(doc, np.arange(n_docs))
    order = np.lexsort((v, doc))
    new = np.append(True, (v[order][1:] != v[order][:-1]) | (doc[order][1:] != doc[order][:-1]))
    seen = np.empty(len(t), dtype=np.int64)
    seen[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    slot = (t == NUMBER) | (t == NAME) | (t == UNIT)
    with np.errstate(over="ignore"):
        value = np.where(slot & ~copied[doc], mix((seen - first[doc]).astype(np.uint64) + np.uint64(1)), v)
        token = mix(value ^ mix(np.where(slot, t, np.uint64(0))) ^ copied[doc].astype(np.uint64))
        at = (np.arange(len(t)) - first[doc]).astype(np.uint64)
        keys = np.zeros((2, n_docs), dtype=np.uint64)
        for k in (0, 1):
            np.add.at(keys[k], doc, mix(token ^ mix(at * np.uint64(2) + np.uint64(k))))
    return value, keys.view(np.int64)


def _windows(texts: DataFrame, sizes: list[int] | None, passes: object) -> DataFrame:
    """(id, size, h, pos, items, slots, exact, total, every, k1, k2) of the windows of each text.

    With ``sizes``, windows of these; else of WIDTH, or of the whole text where it has fewer tokens. Windows under
    SHORTEST tokens are exact, and those under INSIDE tokens must be whole texts. A window with too few literal tokens is ``exact``: its hash holds the values, so only copies meet it. An item
    that has only such windows takes those with FEW as templates; those of the texts are sought both ways. ``total``
    counts template windows, ``every`` all of them. ``passes``: a broadcast filter of hashes, or None. Without
    ``sizes``, ``items``, ``k1`` and ``k2`` are those of ``_kinds``; else they are the tokens' values, 0 and 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, off in chunks(as_text(b.column(1)), 1 << 18):
                t, v, doc = template(data, off)
                if not len(t):
                    continue
                literal = np.append(0, np.cumsum((t != NUMBER) & (t != NAME) & (t != UNIT)))
                n = np.bincount(doc, minlength=j - i)
                first = np.append(0, np.cumsum(n))
                values, keys = v, np.zeros((2, j - i), dtype=np.int64)
                for size in sizes or range(1, WIDTH + 1):
                    h, at = windows(t, doc, size)
                    own, _ = windows(v, doc, size)
                    n_literal = literal[at + size] - literal[at]
                    plain = (n_literal >= min(LITERALS, size - 1)) & (size >= SHORTEST)
                    if sizes is None or size < INSIDE:
                        ok = (n[doc[at]] == size) | (size == WIDTH)
                        h, own, at, n_literal, plain = h[ok], own[ok], at[ok], n_literal[ok], plain[ok]
                    if sizes is None:
                        none = np.bincount(doc[at][plain], minlength=j - i) == 0
                        plain |= none[doc[at]] & (n_literal >= FEW) & (size >= SHORTEST)
                        as_template, as_copy = plain, ~plain
                        values, keys = _kinds(t, v, doc, j - i, np.bincount(doc[at][~plain], minlength=j - i) > 0)
                    else:
                        as_template, as_copy = (n_literal >= FEW) & (size >= SHORTEST), ~plain
                    total = np.bincount(doc[at][plain], minlength=j - i)
                    every = np.bincount(doc[at], minlength=j - i)
                    exact = np.repeat([False, True], [as_template.sum(), as_copy.sum()])
                    h, at = np.append(h[as_template], mix(own[as_copy] ^ EXACT)), np.append(at[as_template], at[as_copy])
                    if passes is not None and len(h):
                        ok = _passes(passes.value, h)
                        h, at, exact = h[ok], at[ok], exact[ok]
                    if not len(h):
                        continue
                    for k in range(0, len(h), 20_000):
                        a = at[k : k + 20_000]
                        index = a[:, None] + np.arange(size)
                        slot = (t[index] == NUMBER) | (t[index] == NAME) | (t[index] == UNIT)
                        rows = doc[a]
                        cut = pa.array(np.arange(0, len(a) * size + 1, size), pa.int32())
                        yield pa.RecordBatch.from_arrays(
                            [b.column(0).take(pa.array(rows + i)), pa.array([size] * len(a), pa.int32()), pa.array(h[k : k + 20_000].view(np.int64)), pa.array(a - first[rows], pa.int64()), pa.ListArray.from_arrays(cut, pa.array(values[index].ravel().view(np.int64))), pa.ListArray.from_arrays(cut, pa.array(slot.ravel())), pa.array(exact[k : k + 20_000]), pa.array(total[rows], pa.int64()), pa.array(every[rows], pa.int64()), pa.array(keys[0][rows]), pa.array(keys[1][rows])],
                            ["id", "size", "h", "pos", "items", "slots", "exact", "total", "every", "k1", "k2"],
                        )

    key = texts.schema.fields[0].dataType
    schema = T.StructType([T.StructField("id", key), *T.StructType.fromDDL("size int, h bigint, pos bigint, items array<bigint>, slots array<boolean>, exact boolean, total bigint, every bigint, k1 bigint, k2 bigint").fields])
    return lean(texts, run, schema)


def _filter(hashes: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter over the ``n`` hashes ``h``, as words of 64 bits; these are merged on the executors, MOST_BITS / 64 at most."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_WINDOW * n - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.concatenate(_probes(b.column(0).to_numpy().view(np.uint64), bits))
            yield pa.RecordBatch.from_arrays([pa.array((p >> np.uint64(6)).view(np.int64)), pa.array((np.uint64(1) << (p & np.uint64(63))).view(np.int64))], ["at", "bit"])

    words = lean(hashes.select("h"), run, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[words.column("at").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def _needed() -> Column:
    """The least number of an item's windows that a contaminated document meets."""
    least = lambda of: F.least(F.lit(RUN), F.ceil(COVERED * F.col(of)))
    return F.greatest(F.lit(1), F.least(F.when(F.col("total") > 0, least("total")), least("every")))


def contaminated_documents(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, windows, coverage, n_items) of the documents that hold a benchmark passage, with the best covered item.

    A passage is windows of one item on one diagonal of positions; it counts if at most a tenth of the item's distinct
    slot values meet more than one value of the document. A document is contaminated if one passage has RUN windows
    (13 words), or all of the item's if it has fewer, or if its passages cover COVERED of an item; of template windows
    alone, or of all windows; a window that is met many times covers once. Items with under FEW literal words in each
    window, or under SHORTEST tokens, are searched for copies only, and those under INSIDE tokens as whole texts; null
    and empty texts hold nothing; rows of one id, null included, are one document. ``n_items`` counts items with other
    texts under one id each. The filter is destroyed when the hits are written.

    Items that differ in slot values only are one kind, met once. A document meets a kind only if it holds one of the
    kind's windows that are rarest among the documents, as many as any contaminated document must hold one of (prefix);
    so a window that many kinds and many documents share makes no row for each of both.
    """
    items = settle(_windows(benchmark.select(F.col(item_id), F.col(item_text)), None, None).withColumnRenamed("id", "item_id"))
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())  # at most WIDTH
    spark = docs.sparkSession
    if not sizes:
        return spark.createDataFrame([], T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("item_id", benchmark.schema[item_id].dataType), *T.StructType.fromDDL("windows bigint, coverage double, n_items bigint").fields]))
    n = items.count()
    kind, pair = ["k1", "k2"], ["d", "k1", "k2"]
    kinds = items.groupBy(*kind).agg(F.min_by(F.struct("item_id"), F.xxhash64("item_id")).alias("i"), F.countDistinct(F.struct("item_id")).alias("members"))
    lined = items.drop("item_id", "size").dropDuplicates([*kind, "pos"]).withColumnRenamed("pos", "item_pos")
    passes = spark.sparkContext.broadcast(_filter(items, n))
    # a null id is a document of its own
    hits = settle(_windows(docs.select(F.col(doc_id), F.col(text)), sizes, passes).select(F.struct(F.col("id").alias("doc_id")).alias("d"), "h", "pos", F.col("items").alias("values")))
    passes.destroy()
    found = hits.groupBy("h").agg(F.count("*").alias("found"))
    rank = F.row_number().over(Window.partitionBy(*kind).orderBy(F.coalesce("found", F.lit(0)), "item_pos"))
    lined = lined.join(found, "h", "left").withColumn("rare", rank <= F.col("every") - _needed() + 1)
    lined = settle(lined.where("found > 0").drop("found"))
    close = hits.select("d", "h").join(small(lined.where("rare").select("h", *kind), n, 200_000), "h").select(*pair).distinct()
    met = settle(close.join(small(lined, n, 200_000), kind).join(hits, ["d", "h"]).withColumn("diagonal", F.col("pos") - F.col("item_pos")))
    slots = met.where(F.exists("slots", lambda s: s)).select(*pair, "diagonal", F.explode(F.filter(F.arrays_zip("slots", "items", "values"), lambda z: z["slots"])).alias("z"))
    slots = slots.groupBy(*pair, "diagonal", "z.items").agg((F.min("z.values") != F.max("z.values")).cast("int").alias("odd"))
    mixed = slots.groupBy(*pair, "diagonal").agg((10 * F.sum("odd") > F.count("*")).alias("mixed")).where("mixed")
    good = met.join(mixed, [*pair, "diagonal"], "left_anti").select(*pair, "diagonal", "item_pos", "exact", "total", "every")
    counts = [F.countDistinct(F.when(~F.col("exact"), F.col("item_pos"))), F.countDistinct("item_pos")]
    runs = good.groupBy(*pair, "diagonal").agg(counts[0].alias("plain"), counts[1].alias("windows")).groupBy(*pair).agg(F.max("plain").alias("plain_run"), F.max("windows").alias("run"))
    per = good.groupBy(*pair, "total", "every").agg(counts[0].alias("plain"), counts[1].alias("windows")).join(runs, pair)
    enough = lambda run, n, of: (F.col(of) > 0) & ((F.col(run) >= F.least(F.lit(RUN), F.col(of))) | (F.col(n) >= COVERED * F.col(of)))
    per = per.where(enough("plain_run", "plain", "total") | enough("run", "windows", "every")).join(small(kinds, n, 200_000), kind)
    per = per.withColumn("coverage", F.greatest(F.col("plain") / F.nullif(F.col("total"), F.lit(0)), F.col("windows") / F.col("every")))
    best = F.max_by(F.struct(F.col("i.item_id").alias("item_id"), "windows", "coverage"), F.struct("coverage", "windows", (-F.xxhash64("i.item_id").cast("decimal(38,0)")).alias("tie")))
    return per.groupBy("d").agg(best.alias("b"), F.sum("members").alias("n_items")).select("d.doc_id", "b.item_id", "b.windows", "b.coverage", "n_items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the contaminated documents; other rows and all columns stay as they are."""
    (name,) = columns_free(docs, "found")
    found = settle(contaminated_documents(docs, benchmark, doc_id=doc_id, text=text).select(F.struct("doc_id").alias(name)))
    return docs.join(small(found, found.count()), F.struct(F.col(doc_id)) == F.col(name), "left_anti")
