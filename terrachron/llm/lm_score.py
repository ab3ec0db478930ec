"""Language-model scores from a weighted backoff automaton of word n-grams.

The automaton has a state for the end mark and for each training word, and a root. A state's arcs are the bigrams seen
after it; on any other word its failure arc leads to the root, whose arcs are the words seen, and one for all others.
A text is read once from left to right: the state is the word before, every arc adds its log10 weight.

Each run of texts sends its distinct bigrams once, with their training counts, to shards by the context's hash. A shard
knows all of its contexts: it answers each run with the bigrams' totals and with the contexts' counts and followers,
which are the words' own counts too, as every training word is a context once each time it is seen. The arcs of hot
contexts (found by ``frequent_words``) are dealt by the following word instead, and their followers are summed over the
shards; which contexts these are moves work only, never a score. Within a context a word is known by 40 bits of its hash.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrachron.llm.shared import settle
from terrachron.llm.textcore import as_text, chunks, words

END = np.uint64(1)
FLUSH_TOKENS = 1_000_000
LOCAL_SHARE, GLOBAL_SHARE = 0.0002, 0.0001
#: Bytes of text for each shard, and the least number of shards.
SHARD_BYTES, LEAST_SHARDS = 16 << 20, 16
WORD_BITS = 40
_codec = pa.Codec("zstd", compression_level=1)


def pack(*arrays: object) -> bytes:
    raw = pickle.dumps(arrays, protocol=5)
    return len(raw).to_bytes(8, "little") + _codec.compress(raw, asbytes=True)


def unpack(blob: bytes) -> tuple:
    return pickle.loads(_codec.decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True))


def planes(n_bytes: int, a: np.ndarray) -> bytes:
    """The low bytes of whole numbers, the first byte of all before the second of all, so that zeros compress."""
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n_bytes].T).tobytes()


def press(head: tuple[int, ...], *columns: tuple[int, np.ndarray]) -> bytes:
    """Numbers ``head``, then columns by ``planes``: a few bytes besides the data, as there is a blob for each run and shard."""
    raw = b"".join([np.array(head, dtype="<i8").tobytes(), *(planes(k, a) for k, a in columns)])
    return len(raw).to_bytes(8, "little") + _codec.compress(raw, asbytes=True)


def unpress(blob: bytes, n_head: int, widths: tuple[int, ...], counts) -> tuple[list[int], list[np.ndarray]]:
    """What ``press`` took; ``counts`` gives the columns' lengths from the head."""
    raw = np.frombuffer(_codec.decompress(blob[8:], int.from_bytes(blob[:8], "little")), dtype=np.uint8)
    head = [int(x) for x in raw[: 8 * n_head].view("<i8")]
    out, at = [], 8 * n_head
    for k, n in zip(widths, counts(head)):
        full = np.zeros((n, 8), dtype=np.uint8)
        full[:, :k] = raw[at : at + k * n].reshape(k, n).T
        out.append(full.view("<u8").ravel())
        at += k * n
    return head, out


def _flushes(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[list[tuple[pa.RecordBatch, int, int]], np.ndarray, np.ndarray]]:
    """Runs of whole texts: (their rows, token hashes with an END after each text, text numbers)."""
    rows, hs, ds, held, n_docs = [], [], [], 0, 0
    for b in batches:
        for i, j, data, off in chunks(as_text(b.column(column))):
            h, doc = words(data, off)
            n = j - i
            per = np.bincount(doc, minlength=n)
            out = np.full(len(h) + n, END, dtype=np.uint64)
            out[np.arange(len(h)) + doc] = h
            rows.append((b, i, j))
            hs.append(out)
            ds.append(np.repeat(np.arange(n_docs, n_docs + n), per + 1))
            n_docs += n
            held += len(out)
            if held >= FLUSH_TOKENS:
                yield rows, np.concatenate(hs), np.concatenate(ds)
                rows, hs, ds, held, n_docs = [], [], [], 0, 0
    if rows:
        yield rows, np.concatenate(hs), np.concatenate(ds)


def frequent_words(docs: DataFrame, text: str) -> np.ndarray:
    """Sorted hashes of END and of every word with more than LOCAL_SHARE + GLOBAL_SHARE of all tokens; some with less.

    Which of those with less are found depends on the runs, so no result may depend on them. A word is reported by each run of texts in which it has LOCAL_SHARE; those below it in a run lose less than
    LOCAL_SHARE in all, so words whose reports sum to GLOBAL_SHARE include all of them, and are at most 1/GLOBAL_SHARE.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, h, _ in _flushes(batches, text):
            keys, n = np.unique(h, return_counts=True)
            at = n >= max(2, LOCAL_SHARE * len(h))
            yield pa.RecordBatch.from_arrays([pa.array([None, *keys[at].view(np.int64).tolist()], pa.int64()), pa.array([len(h), *n[at].tolist()], pa.int64())], ["h", "n"])

    seen = docs.select(text).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    total = F.lit(GLOBAL_SHARE) * F.max(F.when(F.col("h").isNull(), F.col("n"))).over(Window.partitionBy(F.lit(0)))
    got = seen.withColumn("least", total).where("h IS NOT NULL AND n >= least").select("h").toArrow().column("h").to_numpy()
    return np.unique(np.append(got.astype(np.int64).view(np.uint64), END))


def _dealt(first: np.ndarray, hot_at: np.ndarray, hot_of: np.ndarray, context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The shard of each arc: that of the context's range of hashes, or for a hot context one that also moves with the word's."""
    n = len(first) - 1
    own = np.repeat(np.arange(n), np.diff(first))
    hot = np.full(len(own), -1)
    hot[hot_at] = hot_of
    return np.where(hot[context] < 0, own[context], (own[word] + hot[context]) % n)


def _arcs_of(at: np.ndarray, end: int, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts and words of the distinct arcs of a run of tokens, and the arc of each token."""
    before = np.empty(len(at), dtype=np.int64)
    before[0], before[1:] = end, at[:-1]
    arc, back = np.unique(before * n_words + at, return_inverse=True)
    return arc // n_words, arc % n_words, back


def _gathered(docs: DataFrame, doc_id: str, text: str, held: str, hot: np.ndarray, buckets: int) -> DataFrame:
    """(kind, key, n, blob): 'd' a run of documents with their tokens (its key is negative), 'e' a run's arcs for a shard."""
    edges = np.array([(b << 64) // buckets for b in range(1, buckets)], dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for rows, h, doc in _flushes(batches, text):
            flush = part << 32 | seq
            seq += 1
            ids = pa.concat_arrays([b.column(doc_id)[i:j] for b, i, j in rows])
            out = np.concatenate([b.column(held)[i:j].to_numpy(zero_copy_only=False) for b, i, j in rows])
            uniq, at = np.unique(h, return_inverse=True)
            end = int(np.searchsorted(uniq, END))
            context, word, back = _arcs_of(at, end, len(uniq))
            n = np.bincount(back, weights=~out[doc], minlength=len(context)).astype(np.int64)
            first = np.concatenate([[0], np.searchsorted(uniq, edges), [len(uniq)]])
            hot_at = np.minimum(np.searchsorted(uniq, hot), len(uniq) - 1)
            hot_of = np.flatnonzero(uniq[hot_at] == hot)
            hot_at = hot_at[hot_of]
            shard = _dealt(first, hot_at, hot_of, context, word)
            order = np.argsort(shard, kind="stable")
            cut = np.searchsorted(shard[order], np.arange(buckets + 1))
            blobs = [("d", -1 - flush, pack(ids, out, np.bincount(doc, minlength=len(out)), len(at), end, first, hot_at, hot_of, planes(4, at)))]
            for b in range(buckets):
                e = order[cut[b] : cut[b + 1]]
                if len(e):
                    own, per = np.unique(context[e], return_counts=True)
                    blobs.append(("e", b, press((flush, len(own), len(e)), (8, np.diff(uniq[own], prepend=np.uint64(0))), (4, per), (WORD_BITS // 8, uniq[word[e]]), (4, n[e]))))
                if len(blobs) >= 64 or b == buckets - 1 and blobs:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*blobs), (pa.string(), pa.int64(), pa.binary()))], ["kind", "key", "blob"])
                    blobs = []

    return docs.select(doc_id, text, held).mapInArrow(run, "kind string, key long, blob binary")


def _sums(named: list[tuple[str, int, int]]) -> dict[str, pa.Array]:
    name, i, n = zip(*named) if named else ((), (), ())
    return {"kind": pa.array(name, pa.string()), "key": pa.array(i, pa.int64()), "n": pa.array(n, pa.int64()), "blob": pa.nulls(len(name), pa.binary())}


def _tallied(b: int, blobs: list[bytes], hot: np.ndarray) -> pa.Table:
    """Answers ('s') to a shard's runs: the totals of their contexts and arcs; and sums over the shard, by name."""
    runs = [unpress(x, 3, (8, 4, WORD_BITS // 8, 4), lambda head: (head[1], head[1], head[2], head[2])) for x in blobs]
    with np.errstate(over="ignore"):
        uniq, back = np.unique(np.concatenate([np.cumsum(c[0], dtype=np.uint64) for _, c in runs]), return_inverse=True)
    key = np.repeat(back, np.concatenate([c[1] for _, c in runs]).astype(np.int64)).astype(np.uint64) << np.uint64(WORD_BITS) | np.concatenate([c[2] for _, c in runs])
    arc, at = np.unique(key, return_inverse=True)
    del key
    n = np.bincount(at, weights=np.concatenate([c[3] for _, c in runs]), minlength=len(arc)).astype(np.int64)
    context = (arc >> np.uint64(WORD_BITS)).astype(np.int64)
    totals = [np.bincount(context, weights=n, minlength=len(uniq)).astype(np.int64), *(np.bincount(context[(n == k) if k < 3 else (n >= 3)], minlength=len(uniq)) for k in (1, 2, 3))]
    is_hot = np.isin(uniq, hot)
    count = totals[0][~is_hot]
    named = [("N", 0, int(count.sum())), ("V", 0, int((count > 0).sum()))] + [(kind, k, int((of == k).sum())) for kind, of in (("uni", count), ("bi", n)) for k in (1, 2, 3, 4)]
    hot_of = np.searchsorted(hot, uniq[is_hot])
    named += [(f"hot{k}", int(i), int(x)) for k, t in enumerate(totals) for i, x in zip(hot_of, t[is_hot]) if x]
    flushes, answers, i, j = [], [], 0, 0
    for (flush, n_contexts, n_arcs), _ in runs:
        own = back[i : i + n_contexts]
        flushes.append(-1 - flush)
        answers.append(press((b, n_contexts, n_arcs), *((5, t[own]) for t in totals), (5, n[at[j : j + n_arcs]])))
        i, j = i + n_contexts, j + n_arcs
    answered = pa.table({"kind": pa.array(["s"] * len(flushes), pa.string()), "key": pa.array(flushes, pa.int64()), "n": pa.nulls(len(flushes), pa.int64()), "blob": pa.array(answers, pa.binary())})
    return pa.concat_tables([answered, pa.table(_sums(named))])


def discounts(t: list[float]) -> np.ndarray:
    """Modified discounts for counts 1, 2 and from 3, from the counts of counts 1 to 4; kept inside (0, count)."""
    y = t[0] / max(1.0, t[0] + 2 * t[1])
    return np.array([0.0, *(min(max(k - (k + 1) * y * t[k] / max(1.0, t[k - 1]), 0.1 * k), 0.9 * k) for k in (1, 2, 3))])


class Weights:
    """What all states share, from sums over all shards; and a dense table of arcs between ``hot`` words, where there are any."""

    def __init__(self, hot: np.ndarray, pairs: np.ndarray, stats: dict[tuple[str, int], int]) -> None:
        width = len(hot) + 1
        table = pairs.reshape(len(hot), width)
        self.hot_count = table.sum(1)
        self.n_train = int(self.hot_count.sum()) + stats.get(("N", 0), 0)
        self.n_words = int((self.hot_count > 0).sum()) + stats.get(("V", 0), 0)
        uni, bi = ([stats.get((kind, k), 0) + int((of == k).sum()) for k in (1, 2, 3, 4)] for kind, of in (("uni", self.hot_count), ("bi", table[:, 1:])))
        self.d1, self.d2 = discounts(uni), discounts(bi)
        seen = self.hot_count[self.hot_count > 0]
        lost = float(self.d1[np.minimum(seen, 3)].sum()) + self.d1[1] * stats.get(("uni", 1), 0) + self.d1[2] * stats.get(("uni", 2), 0) + self.d1[3] * (stats.get(("V", 0), 0) - stats.get(("uni", 1), 0) - stats.get(("uni", 2), 0))
        self.unseen = lost / self.n_train if self.n_train else 1.0
        get = lambda name: np.array([stats.get((name, i), 0) for i in range(width)], dtype=np.float64)
        self.after = get("sum") + table.sum(0)
        by = [get(f"n{k}") + (((table == k) if k < 3 else (table >= 3)).sum(0)) for k in (1, 2, 3)]
        self.fail = self.failure(self.after, by)
        self.fail[0] = 1.0  # the root
        self.after[0] = 0
        self.hot_logp = self.log_arc(np.repeat(self.hot_count, width), np.tile(np.arange(width), len(hot)), pairs)

    def log_arc(self, count: np.ndarray, state: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """log10 of the weight from ``state`` on a word of ``count`` that followed it ``pair`` times."""
        return self.weigh(count, self.after[state], self.fail[state], pair)

    def weigh(self, count: np.ndarray, after: np.ndarray, fail: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """The same for states of ``after`` words in all that fail with weight ``fail``."""
        low = np.where(count > 0, (count - self.d1[np.minimum(count, 3)]) / max(1, self.n_train), self.unseen)
        own = np.where((pair > 0) & (after > 0), (pair - self.d2[np.minimum(pair, 3)]) / np.maximum(1, after), 0.0)
        return np.log10(np.maximum(own + fail * low, 1e-300))

    def failure(self, after: np.ndarray, by: list[np.ndarray]) -> np.ndarray:
        """The weights of failure of states with ``by`` followers seen once, twice and more often."""
        return np.where(after > 0, sum(self.d2[k + 1] * by[k] for k in range(3)) / np.maximum(1, after), 1.0)


def score_texts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", held_out: str = "held_out") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row; learns from rows not ``held_out``.

    All scores are log10 and count the end mark. Words that training lacks are one word, as in the base. One row per
    input row, repeated ids included; null or empty texts are just the end mark; a null ``held_out`` counts as false;
    an empty table gives an empty result. Nothing is pruned: counts cover every training text, and every word of it is a state.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(held_out), F.lit(False)).alias("held_out"))
    hot = frequent_words(docs, "text")
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(LEAST_SHARDS, -(-n_bytes // SHARD_BYTES))
    # as many tasks as shards at least, so that no task's share grows with the input
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * buckets)
    gathered = _gathered(docs, "doc_id", "text", "held_out", hot, buckets)

    def tallied(group: pa.Table) -> pa.Table:
        kind, key = group.column("kind")[0].as_py(), group.column("key")[0].as_py()
        if kind == "d":  # the runs themselves pass through, so that the texts are read and split once
            return group.select(["kind", "key"]).append_column("n", pa.nulls(len(group), pa.int64())).append_column("blob", group.column("blob"))
        return _tallied(key, group.column("blob").to_pylist(), hot)

    table = settle(gathered.repartition(tasks, "key").groupBy("key").applyInArrow(tallied, "kind string, key long, n long, blob binary"))
    stats = {(r.kind, r.key): r.n for r in table.where("n IS NOT NULL").groupBy("kind", "key").agg(F.sum("n").alias("n")).collect()}  # at most 4 * 10001 + 10 sums
    hot_totals = [np.array([stats.pop((f"hot{k}", i), 0) for i in range(len(hot))], dtype=np.int64) for k in range(4)]
    seen = hot_totals[0]
    for name, n in (("N", int(seen.sum())), ("V", int((seen > 0).sum()))):
        stats[name, 0] = stats.get((name, 0), 0) + n
    for k in (1, 2, 3, 4):
        stats["uni", k] = stats.get(("uni", k), 0) + int((seen == k).sum())
    weights = docs.sparkSession.sparkContext.broadcast((Weights(hot[:0], np.zeros(0, dtype=np.int64), stats), hot_totals))
    schema = docs.select("doc_id", "held_out").schema.add("n_tokens", "long").add("n_known", "long").add("train_tokens", "long").add("base_score", "double").add("score", "double")

    def whole(flush: pa.Table) -> pa.Table:
        w, hot_total = weights.value
        by = list(zip(flush.column("kind").to_pylist(), flush.column("blob").to_pylist()))
        ids, out, n_tokens, n, end, first, hot_at, hot_of, at = unpack(next(b for k, b in by if k == "d"))
        at = sum(p.astype(np.int64) << 8 * i for i, p in enumerate(np.frombuffer(at, dtype=np.uint8).reshape(4, n)))
        context, word, back = _arcs_of(at, end, int(first[-1]))
        shard = _dealt(first, hot_at, hot_of, context, word)
        order = np.argsort(shard, kind="stable")
        answers = sorted((unpress(b, 3, (5,) * 5, lambda head: (head[1],) * 4 + (head[2],)) for k, b in by if k == "s"), key=lambda x: x[0][0])
        pair = np.empty(len(order), dtype=np.int64)
        pair[order] = np.concatenate([c[4] for _, c in answers])
        starts = np.append(True, (np.diff(context[order]) != 0) | (np.diff(shard[order]) != 0))
        totals = []
        for k in range(4):
            t = np.zeros(int(first[-1]), dtype=np.int64)
            t[context[order][starts]] = np.concatenate([c[k] for _, c in answers])
            t[hot_at] = hot_total[k][hot_of]
            totals.append(t)
        count, fail = totals[0], w.failure(totals[0], totals[1:])
        arc = w.weigh(count[word], count[context], fail[context], pair)
        of = np.repeat(np.arange(len(out)), n_tokens)
        known = np.bincount(of, weights=count[at] > 0, minlength=len(out))
        base = np.bincount(of, weights=np.log10(count + 1.0)[at], minlength=len(out)) - n_tokens * np.log10(w.n_train + w.n_words + 1.0)
        score = np.bincount(of, weights=arc[back], minlength=len(out))
        return pa.table({"doc_id": ids, "held_out": pa.array(out, pa.bool_()), "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(known.astype(np.int64)), "train_tokens": pa.array(np.full(len(out), w.n_train, dtype=np.int64)), "base_score": pa.array(base), "score": pa.array(score)})

    return table.where("kind IN ('d', 's')").select("key", "kind", "blob").repartition(tasks, "key").groupBy("key").applyInArrow(whole, schema)
