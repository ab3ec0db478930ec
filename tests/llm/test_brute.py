"""Whole queries against plain versions on the smallest tables."""

import collections
import hashlib
import html
import math
import re
import zlib

import duckdb
import pytest

from pyspark.sql import functions as F

from terrachron.llm import lm_score, queries
from terrachron.llm.html_extract import content_blocks

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return sorted((i, t or "") for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())


def tokens(t):
    return t.encode().lower().split()


def test_base_scores(spark, docs):
    c = collections.Counter()
    for i, t in docs:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update([*tokens(t), b"\n"])
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in queries.op3_lm_score(spark, SF).collect()}
    for i, t in docs:
        ws = [*tokens(t), b"\n"]
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(c[w] > 0 for w in ws), n, zlib.crc32(str(i).encode()) % 7 == 2)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_split_shards_score_alike(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(8, "doc_id").withColumn("held_out", F.col("doc_id") % 5 == 0)
    whole = {r.doc_id: r for r in lm_score.score_texts(docs).collect()}
    monkeypatch.setattr(lm_score, "SHARD_BYTES", 9000)
    split = {r.doc_id: r for r in lm_score.score_texts(docs).collect()}
    assert split.keys() == whole.keys()
    for i, r in split.items():
        assert r[:5] == whole[i][:5]
        assert (r.base_score, r.score) == pytest.approx((whole[i].base_score, whole[i].score))


def test_every_bigram_counts(spark, docs):
    table = spark.read.parquet(f"{SF}/documents.parquet").withColumn("held_out", F.col("doc_id") % 5 == 0)
    uni, bi = collections.Counter(), collections.defaultdict(collections.Counter)
    for i, t in docs:
        if i % 5:
            before = b"\n"
            for w in [*tokens(t), b"\n"]:
                uni[w] += 1
                bi[before][w] += 1
                before = w
    n, pairs = sum(uni.values()), [c for f in bi.values() for c in f.values()]
    d1, d2 = (lm_score.discounts([sum(c == k for c in cs) for k in (1, 2, 3, 4)]) for cs in (list(uni.values()), pairs))
    unseen = sum(d1[min(c, 3)] for c in uni.values()) / n
    fail = {w: sum(d2[min(c, 3)] for c in f.values()) / uni[w] for w, f in bi.items()}
    want = {}
    for i, t in docs:
        before, want[i] = b"\n", 0.0
        for w in [*tokens(t), b"\n"]:
            low, c = (uni[w] - d1[min(uni[w], 3)]) / n if uni[w] else unseen, bi[before][w] if before in bi else 0
            want[i] += math.log10(((c - d2[min(c, 3)]) / uni[before] if c else 0.0) + fail.get(before, 1.0) * low)
            before = w
    assert {r.doc_id: r.score for r in lm_score.score_texts(table).collect()} == pytest.approx(want)


def test_scores_do_not_depend_on_the_layout(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("held_out", F.col("doc_id") % 5 == 0)
    one = {r.doc_id: r.score for r in lm_score.score_texts(docs.coalesce(1)).collect()}
    monkeypatch.setattr(lm_score, "FLUSH_TOKENS", 2000)
    assert {r.doc_id: r.score for r in lm_score.score_texts(docs.repartition(7)).collect()} == pytest.approx(one)


def test_near_duplicates(spark, docs):
    sets = {}
    for i, t in docs:
        w = tokens(t)
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op7_near_duplicates(spark, SF).collect()}
    assert got == {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


def test_fingerprints(spark, docs):
    got = {r.doc_id: r for r in queries.op8_fingerprints(spark, SF).collect()}
    for k, (i, t) in enumerate(docs):
        q, after = len(t) // 4, docs[(k + 1) % len(docs)][1]
        edited = t[: len(t) - q] + after[:q]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
    assert sum(r.near_edited > r.near_next for r in got.values()) >= 0.98 * len(got)


def test_pages(spark):
    pages = duckdb.sql(f"SELECT page_id, html FROM '{SF}/pages.parquet'").fetchall()
    got = {r.page_id: (r.text, r.n_chars) for r in queries.op2_html_extract(spark, SF).collect()}
    for i, h in pages:
        article = re.search(r"<article>(.*?)(</article>|$)", h, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<(?:!--|/?[a-zA-Z])[^>]*>?", " ", re.sub(r"</?b>", "", article))).split())
        assert got[i] == (want, len(want))


def test_pages_without_marks():
    """With neutral tags and no classes, text from outside the article stays in few pages, and no text of it is lost."""
    pages = duckdb.sql("SELECT page_id, html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()
    more = 0
    for _, h in pages:
        want = content_blocks(h)
        got = content_blocks(re.sub(r' class="[^"]*"', "", re.sub(r"<(/?)(?:article|main|nav|header|footer|aside)\b", r"<\1div", h)))
        assert " ".join(want) in " ".join(got)
        more += want != got
    assert more <= 0.1 * len(pages)


def test_benchmark_passages(spark, docs):
    norm = lambda t: re.findall(r"\w+", t.lower())
    grams = {tuple(w[k : k + 13]) for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall() for w in [norm(t)] for k in range(len(w) - 12)}
    want = {i for i, t in docs for w in [norm(t)] if any(tuple(w[k : k + 13]) in grams for k in range(len(w) - 12))}
    assert {r.doc_id for r in queries.op9_decontaminate(spark, SF).collect() if r.contaminated} == want


def test_quality_of_labelled_documents(spark):
    got = {r.doc_id: r.kept for r in queries.op1_quality(spark, "/root/testdata/sf0.01").collect()}
    labels = duckdb.sql("SELECT doc_id, quality, toxic FROM '/root/testdata/sf0.01/labels.parquet'").fetchall()
    bad = [got[i] for i, q, _ in labels if q == 0]
    good = [got[i] for i, q, t in labels if q == 1 and not t]
    assert sum(bad) < 0.25 * len(bad) and sum(good) > 0.98 * len(good)


def test_pipeline(spark):
    import corpus_pipeline

    rows = queries.pipeline(spark, SF).collect()
    ids = [r.doc_id for r in rows]
    assert len(set(ids)) == len(ids) and all(0 < r.taken <= 2 * r.size for r in rows)
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality"
    per = collections.defaultdict(int)
    for r in rows:
        per[r.source, r.target] += r.taken
    assert all(abs(t - n) <= 0.5 for (_, t), n in per.items())
