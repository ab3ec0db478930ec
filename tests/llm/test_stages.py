"""Each stage of the pipeline on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

GOOD = "the cat sat on the mat with a hat and the dog lay by the door of the old house in the rain"
LONG = " ".join(f"word{i % 977} x{i}" for i in range(20_000))
ROWS = [
    (1, GOOD, "en", "a"), (1, GOOD, "en", "a"), (2, "", None, None), (3, None, "de", "b"), (None, GOOD, "en", None), (None, "one more text without an id", "en", None), (None, None, None, None),
    (4, LONG, "en", "a"), (5, " \n\t ", "xx", "c"), (6, GOOD, "en", "b"), (7, "mail bob.smith@x.example on 1980-02-29", "en", "b"), (8, "He said: what is the capital of France and the largest city of Spain in the north, again?", "en", "c"),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(1, 1, 0), (6, 1, 0), (None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, "What is the capital of France and the largest city of Spain in the north?"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("own") for c in ("kept", "_gone", "component", "size", "limit", "found", "n")})


#: Ids and texts that each stage keeps of ROWS; the last stage takes no row without words.
KEPT = {
    "quality": ROWS,
    "near_duplicate": [r for r in ROWS[1:] if r[0] != 6],
    "decontamination": [r for r in ROWS if r[0] != 8],
    "pii": ROWS,
    "mixing": None,
}


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage(spark, docs, folder, name, stage):
    got = stage(spark, docs, folder)
    rows = got.collect()
    if name != "mixing":
        assert got.columns == docs.columns and all(r["n"] == "own" for r in rows)
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in KEPT[name])
    else:
        assert all(r["n"] == "own" and 0 < r.taken <= 2 * r["size"] and len(r.text.split()) == r["size"] for r in rows)
        assert sum(r.doc_id is None for r in rows) <= 2
    if name == "pii":
        assert sum("bob.smith" in (r.text or "") or "1980-02-29" in (r.text or "") for r in rows) == 0
        assert sum(r.text is None for r in rows) == 2 and all(r.n_chars == len(r.text or "") for r in rows)
    empty = stage(spark, docs.limit(0), folder)
    assert empty.count() == 0 and empty.columns == got.columns
