"""A corpus pipeline: quality, near-duplicates, decontamination, pseudonyms and the mix, each over all the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrachron.llm.decontam import decontaminate
from terrachron.llm.mixing import mixed_documents
from terrachron.llm.neardup import near_duplicates
from terrachron.llm.pii import pseudonymise, session_key
from terrachron.llm.quality import classify_quality
from terrachron.llm.shared import columns_free, settle, small

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts, and those of a null or unknown language, are judged by the limit over all languages; rows of
    one id are judged each; without labels, or without rows, nothing is rejected. Other columns pass through.
    """
    return classify_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("kept").select(*docs.columns)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that with the smallest id, and one row of it (by a hash of its columns).

    Rows with a null id stay, all of them, as do null texts and texts without words of their own id; very long texts
    are compared whole. No rows give no rows; other columns pass through.
    """
    out, more = columns_free(docs, "gone", "several")
    gone = settle(near_duplicates(docs, size=5, percent=80).where("NOT kept").select(F.col("doc_id").alias(out)).distinct())
    left = docs.join(small(gone, gone.count()), F.col("doc_id") == F.col(out), "left_anti")
    several = settle(left.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(more)))
    n = several.count()
    if n:
        same = F.col("doc_id") == F.col(more)
        one = left.join(small(several, n), same, "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row"))
        left = left.join(small(several, n), same, "left_anti").unionByName(one.select("row.*"))
    return left.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go, all rows of their id with them (null is an id).

    Null and empty texts hold nothing; with an empty or missing item text nothing is held. Other rows and columns stay.
    """
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, dates and addresses become pseudonyms, by the key of the session; all documents stay.

    Null texts stay null with their ``n_chars``; of others it is counted anew. Repeated rows stay as they are.
    """
    return pseudonymise(docs, key=session_key(spark)).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, one row for each row, with the words that it takes of each.

    Null and empty texts have no words and are never taken; a null source is a source; rows of one id, null included,
    are documents of their own; no rows give no rows. Own columns named like the new ones are replaced.
    """
    return mixed_documents(docs)


STAGES = [("quality", quality), ("near_duplicate", near_duplicate), ("decontamination", decontamination), ("pii", pii), ("mixing", mixing)]

#: SQL can't express the n-gram model of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
