"""The corpus pipeline: five operators one after the other over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and
returns the columns of documents; the last returns the mix, documents repeated as
often as they are taken. Stages are written as Parquet into the shared folder and
read again. Null or repeated doc_ids, null texts and empty tables are defined by
each operator's docstring; a document that line dedup empties stays, with no text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import fresh_path, remove, remove_at_end
from tidemark.llm.decontaminate import decontaminate
from tidemark.llm.jaccard import jaccard_components
from tidemark.llm.line_dedup import deduped_documents
from tidemark.llm.mixing import mixed_documents
from tidemark.llm.quality import keep_good

NO_ID = -(1 << 63)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return keep_good(docs, _table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that later documents repeat."""
    return deduped_documents(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group linked at 0.8 over five-word shingles."""
    got = jaccard_components(docs, n=5, percent=80)
    lose = got.where("component_id <> doc_id").select("doc_id").distinct()
    kept = docs.join(lose, "doc_id", "left_anti").select(*docs.columns)
    again = got.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if again.isEmpty():
        return kept
    one = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(one.select(*docs.columns))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark: one passage is enough, however long the document."""
    bad = decontaminate(docs, _table(spark, sf_dir, "benchmark")).where("n_hit > 0").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("__id"), F.col("text_key").alias("__text")).distinct()
    d = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "__text": F.xxhash64(F.col("text").cast("string"))})
    return d.join(bad, ["__id", "__text"], "left_anti").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: each document as often as systematic sampling takes it."""
    return mixed_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("mixing sources", mixture),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, before = _table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = fresh_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        remove_at_end(spark, path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
