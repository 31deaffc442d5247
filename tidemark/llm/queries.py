"""Queries of the corpus operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark, sf_dir):
    from .toxicity import classify_toxicity

    return classify_toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_quality(spark, sf_dir):
    from .quality import classify_quality

    return classify_quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op3_line_dedup(spark, sf_dir):
    from .line_dedup import line_dedup

    return line_dedup(_read(spark, sf_dir, "documents"), with_text=False).drop("kept_text")


def op4_jaccard(spark, sf_dir):
    from .jaccard import jaccard_components

    return jaccard_components(_read(spark, sf_dir, "documents"))


def op5_topk(spark, sf_dir):
    from .topk import topk

    e = _read(spark, sf_dir, "embeddings")
    return topk(e.where("vec_id % 20 = 0"), e, k=20)


def op6_substring(spark, sf_dir):
    from .fm_dedup import substring_dedup

    return substring_dedup(_read(spark, sf_dir, "documents"), with_text=False).drop("kept_text")


def op7_warc(spark, sf_dir):
    from .warc import round_trip

    return round_trip(_read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_decontaminate(spark, sf_dir):
    from .decontaminate import decontaminate

    return decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).drop("text_key")


def op9_mixing(spark, sf_dir):
    from .mixing import mix

    return mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_suffix(spark, sf_dir):
    from .suffix_dedup import suffix_dedup

    return suffix_dedup(_read(spark, sf_dir, "documents"), with_text=False).drop("kept")


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_quality": op2_quality,
    "op3_line_dedup": op3_line_dedup,
    "op4_jaccard": op4_jaccard,
    "op5_topk": op5_topk,
    "op6_substring": op6_substring,
    "op7_warc": op7_warc,
    "op8_decontaminate": op8_decontaminate,
    "op9_mixing": op9_mixing,
    "op10_suffix": op10_suffix,
}
