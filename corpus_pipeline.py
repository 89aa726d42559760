"""Cleaning pipeline of a training corpus: quality rules, line dedup, near-dedup, decontamination, encoding.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``. All but the
last return the columns of ``documents``, with ``n_chars`` kept true.

Very long texts go through whole, columns of any name pass unchanged, and an
empty table gives an empty result. Null ids are never dropped as copies or leaks, since nothing can name them;
null texts fail the quality rules. Of rows that repeat both id and words one
stays after the near-duplicate stage; other texts under a repeated id stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.llm.bpe import encode_documents
from tideline.llm.decontaminate import find_leaks
from tideline.llm.line_dedup import clean_documents
from tideline.llm.near_dedup import near_duplicates
from tideline.llm.quality import fit_bands, keep_good
from tideline.llm.store import discard, materialize, scratch

#: Ids up to which they are broadcast to the documents; beyond, the same join is by shuffle.
BROADCAST_ROWS = 2_000_000
#: SQL has no tokenizer, no sketches and no alignment; tests hold the stages against brute force.
ORACLE_SQL = None


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def _without(docs: DataFrame, ids: DataFrame, how: str = "left_anti") -> DataFrame:
    """``docs`` without (or, by ``left_semi``, with only) the rows whose id is in ``ids``."""
    ids = materialize(ids.select("doc_id").distinct(), "pipeline-ids")
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "doc_id", how).select(*_columns(docs))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bands of token figures come from the labelled rows among the documents."""
    return keep_good(docs, fit_bands(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; documents of which nothing stays go too."""
    return clean_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays."""
    kept = _without(docs, near_duplicates(docs).where("not kept"))
    repeated = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    repeated = materialize(repeated.select("doc_id"), "pipeline-repeated")
    if repeated.isEmpty():
        return kept
    # Rows of one id are copies only if their words are the same; which copy stays does not depend on partitions.
    words = F.trim(F.regexp_replace(F.lower("text"), r"[\x20\x09-\x0D]+", " "))
    order = Window.partitionBy("doc_id", words).orderBy(*_columns(docs))
    one = _without(kept, repeated, "left_semi").withColumn("__nth", F.row_number().over(order)).where("__nth = 1")
    return _without(kept, repeated).unionByName(one.select(*_columns(docs)))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, find_leaks(docs, benchmark))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_documents(docs, keep=["doc_id"])


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch(spark) as keep:
            done = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
            keep.append(done._tideline_folder)
        discard(docs)
        docs = done
    return docs
