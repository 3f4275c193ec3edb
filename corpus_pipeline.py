"""Corpus pipeline: five stages over the documents table, each applying one operator of tidelog.llm.

Each stage is a function of (spark, docs, sf_dir). Its result is written and read again as the next one's docs; all but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.bpe import encode
from tidelog.llm.common import small_batches
from tidelog.llm.decontamination import decontaminate
from tidelog.llm.jaccard import join
from tidelog.llm.langid import UNKNOWN, fit, identify
from tidelog.llm.queries import vocabulary
from tidelog.llm.secrets import scan

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A prediction of less is no language.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or with no language of LEAST_SCORE; tables are learned from docs' own lang."""
    small_batches(spark)
    named = identify(docs, fit(docs))
    return named.where((F.col("language.lang_pred") != UNKNOWN) & (F.col("language.score") >= LEAST_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group of 5-gram similarity 0.8 or more; rows with a null id stay."""
    small_batches(spark)
    groups = join(docs, width=5, num=80, den=100)
    dropped = groups.where("doc_id != component_id").select("doc_id").distinct()
    kept = docs.join(dropped, "doc_id", "left_anti").select(*COLUMNS)
    again = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").select("doc_id")
    if again.isEmpty():
        return kept
    # an id that comes twice with one text is one document
    twice = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, "doc_id", "left_anti").select(*COLUMNS).union(twice.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, re-parameterised or not."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts; n_chars follows."""
    masked = scan(docs)
    changed = ~F.col("text").eqNullSafe(F.col("redacted"))
    return masked.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.when(changed, F.length("redacted").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts as token ids (little-endian 32-bit integers)."""
    small_batches(spark)
    out = encode(docs.select(*COLUMNS), vocabulary())
    return out.select("doc_id", "lang", "source", "n_chars", "bpe.n_tokens", "bpe.ids", "bpe.ids_sha256", "bpe.decoded_sha256")


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("tokens", tokens)]
#: SQL cannot express the first stage, nor the near-duplicate groups on whole tables, nor the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.common import materialize

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
