"""The corpus pipeline: documents in, packed training sequences out.

Each stage gets all that the stage before kept, as a table, and returns a DataFrame that is
written as Parquet and read again. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import near_dup, packing, pii, quality
from tidemark.session import scratch_folder, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7 go, null and empty texts by the score of an empty text.

    The rules are learned on the labelled documents of this stage's input; without any the
    score is the same for all.
    """
    docs = docs.select(*COLUMNS)
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id.

    Rows that share an id are one document: of those, the row that sorts first by its columns
    stays. Rows without an id are kept as they are.
    """
    docs = docs.select(*COLUMNS)
    judged = near_dup.near_duplicates(docs).where("doc_id IS NOT NULL")
    ids = written(judged.groupBy("doc_id").agg(F.min("kept").alias("kept"), F.count(F.lit(1)).alias("n")).where("NOT kept OR n > 1"), "pipeline-ids")
    once = docs.join(ids, "doc_id", "left_anti").select(*COLUMNS)
    repeated = docs.join(ids.where("kept"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("r"))
    return once.unionByName(repeated.select("doc_id", "r.*"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the name of its kind; n_chars follows the text."""
    docs = docs.select(*COLUMNS)
    clean = pii.redact(docs, pii.fit(docs))
    changed = F.when(F.col("text").isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", changed).select(*COLUMNS)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids: one row per piece, with its ids."""
    import public_tokenizers

    # workers and heaps of the stages before hold memory still, so fewer words are remembered than by default
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), remembered=200_000)


STAGES = [("quality", quality_filter), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", packed_sequences)]
#: SQL can express neither the fitted classifiers nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
