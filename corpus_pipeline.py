"""A training-data pipeline over `documents`: five operators, each on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm import langid, mixing, neardup, packing, secrets
from barline.llm.common import shared_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a language can be told; those without a letter go. Labels stay as they are."""
    model = langid.fit(docs)
    kept = [c for c in COLUMNS if c != "doc_id"]
    return langid.identify(docs, model, keep=kept).where(F.col("lang_pred") != langid.UNKNOWN).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (similarity 0.8 or more of five-word shingles): the smallest id.

    Rows without an id stay. Rows that share an id are judged each by its own text; of those with the same text one stays.
    """
    found = neardup.near_duplicates(docs, percent=80, marks=True)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("_gone"), F.col("mark").alias("_mark_gone")).distinct()
    marked = docs.withColumn("_mark", F.xxhash64("text"))
    kept = marked.join(gone, (F.col("doc_id") == F.col("_gone")) & (F.col("_mark") == F.col("_mark_gone")), "left_anti")
    nameless = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    return kept.withColumn("_row", nameless).dropDuplicates(["doc_id", "_mark", "_row"]).select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked; n_chars follows the text. Null texts stay null, repeated rows stay, an empty table stays empty."""
    found = secrets.ledger_scan(docs)
    text = F.when(F.col("text").isNotNull(), secrets.masked("text", "spans"))
    changed = found.withColumn("text", text)
    return changed.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at the square root of their share, as many documents as before on average, in shuffled order.

    A null source is a source of its own; null ids share one draw; repeated rows draw alike; an empty table stays empty.
    """
    return mixing.poisson_mix(docs).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of all documents in sequences of 4096 tokens. Null and empty texts are one end token; repeated rows are packed each."""
    return packing.pack_documents(docs)


STAGES = [("language ID", language), ("MinHash near-dedup", near_duplicates), ("secret scan", secret_scan), ("Poisson mix", mix), ("best-two-fit packing", pack)]

#: The language model is fitted by hashed n-grams, which SQL does not express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        path = shared_path(spark, f"stage{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
