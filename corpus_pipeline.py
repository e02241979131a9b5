"""A corpus pipeline: quality, near-duplicates, repeated passages, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs. All but the
last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spawnlens.llm import decontam, neardup, quality, suffix_dedup, tokenizer
from spawnlens.llm.common import materialise, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents that score less are rejected.
QUALITY = 0.3


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what the quality classifier scores under QUALITY; it learns from all labels."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return quality.accepted(docs.select(*COLUMNS), model, QUALITY)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group linked by five-word shingles at a similarity of 0.8 or more."""
    found = neardup.near_duplicates(docs.select("doc_id", "text"), k=5, threshold=0.8)
    dropped = materialise(found.where(F.col("id") != F.col("component_id")).select(F.col("id").alias("doc_id")).distinct(), "pipeline-dropped")
    return docs.select(*COLUMNS).join(neardup.small(dropped), "doc_id", "left_anti").select(*COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages out that also start in a document with a smaller id."""
    found = suffix_dedup.remove_repeats(docs.select(*COLUMNS), whole_characters=True)
    return found.withColumn("text", F.col("kept").cast("string")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents into which a benchmark item leaked."""
    return decontam.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), alone_words=decontam.SHINGLE)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids, and whether they decode to the text."""
    import public_tokenizers

    whole = docs.select("doc_id", "text").withColumn("whole", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    coded = tokenizer.encode_decode(whole, "text", public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", (F.sha2("decoded", 256) == F.col("whole")).alias("round_trip"))


STAGES = [("quality", good_documents), ("near-duplicates", one_of_near_duplicates), ("repeats", without_repeats), ("leaks", without_leaks), ("tokens", tokens)]
#: Trained scores and sketches are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
