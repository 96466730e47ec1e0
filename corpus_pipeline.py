"""Corpus pipeline: language ID, exact dedup, SimHash near-dedup, benchmark decontamination, BPE round trip.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. Every stage works on all that its predecessor kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axonlake.llm import bpe, decontaminate, exact_dedup, langid, simhash
from axonlake.llm.common import drop_staged, read_table, stage_table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model accepts, as they were; null texts, texts without a letter and those that the model rejects go. Ids
    play no part, so null and repeated ones are harmless."""
    model = langid.train_language_model(docs.filter(langid.learning_rows()))
    rows = docs.select("text", F.struct(*docs.columns).alias("row"))  # so that columns of the predictor's names stay as they are
    return langid.predict_language(rows, model).filter("not rejected").select("row.*")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays, of rows that repeat id and text any one; a null id counts as least."""
    return exact_dedup.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component stays: that with the least doc_id, and of repeats of that any one. Null ids count as greatest."""
    rows = stage_table(docs.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.monotonically_increasing_id().alias("row")).alias("key"), F.struct(*docs.columns).alias("doc")), "numbered")
    classes = simhash.near_duplicate_classes(rows.select("key", F.col("doc.text").alias("text")), id_col="key")
    gone = classes.filter("key <> component_id").select(F.col("key.row").alias("gone"))
    return rows.join(gone, F.col("key.row") == F.col("gone"), "left_anti").select("doc.*")


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain no benchmark item (0.8 or more of its five-word shingles); each row is judged by its own text."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row and the digest of the text decoded from them: doc_id, n_tokens, ids_sha256, decoded_sha256. Null text is empty."""
    return bpe.round_trip(docs, bpe.default_tokenizer())


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_copies),
    ("simhash_neardup", near_copies),
    ("decontaminate", benchmark_leaks),
    ("bpe", bpe_round_trip),
]

#: SQL cannot express the trained language model nor the tokenizer; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; a stage's table is deleted once the next one is written."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, stage_table(stage(spark, docs, sf_dir), f"corpus-{name}")
        drop_staged(before)  # documents itself is no staged table
    return docs
