"""The corpus pipeline: stages of the operators in filingmill.llm, one after another over documents.

Language ID drops texts whose language is undetermined; near-dedup keeps one document of each group whose
five-word shingles are similar by 0.8 or more (by MinHash bands: SimHash anchors reach few of these, see `near_copies`); benchmark
decontamination drops documents in which a test window occurs; secret scans mask what the forest takes for a secret;
SentencePiece encoding gives the piece ids of what is left, with their digest. Every stage works on all that the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingmill.llm import decontaminate, language, near_copies, pieces, secrets
from filingmill.llm._shared import staged
from filingmill.llm.queries import MODEL_PATH

#: A text is rejected if no language has this mean share of its words, or if it has no letter.
LEAST_LANGUAGE_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose language is determined, as they are."""
    return language.determined(docs, language.train(docs), LEAST_LANGUAGE_SCORE)


def near_copy_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, as it is."""
    return near_copies.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows in which no benchmark window occurs, as they are."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets in text masked and n_chars counted anew."""
    masked = docs.withColumn("text", secrets.redact(F.col("text"), secrets.train(docs)))
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids_sha256, round_trip, ids."""
    return pieces.encode_digest(docs, MODEL_PATH, with_ids=True)


STAGES = [
    ("language_id", language_id),
    ("near_copy_dedup", near_copy_dedup),
    ("decontamination", decontamination),
    ("secret_masking", secret_masking),
    ("piece_encoding", piece_encoding),
]

#: A trained model, a forest and merges are beyond SQL: tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and reread as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
