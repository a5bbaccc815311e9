"""The corpus pipeline: language ID, n-gram Jaccard join, benchmark decontamination, PII, byte-level BPE.

Each stage takes the documents that the stage before kept, as read back from Parquet, and returns documents; the last
returns their encoded form.  Null or empty texts pass the middle stages only if language ID accepts them, which it never
does: they have no language.  Empty tables give empty results; extra columns are dropped by the first stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from klangwerk.llm import bpe, decontam, langid, ngramjoin, pii
from klangwerk.llm.common import settle

#: Posterior below which the language of a text counts as unknown.
MIN_LANGUAGE_SCORE = 0.5
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; lang keeps its value, or takes the prediction where it is null.

    Rejected are texts without letters, those that leave the language open, and those that no learned language explains
    better than pieces drawn without regard to any language (letter noise, scripts that were not learned)."""
    docs = docs.select(*COLUMNS)
    model = langid.train(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return langid.with_prediction(docs, model).where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE) & (F.col("gain") > 0)).select(
        "doc_id", "text", F.coalesce("lang", "lang_pred").alias("lang"), "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, that of smallest doc_id."""
    return ngramjoin.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontam.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked; n_chars follows the text."""
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast("long"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and the digest of the bytes that the ids decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode_with_check(docs, path)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("byte_bpe", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs


#: Tokenization, fingerprints and piece models are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None
