"""The registered queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, chat, decontam, feistel, langid, lexical, licenses, lineclean, ngramjoin, pii, tokenbin, unitdedup
from .common import read_table
from .oracle import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES = {}


def _query(f):
    """Registers f(docs) as a query over the table documents."""

    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(read_table(spark, sf_dir, "documents"), sf_dir)

    QUERIES[f.__name__] = run
    return run


@_query
def op1_bitplane_ids(docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokenbin.tokenize_to_files(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


@_query
def op2_line_first_cleaning(docs: DataFrame, sf_dir: str) -> DataFrame:
    return lineclean.clean_lines(docs).drop("clean_text")


@_query
def op3_byte_bpe(docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


@_query
def op4_ngram_jaccard_join(docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngramjoin.components(docs).drop("class_digest", "text_hash")


@_query
def op5_line_hash_dedup(docs: DataFrame, sf_dir: str) -> DataFrame:
    return unitdedup.repeated_units(docs).drop("text_hash")


@_query
def op6_feistel_shards(docs: DataFrame, sf_dir: str) -> DataFrame:
    return feistel.shard(docs, shards=8).drop("row_no")


@_query
def op7_simhash_decontamination(docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.find_matches(docs, read_table(docs.sparkSession, sf_dir, "benchmark"))


@_query
def op8_segmentation_unigram_langid(docs: DataFrame, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = langid.train(docs.where(~held_out), public_tokenizers.path("piece_bpe_32k.model"))
    predicted = langid.predict(docs, model)
    return predicted.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@_query
def op9_license_index(docs: DataFrame, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(docs)


@_query
def op10_information_sanitisation(docs: DataFrame, sf_dir: str) -> DataFrame:
    found = pii.detect(docs)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    shown = lambda s, kind: F.concat_ws(":", kind, s["begin"].cast("string"), s["end"].cast("string"))
    rank = F.create_map(*(x for i, k in enumerate((*pii.KINDS, pii.SECRET, "term")) for x in (F.lit(k), F.lit(i))))
    placed = lambda c, kind: F.transform(c, lambda s: F.struct(s["begin"].alias("begin"), rank[kind(s)].alias("rank"), s["end"].alias("end"), kind(s).alias("kind")))
    every = F.array_sort(F.concat(placed("base", lambda s: s["kind"]), placed("secrets", lambda s: s["kind"]), placed("terms", lambda s: F.lit("term"))))
    base = F.array_join(F.transform("base", lambda s: shown(s, s["kind"])), ",")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(base.cast("binary"), 256).alias("base_sha256"),
                        F.array_join(F.transform(every, lambda s: shown(s, s["kind"])), ",").alias("spans"),
                        F.size("secrets").cast("long").alias("n_secret"), F.size(every).cast("long").alias("n_spans"))


@_query
def op11_ranked_search(docs: DataFrame, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(docs, read_table(docs.sparkSession, sf_dir, "benchmark"))


@_query
def op12_tokenizer_alignment(docs: DataFrame, sf_dir: str) -> DataFrame:
    return align.alignment(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_and_read(chat.with_probe(read_table(spark, sf_dir, "conversations")))


QUERIES["op13_chat_round_trip"] = op13_chat_round_trip
