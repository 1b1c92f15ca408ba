"""Registered queries of the text operators; each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

import corpus_pipeline
from ordinalia.llm import (
    alignment,
    language,
    licences,
    neighbours,
    ngram_join,
    packing,
    pieces,
    quality,
    rules,
    secrets,
    simhash,
    spelling,
    toxicity,
)
from ordinalia.llm.common import crc32_of_id, table
from ordinalia.runtime import checked_broadcast, cut

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


#: Stages change the whole corpus in turn; see corpus_pipeline.py.
QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL


def register(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@register
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    number = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("bigint")
    return secrets.scan(docs).select(
        "doc_id",
        number(0).alias("n_assign"),
        number(1).alias("n_access"),
        number(2).alias("n_hex"),
        F.sha2(secrets.joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        secrets.joined(F.col("spans")).alias("spans"),
    )


@register
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rules.judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good"
    )


@register
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


@register
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


@register
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc32_of_id() % 3 == 1
    model = quality.learn(docs, table(spark, sf_dir, "labels"), ~held_out)
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    return quality.scored(rows, model).drop("text")


@register
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc32_of_id() % 5 == 0
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"), ~held_out)
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    return toxicity.scored(rows, lexicon).drop("text")


@register
def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.linked(docs, n=3, threshold=(90, 100))


@register
def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(rows, F.col("id") % 50 == 0)


@register
def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.size("sentence_ids").cast("bigint").alias("n_sentences"),
        F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.array_join(F.array_distinct("licences.licence"), ",").alias("licences"),
        F.array_join(F.transform("licences", lambda x: F.concat_ws(":", x["licence"], x["start"], x["end"])), ",").alias("spans"),
    )


@register
def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct().withColumn("target", F.lit(True))
    # 8 bytes a label; more labels than the checked bound join by a shuffle
    return language.fitted_and_scored(docs.join(checked_broadcast(cut(good), 1_000_000), "doc_id", "left")).drop("target")


@register
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = alignment.aligned(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return found.withColumn("groups_sha256", digest).drop("groups")


@register
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.grouped(table(spark, sf_dir, "documents").select("doc_id", "text"))


@register
def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.grouped(table(spark, sf_dir, "documents").select("doc_id", "text"))
