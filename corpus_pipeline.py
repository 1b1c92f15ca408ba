"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each result as Parquet into the shared
checkpoint folder and reads it back as the next stage's documents.  All stages but the last return the columns of
the documents that they got.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ordinalia.llm import ngram_join, packing, secrets, toxicity
from ordinalia.llm import quality as quality_model
from ordinalia.llm.common import crc32_of_id, table, text_of, written
from ordinalia.runtime import checked_broadcast, cut

#: Near duplicates: words of a shingle, least similarity.
SHINGLE, SIMILAR = 5, (80, 100)
#: Ids of dropped documents that may be sent to every executor (16 bytes each); more are joined by a shuffle.
SENT_IDS = 1_000_000


def _plain(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """``docs`` with names that no operator uses, besides doc_id and text; and the columns that lead back."""
    names = {c: c if c in ("doc_id", "text") else f"_c{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), [F.col(n).alias(c) for c, n in names.items()]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects (score under 0.5)."""
    rows, back = _plain(docs)
    model = quality_model.learn(rows, table(spark, sf_dir, "labels"), crc32_of_id() % 3 != 1)
    return quality_model.scored(rows, model).where("predicted = 1").select(*back)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the lexicon rejects (score of 0.5 and more)."""
    rows, back = _plain(docs)
    lexicon = toxicity.learn(rows, table(spark, sf_dir, "labels"), crc32_of_id() % 5 != 0)
    return toxicity.scored(rows, lexicon).where("predicted = 0").select(*back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: the one with the smallest id.

    Rows with the same id and text are one document.  A null id stands behind all ids.  Documents without words
    are in no group.
    """
    rows, back = _plain(docs)
    # different texts under one id are different documents: the smaller id first, then the digest
    place = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(1 << 62))
    rows = rows.withColumn("_key", F.struct(place.alias("id"), F.xxhash64("text").alias("digest")))
    found = cut(ngram_join.linked(rows, SHINGLE, SIMILAR, key="_key"))
    dropped = cut(found.where("component_id != _key").select("_key").distinct())
    repeated = cut(found.groupBy("_key").count().where("count > 1").select("_key"))
    left = rows.join(checked_broadcast(dropped, SENT_IDS), "_key", "left_anti")
    if repeated.isEmpty():
        return left.select(*back)
    twice = checked_broadcast(repeated, SENT_IDS)
    order = W.partitionBy("_key", F.xxhash64("text"), text_of()).orderBy(*[c for c in rows.columns if c not in ("_key", "text")])
    first = left.join(twice, "_key", "left_semi").withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return left.join(twice, "_key", "left_anti").select(*back).unionAll(first.select(*back))


def secret(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mask; ``n_chars``, where there is one, counts the new text of a changed document."""
    rows, back = _plain(docs)
    found = secrets.scan(rows, with_text=True)
    clean = secrets.redact(F.col("text"), F.col("spans"))
    fixed = found.withColumn("_clean", F.when(F.size("spans") > 0, clean).otherwise(F.col("text"))).select(*back, "_clean", "spans")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        length = F.length("_clean").cast(kind)
        fixed = fixed.withColumn("n_chars", F.when(F.size("spans") > 0, length).otherwise(F.col("n_chars")))
    return fixed.withColumn("text", F.col("_clean")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of at most 1024 tokens; one row per piece."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality),
    ("toxicity", toxic),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret),
    ("packing", pack),
]

#: The classifiers and the tokenizer can't be stated in SQL; tests/llm compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
