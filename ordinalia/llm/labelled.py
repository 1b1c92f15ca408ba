"""Labelled rows for the classifiers: bounded, reproducible samples, joined to their texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordinalia.llm.common import text_of
from ordinalia.runtime import cut


def sample(
    docs: DataFrame, labels: DataFrame, label: str, allowed: Column, per_class: int, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """Columns key, label (0/1) and text: at most ``per_class`` rows of each class, chosen by a hash of the key.

    Of a larger class, keys under a hash bound are taken that 9 in 10 of ``per_class`` are expected to reach, so that no
    task or driver has to order them; a last limit makes the bound strict.

    ``allowed`` is a condition on the key.  Rows of ``labels`` with a null key or a label other than 0 and 1 are
    left out; a key with several rows of labels counts once, with its largest label.  The chosen keys (2 * per_class
    at most, a proven bound) are broadcast to the scan of the documents.
    """
    rows = (
        labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
        .where(F.col("key").isNotNull() & F.col("label").isin(0, 1))
        .withColumnRenamed("key", key)
        .where(allowed)
        .groupBy(key)
        .agg(F.max("label").alias("label"))
    )
    rows = cut(rows)
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    chosen = rows.limit(0)
    for value, size in sorted(sizes.items()):
        part = rows.where(F.col("label") == value)
        if size > per_class:
            bound = int(0.9 * per_class / size * (1 << 62))
            part = part.where(F.pmod(F.xxhash64(key), F.lit(1 << 62)) < bound).limit(per_class)
        chosen = chosen.unionAll(part)
    return docs.select(F.col(key), text_of(text).alias("text")).join(F.broadcast(chosen), key)
