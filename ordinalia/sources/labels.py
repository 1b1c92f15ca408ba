"""Evaluation labels.  Only evaluation functions use this module."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .matrices import with_row_order


def read_labels(
    spark: SparkSession,
    path: str,
    dataset_id: str,
    label_column: str,
    expected: DataFrame,
    alignment: str = "sample_id",
) -> DataFrame:
    """Labels aligned with ``expected(sample_id[, row_order])`` -> ``dataset_id, sample_id, label``.

    ``sample_id`` alignment needs the same id set on both sides, ``row_order`` the same row count;
    otherwise the read fails.
    """
    raw = spark.read.option("header", True).csv(path)
    label = F.col(f"`{label_column}`").cast("string").alias("label")
    if alignment == "sample_id":
        joined = raw.select(F.col("sample_id").cast("string"), label, F.lit(True).alias("_l")).join(
            expected.select("sample_id", F.lit(True).alias("_e")), "sample_id", "full_outer"
        )
    elif alignment == "row_order":
        left = with_row_order(raw.select(label)).withColumn("_l", F.lit(True))
        right = expected.select("sample_id", "row_order", F.lit(True).alias("_e"))
        joined = left.join(right, "row_order", "full_outer")
    else:
        raise ValueError(f"unknown alignment: {alignment}")
    both = F.col("_l").isNotNull() & F.col("_e").isNotNull()
    checked = F.when(both, F.col("label")).otherwise(
        F.raise_error(F.concat(F.lit("labels and samples do not match at "), F.coalesce("sample_id", F.lit("a row")))).cast("string")
    )
    return joined.select(F.lit(dataset_id).alias("dataset_id"), "sample_id", checked.alias("label"))


def align_labels(labels: DataFrame, samples: DataFrame) -> DataFrame:
    """Samples without a label and labels without a sample; must be empty before evaluation."""
    keys = ["dataset_id", "sample_id"]
    a = samples.select(*keys).distinct()
    b = labels.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("problem", F.lit("no label")).unionByName(
        b.join(a, keys, "left_anti").withColumn("problem", F.lit("no sample"))
    )
