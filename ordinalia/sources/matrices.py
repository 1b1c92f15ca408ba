"""Read matrices in several layouts into the long measurement table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MEASUREMENTS = T.StructType(
    [
        T.StructField("dataset_id", T.StringType()),
        T.StructField("sample_id", T.StringType()),
        T.StructField("feature_id", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)


def as_measurements(df: DataFrame) -> DataFrame:
    """Project to the measurement contract; NaN becomes NULL, which is the one missing marker."""
    value = F.col("value").cast("double")
    return df.select(
        F.col("dataset_id").cast("string"),
        F.col("sample_id").cast("string"),
        F.col("feature_id").cast("string"),
        F.when(~F.isnan(value), value).alias("value"),
    )


def vectors_to_measurements(
    df: DataFrame, dataset: Column, sample: Column, vector: str, prefix: str = "f"
) -> DataFrame:
    """One row per element of an array column; positions become ``f000, f001, ...``."""
    long = df.select(
        dataset.alias("dataset_id"),
        sample.alias("sample_id"),
        F.posexplode(vector).alias("_pos", "value"),
    )
    return as_measurements(
        long.withColumn("feature_id", F.format_string(prefix + "%03d", F.col("_pos")))
    )


def measurements_to_vectors(df: DataFrame) -> DataFrame:
    """Inverse: one array per sample in feature order (a sample has at most one value per feature).

    Names that end in digits are ordered by what stands before them, then by the number.
    """
    stem = F.regexp_replace("feature_id", "[0-9]+$", "")
    items = F.array_sort(F.collect_list(F.struct(stem.alias("stem"), F.length("feature_id").alias("width"), "feature_id", "value")))
    return df.groupBy("dataset_id", "sample_id").agg(
        F.transform(items, lambda s: s["value"]).alias("vector")
    )


def _wide_csv(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.option("header", True)
        .option("maxColumns", 1_000_000)
        .option("enforceSchema", False)
        .csv(path)
    )


def _parsed(text: Column) -> Column:
    """Number, or NULL for an empty or NaN cell; anything else is an error."""
    trimmed = F.trim(text)
    number = trimmed.try_cast("double")
    missing = trimmed.isNull() | F.lower(trimmed).isin("", "nan", "na")
    return F.when(missing, F.lit(None).cast("double")).otherwise(
        F.coalesce(number, F.raise_error(F.concat(F.lit("not a number: "), trimmed)).cast("double"))
    )


def read_feature_major_csv(spark: SparkSession, path: str, dataset_id: str) -> DataFrame:
    """First column holds feature ids, every other column is one sample."""
    wide = _wide_csv(spark, path)
    feature, *samples = wide.columns
    if len(set(samples)) != len(samples):
        raise ValueError("duplicate sample ids in the header")
    long = wide.unpivot(F.col(f"`{feature}`"), [F.col(f"`{s}`") for s in samples], "sample_id", "_text")
    return as_measurements(
        long.select(
            F.lit(dataset_id).alias("dataset_id"),
            "sample_id",
            F.col(f"`{feature}`").alias("feature_id"),
            _parsed(F.col("_text")).alias("value"),
        )
    )


def read_sample_major_csv(
    spark: SparkSession, path: str, dataset_id: str, first_column_is_sample_id: bool
) -> DataFrame:
    """One row per sample; without an id column rows are numbered ``<dataset>_row_0000`` in file order."""
    wide = _wide_csv(spark, path)
    if first_column_is_sample_id:
        first, *features = wide.columns
        wide = wide.withColumnRenamed(first, "_sample")
    else:
        features = wide.columns
        wide = with_row_order(wide).withColumn(
            "_sample", F.format_string(dataset_id + "_row_%04d", F.col("row_order"))
        ).drop("row_order")
    if len(set(features)) != len(features):
        raise ValueError("duplicate feature ids in the header")
    long = wide.unpivot("_sample", [F.col(f"`{f}`") for f in features], "feature_id", "_text")
    return as_measurements(
        long.select(
            F.lit(dataset_id).alias("dataset_id"),
            F.col("_sample").alias("sample_id"),
            "feature_id",
            _parsed(F.col("_text")).alias("value"),
        )
    )


def with_row_order(df: DataFrame) -> DataFrame:
    """Add a contiguous 0-based ``row_order`` in file order (no global sort, one count per partition)."""
    schema = T.StructType([*df.schema.fields, T.StructField("row_order", T.LongType())])
    return df.sparkSession.createDataFrame(
        df.rdd.zipWithIndex().map(lambda pair: (*pair[0], pair[1])), schema
    )


def shape_of(measurements: DataFrame) -> DataFrame:
    """Samples and features per dataset, to compare with a manifest."""
    return measurements.groupBy("dataset_id").agg(
        F.countDistinct("sample_id").alias("n_samples"),
        F.countDistinct("feature_id").alias("n_features"),
    )


def shape_mismatches(measurements: DataFrame, manifest: DataFrame) -> DataFrame:
    """Datasets whose shape differs from the manifest or that are on one side only."""
    found, wanted = shape_of(measurements).alias("f"), manifest.alias("m")
    return (
        found.join(wanted, F.col("f.dataset_id") == F.col("m.dataset_id"), "full_outer")
        .where(
            ~(
                F.col("f.n_samples").eqNullSafe(F.col("m.n_samples"))
                & F.col("f.n_features").eqNullSafe(F.col("m.n_features"))
            )
        )
        .select(
            F.coalesce("f.dataset_id", "m.dataset_id").alias("dataset_id"),
            F.col("f.n_samples").alias("found_samples"),
            F.col("m.n_samples").cast("bigint").alias("manifest_samples"),
            F.col("f.n_features").alias("found_features"),
            F.col("m.n_features").cast("bigint").alias("manifest_features"),
        )
    )
