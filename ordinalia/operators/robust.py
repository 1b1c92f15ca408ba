"""Robust per-feature statistics, feature selection and frozen scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import quantiles as Q
from ..runtime import checked_broadcast, model_table

FEATURE = ["dataset_id", "feature_id"]
SAMPLE = ["dataset_id", "sample_id"]


def sample_counts(measurements: DataFrame) -> DataFrame:
    return measurements.groupBy("dataset_id").agg(F.countDistinct("sample_id").alias("n_samples"))


def observed_median(measurements: DataFrame, group_rows: int | None = None) -> DataFrame:
    stats = Q.quantiles(measurements, FEATURE, "value", [0.5], group_rows=group_rows)
    return stats.select(*FEATURE, F.col("q")[0].alias("median"), F.col("n").alias("n_observed"))


def feature_stats(measurements: DataFrame) -> DataFrame:
    """Median and MAD over observed values, IQR over median-imputed values, ``scale = IQR or 1``.

    Imputed cells are not materialised: a feature with ``m`` missing cells adds its median once with
    multiplicity ``m``.  A feature without any observation has no row.
    """
    observed = measurements.where(F.col("value").isNotNull())
    bound = Q.largest_group(observed, FEATURE)
    # one row per feature, materialised once and counted before it is sent anywhere
    medians = model_table(observed_median(observed, bound))
    deviations = observed.join(medians, FEATURE).select(
        *FEATURE, F.abs(F.col("value") - F.col("median")).alias("_dev")
    )
    mad = Q.quantiles(deviations, FEATURE, "_dev", [0.5], group_rows=bound).select(
        *FEATURE, F.col("q")[0].alias("mad")
    )
    holes = medians.join(sample_counts(measurements), "dataset_id").select(
        *FEATURE,
        F.col("median").alias("value"),
        (F.col("n_samples") - F.col("n_observed")).alias("_times"),
    )
    filled = observed.select(*FEATURE, "value", F.lit(1).cast("bigint").alias("_times")).unionByName(holes)
    spread = Q.quantiles(
        filled, FEATURE, "value", [0.25, 0.75], weight="_times", group_rows=bound + 1
    ).select(*FEATURE, (F.col("q")[1] - F.col("q")[0]).alias("iqr"))
    fallback = F.col("iqr") <= 0
    return (
        medians.join(mad, FEATURE)
        .join(spread, FEATURE)
        .select(
            *FEATURE,
            "median",
            "mad",
            "iqr",
            F.when(fallback, 1.0).otherwise(F.col("iqr")).alias("scale"),
            fallback.alias("iqr_fallback"),
            "n_observed",
        )
    )


def observed_scale(measurements: DataFrame, group_rows: int | None = None) -> DataFrame:
    """IQR over observed values only; 1 with fewer than two of them or no spread.

    A feature without any observation has no row; its cells stay missing under every perturbation.
    """
    spread = Q.quantiles(measurements, FEATURE, "value", [0.25, 0.75], group_rows=group_rows)
    iqr = F.col("q")[1] - F.col("q")[0]
    return spread.select(
        *FEATURE,
        F.when((F.col("n") >= 2) & (iqr > 0), iqr).otherwise(1.0).alias("scale"),
    )


def restrict_features(measurements: DataFrame, allowed: DataFrame) -> DataFrame:
    """Keep the allowed features (``dataset_id, feature_id``)."""
    return measurements.join(allowed.select(*FEATURE).distinct(), FEATURE, "left_semi")


def unknown_features(measurements: DataFrame, allowed: DataFrame) -> DataFrame:
    """Allowed features that the measurements do not have; must be empty."""
    return allowed.select(*FEATURE).distinct().join(
        measurements.select(*FEATURE).distinct(), FEATURE, "left_anti"
    )


def top_features(stats: DataFrame, budget: int | None, score: str = "mad") -> DataFrame:
    """The ``budget`` most spread features per dataset, or all of them; ties go to the smaller feature id.

    The window holds one row per feature, never measurement rows.
    """
    order = W.partitionBy("dataset_id").orderBy(F.col(score).desc(), F.col("feature_id"))
    ranked = stats.withColumn("feature_rank", F.row_number().over(order))
    return ranked if budget is None else ranked.where(F.col("feature_rank") <= budget)


def short_datasets(selected: DataFrame, budget: int) -> DataFrame:
    """Datasets with fewer eligible features than the budget (the strict API refuses them)."""
    return selected.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < budget)


def feature_model(selected: DataFrame) -> DataFrame:
    """One row per dataset with the selected features and their statistics as aligned arrays."""
    items = F.array_sort(
        F.collect_list(F.struct("feature_rank", "feature_id", "median", "scale", "mad"))
    )
    return (
        selected.groupBy("dataset_id")
        .agg(items.alias("_i"))
        .selectExpr(
            "dataset_id", "_i.feature_id AS feature_ids", "_i.median AS medians", "_i.scale AS scales"
        )
    )


def aligned_rows(measurements: DataFrame, model: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per sample with ``x``: its raw values in model order, NULL where missing.

    ``model`` is the one-row-per-dataset table of :func:`feature_model`.  Features outside the model
    are dropped before the shuffle; a sample without any model feature still gets a row.
    """
    keys = keys or SAMPLE
    selected = model.select("dataset_id", F.explode("feature_ids").alias("feature_id")).withColumn(
        "_in", F.lit(True)
    )
    marked = measurements.join(checked_broadcast(selected), FEATURE, "left")
    pair = F.when(F.col("_in") & F.col("value").isNotNull(), F.struct("feature_id", "value"))
    packed = marked.groupBy(*keys).agg(F.map_from_entries(F.collect_list(pair)).alias("_m"))
    return (
        packed.join(checked_broadcast(model), "dataset_id")
        .withColumn("x", F.transform("feature_ids", lambda f: F.col("_m")[f]))
        .drop("_m")
    )


def standardise(x: Column, medians: Column, scales: Column) -> Column:
    """Impute with the frozen median, then ``(x - median) / scale``."""
    items = F.arrays_zip(x.alias("x"), medians.alias("m"), scales.alias("s"))
    return F.transform(items, lambda i: (F.coalesce(i["x"], i["m"]) - i["m"]) / i["s"])


def scaled_rows(measurements: DataFrame, model: DataFrame) -> DataFrame:
    rows = aligned_rows(measurements, model)
    return rows.withColumn("z", standardise(F.col("x"), F.col("medians"), F.col("scales")))


def absent_features(measurements: DataFrame, model: DataFrame) -> DataFrame:
    """Model features that the measurements lack entirely; the strict transform refuses them."""
    wanted = model.select("dataset_id", F.explode("feature_ids").alias("feature_id"))
    return wanted.join(measurements.select(*FEATURE).distinct(), FEATURE, "left_anti")


def robust_z(measurements: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """``(x - median) / MAD`` per observed feature with missing cells at the median, i.e. at 0.

    The MAD of the imputed column is used; a spread of at most 1e-12 counts as 1.
    """
    stats = model_table(imputed_mad(measurements)) if stats is None else stats
    denominator = F.when(F.col("mad") > 1e-12, F.col("mad")).otherwise(1.0)
    return measurements.join(stats, FEATURE).select(
        *SAMPLE,
        "feature_id",
        F.coalesce((F.col("value") - F.col("median")) / denominator, F.lit(0.0)).alias("z"),
    )


def imputed_mad(measurements: DataFrame) -> DataFrame:
    """Median and MAD per feature after median imputation (missing cells deviate by 0)."""
    observed = measurements.where(F.col("value").isNotNull())
    bound = Q.largest_group(observed, FEATURE)
    medians = model_table(observed_median(observed, bound))
    holes = medians.join(sample_counts(measurements), "dataset_id").select(
        *FEATURE,
        F.lit(0.0).alias("_dev"),
        (F.col("n_samples") - F.col("n_observed")).alias("_times"),
    )
    deviations = (
        observed.join(medians, FEATURE)
        .select(
            *FEATURE,
            F.abs(F.col("value") - F.col("median")).alias("_dev"),
            F.lit(1).cast("bigint").alias("_times"),
        )
        .unionByName(holes)
    )
    mad = Q.quantiles(deviations, FEATURE, "_dev", [0.5], weight="_times", group_rows=bound + 1)
    return medians.join(mad.select(*FEATURE, F.col("q")[0].alias("mad")), FEATURE)
