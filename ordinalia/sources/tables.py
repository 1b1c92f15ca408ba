"""Save and load model tables, export assignments and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed contracts of the stored tables.
SCHEMAS: dict[str, str] = {
    "feature_stats": "dataset_id string, feature_rank int, feature_id string, median double, mad double, iqr double, scale double, iqr_fallback boolean",
    "relation_screen": "dataset_id string, relation_rank int, left string, right string, weight double, score double, coverage double, entropy double, stability double",
    "medoids": "dataset_id string, method_id string, cluster int, sample_id string",
    "assignments": "dataset_id string, method_id string, sample_id string, cluster int",
    "pam_trace": "run_id string, method_id string, step int, objective double",
    "audit_metrics": "dataset_id string, method_id string, family string, k int, prediction_strength double, cluster_stability double, perturbation_invariance double, representation_stability double, nondegeneracy_score double, nondegenerate boolean, min_cluster_fraction double, cluster_entropy double, q_score double, complexity int, perturbation_failures bigint",
    "null_thresholds": "calibration_id string, method_id string, threshold double, n bigint",
    "null_calibration": "calibration_id string, k int, quantile double, delta_hybrid double, multiple_testing_margin double",
    "selection": "dataset_id string, decision string, uncertain boolean, decision_confidence double, selected_method string, selected_k int, selected_alpha double, q_score double, null_threshold double, eligible_alternatives array<string>, rejection_reasons map<string,string>, vote_counts map<string,bigint>",
    "frozen_methods": "model_id string, method_id string, family string, feature_ids array<string>, medians array<double>, scales array<double>, medoids array<struct<sample_id:string,z:array<double>,q:array<double>>>, pair_left array<int>, pair_right array<int>, pair_weight array<double>, margin double, value_scale double, relational_scale double, alpha double, radius_q95 array<double>, confidence_q05 double, min_feature_coverage double, min_relation_coverage double",
    "prototype_rules": "model_id string, cluster int, rule_rank int, feature_a string, feature_b string, direction tinyint, support double, contrast double",
    "target_assignments": "model_id string, method_id string, sample_id string, forced_cluster int, accepted_cluster int, nearest_distance double, second_distance double, confidence double, feature_coverage double, relation_coverage double, rejection_reasons array<string>",
}


def schema_of(name: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[name])


def save(df: DataFrame, name: str, path: str, fmt: str = "parquet") -> None:
    """Write a model table under its fixed schema."""
    casts = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema_of(name).fields]
    df.select(*casts).write.mode("errorifexists").format(fmt).save(path)


def load(spark: SparkSession, name: str, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(schema_of(name)).format(fmt).load(path)


def assignment_export(samples: DataFrame, assignments: DataFrame, selection: DataFrame) -> DataFrame:
    """``dataset_id, sample_id, cluster`` of the selected method; every sample is UNASSIGNED after abstention."""
    chosen = selection.select("dataset_id", F.col("selected_method").alias("method_id"))
    picked = assignments.join(chosen, ["dataset_id", "method_id"]).select("dataset_id", "sample_id", "cluster")
    everyone = samples.select("dataset_id", "sample_id").distinct().join(
        chosen.select("dataset_id"), "dataset_id", "left_semi"
    )
    return everyone.join(picked, ["dataset_id", "sample_id"], "left").select(
        "dataset_id", "sample_id", F.coalesce(F.col("cluster").cast("string"), F.lit("UNASSIGNED")).alias("cluster")
    )


def write_assignments(export: DataFrame, path: str) -> None:
    """Gzipped CSV, one folder per dataset, rows ordered by sample id within each file."""
    (
        export.repartitionByRange("dataset_id", "sample_id")
        .sortWithinPartitions("dataset_id", "sample_id")
        .write.partitionBy("dataset_id")
        .option("header", True)
        .option("compression", "gzip")
        .csv(path)
    )


def assignment_payload(assignments: DataFrame) -> DataFrame:
    """All methods' assignments as ``dataset_id, method_id, part, assignments array<struct>``.

    Samples are split over parts of bounded size, so one large dataset is never one array.
    """
    part = F.pmod(F.xxhash64("sample_id"), F.greatest(F.ceil(F.col("_n") / 10000.0), F.lit(1))).cast("int")
    sizes = assignments.groupBy("dataset_id", "method_id").agg(F.count(F.lit(1)).alias("_n"))
    return (
        assignments.join(sizes, ["dataset_id", "method_id"])
        .withColumn("part", part)
        .groupBy("dataset_id", "method_id", "part")
        .agg(F.array_sort(F.collect_list(F.struct("sample_id", "cluster"))).alias("assignments"))
    )


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """Result table as CSV with a header, globally ordered over its part files."""
    df.orderBy(*order).write.option("header", True).csv(path)
