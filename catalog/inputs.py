"""Measurement tables derived from the given tables, and the same in SQL.

* M1: ``embeddings``, one sample per vector, 64 features, no missing cells.
* M2: ``events``, one sample per user, features are event type x weekday, median value, missing cells.
* M3: ``lineitem``, one dataset per line status, one sample per supplier, features are return flag x measure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordinalia.functions import quantiles as Q
from ordinalia.operators import edges as E
from ordinalia.operators import validate as V
from ordinalia.runtime import stored
from ordinalia.sources.matrices import as_measurements, vectors_to_measurements


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def padded(column: str):
    """An id as text of one width, wide enough for every bigint (``lpad`` would cut off what is longer)."""
    return F.lpad(F.col(column).cast("string"), 20, "0")


def m1(spark: SparkSession, sf: str) -> DataFrame:
    return vectors_to_measurements(
        table(spark, sf, "embeddings"), F.lit("embeddings"), padded("vec_id"), "embedding"
    )


def m2(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select(
        padded("user_id").alias("sample_id"),
        F.concat_ws("_", "event_type", (F.dayofweek("ts") - 1).cast("string")).alias("feature_id"),
        "value",
    )
    # read many times by every fit: the events are aggregated once
    middle = stored(Q.quantiles(events, ["sample_id", "feature_id"], "value", [0.5]))
    return as_measurements(
        middle.select(F.lit("events").alias("dataset_id"), "sample_id", "feature_id", F.col("q")[0].alias("value"))
    )


MEASURES = {
    "quantity": "l_quantity",
    "extendedprice": "l_extendedprice",
    "discount": "l_discount",
    "tax": "l_tax",
}


def exact_mean(column: str):
    """Mean from an exact decimal sum, so that it does not depend on the row order."""
    return F.sum(F.col(column).cast("decimal(18,2)")).cast("double") / F.count(column)


def m3(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["l_suppkey", "l_linestatus", "l_returnflag"]
    # read many times by every fit: the lines are aggregated once
    means = stored(
        table(spark, sf, "lineitem").groupBy(*keys).agg(
            *[exact_mean(column).alias(name) for name, column in MEASURES.items()]
        )
    )
    long = means.unpivot(keys, list(MEASURES), "measure", "value")
    return as_measurements(
        long.select(
            F.col("l_linestatus").alias("dataset_id"),
            padded("l_suppkey").alias("sample_id"),
            F.concat_ws("_", "l_returnflag", "measure").alias("feature_id"),
            "value",
        )
    )


def trade(spark: SparkSession, sf: str, column: str) -> DataFrame:
    """Directed nation-to-nation table: mean ``column`` of what suppliers of ``i`` sold to customers of ``j``."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", column)
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    buyers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    sellers = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(buyers, F.col("o_custkey") == F.col("c_custkey"))
        .join(sellers, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(
            F.lpad(F.col("s_nationkey").cast("string"), 2, "0").alias("i"),
            F.lpad(F.col("c_nationkey").cast("string"), 2, "0").alias("j"),
        )
        .agg(exact_mean(column).alias("d"))
    )


def trade_distances(spark: SparkSession, sf: str, column: str) -> DataFrame:
    return V.symmetrise(trade(spark, sf, column))


def region_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluation labels of the M3 samples: the supplier's region, for both datasets."""
    suppliers = table(spark, sf, "supplier")
    nations = table(spark, sf, "nation")
    return suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.explode(F.array(F.lit("F"), F.lit("O"))).alias("dataset_id"),
        padded("s_suppkey").alias("sample_id"),
        F.col("n_regionkey").cast("string").alias("label"),
    )


def audit_reports(spark: SparkSession, sf: str) -> DataFrame:
    """A table of the shape of audit metrics: one report per supplier, one method per line number.

    Line status F plays the NULL audits, O the audited datasets; scores are scaled means in [0, 1].
    """
    methods = F.array(*[F.lit(m) for m in METHODS])
    lines = table(spark, sf, "lineitem")
    grouped = lines.groupBy("l_linestatus", "l_suppkey", "l_linenumber").agg(
        (exact_mean("l_discount") * 10.0).alias("q_score"),
        (exact_mean("l_tax") >= 0.035).alias("nondegenerate"),
        F.count(F.lit(1)).cast("int").alias("complexity"),
        F.round(exact_mean("l_quantity") / 50.0, 6).alias("ari"),
    )
    method = F.element_at(methods, F.col("l_linenumber").cast("int"))
    from ordinalia.functions import expr as X

    return grouped.select(
        F.col("l_linestatus").alias("status"),
        F.lit("all").alias("calibration_id"),
        padded("l_suppkey").alias("report_id"),
        F.lit(3).alias("k"),
        method.alias("method_id"),
        X.family_of(method).alias("family"),
        F.round("q_score", 6).alias("q_score"),
        "complexity",
        "nondegenerate",
        "ari",
    )


# The seven methods in line-number order of the stand-in audit table.
METHODS = (
    "V_EUC_PAM",
    "V_COR_PAM",
    "R_FOOT_PAM",
    "R_PAIR_PAM",
    "H_EUC_PAIR_A025_PAM",
    "H_EUC_PAIR_A050_PAM",
    "H_EUC_PAIR_A075_PAM",
)


def gate_runs(spark: SparkSession, sf: str) -> DataFrame:
    """A table of the shape of finished runs, one per order, for the gate reports.

    The order's priority gives the expected regime, its status the decision, and its lines, dealt over the three families
    by line number, the scores.
    """
    family = (F.col("l_linenumber") - 1) % 3 + 1
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    lines = (
        table(spark, sf, "lineitem")
        .groupBy("l_orderkey")
        .agg(*[
            part
            for name, number in (("value", 1), ("relational", 2), ("hybrid", 3))
            for part in (
                F.round(F.max(F.when(family == number, F.col("l_discount"))) * 10.0, 6).alias(f"q_{name}"),
                F.round(F.max(F.when(family == number, F.col("l_quantity"))) / 50.0, 6).alias(f"ari_{name}"),
            )
        ])
    )
    priority = F.substring("o_orderpriority", 1, 1)
    regime = (
        F.when(priority == "1", "VALUE").when(priority == "2", "RELATIONAL").when(priority == "3", "HYBRID").otherwise("NULL")
    )
    expected = F.when(F.col("regime") == "NULL", "NO_STABLE_STRUCTURE").otherwise(F.col("regime"))
    top = F.greatest(*[F.coalesce(f"ari_{f}", F.lit(0.0)) for f in ("value", "relational", "hybrid")])
    decision = (
        F.when((F.col("o_orderstatus") == "F") & (F.col("regime") != "NULL"), F.col("regime"))
        .when(F.col("o_totalprice") > 400000, "HYBRID")
        .when(F.col("o_totalprice") > 300000, "VALUE")
        .otherwise("NO_STABLE_STRUCTURE")
    )
    return (
        orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .withColumn("regime", regime)
        .withColumn("expected_decision", expected)
        .withColumn("decision", decision)
        .withColumn("regret", F.round(F.greatest(F.lit(0.0), top - F.coalesce("ari_value", F.lit(0.0))), 6))
        .withColumn("decision_correct", F.col("decision") == F.col("expected_decision"))
        .select(
            F.col("o_orderkey").alias("run_id"), "regime",
            F.when(F.col("o_orderstatus") == "P", "moderate").otherwise("strong").alias("signal"),
            F.lower("o_orderstatus").alias("shift"),
            "expected_decision", "decision", "decision_correct", "regret",
            *[f"{p}_{f}" for p in ("q", "ari") for f in ("value", "relational", "hybrid")],
        )
    )


def scaled_edges(edges: DataFrame) -> DataFrame:
    return E.normalise(edges, E.positive_scale(edges))
