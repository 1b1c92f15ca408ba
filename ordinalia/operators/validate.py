"""Integrity queries: each returns the rows that break a contract (empty means valid)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: tolerance of distance checks.
TOLERANCE = 1e-12


def measurement_violations(measurements: DataFrame) -> DataFrame:
    """``dataset_id, sample_id, feature_id, violation`` for bad ids, repeated cells and infinite values."""
    keys = ["dataset_id", "sample_id", "feature_id"]
    per_row = F.array_compact(
        F.array(
            *[
                F.when(F.col(c).isNull() | (F.col(c) == ""), F.lit(f"empty {c}")) for c in keys
            ],
            *[F.when(F.col(c) != F.trim(F.col(c)), F.lit(f"untrimmed {c}")) for c in keys],
            F.when(F.abs("value") == float("inf"), F.lit("infinite value")),
            F.when(F.isnan("value"), F.lit("NaN instead of NULL")),
        )
    )
    rows = measurements.select(*keys, F.explode(per_row).alias("violation"))
    repeated = (
        measurements.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > 1)
        .select(*keys, F.lit("repeated cell").alias("violation"))
    )
    return rows.unionByName(repeated)


def distance_violations(distances: DataFrame) -> DataFrame:
    """``i, j, violation`` of a directed distance table ``i, j, d`` (missing mirror rows count as asymmetric)."""
    mirror = distances.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("d").alias("mirror"))
    both = distances.join(mirror, ["i", "j"], "left")
    found = F.array_compact(
        F.array(
            F.when(F.col("d").isNull() | F.isnan("d") | (F.abs("d") == float("inf")), F.lit("not finite")),
            F.when(F.col("d") < -TOLERANCE, F.lit("negative")),
            F.when((F.col("i") == F.col("j")) & (F.abs("d") > TOLERANCE), F.lit("nonzero diagonal")),
            F.when(
                F.col("mirror").isNull() | (F.abs(F.col("d") - F.col("mirror")) > TOLERANCE), F.lit("asymmetric")
            ),
        )
    )
    return both.select("i", "j", F.explode(found).alias("violation"))


def symmetrise(distances: DataFrame) -> DataFrame:
    """Mean of both directions, negatives at 0, as a strict upper triangle ``i < j`` (zero diagonal implied)."""
    return (
        distances.where(F.col("i") != F.col("j"))
        .groupBy(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
        .agg(F.greatest(F.avg("d"), F.lit(0.0)).alias("d"))
    )


def sample_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Samples that only one of two tables has."""
    a, b = left.select("sample_id").distinct(), right.select("sample_id").distinct()
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(
        b.exceptAll(a).withColumn("side", F.lit("right"))
    )


def row_hash(columns: list[str]) -> Column:
    """Hash of one row; NULL and empty text differ."""
    parts = [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in columns]
    return F.md5(F.concat_ws("|", *parts))


def fingerprint(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Order-independent content fingerprint per group: row count plus the sum of two 52-bit row hashes.

    The sums are exact decimals that combine map-side, so the fingerprint needs no sort and no list
    of hashes, and repeated rows do not cancel out.
    """
    hashed = df.select(*keys, row_hash(columns).alias("_h"))

    def part(start: int) -> Column:
        digits = F.conv(F.substring("_h", start, 13), 16, 10)
        return F.sum(digits.cast("decimal(38,0)")).cast("decimal(38,0)").cast("string")

    return hashed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.concat_ws("-", part(1), part(14)).alias("fingerprint"),
    )


def table_differences(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full-outer comparison of two keyed tables, e.g. (path, sha256) or (metric, value)."""
    a = left.select(*keys, F.col(value).alias("left_value"), F.lit(True).alias("_l"))
    b = right.select(*keys, F.col(value).alias("right_value"), F.lit(True).alias("_r"))
    status = (
        F.when(F.col("_r").isNull(), "missing right")
        .when(F.col("_l").isNull(), "missing left")
        .when(~F.col("left_value").eqNullSafe(F.col("right_value")), "different")
    )
    return (
        a.join(b, keys, "full_outer")
        .withColumn("status", status)
        .where(F.col("status").isNotNull())
        .select(*keys, "left_value", "right_value", "status")
    )


def unfinished(expected: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Expected runs without a finished record."""
    return expected.select(*keys).distinct().join(done.select(*keys).distinct(), keys, "left_anti")


def record_problems(done: DataFrame, inventory: DataFrame, schema_tag: str) -> DataFrame:
    """Finished records whose checksum, schema tag or runtime record is not as it should be.

    ``done(run_id, schema_tag, sha256, seconds)`` against ``inventory(run_id, sha256)``.
    """
    listed = inventory.select("run_id", F.col("sha256").alias("expected_sha"))
    problems = F.array_compact(
        F.array(
            F.when(~F.col("sha256").eqNullSafe(F.col("expected_sha")), F.lit("checksum")),
            F.when(F.col("schema_tag") != schema_tag, F.lit("schema")),
            F.when(F.col("seconds").isNull() | (F.col("seconds") < 0), F.lit("runtime")),
        )
    )
    return done.join(listed, "run_id", "left").select("run_id", F.explode(problems).alias("problem"))


def require_empty(violations: DataFrame, message: str) -> None:
    """Raise if a violation table has rows; shows at most a few of them."""
    shown = violations.limit(5).collect()
    if shown:
        raise ValueError(f"{message}: {[r.asDict() for r in shown]}")


def evaluation_gate(expected: DataFrame, done: DataFrame, inventory: DataFrame, schema_tag: str) -> None:
    """Refuse evaluation unless every expected run is frozen and intact; call before joining labels."""
    require_empty(unfinished(expected, done, ["run_id"]), "runs are not frozen yet")
    require_empty(record_problems(done, inventory, schema_tag), "frozen runs are damaged")


def stale_reports(reports: DataFrame, config_sha: str, n_samples: DataFrame) -> DataFrame:
    """NULL reports of another configuration or another sample set.

    ``reports(report_id, config_sha, sample_id)``; ``n_samples(report_id, n_samples)`` is expected.
    """
    seen = reports.groupBy("report_id").agg(
        F.countDistinct("sample_id").alias("found_samples"),
        F.max((F.col("config_sha") != config_sha).cast("int")).alias("_other"),
    )
    reason = F.when(F.col("_other") == 1, "config").when(
        ~F.col("found_samples").eqNullSafe(F.col("n_samples")), "samples"
    )
    return (
        n_samples.join(seen, "report_id", "left")
        .withColumn("reason", F.when(F.col("found_samples").isNull(), "missing").otherwise(reason))
        .where(F.col("reason").isNotNull())
        .select("report_id", "reason")
    )


def recomputed_differences(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Rows of a stored summary that its details do not give, and the other way round."""
    columns = stored.columns
    again = recomputed.select(*columns)
    return stored.exceptAll(again).withColumn("side", F.lit("stored only")).unionByName(
        again.exceptAll(stored).withColumn("side", F.lit("recomputed only"))
    )


def wrong_claims(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claimed ``metric, value`` pairs that the evidence does not have with the same value."""
    return table_differences(claims, evidence, ["metric"], "value")
