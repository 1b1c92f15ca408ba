"""Seeded perturbations of a user's measurements, all replicates in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions import quantiles as Q
from ..runtime import model_table
from .robust import FEATURE, SAMPLE, observed_scale

# Kinds in cycle order, and strength per level (small, moderate, strong).
KINDS = ("sample_monotone", "gene_offset", "additive_noise", "feature_dropout", "quantization")
LEVELS = ("small", "moderate", "strong")
STRENGTH = {
    "sample_monotone": (0.01, 0.03, 0.08),
    "gene_offset": (0.05, 0.20, 0.55),
    "additive_noise": (0.03, 0.10, 0.30),
    "feature_dropout": (0.01, 0.04, 0.12),
    "quantization": (0.02, 0.08, 0.20),
}
GAMMA_RANGE = (0.75, 1.25)
# Those that do not divide a sample count are coprime to it, and so are their products.
PRIMES = (1000000007, 1000000009, 1000000021, 1000000033, 1000000087, 1000000093, 1000000097, 1000000103)


def suite(count: int, level: str = "moderate") -> list[tuple[int, str, float]]:
    """``count`` replicates cycling over the kinds -> ``(rep, kind, strength)``."""
    if count <= 0:
        raise ValueError("count must be positive")
    at = LEVELS.index(level)
    return [(rep, KINDS[rep % len(KINDS)], STRENGTH[KINDS[rep % len(KINDS)]][at]) for rep in range(count)]


def perturbed_value(kind: Column, strength: Column, seed: int, rep: Column) -> Column:
    value, scale = F.col("value"), F.col("scale")
    gamma = X.clip(
        1.0 + strength * X.normal(seed, rep, "gamma", F.col("sample_id")), *GAMMA_RANGE
    )
    quantum = F.greatest(strength * scale, F.lit(2.220446049250313e-16))
    return (
        F.when(kind == "sample_monotone", F.signum(value) * F.pow(F.abs(value), gamma))
        .when(
            kind == "gene_offset",
            value + strength * scale * X.normal(seed, rep, "offset", F.col("feature_id")),
        )
        .when(
            kind == "additive_noise",
            value
            + strength * scale * X.normal(seed, rep, "noise", F.col("sample_id"), F.col("feature_id")),
        )
        .when(
            kind == "feature_dropout",
            F.when(
                X.uniform(seed, rep, "drop", F.col("sample_id"), F.col("feature_id")) >= strength, value
            ),
        )
        .when(kind == "quantization", F.bround(value / quantum) * quantum)
    )


def perturb(
    measurements: DataFrame,
    specs: list[tuple[int, str, float]],
    seed: int,
    scales: DataFrame | None = None,
) -> DataFrame:
    """Measurements of every replicate, with ``rep`` and ``kind`` columns; ids and schema stay as they are.

    ``scales`` may hold already materialised feature scales.
    """
    scales = model_table(observed_scale(measurements)) if scales is None else scales
    listed = F.array(
        *[
            F.struct(F.lit(rep).alias("rep"), F.lit(kind).alias("kind"), F.lit(s).alias("strength"))
            for rep, kind, s in specs
        ]
    )
    spread = measurements.join(scales, FEATURE, "left").select(
        *SAMPLE, "feature_id", "value", F.coalesce("scale", F.lit(1.0)).alias("scale"), F.explode(listed).alias("_s")
    )
    value = perturbed_value(F.col("_s.kind"), F.col("_s.strength"), seed, F.col("_s.rep"))
    return spread.select(
        "dataset_id",
        F.col("_s.rep").alias("rep"),
        F.col("_s.kind").alias("kind"),
        "sample_id",
        "feature_id",
        value.alias("value"),
    )


def sample_order(samples: DataFrame, seed: int, *salt) -> DataFrame:
    """Contiguous 0-based position ``at`` and size ``n`` of each sample in a seeded random order per dataset."""
    drawn = samples.select(*SAMPLE).distinct().withColumn(
        "_u", X.uniform(seed, *salt, F.col("sample_id"))
    )
    ranked = Q.average_rank(drawn, ["dataset_id"], "_u", "_rank")
    sizes = drawn.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"))
    return ranked.join(model_table(sizes), "dataset_id").select(
        *SAMPLE, (F.col("_rank") - 1).cast("bigint").alias("at"), "n"
    )


def shuffle_null(measurements: DataFrame, replicates: int, seed: int) -> DataFrame:
    """Structure-free copies of the user's own data: each feature's values move to other samples.

    Feature ``f`` of replicate ``r`` is permuted by ``at -> (a * at + b) mod n`` on a seeded random
    sample order, with ``a`` coprime to ``n``.  Every value is kept once; the only joins are on the
    sample index, so no feature column is ever sorted or gathered in one task.
    """
    order = sample_order(measurements, seed, "null")
    reps = F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep")
    placed = measurements.join(order, SAMPLE).select(
        "dataset_id", reps, "feature_id", "value", "at", "n"
    )
    primes = F.filter(F.array(*[F.lit(p).cast("bigint") for p in PRIMES]), lambda p: F.col("n") % p != 0)

    def prime(tag: str) -> Column:
        pick = (X.uniform(seed, tag, F.col("rep"), F.col("feature_id")) * F.size(primes)).cast("int")
        return F.get(primes, pick) % F.col("n")

    def product(a: Column, b: Column) -> Column:
        """a * b mod n, exact for every bigint count."""
        return (a.cast("decimal(19,0)") * b.cast("decimal(19,0)") % F.col("n").cast("decimal(19,0)")).cast("bigint")

    step = product(prime("p1"), prime("p2"))
    start = (X.uniform(seed, "b", F.col("rep"), F.col("feature_id")) * F.col("n")).cast("bigint")
    moved = placed.withColumn("at", (product(step, F.col("at")) + start) % F.col("n")).drop("n")
    names = order.select("dataset_id", "at", "sample_id")
    return moved.join(names, ["dataset_id", "at"]).select(
        F.format_string("%s#null%03d", "dataset_id", "rep").alias("dataset_id"),
        "sample_id",
        "feature_id",
        "value",
    )
