"""Operators on distance tables that the user brings: ``..., i, j, d`` with ``i < j``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions import quantiles as Q


def positive_scale(distances: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Median of the positive distances per group (groups without one have no row)."""
    keys = list(keys)
    found = Q.quantiles(distances.where(F.col("d") > 0), keys, "d", [0.5])
    return found.select(*keys, F.col("q")[0].alias("scale"))


def _with_scale(distances: DataFrame, scale: DataFrame, keys: list[str]) -> DataFrame:
    if keys:
        return distances.join(scale, keys)
    tag = F.lit(0).alias("_k")
    return distances.select("*", tag).join(scale.select("*", tag), "_k").drop("_k")


def normalise(distances: DataFrame, scale: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Distances over a frozen positive scale."""
    return _with_scale(distances, scale, list(keys)).withColumn("d", F.col("d") / F.col("scale")).drop("scale")


def hybrid(
    value: DataFrame, relational: DataFrame, alphas: Sequence[float], keys: Sequence[str] = ()
) -> DataFrame:
    """``(1 - alpha) * d_value / s_value + alpha * d_relational / s_relational`` for every alpha."""
    keys = list(keys)
    v = normalise(value, positive_scale(value, keys), keys).withColumnRenamed("d", "_v")
    r = normalise(relational, positive_scale(relational, keys), keys).withColumnRenamed("d", "_r")
    grid = F.explode(F.array(*[F.lit(float(a)) for a in alphas])).alias("alpha")
    mixed = v.join(r, [*keys, "i", "j"]).select("*", grid)
    return mixed.select(
        *keys,
        X.hybrid_method_of(F.col("alpha")).alias("method_id"),
        "i",
        "j",
        ((1.0 - F.col("alpha")) * F.col("_v") + F.col("alpha") * F.col("_r")).alias("d"),
    )


def order_stability(first: DataFrame, second: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Spearman correlation of two distance tables over their pairs, clipped to [0, 1].

    Equal tables score 1; a constant table scores 0.
    """
    keys = list(keys)
    tag = [] if keys else [F.lit(0).alias("_g")]
    group = keys or ["_g"]
    both = first.join(second.withColumnRenamed("d", "d2"), [*keys, "i", "j"]).select("*", *tag)
    rho = Q.spearman(both, group, "d", "d2", "_rho")
    same = both.groupBy(*group).agg(F.min((F.col("d") == F.col("d2")).cast("int")).alias("_same"))
    score = F.when(F.col("_same") == 1, 1.0).otherwise(X.clip(F.col("_rho"), 0.0, 1.0))
    return rho.join(same, group).select(*keys, score.alias("order_stability"))
