"""Exact quantiles and average ranks that survive very large groups.

Small groups use Spark's ``percentile`` / a rank window.  When a counted group is larger than
``SMALL_GROUP`` rows, equal values are first collapsed into counts, the distinct values are cut into
bins at approximate quantiles, and only the bins that hold the wanted ranks are ordered.  Both ways
give the same exact answer; no task ever holds a whole large group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Groups up to this many rows are finished inside one aggregation buffer or window.
SMALL_GROUP = 1_000_000
#: Wanted number of distinct values per bin of a large group.
BIN_ROWS = 1_000_000


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    counts = df.groupBy(*keys).count() if keys else df.agg(F.count(F.lit(1)).alias("count"))
    return int(counts.agg(F.max("count")).first()[0] or 0)


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    *,
    weight: str | None = None,
    group_rows: int | None = None,
    small_group: int = SMALL_GROUP,
) -> DataFrame:
    """Linearly interpolated exact quantiles per group -> ``keys..., q array<double>, n``.

    ``weight`` is an optional integer multiplicity.  ``group_rows`` is a known bound on the rows per
    group; without it the groups are counted first.
    """
    keys = list(keys)
    mult = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    rows = df.select(*keys, F.col(value).cast("double").alias("_v"), mult.alias("_w"))
    rows = rows.where(F.col("_v").isNotNull() & (F.col("_w") > 0))
    bound = largest_group(rows, keys) if group_rows is None else group_rows
    if bound <= small_group:
        wanted = F.array(*[F.lit(float(p)) for p in probs])
        freq = F.col("_w") if weight else F.lit(1)
        return rows.groupBy(*keys).agg(
            F.percentile("_v", wanted, freq).alias("q"), F.sum("_w").alias("n")
        )
    return _large_quantiles(rows, keys, [float(p) for p in probs], bound)


def _binned(rows: DataFrame, keys: list[str], bound: int) -> DataFrame:
    """Collapse equal values and add ``_bin`` plus ``_before`` (weight in the lower bins) and ``_total``."""
    bins = max(16, min(1024, bound // BIN_ROWS + 1))
    grid = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    distinct = rows.groupBy(*keys, "_v").agg(F.sum("_w").alias("_w"))
    sketch = (
        distinct.groupBy(*keys)
        .agg(F.percentile_approx("_v", grid, 20 * bins).alias("_cuts"))
        .withColumn("_cuts", F.array_distinct("_cuts"))
    )
    joined = distinct.join(sketch, keys).withColumn(
        "_bin", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))).cast("int")
    )
    sizes = joined.groupBy(*keys, "_bin").agg(F.sum("_w").alias("_bw"))
    # at most `bins` rows per group enter these windows
    by_group = W.partitionBy(*keys)
    sizes = sizes.select(
        *keys,
        "_bin",
        (F.sum("_bw").over(by_group.orderBy("_bin")) - F.col("_bw")).alias("_before"),
        F.col("_bw"),
        F.sum("_bw").over(by_group).alias("_total"),
    )
    return joined.drop("_cuts").join(sizes, [*keys, "_bin"])


def _values_at(binned: DataFrame, keys: list[str], ranks: list[Column]) -> DataFrame:
    """Values at 0-based ``ranks`` (expressions of ``_total``) as ``_s0, _s1, ...`` plus ``n``."""
    hit = binned.withColumn("_ranks", F.array(*[r.cast("bigint") for r in ranks])).where(
        F.exists(
            "_ranks", lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_bw"))
        )
    )
    upto = F.col("_before") + F.sum("_w").over(W.partitionBy(*keys, "_bin").orderBy("_v"))
    found = (
        hit.withColumn("_upto", upto)
        .select(*keys, "_v", "_w", "_upto", "_total", F.posexplode("_ranks").alias("_slot", "_rank"))
        .where((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_w")))
    )
    slots = [F.max(F.when(F.col("_slot") == i, F.col("_v"))).alias(f"_s{i}") for i in range(len(ranks))]
    return found.groupBy(*keys).agg(F.first("_total").alias("n"), *slots)


def _large_quantiles(rows: DataFrame, keys: list[str], probs: list[float], bound: int) -> DataFrame:
    group = keys or ["_g"]
    grouped = rows if keys else rows.withColumn("_g", F.lit(0))
    position = [F.lit(p) * (F.col("_total") - 1) for p in probs]
    wide = _values_at(
        _binned(grouped, group, bound), group, [f(h) for h in position for f in (F.floor, F.ceil)]
    )
    parts = []
    for i, p in enumerate(probs):
        h = F.lit(p) * (F.col("n") - 1)
        low, high = F.col(f"_s{2 * i}"), F.col(f"_s{2 * i + 1}")
        parts.append(low + (high - low) * (h - F.floor(h)))
    return wide.select(*keys, F.array(*parts).alias("q"), "n")


def average_rank(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    out: str,
    *,
    group_rows: int | None = None,
    small_group: int = SMALL_GROUP,
) -> DataFrame:
    """Add the 1-based average rank of ``value`` within each group (ties share their mean rank).

    A NULL keeps its row, has no rank and does not count, whatever the size of its group.
    """
    keys = list(keys)
    if not keys:
        return average_rank(
            df.withColumn("_g", F.lit(0)), ["_g"], value, out, group_rows=group_rows, small_group=small_group
        ).drop("_g")
    bound = largest_group(df, keys) if group_rows is None else group_rows
    if bound <= small_group:
        group = W.partitionBy(*keys)
        first = F.rank().over(group.orderBy(F.asc_nulls_last(value)))
        ties = F.count(F.lit(1)).over(W.partitionBy(*keys, value))
        return df.withColumn(out, F.when(F.col(value).isNotNull(), first + (ties - 1) / 2.0))
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"), F.lit(1).cast("bigint").alias("_w"))
    binned = _binned(rows, keys, bound)
    upto = F.col("_before") + F.sum("_w").over(W.partitionBy(*keys, "_bin").orderBy("_v"))
    ranks = binned.select(*keys, F.col("_v").alias(value), (upto - (F.col("_w") - 1) / 2.0).alias(out))
    return df.join(ranks, [*keys, value], "left")


def upper_quantile(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    prob: float,
    out: str,
    *,
    small_group: int = SMALL_GROUP,
) -> DataFrame:
    """Observed value at index ``ceil(prob * (n - 1))`` of each sorted group, with the group size ``n``."""
    keys = list(keys)
    group = keys or ["_g"]
    rows = df.where(F.col(value).isNotNull()).select(
        *(keys or [F.lit(0).alias("_g")]),
        F.col(value).cast("double").alias("_v"),
        F.lit(1).cast("bigint").alias("_w"),
    )
    target = F.ceil(F.lit(float(prob)) * (F.col("_total") - 1))
    bound = largest_group(rows, group)
    if bound <= small_group:
        by_group = W.partitionBy(*group)
        ranked = rows.select(
            *group,
            "_v",
            F.row_number().over(by_group.orderBy("_v")).alias("_at"),
            F.count(F.lit(1)).over(by_group).alias("_total"),
        )
        return ranked.where(F.col("_at") - 1 == target).select(
            *keys, F.col("_v").alias(out), F.col("_total").alias("n")
        )
    wide = _values_at(_binned(rows, group, bound), group, [target])
    return wide.select(*keys, F.col("_s0").alias(out), "n")


def spearman(
    df: DataFrame, keys: Sequence[str], left: str, right: str, out: str, **bounds
) -> DataFrame:
    """Spearman correlation per group on average ranks; 0 where it is not defined."""
    keys = list(keys)
    bound = bounds.get("group_rows") or largest_group(df, keys)
    ranked = average_rank(df, keys, left, "_ra", group_rows=bound)
    ranked = average_rank(ranked, keys, right, "_rb", group_rows=bound)
    rho = F.corr("_ra", "_rb")
    return ranked.groupBy(*keys).agg(
        F.when(rho.isNull() | F.isnan(rho), 0.0).otherwise(rho).alias(out)
    )
