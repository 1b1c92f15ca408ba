"""Within-sample ranks and order relations between features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import expr as X
from ..runtime import BROADCAST_ROWS, at_most, checked_broadcast, cut, model_table
from .robust import FEATURE, SAMPLE


def rank_columns(keys: list[str], value: str = "value") -> Column:
    """Normalised average rank ``(r - 1) / (m - 1)`` over the observed cells of one sample; ``m = 1`` gives 0."""
    observed = F.col(value).isNotNull()
    cells = W.partitionBy(*keys, observed)
    # the value joins the partition key only for the tie count, so one shuffle by sample serves both
    first = F.rank().over(cells.orderBy(value))
    ties = F.count(F.lit(1)).over(W.partitionBy(*keys, observed, F.col(value)))
    m = F.count(F.lit(1)).over(cells)
    q = (first - 1 + (ties - 1) / 2.0) / F.greatest(m - 1, F.lit(1))
    return F.when(observed, q)


def rank_encode(measurements: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Long rank table; a missing cell has no row.  Restrict the features first."""
    keys = keys or SAMPLE
    ranked = measurements.withColumn("q", rank_columns(keys))
    return ranked.where(F.col("q").isNotNull()).select(*keys, "feature_id", "q")


def profile_rows(
    measurements: DataFrame, model: DataFrame, keys: list[str] | None = None
) -> DataFrame:
    """One row per sample with aligned arrays ``x`` (raw) and ``q`` (rank), NULL where missing.

    ``model`` is the one-row-per-dataset table of ``robust.feature_model``; its columns stay on the
    row.  Ranks are over the model features.  A sample without any model feature keeps a row.
    """
    keys = keys or SAMPLE
    selected = model.select(
        "dataset_id", F.posexplode("feature_ids").alias("_pos", "feature_id")
    )
    # one count decides for both: the model has fewer rows than its exploded features
    small = at_most(selected, BROADCAST_ROWS)
    marked = measurements.join(F.broadcast(selected) if small else selected, FEATURE, "left")
    used = F.col("_pos").isNotNull() & F.col("value").isNotNull()
    ranked = (
        marked.select(*keys, "_pos", F.when(used, F.col("value")).alias("value"))
        .withColumn("q", rank_columns(keys))
    )
    cell = F.when(F.col("q").isNotNull(), F.struct("_pos", "value", "q"))
    packed = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(cell)).alias("_cells"))
    rows = packed.join(F.broadcast(model) if small else model, "dataset_id")
    complete = F.size("_cells") == F.size("feature_ids")
    lookup = F.map_from_entries(
        F.transform("_cells", lambda c: F.struct(c["_pos"], F.struct(c["value"], c["q"])))
    )
    positions = F.sequence(F.lit(0), F.size("feature_ids") - 1)

    def aligned(field: str) -> Column:
        found = X.let(lookup, lambda m: F.transform(positions, lambda p: m[p][field]))
        return F.when(complete, F.transform("_cells", lambda c: c[field])).otherwise(found)

    return (
        rows.withColumn("x", aligned("value"))
        .withColumn("q", aligned("q"))
        .drop("_cells")
    )


def state_of(difference: Column, margin: float | Column = 0.0) -> Column:
    """+1 above the margin, -1 below its negative, 0 between, NULL if a side is missing."""
    margin = margin if isinstance(margin, Column) else F.lit(float(margin))
    return (
        F.when(difference > margin, 1)
        .when(difference < -margin, -1)
        .when(difference.isNotNull(), 0)
        .cast("tinyint")
    )


def relation_states(ranks: DataFrame, pairs: DataFrame, margin: float = 0.0) -> DataFrame:
    """Long relation table for a frozen pair list ``dataset_id, left, right`` (state NULL if unobserved).

    A self pair, a repeated pair or a pair with a feature that has no ranks is an error.
    """
    pairs = cut(pairs.select("dataset_id", "left", "right"))
    bad = invalid_pairs(pairs, ranks.select("dataset_id", "feature_id").distinct()).limit(3).collect()
    if bad:
        raise ValueError("invalid pairs, e.g. " + "; ".join(f"{r['left']}>{r['right']} ({r['reason']})" for r in bad))
    listed = checked_broadcast(pairs)
    by_sample = ranks.groupBy(*SAMPLE).agg(
        F.map_from_entries(F.collect_list(F.struct("feature_id", "q"))).alias("_q")
    )
    return by_sample.join(listed, "dataset_id").select(
        *SAMPLE,
        "left",
        "right",
        state_of(F.col("_q")[F.col("left")] - F.col("_q")[F.col("right")], margin).alias("state"),
    )


def binary_relations(measurements: DataFrame, pairs: DataFrame) -> DataFrame:
    """Strict ``value(left) > value(right)`` as 0/1 on complete samples; a tie gives 0."""
    by_sample = measurements.groupBy(*SAMPLE).agg(
        F.map_from_entries(F.collect_list(F.struct("feature_id", "value"))).alias("_v")
    )
    return by_sample.join(model_table(pairs), "dataset_id").select(
        *SAMPLE,
        "left",
        "right",
        (F.col("_v")[F.col("left")] > F.col("_v")[F.col("right")]).cast("tinyint").alias("bit"),
    )


def invalid_pairs(pairs: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """Self pairs, duplicates and (given the known features) pairs with an unknown end."""
    keys = ["dataset_id", "left", "right"]
    self_pairs = pairs.where(F.col("left") == F.col("right")).select(
        *keys, F.lit("self pair").alias("reason")
    )
    repeated = (
        pairs.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > 1)
        .select(*keys, F.lit("duplicate pair").alias("reason"))
    )
    found = self_pairs.unionByName(repeated)
    if features is None:
        return found
    known = features.select(*FEATURE).distinct()
    for side in ("left", "right"):
        missing = pairs.join(
            known.withColumnRenamed("feature_id", side), ["dataset_id", side], "left_anti"
        )
        found = found.unionByName(missing.select(*keys, F.lit(f"unknown {side}").alias("reason")))
    return found


def candidate_pairs(selected: DataFrame) -> DataFrame:
    """All unordered pairs of the selected features, left id < right id, numbered from 0 per dataset.

    Built from one sorted feature array per dataset, so its size is set by the feature budget.
    """
    features = selected.groupBy("dataset_id").agg(F.array_sort(F.collect_set("feature_id")).alias("_f"))
    return _pairs_of(features)


def ranked_pairs(selected: DataFrame, max_pairs: int) -> DataFrame:
    """The first ``max_pairs`` pairs in feature-rank order (i, j), i before j."""
    ranked = F.array_sort(F.collect_list(F.struct("feature_rank", "feature_id")))
    features = selected.groupBy("dataset_id").agg(
        F.transform(ranked, lambda s: s["feature_id"]).alias("_f")
    )
    return _pairs_of(features).where(F.col("pair_no") < max_pairs)


def _pairs_of(features: DataFrame) -> DataFrame:
    left = features.select("dataset_id", "_f", F.posexplode("_f").alias("_i", "left"))
    rest = F.slice("_f", F.col("_i") + 2, F.greatest(F.size("_f") - F.col("_i") - 1, F.lit(0)))
    both = left.select("dataset_id", F.size("_f").alias("_p"), "_i", "left", F.posexplode(rest).alias("_k", "right"))
    before = (F.col("_i") * (2 * F.col("_p") - F.col("_i") - 1) / 2).cast("bigint")
    return both.select("dataset_id", (before + F.col("_k")).alias("pair_no"), "left", "right")
