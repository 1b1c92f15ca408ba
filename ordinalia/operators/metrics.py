"""Agreement between partitions, coverage and rule recovery, from contingency counts only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def contingency(df: DataFrame, keys: Sequence[str], truth: str, predicted: str) -> DataFrame:
    """``keys..., truth, predicted, n``: the only place where sample rows are read."""
    return df.groupBy(*keys, F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _margins(table: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    rows = table.groupBy(*keys, "truth").agg(F.sum("n").alias("n"))
    cols = table.groupBy(*keys, "predicted").agg(F.sum("n").alias("n"))
    return rows, cols


def _pairs(n: Column) -> Column:
    return n.cast("double") * (n - 1) / 2.0


def adjusted_rand(table: DataFrame, keys: Sequence[str], out: str = "ari") -> DataFrame:
    """Adjusted Rand index per group of a contingency table; two trivial partitions agree fully."""
    keys = list(keys)
    rows, cols = _margins(table, keys)
    both = table.groupBy(*keys).agg(F.sum(_pairs(F.col("n"))).alias("_ij"), F.sum("n").alias("_n"))
    a = rows.groupBy(*keys).agg(F.sum(_pairs(F.col("n"))).alias("_a"))
    b = cols.groupBy(*keys).agg(F.sum(_pairs(F.col("n"))).alias("_b"))
    joined = _join(_join(both, a, keys), b, keys)
    total = _pairs(F.col("_n"))
    expected = F.when(total > 0, F.col("_a") * F.col("_b") / total).otherwise(0.0)
    best = (F.col("_a") + F.col("_b")) / 2.0
    # perfect agreement first: it also covers the groups where the denominator vanishes
    perfect = (F.col("_ij") == F.col("_a")) & (F.col("_ij") == F.col("_b"))
    score = F.when(perfect, 1.0).otherwise((F.col("_ij") - expected) / (best - expected))
    return joined.select(*keys, score.alias(out), F.col("_n").alias("n_samples"))


def _join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    if keys:
        return left.join(right, keys)
    tagged = left.withColumn("_g", F.lit(0)).join(right.withColumn("_g", F.lit(0)), "_g")
    return tagged.drop("_g")


def normalised_mutual_information(table: DataFrame, keys: Sequence[str], out: str = "nmi") -> DataFrame:
    """Mutual information over the mean of the two entropies; 1 for two one-cluster partitions."""
    keys = list(keys)
    rows, cols = _margins(table, keys)
    total = table.groupBy(*keys).agg(F.sum("n").alias("_n"))

    def entropy(part: DataFrame, name: str) -> DataFrame:
        share = F.col("n") / F.col("_n")
        return _join(part, total, keys).groupBy(*keys).agg(
            F.sum(-share * F.log(share)).alias(name), F.count(F.lit(1)).alias(name + "_k")
        )

    cells = (
        table.join(rows.withColumnRenamed("n", "_r"), [*keys, "truth"])
        .join(cols.withColumnRenamed("n", "_c"), [*keys, "predicted"])
    )
    cells = _join(cells, total, keys)
    share = F.col("n") / F.col("_n")
    mutual = cells.groupBy(*keys).agg(
        F.sum(share * F.log(F.col("n").cast("double") * F.col("_n") / (F.col("_r").cast("double") * F.col("_c")))).alias("_mi")
    )
    joined = _join(_join(mutual, entropy(rows, "_h1"), keys), entropy(cols, "_h2"), keys)
    mean = (F.col("_h1") + F.col("_h2")) / 2.0
    score = (
        F.when((F.col("_h1_k") == 1) & (F.col("_h2_k") == 1), 1.0)
        .when(F.col("_mi") <= 2.220446049250313e-16, 0.0)
        .otherwise(F.col("_mi") / mean)
    )
    return joined.select(*keys, score.alias(out))


def co_membership(table: DataFrame, keys: Sequence[str], k: int, out: str = "prediction_strength") -> DataFrame:
    """Smallest share, over predicted clusters, of member pairs that the other partition keeps together.

    ``table`` has the observed partition as ``truth``.  Clusters with fewer than two members, also
    those that are absent, count as 0.
    """
    keys = list(keys)
    per = table.groupBy(*keys, "predicted").agg(
        F.sum(_pairs(F.col("n"))).alias("_together"), F.sum("n").alias("_n")
    )
    share = F.when(F.col("_n") < 2, 0.0).otherwise(F.col("_together") / _pairs(F.col("_n")))
    found = per.groupBy(*keys).agg(F.min(share).alias("_m"), F.count(F.lit(1)).alias("_k"))
    return found.select(*keys, F.when(F.col("_k") < k, 0.0).otherwise(F.col("_m")).alias(out))


def nondegeneracy(labels: DataFrame, keys: Sequence[str], k: int, min_fraction: float) -> DataFrame:
    """Cluster size balance: ``nondegeneracy_score, nondegenerate, min_cluster_fraction, cluster_entropy``."""
    keys = list(keys)
    sizes = labels.groupBy(*keys, "cluster").agg(F.count(F.lit(1)).alias("_n"))
    totals = sizes.groupBy(*keys).agg(
        F.sum("_n").alias("_t"),
        F.min("_n").alias("_small"),
        F.count(F.lit(1)).alias("_k"),
        F.sum(F.col("_n") * F.log(F.col("_n").cast("double"))).alias("_nln"),
    )
    smallest = F.when(F.col("_k") < k, 0.0).otherwise(F.col("_small") / F.col("_t"))
    entropy = (F.log(F.col("_t").cast("double")) - F.col("_nln") / F.col("_t")) / F.log(F.lit(float(k)))
    size_score = F.least(F.lit(1.0), smallest / min_fraction) if min_fraction > 0 else F.lit(1.0)
    return totals.select(
        *keys,
        F.least(size_score, entropy).alias("nondegeneracy_score"),
        ((F.col("_k") == k) & (smallest >= min_fraction)).alias("nondegenerate"),
        smallest.alias("min_cluster_fraction"),
        entropy.alias("cluster_entropy"),
    )


def coverage(assignments: DataFrame, keys: Sequence[str]) -> DataFrame:
    accepted = F.col("accepted_cluster").isNotNull()
    return assignments.groupBy(*keys).agg(
        F.avg(accepted.cast("double")).alias("coverage"), F.count(F.lit(1)).alias("n_samples")
    )


def accepted_rand(
    assignments: DataFrame, keys: Sequence[str], minimum: int = 2, single_cluster_score: bool = True
) -> DataFrame:
    """ARI over accepted rows; NULL with fewer than ``minimum`` of them.

    With ``single_cluster_score=False`` too few rows, or one accepted cluster only, score 0 instead.
    """
    keys = list(keys)
    accepted = assignments.where(F.col("accepted_cluster").isNotNull())
    table = contingency(accepted, keys, "label", "accepted_cluster")
    scored = adjusted_rand(table, keys, "_ari").join(
        table.groupBy(*keys).agg(F.countDistinct("predicted").alias("_clusters")), keys
    )
    groups = assignments.select(*keys).distinct().join(scored, keys, "left")
    enough = F.col("n_samples") >= minimum
    if not single_cluster_score:
        value = F.when(enough & (F.col("_clusters") > 1), F.col("_ari")).otherwise(0.0)
    else:
        value = F.when(enough, F.col("_ari"))
    return groups.select(*keys, value.alias("accepted_ari"))


def smallest_accepted_share(assignments: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """Accepted rows of the smallest cluster over all rows; a cluster nobody was accepted to counts as 0."""
    keys = list(keys)
    sizes = assignments.groupBy(*keys).agg(F.count(F.lit(1)).alias("_t"))
    used = (
        assignments.where(F.col("accepted_cluster").isNotNull())
        .groupBy(*keys, "accepted_cluster")
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy(*keys)
        .agg(F.min("_n").alias("_n"), F.count(F.lit(1)).alias("_k"))
    )
    share = F.when(F.col("_k") == k, F.col("_n") / F.col("_t")).otherwise(0.0)
    return sizes.join(used, keys, "left").select(*keys, share.alias("min_accepted_share"))


def pair_recovery(truth: DataFrame, learned: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of the designated unordered feature pairs that the learned rules contain."""
    keys = list(keys)

    def unordered(df: DataFrame) -> DataFrame:
        return df.select(
            *keys,
            F.least("feature_a", "feature_b").alias("_l"),
            F.greatest("feature_a", "feature_b").alias("_r"),
        ).distinct()

    found = unordered(learned).withColumn("_hit", F.lit(1))
    joined = unordered(truth).join(found, [*keys, "_l", "_r"], "left")
    return joined.groupBy(*keys).agg(
        F.avg(F.coalesce("_hit", F.lit(0)).cast("double")).alias("pair_recovery")
    )


def prototype_size(rules: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rules.groupBy(*keys).agg(F.count(F.lit(1)).alias("prototype_size"))
