"""Clusters as sparse sets of executable rules ``feature_a > feature_b`` (or ``<``).

Fitting works on one array per sample and per-task counts per pair; nothing of size samples x pairs
or samples x samples is built.  Each round is one pass over the samples.  Model tables have one row
per dataset and stay DataFrames.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import expr as X
from ..runtime import attach_models, cut, stored
from . import robust as R
from .ranks import ranked_pairs
from .tiles import matrix

#: Scores and distances are compared after rounding to this many decimals.
SCORE_DIGITS = 12
RULES = "array<struct<cluster:int,rule_rank:int,pair_no:bigint,direction:int,weight:double,support:double,contrast:double>>"

# ---------------------------------------------------------------- input rows


def select_features(measurements: DataFrame, budget: int) -> DataFrame:
    """Top features by the MAD of the median-imputed column, ties by feature id."""
    return R.top_features(R.imputed_mad(measurements).withColumn("scale", F.lit(1.0)), budget)


def fit_rows(measurements: DataFrame, selected: DataFrame) -> DataFrame:
    """``dataset_id, sample_id, x``: imputed values of the selected features in rank order."""
    rows = R.aligned_rows(measurements, R.feature_model(selected))
    filled = F.transform(
        F.arrays_zip(F.col("x").alias("x"), F.col("medians").alias("m")),
        lambda i: F.coalesce(i["x"], i["m"], F.lit(0.0)),
    )
    return rows.select("dataset_id", "sample_id", filled.alias("x"))


# ---------------------------------------------------------------- task-side arithmetic


def _bits(x: np.ndarray, max_pairs: int) -> np.ndarray:
    """0/1 relations in pair order; pairs run over feature ranks (0,1), (0,2), ..."""
    left, right = np.triu_indices(x.shape[1], 1)
    return (x[:, left[:max_pairs]] > x[:, right[:max_pairs]]).astype(float)


def _seed_distances(bits: np.ndarray, seeds: list, max_pairs: int) -> np.ndarray:
    codes = _bits(np.array(seeds, dtype=float), max_pairs)
    return np.stack([np.round((bits != c).mean(axis=1), SCORE_DIGITS) for c in codes], axis=1)


def _rule_scores(bits: np.ndarray, rules: list[dict], k: int) -> np.ndarray:
    scores = np.zeros((len(bits), k))
    for c in range(k):
        mine = [r for r in rules if r["cluster"] == c]
        at = np.array([r["pair_no"] for r in mine], dtype=int)
        wanted = np.array([r["direction"] for r in mine], dtype=float)
        weight = np.array([r["weight"] for r in mine])
        scores[:, c] = ((bits[:, at] == wanted) * weight).sum(axis=1) / weight.sum()
    return np.round(scores, SCORE_DIGITS)


def _model_labels(bits, ids, model, k, max_pairs):
    """Labels and scores under a model: nearest seed before the first rules exist, best score after."""
    if model["rules"]:
        scores = _rule_scores(bits, model["rules"], k)
    else:
        scores = -_seed_distances(bits, model["seeds"], max_pairs)
    labels = np.argmax(scores, axis=1)
    moved = dict(model["moved"] or [])
    if moved:
        labels = np.array([moved.get(s, l) for s, l in zip(ids, labels)])
    return labels, scores


def _by_dataset(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch]]:
    names = np.array(batch.column("dataset_id").to_pylist(), dtype=object)
    for dataset in dict.fromkeys(names.tolist()):
        yield dataset, batch.take(pa.array(np.flatnonzero(names == dataset)))


def _prevalence(max_pairs: int):
    def run(batches):
        for batch in batches:
            for dataset, part in _by_dataset(batch):
                bits = _bits(matrix(part.column("x")), max_pairs)
                m = bits.shape[1]
                yield pa.RecordBatch.from_pydict(
                    {
                        "dataset_id": pa.array([dataset] * m, pa.string()),
                        "pair_no": pa.array(np.arange(m), pa.int64()),
                        "ones": pa.array(bits.sum(axis=0).astype(np.int64)),
                        "n": pa.array([len(bits)] * m, pa.int64()),
                    }
                )

    return run


def _farthest(max_pairs: int):
    """Best next seed of each task: most atypical sample first, then the one farthest from the seeds."""

    def run(batches):
        for batch in batches:
            for dataset, part in _by_dataset(batch):
                x = matrix(part.column("x"))
                bits = _bits(x, max_pairs)
                seeds = part.column("seeds")[0].as_py() or []
                ids = part.column("sample_id").to_pylist()
                if seeds:
                    score = _seed_distances(bits, [s["x"] for s in seeds], max_pairs).min(axis=1)
                    score[np.isin(ids, [s["sample_id"] for s in seeds])] = -1.0
                else:
                    share = np.array(part.column("prevalence")[0].as_py())
                    score = np.round(np.abs(bits - share).mean(axis=1), SCORE_DIGITS)
                top = np.flatnonzero(score == score.max())
                best = min(top, key=lambda i: ids[i])
                yield pa.RecordBatch.from_pydict(
                    {
                        "dataset_id": pa.array([dataset], pa.string()),
                        "far": pa.array([-float(score[best])]),
                        "sample_id": pa.array([ids[best]], pa.string()),
                        "x": pa.array([x[best].tolist()], pa.list_(pa.float64())),
                    }
                )

    return run


def _round_counts(k: int, max_pairs: int, loose: bool):
    """Per task: cluster sizes, relation counts per cluster, changed labels, and (``loose``) the
    ``k`` least secure members of every cluster."""

    def run(batches):
        for batch in batches:
            for dataset, part in _by_dataset(batch):
                ids = part.column("sample_id").to_pylist()
                bits = _bits(matrix(part.column("x")), max_pairs)
                now, scores = _model_labels(bits, ids, part.column("now")[0].as_py(), k, max_pairs)
                before = part.column("before")[0].as_py()
                changed = 0
                if before is not None:
                    changed = int((now != _model_labels(bits, ids, before, k, max_pairs)[0]).sum())
                out = {"cluster": [], "n": [], "ones": [], "changed": [], "least": []}
                for c in range(k):
                    inside = now == c
                    least = []
                    if loose and inside.any():
                        rest = np.delete(scores[inside], c, axis=1).max(axis=1)
                        security = np.round(scores[inside, c] - rest, SCORE_DIGITS)
                        names = np.array(ids, dtype=object)[inside]
                        order = sorted(range(len(names)), key=lambda i: (security[i], names[i]))[:k]
                        least = [{"margin": float(security[i]), "sample_id": names[i]} for i in order]
                    out["cluster"].append(c)
                    out["n"].append(int(inside.sum()))
                    out["ones"].append(bits[inside].sum(axis=0).astype(np.int64).tolist())
                    out["changed"].append(changed if c == 0 else 0)
                    out["least"].append(least)
                yield pa.RecordBatch.from_pydict(
                    {
                        "dataset_id": pa.array([dataset] * k, pa.string()),
                        "cluster": pa.array(out["cluster"], pa.int32()),
                        "n": pa.array(out["n"], pa.int64()),
                        "ones": pa.array(out["ones"], pa.list_(pa.int64())),
                        "changed": pa.array(out["changed"], pa.int64()),
                        "least": pa.array(
                            out["least"],
                            pa.list_(pa.struct([("margin", pa.float64()), ("sample_id", pa.string())])),
                        ),
                    }
                )

    return run


def _repairs(k: int):
    """Fill empty clusters one after the other from the largest cluster's least secure member."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                sizes = {c["cluster"]: c["n"] for c in row["clusters"]}
                spare = {
                    c["cluster"]: sorted((s["margin"], s["sample_id"]) for s in c["least"])
                    for c in row["clusters"]
                }
                moved = []
                for c in range(k):
                    if sizes.get(c, 0) == 0:
                        donor = max(range(k), key=lambda d: (sizes.get(d, 0), -d))
                        moved.append((spare[donor].pop(0)[1], c))
                        sizes[donor] -= 1
                        sizes[c] = 1
                yield pa.RecordBatch.from_pydict(
                    {
                        "dataset_id": pa.array([row["dataset_id"]], pa.string()),
                        "moved": pa.array([moved], pa.map_(pa.string(), pa.int32())),
                    }
                )

    return run


def _final_labels(k: int, max_pairs: int):
    def run(batches):
        for batch in batches:
            for dataset, part in _by_dataset(batch):
                ids = part.column("sample_id").to_pylist()
                bits = _bits(matrix(part.column("x")), max_pairs)
                labels, _ = _model_labels(bits, ids, part.column("labelled_by")[0].as_py(), k, max_pairs)
                scores = np.sort(_rule_scores(bits, part.column("rules")[0].as_py(), k), axis=1)
                yield pa.RecordBatch.from_pydict(
                    {
                        "dataset_id": pa.array([dataset] * len(ids), pa.string()),
                        "sample_id": pa.array(ids, pa.string()),
                        "cluster": pa.array(labels.astype(np.int32)),
                        "score_margin": pa.array(np.round(scores[:, -1] - scores[:, -2], SCORE_DIGITS)),
                    }
                )

    return run


# ---------------------------------------------------------------- prototypes


def prevalence(rows: DataFrame, max_pairs: int) -> DataFrame:
    counted = rows.mapInArrow(
        _prevalence(max_pairs), "dataset_id string, pair_no bigint, ones bigint, n bigint"
    )
    return counted.groupBy("dataset_id", "pair_no").agg(
        (F.sum("ones") / F.sum("n")).alias("prevalence")
    )


def contrasts(counts: DataFrame, *carried: str) -> DataFrame:
    """Support, direction and contrast per (dataset, cluster, pair).

    ``counts(dataset_id, cluster, pair_no, ones, n)``.  The contrast is against the share over all
    samples, the cluster's own included.  ``carried`` columns are kept.
    """
    whole = W.partitionBy("dataset_id", "pair_no")
    share = F.try_divide("ones", "n")  # NULL for a cluster that lost all members
    everyone = F.sum("ones").over(whole) / F.sum("n").over(whole)
    up = share >= 0.5
    support = F.when(up, share).otherwise(1.0 - share)
    return counts.select(
        "dataset_id",
        "cluster",
        "pair_no",
        up.cast("int").alias("direction"),
        support.alias("support"),
        (support - F.when(up, everyone).otherwise(1.0 - everyone)).alias("contrast"),
        *carried,
    )


def build_prototypes(
    counts: DataFrame, max_rules: int, min_support: float, min_contrast: float, *carried: str
) -> DataFrame:
    """Strongest rules per cluster: those above both limits, or all pairs if none is; at most ``max_rules``."""
    scored = contrasts(counts, *carried)
    cluster = W.partitionBy("dataset_id", "cluster")
    strong = (F.col("support") >= min_support) & (F.col("contrast") >= min_contrast)
    marked = scored.withColumn("_strong", strong).withColumn("_any", F.max(strong).over(cluster))
    order = cluster.orderBy(
        F.round("contrast", SCORE_DIGITS).desc(), F.round("support", SCORE_DIGITS).desc(), "pair_no"
    )
    return (
        marked.where(F.col("_strong") | ~F.col("_any"))
        .withColumn("rule_rank", F.row_number().over(order))
        .where(F.col("rule_rank") <= max(1, max_rules))
        .drop("_strong", "_any")
    )


def rule_weight(support: Column, contrast: Column) -> Column:
    return F.greatest(F.lit(1e-12), support * F.greatest(contrast, F.lit(1e-6)))


def _rules_of(prototypes: DataFrame) -> DataFrame:
    """Rules of each dataset as one array, with the largest ``changed`` and smallest ``n`` seen."""
    rule = F.struct(
        F.col("cluster").cast("int").alias("cluster"),
        F.col("rule_rank").cast("int").alias("rule_rank"),
        "pair_no",
        F.col("direction").alias("direction"),
        rule_weight(F.col("support"), F.col("contrast")).alias("weight"),
        "support",
        "contrast",
    )
    return prototypes.groupBy("dataset_id").agg(
        F.array_sort(F.collect_list(rule)).cast(RULES).alias("_next"),
        F.max("_changed").alias("_changed"),
        F.min("_smallest").alias("_smallest"),
    )


def named_rules(prototypes: DataFrame, selected: DataFrame, max_pairs: int) -> DataFrame:
    """``prototype_rules`` table with feature names."""
    names = ranked_pairs(selected, max_pairs)
    return prototypes.join(names, ["dataset_id", "pair_no"]).select(
        F.col("dataset_id").alias("model_id"),
        "cluster",
        "rule_rank",
        F.col("left").alias("feature_a"),
        F.col("right").alias("feature_b"),
        F.col("direction").cast("tinyint").alias("direction"),
        "support",
        "contrast",
    )


# ---------------------------------------------------------------- fitting

_MODEL = f"struct<rules:{RULES},seeds:array<array<double>>,moved:map<string,int>>"


def initial_seeds(rows: DataFrame, k: int, max_pairs: int) -> DataFrame:
    """``dataset_id, seeds``: the most atypical sample, then repeatedly the one farthest from all seeds."""
    share = F.array_sort(F.collect_list(F.struct("pair_no", "prevalence")))
    state = prevalence(rows, max_pairs).groupBy("dataset_id").agg(
        F.transform(share, lambda s: s["prevalence"]).alias("prevalence")
    )
    state = cut(
        state.withColumn("seeds", F.lit(None).cast("array<struct<sample_id:string,x:array<double>>>"))
    )
    for _ in range(k):
        best = (
            attach_models(rows, state, "dataset_id", 16 * max_pairs)
            .mapInArrow(_farthest(max_pairs), "dataset_id string, far double, sample_id string, x array<double>")
            .groupBy("dataset_id")
            .agg(F.expr("min(struct(far, sample_id, x)) AS b"))
        )
        state = stored(
            state.join(best, "dataset_id").selectExpr(
                "dataset_id",
                "prevalence",
                "concat(coalesce(seeds, CAST(array() AS array<struct<sample_id:string,x:array<double>>>)), "
                "array(struct(b.sample_id AS sample_id, b.x AS x))) AS seeds",
            )
        )
    return state.select("dataset_id", "seeds")


def pair_limit(feature_budget: int, max_pairs: int | None) -> int:
    """All pairs of the budget unless the caller states a limit."""
    return feature_budget * (feature_budget - 1) // 2 if max_pairs is None else max_pairs


def fit(
    measurements: DataFrame,
    *,
    k: int = 2,
    feature_budget: int = 60,
    max_pairs: int | None = None,
    max_rules: int = 25,
    min_support: float = 0.80,
    min_contrast: float = 0.10,
    max_iter: int = 50,
) -> dict[str, DataFrame]:
    """Fit rule clusters for every dataset.

    Returns ``rules`` (prototype table), ``labels`` (dataset, sample, cluster, score_margin), ``models``
    (iterations, converged) and ``features`` (selected features).
    """
    if k < 2:
        raise ValueError("k must be at least 2")
    max_pairs = pair_limit(feature_budget, max_pairs)
    selected = cut(select_features(measurements, feature_budget))
    # neighbours of one dataset share Arrow batches and therefore partial counts
    rows = cut(fit_rows(measurements, selected).sortWithinPartitions("dataset_id"))
    seeds = initial_seeds(rows, k, max_pairs)
    model_bytes = 64 * (k * (max_rules + feature_budget) + 16)
    state = cut(
        seeds.select(
            "dataset_id",
            F.expr(
                f"CAST(struct(CAST(NULL AS {RULES}) AS rules, seeds.x AS seeds, CAST(NULL AS map<string,int>) AS moved) AS {_MODEL})"
            ).alias("now"),
            F.expr(f"CAST(NULL AS {_MODEL})").alias("before"),
            F.lit(0).alias("iterations"),
            F.lit(False).alias("converged"),
            F.lit(None).cast(RULES).alias("rules"),
            F.lit(False).alias("torn"),
        )
    )

    def advance(current: DataFrame, step: int) -> DataFrame:
        """Label with ``now``, build the next rules from those labels, note what changed."""
        counts = _exploded(_counts(rows, current, k, max_pairs, False, model_bytes))
        built = build_prototypes(counts, max_rules, min_support, min_contrast, "_changed", "_smallest")
        done = "_changed = 0" if step else "false"
        return current.join(_rules_of(built), "dataset_id", "left").selectExpr(
            "dataset_id",
            f"if(_next IS NULL OR ({done}), now, CAST(struct(_next AS rules, now.seeds AS seeds, CAST(NULL AS map<string,int>) AS moved) AS {_MODEL})) AS now",
            "now AS before",
            f"if(_next IS NULL, iterations, {step}) AS iterations",
            f"converged OR (_next IS NOT NULL AND {done}) AS converged",
            "coalesce(_next, rules) AS rules",
            "coalesce(_smallest = 0, false) AS torn",
        )

    for step in range(max_iter + 1):
        following = stored(advance(state, step))
        flags = following.agg(F.max("torn").alias("torn"), F.min("converged").alias("all_done")).first()
        if flags["torn"]:
            # some cluster lost all members: repair those datasets' labels and repeat the round
            state = stored(_repaired(rows, state, following, k, max_pairs, model_bytes))
            following = stored(advance(state, step))
            flags = following.agg(F.min("converged").alias("all_done")).first()
        state = following
        if flags["all_done"]:
            break
    # `before` labelled the samples from which the final rules were built
    final = state.select("dataset_id", F.col("before").alias("labelled_by"), "rules")
    labels = attach_models(rows, final, "dataset_id", 2 * model_bytes).mapInArrow(
        _final_labels(k, max_pairs), "dataset_id string, sample_id string, cluster int, score_margin double"
    )
    prototypes = state.select("dataset_id", F.explode("rules").alias("r")).select("dataset_id", "r.*")
    return {
        "rules": named_rules(prototypes, selected, max_pairs),
        "labels": labels,
        "models": state.select("dataset_id", "iterations", "converged"),
        "features": selected,
    }


_COUNTS = "dataset_id string, cluster int, n bigint, ones array<bigint>, changed bigint, least array<struct<margin:double,sample_id:string>>"


def _counts(
    rows: DataFrame, state: DataFrame, k: int, max_pairs: int, loose: bool, model_bytes: int
) -> DataFrame:
    work = state.where("NOT converged").select("dataset_id", "now", "before")
    joined = attach_models(rows, work, "dataset_id", 2 * model_bytes)
    return joined.mapInArrow(_round_counts(k, max_pairs, loose), _COUNTS)


def _repaired(
    rows: DataFrame, state: DataFrame, following: DataFrame, k: int, max_pairs: int, model_bytes: int
) -> DataFrame:
    """``state`` with sample moves that fill the empty clusters of the datasets that have any."""
    torn = following.where("torn").select("dataset_id")
    loose = _counts(rows, state.join(torn, "dataset_id", "left_semi"), k, max_pairs, True, model_bytes)
    # at most k candidates per cluster and task survive into this per-dataset row
    clusters = (
        loose.groupBy("dataset_id", "cluster")
        .agg(F.sum("n").alias("n"), F.flatten(F.collect_list("least")).alias("least"))
        .withColumn("least", F.slice(F.array_sort("least"), 1, k))
    )
    moves = (
        clusters.groupBy("dataset_id")
        .agg(F.collect_list(F.struct("cluster", "n", "least")).alias("clusters"))
        .mapInArrow(_repairs(k), "dataset_id string, moved map<string,int>")
    )
    return state.join(moves, "dataset_id", "left").selectExpr(
        "dataset_id",
        f"if(moved IS NULL, now, CAST(struct(now.rules AS rules, now.seeds AS seeds, moved AS moved) AS {_MODEL})) AS now",
        "before",
        "iterations",
        "converged",
        "rules",
        "torn",
    )


def _exploded(counts: DataFrame) -> DataFrame:
    """Task counts -> one row per (dataset, cluster, pair), with the dataset's changed labels and smallest cluster."""
    summed = (
        counts.select("dataset_id", "cluster", "n", "changed", F.posexplode("ones").alias("pair_no", "ones"))
        .groupBy("dataset_id", "cluster", "pair_no")
        .agg(F.sum("ones").alias("ones"), F.sum("n").alias("n"), F.sum("changed").alias("changed"))
    )
    dataset = W.partitionBy("dataset_id")
    return summed.select(
        "dataset_id",
        "cluster",
        F.col("pair_no").cast("bigint").alias("pair_no"),
        "ones",
        "n",
        F.max("changed").over(dataset).alias("_changed"),
        F.min("n").over(dataset).alias("_smallest"),
    )


def label_counts(rows: DataFrame, labels: DataFrame, max_pairs: int) -> DataFrame:
    """Relation counts per cluster of a given partition (``dataset_id, sample_id, cluster``)."""

    def run(batches):
        for batch in batches:
            for dataset, part in _by_dataset(batch):
                bits = _bits(matrix(part.column("x")), max_pairs)
                own = part.column("cluster").to_numpy(zero_copy_only=False)
                for c in np.unique(own):
                    inside = bits[own == c]
                    m = inside.shape[1]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "dataset_id": pa.array([dataset] * m, pa.string()),
                            "cluster": pa.array([int(c)] * m, pa.int32()),
                            "pair_no": pa.array(np.arange(m), pa.int64()),
                            "ones": pa.array(inside.sum(axis=0).astype(np.int64)),
                            "n": pa.array([len(inside)] * m, pa.int64()),
                        }
                    )

    joined = rows.join(labels.select("dataset_id", "sample_id", "cluster"), ["dataset_id", "sample_id"])
    partial = joined.mapInArrow(run, "dataset_id string, cluster int, pair_no bigint, ones bigint, n bigint")
    return partial.groupBy("dataset_id", "cluster", "pair_no").agg(
        F.sum("ones").alias("ones"), F.sum("n").alias("n")
    )


def posthoc(rows: DataFrame, labels: DataFrame, max_pairs: int, max_rules: int = 25) -> DataFrame:
    """Rules that summarise an existing partition; no limit on support or contrast."""
    counts = label_counts(rows, labels, max_pairs)
    return build_prototypes(counts, max_rules, -1.0, -2.0)


# ---------------------------------------------------------------- frozen assignment


def rule_model(rules: DataFrame) -> DataFrame:
    """One row per model: its rules as one array; what a stream or batch of new samples is joined to."""
    item = F.struct(
        F.col("cluster").cast("int").alias("cluster"),
        "rule_rank",
        "feature_a",
        "feature_b",
        (F.col("direction") == 1).alias("up"),
        rule_weight(F.col("support"), F.col("contrast")).alias("weight"),
    )
    return rules.groupBy("model_id").agg(
        F.array_sort(F.collect_list(item)).alias("rules"), (F.max("cluster") + 1).cast("int").alias("k")
    )


def rule_scores(values: Column, rules: Column, k: Column) -> Column:
    """Score per cluster of one sample given ``map<feature, value>``; NULL where no rule can be evaluated.

    A pure row expression: the same for one row, a batch or a stream.
    """

    def one(known_values: Column, cluster: Column) -> Column:
        mine = F.filter(rules, lambda r: r["cluster"] == cluster)
        start = F.struct(F.lit(0.0).alias("hit"), F.lit(0.0).alias("all"))

        def add(acc, r):
            a, b = known_values[r["feature_a"]], known_values[r["feature_b"]]
            known = a.isNotNull() & b.isNotNull()
            right = known & ((a > b) == r["up"])
            return F.struct(
                (acc["hit"] + F.when(right, r["weight"]).otherwise(0.0)).alias("hit"),
                (acc["all"] + F.when(known, r["weight"]).otherwise(0.0)).alias("all"),
            )

        total = F.aggregate(mine, start, add)
        return F.when(total["all"] > 0, total["hit"] / total["all"])

    return X.let(values, lambda v: F.transform(F.sequence(F.lit(0), k - 1), lambda c: one(v, c)))


def decide(df: DataFrame, scores: str, k: Column, min_score: float, min_margin: float) -> DataFrame:
    """Add ``best_score, score_margin, forced_cluster, accepted_cluster`` from an array of scores."""
    ranked = F.array_sort(
        F.filter(
            F.transform(
                F.col(scores),
                lambda s, c: F.struct((-F.round(s, SCORE_DIGITS)).alias("neg"), c.alias("cluster")),
            ),
            lambda s: s["neg"].isNotNull(),
        )
    )
    valid = F.size("_ranked") >= F.least(F.lit(2), k)
    best = F.when(valid, -F.get("_ranked", F.lit(0))["neg"])
    second = F.when(valid, -F.get("_ranked", F.lit(1))["neg"])
    cluster = F.when(valid, F.get("_ranked", F.lit(0))["cluster"].cast("int"))
    margin = F.when(k > 1, best - second).otherwise(best)
    accepted = (F.col("best_score") >= min_score) & (F.col("score_margin") >= min_margin)
    return (
        df.withColumn("_ranked", ranked)
        .withColumn("best_score", best)
        .withColumn("score_margin", F.round(margin, SCORE_DIGITS))
        .withColumn("forced_cluster", cluster)
        .withColumn("accepted_cluster", F.when(accepted, F.col("forced_cluster")))
        .drop("_ranked")
    )


def assign(
    samples: DataFrame,
    models: DataFrame,
    *,
    min_score: float = 0.60,
    min_margin: float = 0.05,
) -> DataFrame:
    """Assign new samples (``model_id, sample_id, features map<string,double>``) to frozen rules.

    ``accepted_cluster`` is NULL for UNASSIGNED.  ``models`` is the table of :func:`rule_model`.
    """
    joined = attach_models(samples, models, "model_id", 1 << 16)
    scored = joined.withColumn("scores", rule_scores(F.col("features"), F.col("rules"), F.col("k")))
    decided = decide(scored, "scores", F.col("k"), min_score, min_margin)
    return decided.select(
        "model_id", "sample_id", "scores", "best_score", "score_margin", "forced_cluster", "accepted_cluster"
    )


def feature_maps(measurements: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per sample with its observed values as ``features map<string,double>``."""
    keys = keys or R.SAMPLE
    entry = F.when(F.col("value").isNotNull(), F.struct("feature_id", "value"))
    return measurements.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("features"))
