"""Evaluation of frozen results against labels and summary reports over many runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions import quantiles as Q
from ..operators import metrics as M

# Acceptance limits.
GATE = {
    "identification": 0.70,
    "regret": 0.05,
    "null_false": 0.10,
    "hybrid_on_pure": 0.20,
    "spearman": 0.40,
    "reverse_regret": 0.10,
    "coverage": 0.80,
    "cluster_share": 0.10,
    "rule_ari": 0.75,
    "recovery": 0.60,
    "noninferiority": -0.05,
    "transfer_ari": 0.70,
    "transfer_coverage": 0.70,
    "null_ari": 0.50,
    "null_margin": 0.15,
}
PURE = ("VALUE", "RELATIONAL")


def method_metrics(assignments: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Forced ARI and NMI, coverage and accepted ARI per group.

    ``assignments(keys..., sample_id, forced_cluster, accepted_cluster)``; labels join on the key
    ``dataset_id`` if both sides have it, and on ``sample_id``.
    """
    on = [c for c in ("dataset_id", "sample_id") if c in labels.columns and c in assignments.columns]
    labelled = assignments.join(labels.select(*on, "label"), on)
    table = M.contingency(labelled, keys, "label", "forced_cluster")
    return (
        M.adjusted_rand(table, keys, "ari_forced")
        .join(M.normalised_mutual_information(table, keys, "nmi_forced"), keys)
        .join(M.coverage(labelled, keys).drop("n_samples"), keys)
        .join(M.accepted_rand(labelled, keys), keys)
    )


def oracle(metrics: DataFrame, keys: list[str], ari: str = "ari_forced") -> DataFrame:
    """Best method by ARI, ties to the smaller method id."""
    return metrics.groupBy(*keys).agg(
        F.min(F.struct((-F.col(ari)).alias("neg"), "method_id")).alias("_o")
    ).select(*keys, F.col("_o.method_id").alias("oracle_method"), (-F.col("_o.neg")).alias("oracle_ari"))


def regret(metrics: DataFrame, selection: DataFrame, keys: list[str], ari: str = "ari_forced") -> DataFrame:
    """Selected against oracle method; an abstention has ARI 0.  ``selection(keys..., decision, selected_method)``."""
    chosen = selection.join(
        metrics.withColumnRenamed("method_id", "selected_method").withColumn("_ari", F.col(ari)),
        [*keys, "selected_method"],
        "left",
    )
    best = oracle(metrics, keys, ari)
    carried = [c for c in ("coverage", "nmi_forced", "min_cluster_fraction") if c in metrics.columns]
    joined = chosen.join(best, keys).withColumn("selected_ari", F.coalesce("_ari", F.lit(0.0)))
    return joined.select(
        *keys,
        "decision",
        "selected_method",
        "selected_ari",
        *[c if c == "nmi_forced" else F.coalesce(c, F.lit(0.0)).alias(c) for c in carried],
        "oracle_method",
        X.family_of(F.col("oracle_method")).alias("oracle_family"),
        "oracle_ari",
        F.greatest(F.lit(0.0), F.col("oracle_ari") - F.col("selected_ari")).alias("regret"),
    )


def family_maxima(metrics: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """Per group the best value of each family, e.g. ``{"q_score": "q", "ari_forced": "ari"}``."""
    aggs = [
        F.max(F.when(F.col("family") == family, F.col(column))).alias(f"{name}_{family.lower()}")
        for column, name in columns.items()
        for family in ("VALUE", "RELATIONAL", "HYBRID")
    ]
    return metrics.groupBy(*keys).agg(*aggs)


def class_match(labels: DataFrame, selection: DataFrame) -> DataFrame:
    """Does the frozen k equal the number of label classes?"""
    classes = labels.groupBy("dataset_id").agg(F.countDistinct("label").alias("classes"))
    return selection.join(classes, "dataset_id").select(
        "dataset_id", "classes", (F.col("selected_k") == F.col("classes")).alias("k_matches")
    )


def expected_decision(selection: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    return selection.join(expected.select(*keys, "expected_decision"), keys).withColumn(
        "decision_correct", F.col("decision") == F.col("expected_decision")
    )


def _share(condition: Column, among: Column) -> Column:
    return F.avg(F.when(among, condition.cast("double")))


def _rates(runs: DataFrame):
    signal = F.col("regime") != "NULL"
    null = F.col("regime") == "NULL"
    pure = F.col("regime").isin(*PURE)
    return {
        "identification_rate": _share(F.col("decision_correct"), signal),
        "null_false_structure_rate": _share(F.col("decision") != "NO_STABLE_STRUCTURE", null),
        "hybrid_on_pure_rate": _share(F.col("decision") == "HYBRID", pure),
    }


def primary_gate(runs: DataFrame, expected_runs: int) -> DataFrame:
    """One-row gate report over ``runs`` (regime, decision, decision_correct, regret, family maxima).

    Family columns are ``q_value, q_relational, q_hybrid`` and ``ari_value, ari_relational, ari_hybrid``.
    """
    signal = F.col("regime") != "NULL"
    main = runs.agg(
        F.count(F.lit(1)).alias("runs"),
        *[value.alias(name) for name, value in _rates(runs).items()],
    )
    middle = Q.quantiles(runs.where(signal), [], "regret", [0.5]).select(F.col("q")[0].alias("median_regret"))
    pairs = F.array(
        *[
            F.struct(
                (F.col(f"q_{a}") - F.col(f"q_{b}")).alias("dq"),
                (F.col(f"ari_{a}") - F.col(f"ari_{b}")).alias("da"),
            )
            for a, b in (("value", "relational"), ("hybrid", "value"), ("hybrid", "relational"))
        ]
    )
    contrasts = (
        runs.where(signal)
        .select(F.explode(pairs).alias("p"))
        .select("p.*")
        .where(F.col("dq").isNotNull() & F.col("da").isNotNull())
        .withColumn("_g", F.lit(0))
    )
    rho = Q.spearman(contrasts, ["_g"], "dq", "da", "spearman").drop("_g")
    one = F.lit(0).alias("_k")
    report = (
        main.select("*", one)
        .join(middle.select("*", one), "_k", "left")
        .join(rho.select("*", one), "_k", "left")
        .drop("_k")
    )
    checks = {
        "complete": F.col("runs") == expected_runs,
        "identification_ok": F.col("identification_rate") >= GATE["identification"],
        "regret_ok": F.col("median_regret") <= GATE["regret"],
        "null_ok": F.col("null_false_structure_rate") <= GATE["null_false"],
        "hybrid_ok": F.col("hybrid_on_pure_rate") <= GATE["hybrid_on_pure"],
        "spearman_ok": F.coalesce("spearman", F.lit(0.0)) >= GATE["spearman"],
    }
    return _with_checks(report.withColumn("spearman", F.coalesce("spearman", F.lit(0.0))), checks)


def _with_checks(report: DataFrame, checks: dict) -> DataFrame:
    out = report.select("*", *[F.coalesce(c, F.lit(False)).alias(n) for n, c in checks.items()])
    verdict = F.lit(True)
    for name in checks:
        verdict = verdict & F.col(name)
    return out.withColumn("go", verdict)


def cell_report(runs: DataFrame) -> DataFrame:
    """Accuracy, median regret and decision counts overall, by regime and by (regime, signal, shift) cell."""
    cells = F.array(
        F.lit("all"), F.col("regime"), F.concat_ws("/", "regime", "signal", "shift")
    )
    spread = runs.withColumn("cell", F.explode(cells))
    middle = Q.quantiles(spread, ["cell"], "regret", [0.5]).select("cell", F.col("q")[0].alias("median_regret"))
    counted = spread.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("decision_correct").cast("double")).alias("decision_accuracy"),
        *[
            F.count_if(F.col("decision") == d).alias(f"n_{d.lower()}")
            for d in ("VALUE", "RELATIONAL", "HYBRID", "NO_STABLE_STRUCTURE")
        ],
    )
    return counted.join(middle, "cell", "left")


def smoke_gate(runs: DataFrame, expected_runs: int) -> DataFrame:
    rates = _rates(runs)
    report = runs.agg(
        F.count(F.lit(1)).alias("runs"), *[value.alias(name) for name, value in rates.items()]
    )
    return _with_checks(
        report,
        {
            "complete": F.col("runs") == expected_runs,
            "identification_ok": F.col("identification_rate") >= GATE["identification"],
            "null_ok": F.col("null_false_structure_rate") <= GATE["null_false"],
            "hybrid_ok": F.col("hybrid_on_pure_rate") <= GATE["hybrid_on_pure"],
        },
    )


def regime_report(runs: DataFrame) -> DataFrame:
    return runs.groupBy("regime", "decision").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("decision_correct").cast("double")).alias("decision_accuracy")
    )


def within_summary(evaluations: DataFrame) -> DataFrame:
    """One row over per-dataset evaluations: medians and the share within 0.05 of the oracle."""
    values = evaluations.withColumn("_g", F.lit(0))
    selected = Q.quantiles(values, ["_g"], "selected_ari", [0.5]).select("_g", F.col("q")[0].alias("median_selected_ari"))
    lost = Q.quantiles(values, ["_g"], "regret", [0.5]).select("_g", F.col("q")[0].alias("median_regret"))
    counted = values.groupBy("_g").agg(
        F.count(F.lit(1)).alias("datasets"),
        F.bool_and("k_matches").alias("all_k_match"),
        F.avg((F.col("regret") <= GATE["regret"]).cast("double")).alias("within_005_rate"),
    )
    return counted.join(selected, "_g").join(lost, "_g").drop("_g")


def decision_counts(evaluations: DataFrame) -> DataFrame:
    """Long counts of decisions and oracle families."""
    items = F.array(
        F.struct(F.lit("decision").alias("kind"), F.col("decision").alias("name")),
        F.struct(F.lit("oracle_family").alias("kind"), F.col("oracle_family").alias("name")),
    )
    return evaluations.select(F.explode(items).alias("i")).groupBy("i.kind", "i.name").agg(
        F.count(F.lit(1)).alias("n")
    )


def transfer_gate(directions: DataFrame) -> DataFrame:
    """Gate over transfer directions ``direction_id, regret, frozen, coverage, min_accepted_share``.

    The best direction must stay within 0.05 and all others within 0.10 of their oracles; at least two are needed, and
    a direction without a regret is not within anything.
    """
    report = directions.agg(
        F.count(F.lit(1)).alias("directions"),
        F.min("regret").alias("_best"),
        F.bool_and(F.coalesce(F.col("regret") <= GATE["reverse_regret"], F.lit(False))).alias("_rest"),
        F.bool_and("frozen").alias("frozen_ok"),
        F.bool_and(F.col("coverage") >= GATE["coverage"]).alias("coverage_ok"),
        F.bool_and(F.col("min_accepted_share") >= GATE["cluster_share"]).alias("cluster_share_ok"),
    )
    regret_ok = F.coalesce((F.col("directions") >= 2) & (F.col("_best") <= GATE["regret"]) & F.col("_rest"), F.lit(False))
    out = report.select("directions", regret_ok.alias("regret_ok"), "frozen_ok", "coverage_ok", "cluster_share_ok")
    return out.withColumn(
        "go", F.col("regret_ok") & F.col("frozen_ok") & F.col("coverage_ok") & F.col("cluster_share_ok")
    )


def paired_difference(metrics: DataFrame, left: str, right: str, by: str = "dataset_id") -> DataFrame:
    """ARI of one method minus another on the same dataset."""
    a = metrics.where(F.col("method_id") == left).select(by, F.col("ari").alias("ari_left"))
    b = metrics.where(F.col("method_id") == right).select(by, F.col("ari").alias("ari_right"))
    return a.join(b, by).withColumn("difference", F.col("ari_left") - F.col("ari_right"))


def _median_of(df: DataFrame, value: str, name: str) -> DataFrame:
    tagged = df.withColumn("_g", F.lit(0))
    return Q.quantiles(tagged, ["_g"], value, [0.5]).select("_g", F.col("q")[0].alias(name))


def rule_gate(simulated: DataFrame, real: DataFrame, transfers: DataFrame) -> DataFrame:
    """Eight metrics and five checks of rule clustering.

    ``simulated(kind, method_id, ari, pair_recovery, score_margin)``, ``real(dataset_id, method_id, ari)``,
    ``transfers(ari, coverage)``.
    """
    mine = simulated.where(F.col("method_id") == "RR_DIRECT")
    related, empty = mine.where(F.col("kind") == "REL"), mine.where(F.col("kind") == "NULL")
    confident = (F.col("ari") > GATE["null_ari"]) & (F.col("score_margin") > GATE["null_margin"])
    parts = [
        _median_of(related, "ari", "rel_median_ari"),
        _median_of(related, "pair_recovery", "rel_median_recovery"),
        empty.groupBy(F.lit(0).alias("_g")).agg(F.avg(confident.cast("double")).alias("null_confident_rate")),
        _median_of(real.where(F.col("method_id") == "RR_DIRECT"), "ari", "real_rr_median_ari"),
        _median_of(real.where(F.col("method_id") == "RELATION_PAM"), "ari", "real_relation_median_ari"),
        _median_of(paired_difference(real, "RR_DIRECT", "RELATION_PAM"), "difference", "real_median_difference"),
        transfers.groupBy(F.lit(0).alias("_g")).agg(
            F.max("ari").alias("best_transfer_ari"),
            F.max_by("coverage", "ari").alias("best_transfer_coverage"),
            F.max(((F.col("ari") >= GATE["transfer_ari"]) & (F.col("coverage") >= GATE["transfer_coverage"])).cast("int")).alias("_t"),
        ),
    ]
    report = parts[0]
    for part in parts[1:]:
        report = report.join(part, "_g", "full_outer")
    return _with_checks(
        report.drop("_g"),
        {
            "ari_ok": F.col("rel_median_ari") >= GATE["rule_ari"],
            "recovery_ok": F.col("rel_median_recovery") >= GATE["recovery"],
            "null_ok": F.col("null_confident_rate") <= GATE["null_false"],
            "noninferior_ok": F.col("real_median_difference") >= GATE["noninferiority"],
            "transfer_ok": F.col("_t") == 1,
        },
    ).drop("_t")


def identifiability_summary(frame: DataFrame) -> DataFrame:
    """Medians and all-replicate flags of ``source_ari, pair_recovery, target_ari, coverage`` rows."""
    tagged = frame.withColumn("_g", F.lit(0))
    flags = tagged.groupBy("_g").agg(
        F.bool_and(F.col("pair_recovery") == 1.0).alias("all_pairs_recovered"),
        F.bool_and(F.col("source_ari") >= GATE["rule_ari"]).alias("all_source_ari_ok"),
    )
    out = flags
    for column in ("source_ari", "pair_recovery", "target_ari", "coverage"):
        out = out.join(_median_of(frame, column, f"median_{column}"), "_g")
    return out.drop("_g")


def grouped_medians(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Median of each column per group, with group sizes."""
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    for column in columns:
        part = Q.quantiles(df, keys, column, [0.5]).select(*keys, F.col("q")[0].alias(f"median_{column}"))
        out = out.join(part, keys, "left")
    return out


def method_pivot(metrics: DataFrame, methods: list[str], value: str = "ari") -> DataFrame:
    """Dataset x method table; the methods are named, so no extra pass looks for them."""
    return metrics.groupBy("dataset_id").pivot("method_id", methods).agg(F.first(value))
