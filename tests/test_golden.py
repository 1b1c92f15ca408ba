"""Small inputs with known answers, metamorphic checks, and brute-force comparisons."""

from __future__ import annotations

import inspect
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordinalia.functions import quantiles as Q
from ordinalia.operators import audit as A
from ordinalia.operators import edges as E
from ordinalia.operators import metrics as M
from ordinalia.operators import pam
from ordinalia.operators import perturb as P
from ordinalia.operators import ranks as K
from ordinalia.operators import robust as R
from ordinalia.operators import rules as RL
from ordinalia.operators import screen as S
from ordinalia.operators import select as SEL
from ordinalia.operators import tiles as T
from ordinalia.operators import transfer as TR
from ordinalia.operators import validate as V
from ordinalia.plans import gates as G


def measurements(spark, matrix, samples=None, features=None, dataset="d"):
    rows = []
    for i, row in enumerate(matrix):
        for j, value in enumerate(row):
            s = samples[i] if samples else f"s{i}"
            f = features[j] if features else f"g{j}"
            rows.append((dataset, s, f, None if value is None else float(value)))
    return spark.createDataFrame(rows, "dataset_id string, sample_id string, feature_id string, value double")


def space(spark, vectors, ids=None, q=None):
    rows = [
        ("x", ids[i] if ids else f"s{i}", [float(v) for v in vec], [float(v) for v in (q[i] if q else vec)])
        for i, vec in enumerate(vectors)
    ]
    return spark.createDataFrame(rows, "space_id string, sample_id string, z array<double>, q array<double>")


def bare(spark):
    return spark.range(1).select(F.lit("x").alias("space_id"), *T.no_relations())


def one_run(spark, method):
    return spark.createDataFrame([("x", "r", method, 0)], "space_id string, run_id string, method_id string, member_no int")


def test_robust_statistics(spark):
    m = measurements(
        spark,
        [(0, 0, 0, 5, None), (10, 0, 0, 5, 1), (20, 2, 2, 5, 1), (30, 2, 2, 5, 3)],
        features=["z_high", "a_tie", "b_tie", "c_const", "d_missing"],
    )
    top = R.top_features(R.feature_stats(m), 3).orderBy("feature_rank").collect()
    assert [r.feature_id for r in top] == ["z_high", "a_tie", "b_tie"]
    assert [r.mad for r in top] == [10, 1, 1]
    assert [r.median for r in top] == [15, 1, 1]
    assert [r.iqr for r in top] == [15, 2, 2]
    assert not any(r.iqr_fallback for r in top)


def test_average_ranks_with_ties_and_missing(spark):
    m = measurements(spark, [(1, 1, 3, 2), (1, None, 3, 2)], features=list("abcd"))
    got = {(r.sample_id, r.feature_id): r.q for r in K.rank_encode(m).collect()}
    assert [got["s0", f] for f in "abcd"] == pytest.approx([1 / 6, 1 / 6, 1, 2 / 3])
    assert ("s1", "b") not in got
    assert [got["s1", f] for f in "acd"] == [0, 1, 0.5]


def test_ternary_states_and_margin(spark):
    m = measurements(spark, [(1, 2, 2, 4), (3, 2, 1, 4)], features=list("abcd"))
    pairs = spark.createDataFrame([("d", "a", "b"), ("d", "b", "a"), ("d", "b", "c")], "dataset_id string, left string, right string")
    got = {(r.sample_id, r.left, r.right): r.state for r in K.relation_states(K.rank_encode(m), pairs).collect()}
    assert [got["s0", *p] for p in (("a", "b"), ("b", "a"), ("b", "c"))] == [-1, 1, 0]
    assert [got["s1", *p] for p in (("a", "b"), ("b", "a"), ("b", "c"))] == [1, -1, 1]
    edge = measurements(spark, [(1, 2, 3)], features=list("abc"))
    at_margin = K.relation_states(K.rank_encode(edge), pairs.where("left = 'b' AND right = 'a'"), margin=0.5)
    assert at_margin.first().state == 0


def test_distance_helpers():
    e = T._euclidean(np.array([[0.0, 0], [3, 4], [0, 4]]), np.array([[0.0, 0], [3, 4], [0, 4]]))
    assert (e[0, 1], e[0, 2], e[1, 2]) == (5, 4, 3)
    c = T._correlation(*(np.array([[1.0, 2, 3], [2, 4, 6], [3, 2, 1]]),) * 2)
    assert c[0, 1] == pytest.approx(0) and c[0, 2] == pytest.approx(2) and c[1, 2] == pytest.approx(2)
    assert np.isnan(T._correlation(np.array([[1.0, 1]]), np.array([[1.0, 2]]))).all()
    f = T._footrule(*(np.array([[0, 0.5, 1], [0, 0.5, 1], [1, 0.5, 0]]),) * 2)
    assert (f[0, 1], f[0, 2], f[1, 2]) == (0, 1, 1)
    assert np.isnan(T._footrule(np.array([[np.nan, 1.0]]), np.array([[0.0, 1.0]]))).all()
    states = np.array([[1, 0, -1], [1, 1, np.nan], [-1, 0, -1]])
    h = T._hamming(states, states, np.ones(3))
    assert h[0, 1] == pytest.approx(0.5) and h[0, 2] == pytest.approx(1 / 3) and h[1, 2] == pytest.approx(1.0)
    w = T._hamming(np.array([[1.0, 0]]), np.array([[-1.0, 0]]), np.array([3.0, 1.0]))
    assert w[0, 0] == pytest.approx(0.75)
    assert np.isnan(T._hamming(np.array([[np.nan]]), np.array([[1.0]]), np.ones(1))).all()


def test_scale_of_positive_pairs(spark):
    points = space(spark, [(0.0,), (0.0,), (2.0,), (4.0,)][1:], q=[(0.0,)] * 3)
    assert T.positive_median(points, bare(spark), ["V_EUC_PAM"]).first().scale == 2.0
    table = spark.createDataFrame([("a", "b", 0.0), ("a", "c", 2.0), ("b", "c", 4.0)], "i string, j string, d double")
    assert E.positive_scale(table).first().scale == 3.0


def exhaustive(d, k):
    return min(d[:, list(c)].min(axis=1).sum() for c in itertools.combinations(range(len(d)), k))


@pytest.mark.parametrize("points,k,cost", [([0, 1, 9, 10], 2, 2.0), ([0, 1, 9, 10, 30], 2, None)])
def test_medoids_reach_the_optimum(spark, points, k, cost):
    x = np.array(points, dtype=float)
    fitted = pam.fit(space(spark, [(p,) for p in points]), bare(spark), one_run(spark, "V_EUC_PAM"), k).first()
    best = exhaustive(np.abs(x[:, None] - x[None]), k)
    assert float(fitted.objective) == pytest.approx(best)
    if cost is not None:
        assert float(fitted.objective) == cost
    assert all(a >= b for a, b in zip(fitted.trace, fitted.trace[1:]))


def test_medoid_ties_and_row_order(spark):
    same = space(spark, [(1.0,)] * 4, ids=["z", "a", "m", "b"])
    fitted = pam.fit(same, bare(spark), one_run(spark, "V_EUC_PAM"), 2)
    assert [m.sample_id for m in fitted.first().medoids] == ["a", "b"]
    labels = {r.sample_id: r.cluster for r in pam.assign(same, bare(spark), fitted).collect()}
    assert set(labels.values()) == {0, 1} and float(fitted.first().objective) == 0
    ids, values = ["s3", "s1", "s5", "s2", "s4"], [0.0, 1.0, 9.0, 10.0, 30.0]
    results = []
    for order, parts in ((range(5), 1), ((4, 2, 0, 3, 1), 4)):
        points = space(spark, [(values[i],) for i in order], ids=[ids[i] for i in order]).repartition(parts)
        f = pam.fit(points, bare(spark), one_run(spark, "V_EUC_PAM"), 2)
        results.append(
            ([m.sample_id for m in f.first().medoids], f.first().objective,
             sorted((r.sample_id, r.cluster) for r in pam.assign(points, bare(spark), f).collect()))
        )
    assert results[0] == results[1]


def test_medoids_do_not_depend_on_blocks(spark):
    rng = np.random.default_rng(3)
    points = space(spark, rng.normal(size=(60, 3)).tolist()).cache()
    whole = pam.fit(points, bare(spark), one_run(spark, "V_EUC_PAM"), 3).first()
    parted = pam.fit(points, bare(spark), one_run(spark, "V_EUC_PAM"), 3, block_rows=17).first()
    assert [m.sample_id for m in whole.medoids] == [m.sample_id for m in parted.medoids]
    assert [float(c) for c in whole.trace] == pytest.approx([float(c) for c in parted.trace])
    one = T.positive_median(points, bare(spark), ["V_EUC_PAM"]).first().scale
    many = T.positive_median(points, bare(spark), ["V_EUC_PAM"], 17).first().scale
    x = np.array([r.z for r in points.collect()])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))[np.triu_indices(60, 1)]
    assert one == many == pytest.approx(np.median(d))


def test_failed_method_and_swap_limit(spark):
    holes = space(spark, [(0.0, 1.0), (1.0, 0.0), (0.5, 0.5)]).withColumn(
        "q", F.when(F.col("sample_id") == "s1", F.array(F.lit(None).cast("double"), F.lit(1.0))).otherwise(F.col("q"))
    )
    assert pam.fit(holes, bare(spark), one_run(spark, "R_FOOT_PAM"), 2).first().status == "undefined distance"
    with pytest.raises(ValueError):
        pam.fit(holes, bare(spark), one_run(spark, "V_EUC_PAM"), 0)
    assert pam.fit(holes, bare(spark), one_run(spark, "V_EUC_PAM"), 4).first().status == "too few samples"


def test_relation_screen(spark):
    matrix = [(3, 1, 10, 20), (4, 1, 11, 21), (1, 3, 12, 22), (1, 4, 13, 23), (3.5, 1.5, 14, 24), (1.5, 3.5, 15, 25)]
    results = []
    for order in ((0, 1, 2, 3), (2, 1, 3, 0)):
        m = measurements(spark, [[row[i] for i in order] for row in matrix], features=["abcd"[i] for i in order])
        model = R.feature_model(R.top_features(R.feature_stats(m), 4))
        scored = S.score_pairs(m, model, perturbations=2, seed=13, stability_threshold=0.5).cache()
        kept = S.retain(scored, 3).orderBy("relation_rank").collect()
        assert scored.count() == 6
        assert ("a", "b") in [(r.left, r.right) for r in kept]
        assert np.mean([r.weight for r in kept]) == pytest.approx(1)
        results.append([(r.left, r.right, round(r.score, 9)) for r in kept])
    assert results[0] == results[1]
    constant = measurements(spark, [(0, 1, 2), (0.1, 1.1, 2.1), (0.2, 1.2, 2.2)], features=list("abc"))
    model = R.feature_model(R.top_features(R.feature_stats(constant), 3))
    assert S.retain(S.score_pairs(constant, model, perturbations=1), 2).count() == 0


def test_perturbations(spark):
    rng = np.random.default_rng(1)
    m = measurements(spark, rng.normal(size=(4, 4)).tolist())
    specs = P.suite(5, "strong")
    first = {(r.rep, r.sample_id, r.feature_id): r.value for r in P.perturb(m, specs, 9).collect()}
    again = {(r.rep, r.sample_id, r.feature_id): r.value for r in P.perturb(m.repartition(3), specs, 9).collect()}
    assert first == again and len(first) == 80
    original = {(r.sample_id, r.feature_id): r.q for r in K.rank_encode(m).collect()}
    moved = P.perturb(m, [s for s in specs if s[1] == "sample_monotone"], 9).drop("rep", "kind")
    assert {(r.sample_id, r.feature_id): r.q for r in K.rank_encode(moved).collect()} == original
    dropped = P.perturb(m, [(0, "feature_dropout", 0.9)], 9)
    assert dropped.where("value IS NULL").count() > 0


def test_shuffled_null_keeps_each_feature(spark):
    rng = np.random.default_rng(2)
    m = measurements(spark, rng.normal(size=(13, 3)).tolist())
    null = P.shuffle_null(m, 2, 4).cache()
    assert null.count() == 78 and null.select("dataset_id").distinct().count() == 2
    for f in ("g0", "g1", "g2"):
        want = sorted(r.value for r in m.where(f"feature_id = '{f}'").collect())
        for d in ("d#null000", "d#null001"):
            assert sorted(r.value for r in null.where(f"feature_id = '{f}' AND dataset_id = '{d}'").collect()) == want


def test_agreement_metrics(spark):
    def table(a, b):
        return M.contingency(spark.createDataFrame(list(zip(a, b)), "t int, p int"), [], "t", "p")

    assert M.adjusted_rand(table([0, 0, 1, 1], [1, 1, 0, 0]), []).first().ari == 1.0
    assert M.adjusted_rand(table([0, 0, 1, 1], [0, 1, 0, 1]), []).first().ari == pytest.approx(-0.5)
    assert M.adjusted_rand(table([0, 0, 0], [5, 5, 5]), []).first().ari == 1.0
    assert M.normalised_mutual_information(table([0, 0, 1, 1], [1, 1, 0, 0]), []).first().nmi == pytest.approx(1.0)
    assert M.normalised_mutual_information(table([0, 0, 1, 1], [0, 0, 0, 0]), []).first().nmi == 0.0
    assert M.normalised_mutual_information(table([3, 3], [1, 1]), []).first().nmi == 1.0
    labels = spark.createDataFrame([(0,)] * 19 + [(1,)], "cluster int").withColumn("d", F.lit("x"))
    row = M.nondegeneracy(labels, ["d"], 2, 0.10).first()
    assert not row.nondegenerate and row.min_cluster_fraction == pytest.approx(0.05)


def test_large_groups_give_the_same_quantiles_and_ranks(spark):
    rng = np.random.default_rng(5)
    values = np.round(rng.normal(size=500), 1).tolist() + [0.0] * 250
    df = spark.createDataFrame([("k", float(v), 1 + i % 3) for i, v in enumerate(values)], "k string, v double, w int")
    probs = [0.0, 0.05, 0.5, 0.9, 1.0]
    small, large = (Q.quantiles(df, ["k"], "v", probs, small_group=g).first().q for g in (10**6, 0))
    assert small == pytest.approx(large) and small == pytest.approx(np.quantile(values, probs).tolist())
    weighted = np.repeat(values, [1 + i % 3 for i in range(len(values))])
    for g in (10**6, 0):
        assert Q.quantiles(df, ["k"], "v", [0.3], weight="w", small_group=g).first().q[0] == pytest.approx(np.quantile(weighted, 0.3))
        assert Q.upper_quantile(df, ["k"], "v", 0.9, "u", small_group=g).first().u == np.quantile(values, 0.9, method="higher")
    a, b = (sorted((r.v, r.r) for r in Q.average_rank(df, ["k"], "v", "r", small_group=g).collect()) for g in (10**6, 0))
    assert a == b


def metric_rows(spark, rows):
    return spark.createDataFrame(
        [("c", *r) for r in rows],
        "calibration_id string, report_id string, method_id string, family string, q_score double, complexity int, nondegenerate boolean",
    ).withColumn("k", F.lit(3)).withColumn("dataset_id", F.lit("x"))


def calibration_of(spark, thresholds, delta=0.05, margin=0.0):
    t = spark.createDataFrame([("c", m, v) for m, v in thresholds.items()], "calibration_id string, method_id string, threshold double")
    c = spark.createDataFrame([("c", delta, margin, 3)], "calibration_id string, delta_hybrid double, multiple_testing_margin double, k int")
    return t, c


def test_null_calibration(spark):
    one = metric_rows(spark, [(str(i), "V_EUC_PAM", "VALUE", q, 10, True) for i, q in enumerate((0.1, 0.2, 0.3, 0.4))])
    t, c = SEL.calibrate(one, 0.75)
    assert t.first().threshold == 0.4 and t.first().n == 4
    assert c.first().multiple_testing_margin == pytest.approx(0.1) and c.first().delta_hybrid == 0.02
    both = metric_rows(spark, [
        (str(i), m, f, q, 10, True)
        for i, pair in enumerate(((0.80, 0.10), (0.81, 0.11), (0.82, 0.12), (0.83, 0.13)))
        for m, f, q in (("V_EUC_PAM", "VALUE", pair[0]), ("R_PAIR_PAM", "RELATIONAL", pair[1]))
    ])
    t, c = SEL.calibrate(both, 0.75)
    assert {r.method_id: r.threshold for r in t.collect()} == {"V_EUC_PAM": 0.83, "R_PAIR_PAM": 0.13}
    assert c.first().multiple_testing_margin == pytest.approx(0.01)
    assert SEL.calibration_problems(one.where("report_id < '2'")).count() == 1


V_, R_, H_ = ("V_EUC_PAM", "VALUE"), ("R_PAIR_PAM", "RELATIONAL"), ("H_EUC_PAIR_A050_PAM", "HYBRID")


@pytest.mark.parametrize(
    "rows,thresholds,margin,decision",
    [
        ([(*V_, 0.40, 10, True), (*R_, 0.45, 10, True)], {"V_EUC_PAM": 0.5, "R_PAIR_PAM": 0.5}, 0.0, "NO_STABLE_STRUCTURE"),
        ([(*V_, 0.70, 20, True), (*R_, 0.82, 100, True)], {"V_EUC_PAM": 0.5, "R_PAIR_PAM": 0.5}, 0.0, "RELATIONAL"),
        ([(*V_, 0.80, 20, True), (*R_, 0.81, 100, True)], {"V_EUC_PAM": 0.5, "R_PAIR_PAM": 0.5}, 0.0, "VALUE"),
        ([(*V_, 0.70, 10, True), (*R_, 0.72, 10, True), (*H_, 0.76, 10, True)], {m: 0.5 for m in (V_[0], R_[0], H_[0])}, 0.0, "RELATIONAL"),
        ([(*V_, 0.70, 10, True), (*R_, 0.72, 10, True), (*H_, 0.80, 10, True)], {m: 0.5 for m in (V_[0], R_[0], H_[0])}, 0.0, "HYBRID"),
        ([(*V_, 0.59, 10, True), (*R_, 0.31, 10, True)], {"V_EUC_PAM": 0.5, "R_PAIR_PAM": 0.2}, 0.10, "RELATIONAL"),
        ([(*V_, 0.95, 10, False)], {"V_EUC_PAM": 0.5}, 0.0, "NO_STABLE_STRUCTURE"),
    ],
)
def test_selection(spark, rows, thresholds, margin, decision):
    t, c = calibration_of(spark, thresholds, margin=margin)
    metrics = metric_rows(spark, [("r", *r) for r in rows])
    got = SEL.select_representation(metrics, t, c).first()
    assert got.decision == decision
    assert (got.selected_method is None) == (decision == "NO_STABLE_STRUCTURE")
    if decision == "HYBRID":
        assert got.selected_alpha == 0.5
    if margin:
        assert got.null_threshold == pytest.approx(0.30)
    if not rows[0][-1]:
        assert got.rejection_reasons["V_EUC_PAM"] == "degenerate"


def test_outer_vote(spark):
    t, c = calibration_of(spark, {"V_EUC_PAM": 0.5, "R_PAIR_PAM": 0.5})
    metrics = metric_rows(spark, [("a", *V_, 0.8, 10, True), ("b", *R_, 0.8, 10, True)])
    got = SEL.select_representation(metrics, t, c).first()
    assert (got.decision, got.decision_confidence, got.uncertain) == ("VALUE", 0.5, True)


@pytest.mark.parametrize("regrets,passes", [((0.0, 0.105284), False), ((0.05, 0.10), True), ((0.0, 0.05, 0.9), False), ((0.1, 0.0, 0.02), True), ((0.0,), False), ((0.0, None), False)])
def test_transfer_gate(spark, regrets, passes):
    rows = [(str(i), r, 0.9, 0.2, True) for i, r in enumerate(regrets)]
    gate = G.transfer_gate(spark.createDataFrame(rows, "direction_id string, regret double, coverage double, min_accepted_share double, frozen boolean")).first()
    assert gate.go is passes and gate.coverage_ok and gate.frozen_ok and gate.cluster_share_ok


def test_regret(spark):
    assigned = spark.createDataFrame(
        [(m, f"s{i}", c, c) for m, cs in (("V_EUC_PAM", (0, 0, 1, 1)), ("R_PAIR_PAM", (0, 1, 0, 1))) for i, c in enumerate(cs)],
        "method_id string, sample_id string, forced_cluster int, accepted_cluster int",
    ).withColumn("dataset_id", F.lit("x"))
    labels = spark.createDataFrame([(f"s{i}", l) for i, l in enumerate("AABB")], "sample_id string, label string")
    scored = G.method_metrics(assigned, labels, ["dataset_id", "method_id"])
    selection = spark.createDataFrame([("x", "VALUE", "V_EUC_PAM")], "dataset_id string, decision string, selected_method string")
    got = G.regret(scored, selection, ["dataset_id"]).first()
    assert (got.selected_ari, got.oracle_method, got.regret) == (1.0, "V_EUC_PAM", 0.0)


def blocks_matrix(n=80, p=12):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(n, p))
    x[: n // 2, 0] += 2.5
    x[: n // 2, 1] -= 2.5
    x[n // 2 :, 0] -= 2.5
    x[n // 2 :, 1] += 2.5
    return x


def test_rule_clusters(spark):
    x = blocks_matrix()
    m = measurements(spark, x.tolist(), samples=[f"s{i:02d}" for i in range(80)], features=[f"g{j:02d}" for j in range(12)])
    results = []
    for part in (1, 5):
        fitted = RL.fit(m.repartition(part), k=2, feature_budget=12)
        results.append(
            (
                sorted((r.sample_id, r.cluster) for r in fitted["labels"].collect()),
                sorted(tuple(r) for r in fitted["rules"].collect()),
            )
        )
    assert results[0] == results[1]
    labels = dict(results[0][0])
    halves = [{labels[f"s{i:02d}"] for i in range(*span)} for span in ((0, 40), (40, 80))]
    assert set(labels.values()) == {0, 1} and halves[0] != halves[1]
    samples = RL.feature_maps(m).withColumnRenamed("dataset_id", "model_id")
    frozen = {r.sample_id: r.forced_cluster for r in RL.assign(samples, RL.rule_model(fitted["rules"])).collect()}
    assert frozen == labels


def test_rules_with_missing_cells(spark):
    x = blocks_matrix().tolist()
    for row in x:
        row[7] = None
    x[3][0] = None
    m = measurements(spark, x)
    fitted = RL.fit(m, k=2, feature_budget=12)
    used = {f for r in fitted["rules"].collect() for f in (r.feature_a, r.feature_b)}
    assert "g7" not in used
    samples = RL.feature_maps(m).withColumnRenamed("dataset_id", "model_id")
    out = RL.assign(samples, RL.rule_model(fitted["rules"])).collect()
    assert len(out) == 80 and all(r.accepted_cluster in (0, 1, None) for r in out)


def test_empty_cluster_is_refilled():
    import pyarrow as pa

    row = {
        "dataset_id": "d",
        "clusters": [
            {"cluster": 0, "n": 3, "least": [{"margin": 0.3, "sample_id": "b"}, {"margin": 0.1, "sample_id": "c"}]},
            {"cluster": 1, "n": 0, "least": []},
        ],
    }
    out = list(RL._repairs(2)(iter([pa.RecordBatch.from_pylist([row])])))[0].to_pylist()
    assert out[0]["moved"] == [("c", 1)]


def test_identical_rows_still_fill_all_rule_clusters(spark):
    x = [[1.0, 2.0, 3.0]] * 5 + [[3.0, 2.0, 1.0]]
    fitted = RL.fit(measurements(spark, x), k=3, feature_budget=3, max_iter=5)
    assert {r.cluster for r in fitted["labels"].collect()} == {0, 1, 2}


@pytest.fixture(scope="module")
def small_audit(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(40, 6))
    x[:20] += 6.0
    m = measurements(spark, x.tolist(), samples=[f"s{i:02d}" for i in range(40)]).cache()
    config = A.AuditConfig(k=2, feature_budget=6, relation_budget=10, resamples=2, seed=3)
    return m, config, A.audit(m, config)


def test_audit_finds_clear_blocks(small_audit):
    _, _, result = small_audit
    rows = {r.method_id: r for r in result.metrics.collect()}
    assert rows["V_EUC_PAM"].prediction_strength == 1.0
    assert rows["V_EUC_PAM"].cluster_stability == 1.0
    assert rows["V_EUC_PAM"].nondegenerate
    for r in rows.values():
        assert r.q_score == min(r.prediction_strength, r.cluster_stability, r.perturbation_invariance)
        assert 0 <= r.representation_stability <= 1


def test_self_transfer_reproduces_labels(spark, small_audit):
    from ordinalia.plans import pipelines as PL

    m, _, result = small_audit
    models = PL.freeze_models(result).cache()
    samples = RL.feature_maps(m).withColumnRenamed("dataset_id", "model_id").cache()
    batch = {(r.method_id, r.sample_id): r for r in TR.assign(samples, models).collect()}
    own = {(r.method_id, r.sample_id): r.cluster for r in result.assignments.collect()}
    assert {k: r.forced_cluster for k, r in batch.items()} == own
    single = TR.assign(samples.where("sample_id = 's07'"), models).collect()
    for r in single:
        assert r == batch[r.method_id, r.sample_id]


def test_fit_functions_take_no_labels():
    for function in (A.audit, A.build_representations, RL.fit, pam.fit, S.score_pairs, R.feature_stats, TR.freeze):
        names = " ".join(inspect.signature(function).parameters)
        assert "label" not in names and "target" not in names


def test_config_is_checked():
    good = {"k": 2, "feature_budget": 4, "relation_budget": 3, "resamples": 1, "seed": 0}
    A.AuditConfig(**good)
    for wrong in ({"k": 1}, {"alphas": (0.5, 0.5)}, {"alphas": (1.0,)}, {"margin": 2.0}, {"perturbation_level": "huge"}, {"resamples": 0}):
        with pytest.raises(ValueError):
            A.AuditConfig(**{**good, **wrong})


def test_evaluation_needs_frozen_runs(spark):
    expected = spark.createDataFrame([("a",), ("b",)], "run_id string")
    done = spark.createDataFrame([("a", "v1", "x", 1.0)], "run_id string, schema_tag string, sha256 string, seconds double")
    inventory = spark.createDataFrame([("a", "x")], "run_id string, sha256 string")
    with pytest.raises(ValueError, match="not frozen"):
        V.evaluation_gate(expected, done, inventory, "v1")
    V.evaluation_gate(expected.where("run_id = 'a'"), done, inventory, "v1")
    with pytest.raises(ValueError, match="damaged"):
        V.evaluation_gate(expected.where("run_id = 'a'"), done, inventory, "v2")


def test_salted_model_join_equals_broadcast(spark, monkeypatch):
    from ordinalia import runtime

    rows = spark.createDataFrame([(k, f"s{i}") for k in ("a", "b") for i in range(40)], "key string, sample_id string")
    models = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "key string, m int")
    want = sorted(map(tuple, runtime.attach_models(rows, models, "key").collect()))
    monkeypatch.setattr(runtime, "BROADCAST_BYTES", 0)
    salted = runtime.attach_models(rows, models, "key")
    assert sorted(map(tuple, salted.select("key", "sample_id", "m").collect())) == want
    plan = salted._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan and "broadcast" not in plan.lower()


def test_checkpoint_folder_is_read_from_the_session(spark):
    from ordinalia import runtime

    before = spark.sparkContext.getCheckpointDir()
    runtime.ensure_checkpoint_dir(spark)
    after = spark.sparkContext.getCheckpointDir()
    assert after is not None and (before is None or before == after)
    frame = runtime.cut(spark.range(3))
    assert frame.count() == 3
