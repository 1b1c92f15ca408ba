"""Sizes and inputs at which something used to be dropped or cut off."""

from __future__ import annotations

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from catalog import inputs as I
from ordinalia.functions import quantiles as Q
from ordinalia.operators import pam, perturb
from ordinalia.operators import ranks as K
from ordinalia.operators import rules as RL
from ordinalia.operators import transfer as TR
from ordinalia.operators.audit import AuditConfig
from ordinalia.plans import pipelines as PL
from ordinalia.sources import manifest
from ordinalia.sources.matrices import measurements_to_vectors, vectors_to_measurements


def test_long_ids_stay_apart(spark):
    ids = [1, 100000, 1000000, 1000001, 2**62]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "id bigint").select(I.padded("id")).collect()]
    assert len(set(got)) == len(ids) and got == sorted(got) and [int(x) for x in got] == ids


def test_wide_vectors_come_back_in_order(spark):
    vector = [float(i) for i in range(1200)]
    rows = spark.createDataFrame([("a", vector)], "id string, v array<double>")
    long = vectors_to_measurements(rows, F.lit("d"), F.col("id"), "v")
    assert measurements_to_vectors(long).first()["vector"] == vector


def test_large_files_are_verified_in_parts(spark, tmp_path, monkeypatch):
    for name in ("a.csv", "c d.csv"):
        (tmp_path / name).write_text("x" * 20)
    (tmp_path / "b.csv").write_text("y")
    monkeypatch.setattr(manifest, "HASHED_BYTES", 10)
    monkeypatch.setattr(manifest, "PART_BYTES", 7)
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    entries = spark.createDataFrame(
        [("a", "a.csv", 20, digest("x" * 20)), ("b", "b.csv", 1, digest("y")), ("c", "c d.csv", 20, digest("z" * 20))],
        "dataset_id string, x_path string, x_size_bytes long, x_sha256 string",
    )
    files = manifest.scan_files(spark, str(tmp_path))
    assert files.where("sha256 IS NULL").isEmpty()
    found = manifest.file_problems(entries, files, str(tmp_path)).collect()
    assert [(r["dataset_id"], r["problem"]) for r in found] == [("c", "checksum")]


def test_nulls_have_no_rank_in_groups_of_any_size(spark):
    values = [3.0, None, 1.0, 1.0, None, 2.0]
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(values)], "k string, i int, v double")
    for small in (10**6, 0):
        got = {r["i"]: r["r"] for r in Q.average_rank(df, ["k"], "v", "r", small_group=small).collect()}
        assert got == {0: 4.0, 1: None, 2: 1.5, 3: 1.5, 4: None, 5: 3.0}


@pytest.mark.parametrize("pairs", [[("a", "b"), ("a", "b")], [("a", "a")], [("a", "z")]])
def test_invalid_pairs_are_refused(spark, pairs):
    m = spark.createDataFrame([("d", "s", f, float(i)) for i, f in enumerate("abc")], "dataset_id string, sample_id string, feature_id string, value double")
    frame = spark.createDataFrame([("d", *p) for p in pairs], "dataset_id string, left string, right string")
    with pytest.raises(ValueError, match="invalid pairs"):
        K.relation_states(K.rank_encode(m), frame)


def test_unsettled_runs_are_an_error(spark):
    fitted = spark.createDataFrame([("r1", "done"), ("r2", "max_swaps reached")], "run_id string, status string")
    with pytest.raises(ValueError, match="r2: max_swaps reached"):
        pam.settled(fitted)
    assert pam.settled(fitted.where("run_id = 'r1'")).count() == 1


def test_all_pairs_unless_a_limit_is_stated():
    assert RL.pair_limit(60, None) == 1770 and RL.pair_limit(60, 1500) == 1500


@pytest.mark.parametrize("prime", [None, 7])
def test_null_copies_keep_every_value_once(spark, monkeypatch, prime):
    if prime:  # a listed prime that divides the number of samples
        monkeypatch.setattr(perturb, "PRIMES", (prime, 11))
    rows = [("d", f"s{i:02d}", f"f{j}", float(100 * j + i)) for i in range(14) for j in range(6)]
    m = spark.createDataFrame(rows, "dataset_id string, sample_id string, feature_id string, value double")
    out = perturb.shuffle_null(m, 3, 5).groupBy("dataset_id", "feature_id").agg(
        F.countDistinct("sample_id").alias("samples"), F.countDistinct("value").alias("values")
    )
    assert {(r["samples"], r["values"]) for r in out.collect()} == {(14, 14)}


def test_all_violations_are_reported_together():
    with pytest.raises(ValueError) as caught:
        AuditConfig(k=1, feature_budget=2, relation_budget=0, resamples=1, seed=0, alphas=(0.5, 1.0), margin=math.nan, perturbation_level="huge")
    assert all(name in str(caught.value) for name in ("k=1", "relation_budget=0", "alphas=1.0", "margin=nan", "perturbation_level"))
    AuditConfig(k=2, feature_budget=2, relation_budget=1, resamples=1, seed=0, margin=1.0)


def test_leave_one_out_agrees_with_whole_sets(spark):
    """Thresholds and deltas from order statistics equal those of sets that really leave a report out."""
    import random

    from ordinalia.operators import select as S

    rng = random.Random(2)
    rows = []
    for report in range(9):
        for method, family in (("a", "VALUE"), ("b", "RELATIONAL"), ("h", "HYBRID"), ("i", "HYBRID")):
            if family != "HYBRID" or report not in (3, 4):  # some reports have no gain
                rows.append(("c", f"r{report}", 2, method, family, round(rng.random(), 1), rng.random() < 0.7))
    rows += [("d", "x", 2, "a", "VALUE", 0.5, True), ("d", "x", 2, "h", "HYBRID", 0.9, True)]  # a set of one report
    null = spark.createDataFrame(
        rows, "calibration_id string, report_id string, k int, method_id string, family string, q_score double, nondegenerate boolean"
    )
    for quantile in (0.5, 0.9):
        thresholds = {(r["calibration_id"], r["excluded"], r["method_id"]): r["threshold"] for r in S.leave_one_out_thresholds(null, quantile).collect()}
        deltas = {(r["calibration_id"], r["excluded"]): r["delta_hybrid"] for r in S.leave_one_out_deltas(null, quantile).collect()}
        assert len(deltas) == 10 and deltas["d", "x"] == 0.02
        for out in (f"r{i}" for i in range(9)):
            rest = null.where((F.col("calibration_id") == "c") & (F.col("report_id") != out))
            wanted = {r["method_id"]: r["threshold"] for r in S.method_thresholds(rest, quantile).collect()}
            assert {m: t for (c, o, m), t in thresholds.items() if c == "c" and o == out}.items() <= wanted.items()
            assert deltas["c", out] == S.hybrid_delta(rest, quantile).first()["delta_hybrid"]


@pytest.mark.parametrize("wrong", [{"k": 2.5}, {"k": True}, {"seed": "7"}, {"resamples": 3.0}, {"margin": None}, {"alphas": (0.5, "0.7")}])
def test_counts_are_whole_numbers(wrong):
    good = {"k": 2, "feature_budget": 4, "relation_budget": 3, "resamples": 1, "seed": 0}
    with pytest.raises(ValueError, match=f"{next(iter(wrong))}=.* is not a"):
        AuditConfig(**{**good, **wrong})


def test_too_few_null_copies_are_refused():
    config = AuditConfig(k=2, feature_budget=4, relation_budget=3, resamples=1, seed=0)
    with pytest.raises(ValueError, match="null_replicates=2"):
        PL.audit_and_select(None, config, 2)


def _cells(spark, names):
    rows = [(d, f"s\t{i}", f"f{j}", float((i * 7 + j * j * (i % 2)) % 11)) for d in names for i in range(8) for j in range(4)]
    return spark.createDataFrame(rows, "dataset_id string, sample_id string, feature_id string, value double")


def test_names_with_tabs_and_colons_keep_their_targets(spark):
    names = ["a\tb", "a", "x:y"]
    routes = spark.createDataFrame([("a", "a\tb"), ("a", "x:y")], "model_id string, target_id string")
    _, assigned = PL.rule_transfer(_cells(spark, names), routes, k=2, feature_budget=4, max_rules=4, min_support=0.5)
    got = {(r["target_id"], r["sample_id"]) for r in assigned.collect()}
    assert got == {(t, f"s\t{i}") for t in ("a\tb", "x:y") for i in range(8)}


def test_targets_with_another_schema_are_refused(spark):
    cells = _cells(spark, ["a", "b"])
    routes = spark.createDataFrame([("a", "b")], "model_id string, target_id string")
    frozen_for = TR.feature_schema_hash(cells.where("dataset_id = 'b'"))
    for changed in (cells.where("feature_id <> 'f3'"), cells.where("dataset_id <> 'b'")):
        with pytest.raises(ValueError, match="frozen for"):
            PL.assign_targets(None, routes, changed, frozen_for)
    assert TR.schema_mismatches(cells.where("dataset_id = 'b'"), frozen_for).isEmpty()


def test_labels_wait_for_frozen_runs(spark):
    assigned = spark.createDataFrame(
        [("m", "t", f"s{i}", i % 2, 0.9, 0.4) for i in range(6)],
        "model_id string, target_id string, sample_id string, accepted_cluster int, best_score double, score_margin double",
    )
    labels = spark.createDataFrame([("t", f"s{i}", "xy"[i % 2]) for i in range(6)], "dataset_id string, sample_id string, label string")
    done = spark.createDataFrame([("m", "v1", "c", 1.0)], "run_id string, schema_tag string, sha256 string, seconds double")
    files = spark.createDataFrame([("m", "c")], "run_id string, sha256 string")
    for runs, reason in (
        (PL.FrozenRuns(done.limit(0), files, "v1"), "not frozen"),
        (PL.FrozenRuns(done, files.withColumn("sha256", F.lit("d")), "v1"), "damaged"),
    ):
        with pytest.raises(ValueError, match=reason):
            PL.evaluate_rules(assigned, labels, runs)
        with pytest.raises(ValueError, match=reason):
            PL.evaluate_transfer(None, assigned, labels, 2, runs)
    row = PL.evaluate_rules(assigned, labels, PL.FrozenRuns(done, files, "v1")).first()
    assert (row["ari"], row["coverage"]) == (1.0, 1.0)
