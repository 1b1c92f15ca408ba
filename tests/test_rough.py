"""Rough costs decide only which candidates get exact ones: the fits stay what they are."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordinalia.operators import pam
from ordinalia.operators import tiles as T

METHODS = ("V_EUC_PAM", "V_COR_PAM", "R_FOOT_PAM", "R_PAIR_PAM", "H_EUC_PAIR_A025_PAM")


def _geometry(p: int) -> dict:
    left, right = np.triu_indices(p, 1)
    return {
        "pair_left": left.tolist(), "pair_right": right.tolist(), "pair_weight": np.linspace(0.5, 2.0, len(left)).tolist(),
        "margin": 0.0, "value_scale": 1.5, "relational_scale": 0.4,
    }


def _ranks(x: np.ndarray) -> np.ndarray:
    return np.argsort(np.argsort(x, axis=1), axis=1) / (x.shape[1] - 1.0)


@pytest.mark.parametrize("stretch", [1e-3, 1.0, 1e6], ids=lambda s: f"values of {s}")
@pytest.mark.parametrize("method", METHODS)
def test_rough_distances_keep_their_bounds(method, stretch):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(90, 6)) * stretch
    x[60:] = x[:30]  # pairs without any distance, where roots of rounding errors are largest
    x[50:60] = x[40:50] + 1e-9 * stretch
    q = _ranks(x)
    q[7, 2] = q[70, :2] = np.nan
    block = lambda at: {"id": [*range(len(x[at]))], "z": x[at], "q": q[at]}
    exact = T.geometry_of(_geometry(6))
    a, b = slice(0, 45), slice(45, 90)
    want = exact.between(block(a), block(b), method, {})
    got, rows, columns = T.Rough(exact).between(block(a), block(b), method, {})
    assert got.dtype == np.float32 and (np.isnan(got) == np.isnan(want)).all()
    known = ~np.isnan(want)
    off = np.abs(got - want) - 8 * T.ROUGH_UNIT * np.nan_to_num(want)
    assert (off <= rows[:, None] + columns[None, :] + 1e-11)[known].all()


def _points(spark, rows: int, copies: bool):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(rows, 5)) + 3.0 * rng.integers(0, 3, size=(rows, 1)), 2)
    if copies:
        x[rows // 2 :] = x[: rows - rows // 2]
    member = [[True, bool(i % 2), bool(i % 5)] for i in range(rows)]
    listed = [("s", f"{i:04d}", r.tolist(), q.tolist(), m) for i, (r, q, m) in enumerate(zip(x, _ranks(x), member))]
    points = spark.createDataFrame(
        listed, "space_id string, sample_id string, z array<double>, q array<double>, member array<boolean>"
    )
    types = ("array<int>", "array<int>", "array<double>", "double", "double", "double")
    schema = "space_id string, " + ", ".join(f"{c} {t}" for c, t in zip(T.PARAM_COLUMNS, types))
    params = spark.createDataFrame([("s", *_geometry(5).values())], schema)
    runs = spark.createDataFrame(
        [("s", f"{m} {no}", m, no) for m in METHODS for no in range(3)],
        "space_id string, run_id string, method_id string, member_no int",
    )
    return points, params, runs


def _fitted(fitted):
    rows = fitted.select("run_id", "status", F.col("medoids.sample_id").alias("ids"), "objective", "trace").collect()
    return {r["run_id"]: (r["status"], r["ids"], r["objective"], r["trace"]) for r in rows}


@pytest.mark.parametrize(
    ("copies", "whole", "most"),
    [(True, False, 2048), (False, True, 2048), (True, True, 1)],
    ids=["every row twice", "whole sums", "too many picks"],
)
def test_fits_are_the_same_with_rough_costs(spark, monkeypatch, copies, whole, most):
    points, params, runs = _points(spark, 70, copies)
    if whole:
        monkeypatch.setattr(T, "MOST_PARTIAL_SUMS", 1)
    want = _fitted(pam.fit(points, params, runs, 3, block_rows=16))
    made, rough = [], T.candidate_costs

    def counted(*args, **options):
        made.append(options.get("rough", False))
        return rough(*args, **options)

    monkeypatch.setattr(T, "candidate_costs", counted)
    monkeypatch.setattr(pam, "LEAST_ROUGH", 1)
    monkeypatch.setattr(pam, "MOST_PICKS", most)
    got = _fitted(pam.fit(points, params, runs, 3, block_rows=16))
    assert got == want and all(status == "done" for status, *_ in want.values())
    assert any(made) and (most > 1) == all(made)


def test_missing_distances_still_end_a_run(spark, monkeypatch):
    points, params, runs = _points(spark, 40, False)
    hole = F.when(F.col("sample_id") == "0017", F.transform("q", lambda v: F.lit(None).cast("double"))).otherwise(F.col("q"))
    monkeypatch.setattr(pam, "LEAST_ROUGH", 1)
    got = _fitted(pam.fit(points.withColumn("q", hole), params, runs, 2, block_rows=16))
    for run_id, (status, *_) in got.items():
        lost = not run_id.startswith("V_") and not run_id.endswith("1") or run_id.startswith(("R_", "H_")) and 17 % 2
        assert (status == "undefined distance") == bool(lost), run_id
