"""Queries whose whole table and every stage must count."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from compare import compare, connect

import __spark_entry__ as entry
from ordinalia.plans import pipelines as PL

WIDTH = 70  # fixed value: more features than the given vectors have


def _vectors(folder, low: int) -> str:
    """Vectors whose features from ``low`` on vary least."""
    x = np.random.default_rng(5).normal(size=(40, WIDTH))
    x[:, low:] *= 0.01
    x[:, low:] += np.linspace(0.0, 0.05, 40)[:, None]
    table = pa.table({"vec_id": pa.array(range(40), pa.int64()), "embedding": [r.tolist() for r in x]})
    pq.write_table(table, f"{folder}/embeddings.parquet")
    return str(folder)


def _distances(name: str, x: np.ndarray) -> np.ndarray:
    low, middle, high = np.quantile(x, (0.25, 0.5, 0.75), axis=0)
    z = (x - middle) / (high - low)
    if name == "euclidean_sums":
        return np.sqrt(((z[:, None] - z[None]) ** 2).sum(axis=2))
    return 1.0 - np.corrcoef(z)


@pytest.mark.parametrize("name", ["correlation_sums", "euclidean_sums"])
def test_distance_sums_read_every_feature(spark, tmp_path, name):
    sf = _vectors(tmp_path, 16)
    x = np.array(pq.read_table(f"{sf}/embeddings.parquet")["embedding"].to_pylist())
    want = _distances(name, x).sum(axis=1)
    got = {int(r["sample_id"]): r["total_distance"] for r in entry.queries()[name](spark, sf).collect()}
    assert all(abs(got[i] - v) < 1e-5 for i, v in enumerate(want))
    assert compare(spark, connect(sf), entry.queries()[name], entry.oracle_sql()[name], sf) is None
    spark.catalog.clearCache()


_MODEL = (
    "model_id string, method_id string, feature_ids array<string>, medians array<double>, scales array<double>, "
    "medoids array<struct<sample_id:string,z:array<double>,q:array<double>>>, pair_left array<int>, pair_right array<int>, "
    "pair_weight array<double>, margin double, value_scale double, relational_scale double, alpha double, "
    "radius_q95 array<double>, confidence_q05 double, min_feature_coverage double, min_relation_coverage double"
)


@pytest.mark.parametrize("selected", ["V_EUC_PAM", None], ids=["a method is selected", "none is stable"])
def test_the_selection_decides_what_a_transfer_assigns(spark, monkeypatch, selected):
    medoids = [("a", [0.0, 1.0], [0.0, 1.0]), ("b", [1.0, 0.0], [1.0, 0.0])]
    rest = ([0, 1], [0.0, 0.0], [1.0, 1.0], medoids, [], [], [], 0.0, None, None, None, [9.0, 9.0], 0.0, 0.5, 0.5)
    rows = [("s", m, ["f0", "f1"], *rest[1:]) for m in ("V_EUC_PAM", "R_FOOT_PAM")]
    decision = "VALUE" if selected else "NO_STABLE_STRUCTURE"
    selection = spark.createDataFrame([("s", decision, selected)], "dataset_id string, decision string, selected_method string")
    monkeypatch.setattr(PL, "audit_and_select", lambda *a, **o: (None, selection, None, None))
    monkeypatch.setattr(PL, "freeze_models", lambda result: spark.createDataFrame(rows, _MODEL))
    cells = spark.createDataFrame(
        [("t", f"x{i}", f"f{j}", float(i == j)) for i in range(2) for j in range(2)],
        "dataset_id string, sample_id string, feature_id string, value double",
    )
    routes = spark.createDataFrame([("s", "t")], "model_id string, target_id string")
    frozen = PL.fit_and_freeze(cells, None, 3)
    got = PL.assign_targets(frozen.models, routes, cells).collect()
    assert {(r["sample_id"], r["method_id"]): r["accepted_cluster"] for r in got} == {
        (f"x{i}", m): 1 - i for i in range(2) for m in ("V_EUC_PAM", "R_FOOT_PAM")
    }
    assert all(r["decision"] == decision and r["selected"] == (r["method_id"] == selected) for r in got)
    assert {(r["sample_id"], r["method_id"]): r["selected_cluster"] for r in got} == {
        (f"x{i}", m): 1 - i if m == selected else None for i in range(2) for m in ("V_EUC_PAM", "R_FOOT_PAM")
    }
