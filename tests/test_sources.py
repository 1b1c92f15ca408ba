"""Readers, writers and the stream on small files."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from ordinalia.operators import rules as RL
from ordinalia.sources import labels as SL
from ordinalia.sources import manifest as SM
from ordinalia.sources import matrices as MX
from ordinalia.sources import tables as ST
from ordinalia.streaming import assign as STR


def cells(df):
    return {(r.sample_id, r.feature_id): r.value for r in df.collect()}


def test_csv_layouts(spark, tmp_path):
    (tmp_path / "f.csv").write_text("id,s1,s2\ng1,1.5,2\ng2,,nan\n")
    want = {("s1", "g1"): 1.5, ("s2", "g1"): 2.0, ("s1", "g2"): None, ("s2", "g2"): None}
    assert cells(MX.read_feature_major_csv(spark, str(tmp_path / "f.csv"), "d")) == want
    (tmp_path / "s.csv").write_text("id,g.1,g2\ns1,1.5,\ns2,2,3\n")
    got = cells(MX.read_sample_major_csv(spark, str(tmp_path / "s.csv"), "d", True))
    assert got == {("s1", "g.1"): 1.5, ("s1", "g2"): None, ("s2", "g.1"): 2.0, ("s2", "g2"): 3.0}
    (tmp_path / "n.csv").write_text("g1,g2\n1,2\n3,4\n")
    got = cells(MX.read_sample_major_csv(spark, str(tmp_path / "n.csv"), "d", False))
    assert got["d_row_0001", "g2"] == 4.0 and len(got) == 4
    (tmp_path / "bad.csv").write_text("id,s1\ng1,oops\n")
    with pytest.raises(Exception, match="not a number"):
        MX.read_feature_major_csv(spark, str(tmp_path / "bad.csv"), "d").collect()


def test_manifest_and_files(spark, tmp_path):
    data = tmp_path / "data"
    data.mkdir()
    (data / "a.csv").write_text("id,s1\ng1,1\n")
    (data / "extra.csv").write_text("x")
    sha = hashlib.sha256((data / "a.csv").read_bytes()).hexdigest()
    entry = {"x_path": "a.csv", "x_size_bytes": (data / "a.csv").stat().st_size, "x_sha256": sha, "n_samples": 1, "n_features": 1}
    book = {"schema": "M/v1", "datasets": {"a": entry, "b": {**entry, "x_path": "gone.csv"}}}
    (tmp_path / "m.json").write_text(json.dumps(book))
    manifest = SM.read_manifest(spark, str(tmp_path / "m.json"), "M/v1")
    problems = SM.file_problems(manifest, SM.scan_files(spark, str(data)), str(data))
    assert {(r.x_path, r.problem) for r in problems.collect()} == {("gone.csv", "missing file"), ("extra.csv", "unlisted file")}
    with pytest.raises(Exception, match="expected M/v2"):
        SM.read_manifest(spark, str(tmp_path / "m.json"), "M/v2").collect()
    shape = MX.shape_mismatches(MX.read_feature_major_csv(spark, str(data / "a.csv"), "a"), manifest)
    assert [r.dataset_id for r in shape.collect()] == ["b"]


def test_labels(spark, tmp_path):
    (tmp_path / "y.csv").write_text("sample_id,y\ns2,B\ns1,A\n")
    expected = spark.createDataFrame([("s1", 1), ("s2", 0)], "sample_id string, row_order bigint")
    by_id = SL.read_labels(spark, str(tmp_path / "y.csv"), "d", "y", expected)
    assert {r.sample_id: r.label for r in by_id.collect()} == {"s1": "A", "s2": "B"}
    by_row = SL.read_labels(spark, str(tmp_path / "y.csv"), "d", "y", expected, "row_order")
    assert {r.sample_id: r.label for r in by_row.collect()} == {"s2": "B", "s1": "A"}
    more = expected.unionByName(spark.createDataFrame([("s3", 2)], expected.schema))
    for alignment in ("sample_id", "row_order"):
        with pytest.raises(Exception, match="do not match"):
            SL.read_labels(spark, str(tmp_path / "y.csv"), "d", "y", more, alignment).collect()


def test_tables_round_trip(spark, tmp_path):
    rules = spark.createDataFrame([("m", 0, 1, "a", "b", 1, 0.1 + 0.2, 1 / 3)], ST.schema_of("prototype_rules"))
    for fmt in ("parquet", "json"):
        ST.save(rules, "prototype_rules", str(tmp_path / fmt), fmt)
        assert ST.load(spark, "prototype_rules", str(tmp_path / fmt), fmt).collect() == rules.collect()


def test_assignment_export(spark, tmp_path):
    rows = spark.createDataFrame(
        [("x", "V", "s1", 0), ("x", "V", "s2", 1), ("y", "V", "s1", 0)],
        "dataset_id string, method_id string, sample_id string, cluster int",
    )
    chosen = spark.createDataFrame([("x", "V"), ("y", None)], "dataset_id string, selected_method string")
    export = ST.assignment_export(rows, rows, chosen)
    assert {(r.dataset_id, r.sample_id): r.cluster for r in export.collect()} == {
        ("x", "s1"): "0", ("x", "s2"): "1", ("y", "s1"): "UNASSIGNED",
    }
    ST.write_assignments(export, str(tmp_path / "out"))
    assert list((tmp_path / "out" / "dataset_id=x").glob("*.csv.gz"))
    ST.write_csv(export, str(tmp_path / "table"), ["dataset_id", "sample_id"])
    assert spark.read.option("header", True).csv(str(tmp_path / "table")).count() == 3


def test_stream_equals_batch(spark, tmp_path):
    rules = spark.createDataFrame(
        [("m", 0, 1, "a", "b", 1, 0.9, 0.3), ("m", 1, 1, "a", "b", 0, 0.9, 0.3)], ST.schema_of("prototype_rules")
    )
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.json").write_text('{"model_id":"m","sample_id":"s1","features":{"a":2.0,"b":1.0}}\n')
    (folder / "2.json").write_text(
        '{"model_id":"m","sample_id":"s2","features":{"a":0.0,"b":1.0}}\n{"model_id":"m","sample_id":"s3","features":{"a":1.0}}\n'
    )
    models = RL.rule_model(rules)
    stream = STR.assign_rules(STR.read_samples(spark, str(folder), files_per_trigger=1), models)
    query = STR.write_assignments(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    assert not any(p.get("stateOperators") for p in query.recentProgress)
    batch = RL.assign(spark.read.schema(STR.SAMPLES).json(str(folder)), models)
    columns = ["sample_id", "accepted_cluster", "best_score"]
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(*columns).collect())) == sorted(
        map(tuple, batch.select(*columns).collect())
    )
    assert {r.sample_id: r.accepted_cluster for r in batch.select("sample_id", F.col("accepted_cluster")).collect()} == {
        "s1": 0, "s2": 1, "s3": None,
    }
