"""The tile engine: every block is kept once, pairs of blocks are neither stored nor shuffled."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from catalog import inputs as I
from ordinalia.operators import pam
from ordinalia.operators import tiles as T


def _two_spaces(spark, rows: int = 60, stretch: float = 1.0):
    rng = np.random.default_rng(3)
    made = {s: rng.normal(size=(rows + 7 * i, 4)) * stretch for i, s in enumerate(("a", "b"))}
    listed = [(s, f"{i:03d}", x.tolist(), x.tolist()) for s, m in made.items() for i, x in enumerate(m)]
    points = spark.createDataFrame(listed, "space_id string, sample_id string, z array<double>, q array<double>")
    params = points.select("space_id").distinct().select("space_id", *T.no_relations())
    return made, points, params


def _sums(made: dict) -> dict:
    out = {}
    for space, m in made.items():
        d = np.sqrt(((m[:, None, :] - m[None, :, :]) ** 2).sum(axis=2))
        out |= {(space, f"{i:03d}"): v for i, v in enumerate(d.sum(axis=0))}
    return out


def test_blocks_are_kept_once_and_meet_without_a_shuffle(spark):
    _, points, params = _two_spaces(spark)
    blocks = T.block_table(points, params, 10)
    kept = blocks.rows.select(F.size("rows").alias("n"), "space_id", "block")
    assert kept.agg(F.sum("n")).first()[0] == points.count()
    assert kept.count() == kept.select("space_id", "block").distinct().count()
    runs = T.space_blocks(blocks).select("space_id", "blocks", F.lit("r").alias("run_id"))
    met = T.tiles(blocks, runs, "run_id", small=True)
    counts = {r["space_id"]: r["blocks"] for r in T.space_blocks(blocks).collect()}
    assert met.count() == sum(b * (b + 1) // 2 for b in counts.values())
    pairs = {(r["space_id"], *sorted((r["block"], r["other"]))) for r in met.select("space_id", "block", "other").collect()}
    assert len(pairs) == met.count()
    plan = met._jdf.queryExecution().sparkPlan().toString()
    assert "CartesianProduct" in plan and "SortMergeJoin" not in plan
    blocks.unpersist()


def test_sums_are_those_of_all_pairs_whatever_the_blocks_and_flushes(spark, monkeypatch):
    made, points, params = _two_spaces(spark)
    want = _sums(made)
    monkeypatch.setattr(T, "PART_BLOCKS", 2)
    for block_rows, held in ((10, 15), (10, 10**6), (1000, 10**6)):
        monkeypatch.setattr(T, "HELD_SUMS", held)
        got = T.distance_sums(points, params, ["V_EUC_PAM"], block_rows).collect()
        assert len(got) == len(want)
        assert all(abs(r["total_distance"] - want[r["space_id"], r["sample_id"]]) < 1e-6 for r in got)


def test_costs_too_large_for_whole_units_are_added_up(spark):
    made, points, params = _two_spaces(spark, stretch=1e8)
    want = _sums(made)
    got = T.distance_sums(points, params, ["V_EUC_PAM"], 10).collect()
    assert all(abs(r["total_distance"] / want[r["space_id"], r["sample_id"]] - 1) < 1e-12 for r in got)


def test_the_lines_and_events_are_aggregated_once(spark, tmp_path):
    lines = {
        "l_suppkey": [1, 1, 2, 2], "l_linestatus": ["F", "F", "O", "O"], "l_returnflag": ["A", "N", "A", "N"],
        **{c: [1.0, 2.0, 3.0, 4.0] for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")},
    }
    pq.write_table(pa.table(lines), tmp_path / "lineitem.parquet")
    events = {"user_id": [1, 1, 2], "event_type": ["a", "a", "b"], "value": [1.0, 3.0, 5.0]}
    stamps = pa.array([0, 0, 86_400_000_000], pa.timestamp("us"))
    pq.write_table(pa.table({**events, "ts": stamps}), tmp_path / "events.parquet")
    for made, rows, file in ((I.m3, 16, "lineitem.parquet"), (I.m2, 2, "events.parquet")):
        long = made(spark, str(tmp_path))
        assert long.count() == rows
        assert not [f for f in long.inputFiles() if f.endswith(file)]


def _fitted(points, params):
    runs = points.select("space_id").distinct().selectExpr(
        "space_id", "explode(array(0, 1)) AS member_no", "'V_EUC_PAM' AS method_id"
    ).selectExpr("space_id", "concat(space_id, member_no) AS run_id", "method_id", "member_no")
    flags = points.withColumn("member", F.expr("array(true, pmod(xxhash64(sample_id), 3) > 0)"))
    fitted = pam.fit(flags, params, runs, 2, block_rows=10)
    return sorted((r["run_id"], r["medoids"], r["trace"], r["status"]) for r in fitted.collect())


@pytest.mark.parametrize("stretch", [1.0, 1e8])
def test_whole_costs_of_a_task_give_the_same_medoids_and_sums(spark, monkeypatch, stretch):
    made, points, params = _two_spaces(spark, stretch=stretch)
    parted = _fitted(points, params)
    assert all(status == "done" for *_, status in parted)
    monkeypatch.setattr(T, "MOST_PARTIAL_SUMS", 0)
    assert T.block_table(points, params, 10).whole
    assert _fitted(points, params) == parted
    want = _sums(made)
    got = T.distance_sums(points, params, ["V_EUC_PAM"], 10).collect()
    assert len(got) == len(want)
    assert all(abs(r["total_distance"] / want[r["space_id"], r["sample_id"]] - 1) < 1e-9 for r in got)


def test_many_runs_pass_on_the_cheapest_candidates_only(spark, monkeypatch):
    made, points, params = _two_spaces(spark)
    monkeypatch.setattr(T, "MOST_PARTIAL_SUMS", 1000)
    blocks = T.block_table(points, params, 10, runs=1000)
    runs = T.space_blocks(blocks).selectExpr(
        "space_id", "blocks", "space_id AS run_id", "'V_EUC_PAM' AS method_id", "0 AS member_no", f"CAST(NULL AS {T.MEDOIDS}) AS medoids"
    )
    costs = T.candidate_costs(blocks, runs, 1, False, small=True).collect()
    assert len(costs) <= blocks.rows.count()  # not one row per sample
    for space in made:
        found = min((float(r["c0"]), r["sample_id"]) for r in costs if r["run_id"] == space)
        want = min((v, s) for (name, s), v in _sums(made).items() if name == space)
        assert found[1] == want[1] and abs(found[0] - want[0]) < 1e-6
    blocks.unpersist()


def _median(made: dict, digits: int) -> dict:
    out = {}
    for space, m in made.items():
        d = np.round(np.sqrt(((m[:, None, :] - m[None, :, :]) ** 2).sum(axis=2)), digits)[np.triu_indices(len(m), 1)]
        out[space] = float(np.median(d[d > 0]))
    return out


@pytest.mark.parametrize("listed", [0, 3, 1 << 16])
@pytest.mark.parametrize("kind", ["spread", "narrow", "ties"])
def test_the_median_of_all_pairs_is_exact_whatever_the_passes(spark, monkeypatch, listed, kind):
    made, points, params = _two_spaces(spark)
    if kind != "spread":  # distances that share their first 40 bits, and distances of few values
        for m in made.values():
            m[:] = np.arange(len(m))[:, None] % 2 + (m * 1e-9 if kind == "narrow" else 0)
        listed_rows = [(s, f"{i:03d}", x.tolist(), x.tolist()) for s, m in made.items() for i, x in enumerate(m)]
        points = spark.createDataFrame(listed_rows, points.schema)
    monkeypatch.setattr(T, "LISTED_VALUES", listed)
    got = {r["space_id"]: r["scale"] for r in T.positive_median(points, params, ["V_EUC_PAM"], 10).collect()}
    want = _median(made, T.DISTANCE_DIGITS)
    assert got.keys() == want.keys()
    assert all(abs(got[s] / want[s] - 1) < 1e-12 for s in want)


def _search_rows(spark, monkeypatch, points, params) -> list[int]:
    """Rows that the tasks of each pass of the median's search pass on."""
    counters, tile_bins = [], T._tile_bins

    def counting(*passed):
        counters.append(spark.sparkContext.accumulator(0))
        counter, run = counters[-1], tile_bins(*passed)

        def counted(batches):
            for part in run(batches):
                counter.add(part.num_rows)
                yield part

        return counted

    monkeypatch.setattr(T, "_tile_bins", counting)
    T.positive_median(points, params, ["V_EUC_PAM"]).collect()
    return [c.value for c in counters]


def test_a_later_pass_of_the_median_passes_on_a_bounded_number_of_bins(spark, monkeypatch):
    """The middle distances of 500 samples share their first 24 bits with some 30,000 others; one block."""
    rng = np.random.default_rng(5)
    listed = [("a", f"{i:03d}", [float(i % 2 + x)], [0.0]) for i, x in enumerate(rng.uniform(0, 2e-5, 500))]
    points = spark.createDataFrame(listed, "space_id string, sample_id string, z array<double>, q array<double>")
    params = points.select("space_id").distinct().select("space_id", *T.no_relations())
    monkeypatch.setattr(T, "LISTED_VALUES", 1000, raising=False)
    rows = _search_rows(spark, monkeypatch, points, params)
    assert len(rows) > 1 and max(rows[1:]) <= 1 << 14


def test_distances_of_one_value_end_the_search(spark, monkeypatch):
    listed = [("a", f"{i:03d}", [float(i % 2)], [0.0]) for i in range(600)]
    points = spark.createDataFrame(listed, "space_id string, sample_id string, z array<double>, q array<double>")
    params = points.select("space_id").distinct().select("space_id", *T.no_relations())
    assert len(_search_rows(spark, monkeypatch, points, params)) == 2
