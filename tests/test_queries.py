"""Every registered query runs; those with SQL agree with DuckDB on the smallest tables."""

from __future__ import annotations

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from compare import compare, connect

import __spark_entry__ as entry
from catalog.registry import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
#: Whole pipelines take a minute each; set ALL_QUERIES=1 to run them here too.
SLOW = {
    "representation_audit", "audit_with_missing_cells", "calibrated_selection", "cohort_transfer",
    "transfer_evaluation", "shared_source_transfer", "method_comparison",
}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(name for name, (_, sql) in QUERIES.items() if sql))
def test_query_agrees_with_sql(spark, con, name):
    problem = compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], SF)
    spark.catalog.clearCache()
    assert problem is None, problem


@pytest.mark.parametrize("name", sorted(name for name, (_, sql) in QUERIES.items() if not sql))
def test_query_without_sql_has_rows(spark, name):
    if name in SLOW and not os.environ.get("ALL_QUERIES"):
        pytest.skip("slow; set ALL_QUERIES=1")
    assert entry.queries()[name](spark, SF).count() > 0
    spark.catalog.clearCache()


@pytest.mark.parametrize("kinds", [1, 2, 5], ids=lambda c: f"{c} different rows")
@pytest.mark.parametrize("name", ["kmedoids_vectors", "rule_clusters"])
def test_ties_and_empty_clusters_agree_with_sql(spark, tmp_path, name, kinds):
    """Repeated rows: equal costs, equal scores and clusters that lose all members, in Spark and in SQL."""
    vectors = [[float((7 * i * i + 3 * f * (i + 1)) % 11) for f in range(64)] for i in range(kinds)]
    table = pa.table({"vec_id": pa.array(range(14), pa.int64()), "embedding": [vectors[i % kinds] for i in range(14)]})
    pq.write_table(table, tmp_path / "embeddings.parquet")
    sf = str(tmp_path)
    assert compare(spark, connect(sf), entry.queries()[name], entry.oracle_sql()[name], sf) is None
    spark.catalog.clearCache()
