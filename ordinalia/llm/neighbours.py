"""Approximate nearest neighbours by an inverted multi-index.

Vectors are scaled to length 1 and cut in two halves; each half is quantised by its own centroids (fitted on a bounded
sample), so a vector lies in the cell of a centroid pair.  A query visits pairs in the order of their summed
distances, taken from a heap that starts at the nearest pair and adds a pair when its neighbours towards the start
have been visited, until the visited cells hold enough vectors.  Those are reranked by their exact cosine.

Equal vectors are one entry with its k + 1 smallest ids, so a vector that a third of all rows share costs as
much as any other.  A cell's entries and the queries that visit it are packed into blocks of bounded size that meet by an
equi-join, so a full cell is spread over its blocks.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ordinalia.llm.common import batches_of
from ordinalia.runtime import cut

#: Bounds of the sample for the centroids, of the centroids of a half, and passes of the fit.
SAMPLE, CENTROIDS, PASSES = 20_000, 256, 12
#: Entries of a block, queries of a block, pairs of blocks in an Arrow batch, queries whose best a task holds.
BLOCK, QUERIES, BATCH, HELD = 256, 64, 32, 20_000
#: A query visits cells until they hold the share of all entries that finds this share of the true neighbours of
#: PROBES sampled vectors within the sample, and at least VISITED entries.  (In more entries neighbours are nearer, so the
#: share found is larger.)
RECALL, PROBES, VISITED = 0.96, 256, 1000


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """key, ``v`` (array<double>) and ``dim`` of rows whose vectors are not null, not zero and finite throughout."""
    v = F.col(vector).cast("array<double>")
    good = (
        v.isNotNull()
        & (F.size(v) > 0)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists(v, lambda x: x != 0)
        & F.col(key).isNotNull()
    )
    return rows.select(F.col(key).cast("bigint").alias("id"), F.when(good, v).alias("v")).where("v IS NOT NULL").withColumn("dim", F.size("v"))


def _unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, keepdims=True)  # scaled first: squares of very large numbers overflow
    x = x / top
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def centroids(x: np.ndarray, k: int) -> np.ndarray:
    """k-means from seeds drawn with a fixed generator."""
    x = np.unique(x, axis=0)
    if len(x) <= k:
        return x
    rng = np.random.default_rng(0)
    chosen = x[rng.choice(len(x), k, replace=False)]
    for _ in range(PASSES):
        d = (chosen * chosen).sum(1) - 2 * x @ chosen.T
        own = d.argmin(1)
        n = np.bincount(own, minlength=k)
        total = np.zeros_like(chosen)
        np.add.at(total, own, x)
        new = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], chosen)
        if np.allclose(new, chosen):
            break
        chosen = new
    return chosen


def visits(first: np.ndarray, second: np.ndarray, counts: dict[int, int], wanted: int) -> list[int]:
    """Cells (i * len(second) + j) in the order of first[i] + second[j] until they hold ``wanted`` entries."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    x, y = first[a], second[b]
    heap, out, held = [(float(x[0] + y[0]), 0, 0)], [], 0
    done: set[tuple[int, int]] = set()
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        done.add((i, j))
        cell = int(a[i]) * len(second) + int(b[j])
        if cell in counts:
            out.append(cell)
            held += counts[cell]
        if i + 1 < len(x) and (j == 0 or (i + 1, j - 1) in done):
            heapq.heappush(heap, (float(x[i + 1] + y[j]), i + 1, j))
        if j + 1 < len(y) and (i == 0 or (i - 1, j + 1) in done):
            heapq.heappush(heap, (float(x[i] + y[j + 1]), i, j + 1))
    return out


class Index:
    """Centroids of the two halves."""

    def __init__(self, first: np.ndarray, second: np.ndarray) -> None:
        self.first, self.second = first, second

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.first.shape[1]
        squares = lambda p, c: (p * p).sum(1)[:, None] - 2 * p @ c.T + (c * c).sum(1)
        return squares(x[:, :half], self.first), squares(x[:, half:], self.second)

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(1) * len(self.second) + b.argmin(1)


def share_needed(index: Index, x: np.ndarray, k: int, recall: float = RECALL, probes: int = PROBES) -> float:
    """Share of the sample that the first cells must hold for ``recall`` of the k true neighbours of the probes."""
    chosen = np.unique(np.linspace(0, len(x) - 1, min(probes, len(x))).astype(np.int64))
    near = x[chosen] @ x.T
    near[np.arange(len(chosen)), chosen] = -np.inf
    true = np.argsort(-near, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    if not true.size:
        return 1.0
    cell = index.cells(x)
    count = np.bincount(cell, minlength=len(index.first) * len(index.second))
    first, second = index.distances(x[chosen])
    shares = []
    for a, b, neighbours in zip(first, second, true):
        order = np.argsort((a[:, None] + b[None, :]).ravel(), kind="stable")
        upto = np.empty(len(order))
        upto[order] = np.cumsum(count[order])
        shares.extend(upto[cell[neighbours]] / len(x))
    return float(np.quantile(shares, recall, method="higher"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nearest(
    rows: DataFrame, queries: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", wanted: int | None = None
) -> DataFrame:
    """query_id, rank (from 1), key and score (cosine in double precision): the k nearest found for each query row.

    ``queries`` is a condition on the key.  Candidates are all rows but the query's own, ties go to the smaller key;
    with fewer candidates all are returned.  Rows with a null key or with a vector that is null, zero or not finite
    take no part, and of vectors of several widths only those of the commonest width (the larger one on a tie).
    A key that is repeated with equal vectors counts once.  ``wanted``: entries that a query visits.
    """
    all_rows = usable(rows, key, vector)
    widths = all_rows.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    found = "query_id bigint, rank int, id bigint, score double"
    if not widths:
        return rows.sparkSession.createDataFrame([], found).withColumnRenamed("id", key)
    width = widths[0]["dim"]
    own = all_rows.where(F.col("dim") == width).select("id", "v").distinct()

    order = W.partitionBy("v").orderBy("id")
    entries = cut(
        own.withColumn("n", F.row_number().over(order))
        .where(F.col("n") <= k + 1)
        .groupBy("v")
        .agg(F.sort_array(F.collect_list("id")).alias("ids"))
        .withColumn("entry", F.element_at("ids", 1))
    )
    total = entries.count()
    asked = cut(own.where(queries).withColumnRenamed("id", "query_id"))

    part = entries.select("entry", "v")
    if total > SAMPLE:  # a hash bound that 9 in 10 of SAMPLE are expected to reach: no task has to order them
        part = part.where(F.pmod(F.xxhash64("entry"), F.lit(1 << 62)) < int(0.9 * SAMPLE / total * (1 << 62))).limit(SAMPLE)
    sample = sorted(part.collect(), key=lambda r: r["entry"])
    x = _unit(np.array([r["v"] for r in sample], dtype=np.float64))
    many, half = min(CENTROIDS, max(2, round(total**0.25))), width // 2  # about as many cells as entries of a cell
    index = Index(centroids(x[:, :half], many) if half else np.zeros((1, 0)), centroids(x[:, half:], many))

    wanted = wanted or max(VISITED, math.ceil(total * share_needed(index, x, k)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = index.cells(_unit(_matrix(batch.column(1)))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.int64())], names=["ids", "v", "cell"])

    placed = cut(entries.select("ids", "v").mapInArrow(place, "ids array<bigint>, v array<double>, cell bigint"))
    # at most CENTROIDS ** 2 cells
    held = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}
    sent = rows.sparkSession.sparkContext.broadcast(held)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            first, second = index.distances(_unit(_matrix(batch.column(1))))
            cells = [visits(a, b, counts, wanted) for a, b in zip(first, second)]
            at = np.repeat(np.arange(len(cells)), [len(c) for c in cells])
            yield pa.RecordBatch.from_arrays(
                [*(c.take(pa.array(at)) for c in batch.columns), pa.array([c for row in cells for c in row], pa.int64())],
                names=["query", "v", "cell"],
            )

    searched = asked.groupBy("v").agg(F.min("query_id").alias("query"))
    searched = cut(searched.select("query", "v"))
    groups = max(1, math.ceil(searched.count() / QUERIES))
    going = (
        searched.mapInArrow(visit, "query bigint, v array<double>, cell bigint")
        .groupBy("cell", F.pmod(F.xxhash64("query"), F.lit(groups)).alias("group"))
        .agg(F.collect_list(F.struct("query", "v")).alias("queries"))
    )
    blocks = _blocks(placed, held)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[float, int]]] = {}

        def out() -> pa.RecordBatch:
            rows = [(q, i, -s) for q, best in held.items() for s, i in best]
            held.clear()
            columns = [pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))]
            return pa.RecordBatch.from_arrays(columns, names=["query", "id", "score"])

        for batch in batches:
            for qs, es in zip(batch.column(0), batch.column(1)):
                qs, es = qs.values, es.values
                q, e = _matrix(qs.field("v")), _matrix(es.field("v"))
                name, ids = qs.field("query").to_pylist(), es.field("ids").to_pylist()
                length = np.sqrt((e * e).sum(1))
                rough = _unit(q) @ _unit(e).T
                for i in range(len(q)):
                    top = np.arange(len(e))
                    if len(top) > k + 1:  # the last place's ties and near ties stay until the exact score
                        last = np.partition(rough[i], len(top) - k - 1)[len(top) - k - 1]
                        before = held.get(name[i], ())
                        if len(before) > k:  # what is worse than the best so far need not be scored exactly
                            last = max(last, -before[-1][0])
                        top = np.flatnonzero(rough[i] >= last - 1e-9)
                    found = [(-s, x) for s, t in zip(cosine(q[i], e[top], length[top]), top) for x in ids[t]]
                    held[name[i]] = sorted([*held.get(name[i], ()), *found])[: k + 1]
            if len(held) > HELD:
                yield out()
        if held:
            yield out()

    met = going.join(blocks, "cell").select("queries", "entries")
    with batches_of(rows.sparkSession, BATCH):
        scored = cut(met.mapInArrow(rank, "query bigint, id bigint, score double"))
    best = W.partitionBy("query").orderBy(F.desc("score"), "id")
    top = scored.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    lists = top.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("n", "id", "score"))).alias("found"))
    named = asked.join(searched, "v").select("query_id", "query").join(lists, "query", "left")
    return (
        named.select("query_id", F.filter("found", lambda x: x["id"] != F.col("query_id")).alias("found"))
        .select("query_id", F.posexplode(F.slice("found", 1, k)).alias("at", "x"))
        .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias(key), F.col("x.score").alias("score"))
    )


def _blocks(placed: DataFrame, held: dict[int, int]) -> DataFrame:
    """``cell``, ``entries``: the entries of a cell in blocks of about BLOCK."""
    full = {cell: math.ceil(n / BLOCK) for cell, n in held.items() if n > BLOCK}
    number = F.lit(1).cast("bigint")
    if full:  # at most CENTROIDS ** 2 cells
        number = F.coalesce(F.create_map(*[F.lit(x) for pair in full.items() for x in pair])[F.col("cell")].cast("bigint"), number)
    return (
        placed.groupBy("cell", F.pmod(F.xxhash64(F.element_at("ids", 1)), number).alias("block"))
        .agg(F.collect_list(F.struct("ids", "v")).alias("entries"))
        .select("cell", "entries")
    )


def cosine(query: np.ndarray, entries: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Cosine of the query with every entry, at most 1 in size."""
    own = math.sqrt(float((query * query).sum()))
    return np.clip((entries * query).sum(1) / (length * own), -1.0, 1.0)
