"""All-sample sums of pairwise distances without ever emitting a pair.

Samples of one space are packed into blocks of a bounded number of rows; the table of blocks is kept once.
Blocks meet in a Cartesian product of the partitions of that table, so a pair of blocks is neither stored nor
shuffled: a task reads two partitions, computes the distances of their block pairs, reduces them at once and
emits only sums per candidate sample (or counts per distance value).  A space that holds a third of
all rows is therefore spread over its many block pairs.

Partial sums are shuffled once per pair of partitions.  Where many runs would make them too many, a task streams
the whole table past its own candidates instead: it ends with totals and passes on little more than the cheapest.

The numpy helpers below work on one block pair; Spark does the partitioning, joins and final sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expr import HYBRID_PREFIX
from ..runtime import BROADCAST_BYTES, BROADCAST_ROWS, at_most, checked_broadcast, cut, model_table

#: Rows per block: bounds the memory of one task and the size of one packed row.
BLOCK_ROWS = 512
#: Most blocks per partition of the block table: bounds what a task that joins two partitions holds.
PART_BLOCKS = 128
#: Rows whose gaps are added up at once, so that they stay in the processor's cache.
STEP_ROWS = 64
#: Cost sums (runs x samples x medoids) that a task adds up before it passes them on.
HELD_SUMS = 1_000_000
#: Partial sums that one round may shuffle; beyond, a task adds up the whole costs of its candidates.
MOST_PARTIAL_SUMS = 32_000_000
#: Largest partial cost that is added up in whole units of the last decimal; a larger one is passed on as it is.
UNIT_COST = 100_000.0
#: Distances are rounded to this many decimals, so that equal distances compare equal.
DISTANCE_DIGITS = 12
#: Decimals kept in cost sums; sums of decimals do not depend on the order of the partitions.
COST_DIGITS = 10
COST_TYPE = f"decimal(38,{COST_DIGITS})"
#: Half the gap between 1 and the next number of 32 bits: bounds the relative error of one rough operation.
ROUGH_UNIT = 2.0**-24
#: Coordinates (bytes) of the unpacked right blocks that a task remembers while it makes rough costs.
HELD_BYTES = 16 << 20

# ---------------------------------------------------------------- block-pair arithmetic


def _over_features(a: np.ndarray, b: np.ndarray, step) -> np.ndarray:
    """Sum ``step(a_f - b_f)`` feature by feature: the same order, hence the same sum, everywhere."""
    total = np.zeros((len(a), len(b)))
    columns, rows = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    rows_at_once = max(STEP_ROWS, STEP_ROWS * BLOCK_ROWS // max(1, len(b)))
    for at in range(0, len(a), rows_at_once):
        part = total[at : at + rows_at_once]
        gap = np.empty_like(part)
        for f in range(a.shape[1]):
            np.subtract(columns[f][at : at + rows_at_once, None], rows[f][None, :], out=gap)
            step(gap)
            part += gap
    return total


def _euclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(_over_features(a, b, lambda gap: np.multiply(gap, gap, out=gap)))


def _correlation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    def unit(x):
        x = x - x.mean(axis=1, keepdims=True)
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return x / np.where(norm > 0, norm, np.nan)

    return 1.0 - np.clip(unit(a) @ unit(b).T, -1.0, 1.0)


def _footrule(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    p = a.shape[1]
    total = _over_features(a, b, lambda gap: np.abs(gap, out=gap))
    return np.clip(total * (p - 1.0) / float(p * p // 2), 0.0, 1.0)


def _states(q: np.ndarray, relations: dict) -> np.ndarray:
    """States per relation; a negative margin asks for the two states ``>`` and ``not >``."""
    gap = q[:, relations["left"]] - q[:, relations["right"]]
    if relations["margin"] < 0:
        return np.where(np.isnan(gap), np.nan, (gap > 0).astype(float))
    out = np.where(gap > relations["margin"], 1.0, np.where(gap < -relations["margin"], -1.0, 0.0))
    return np.where(np.isnan(gap), np.nan, out)


def _hamming(a: np.ndarray, b: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted share of disagreeing states among jointly known ones; NaN without any."""
    joint = (~np.isnan(a) * weights) @ (~np.isnan(b)).T.astype(float)
    same = sum(((a == s) * weights) @ (b == s).T.astype(float) for s in (-1.0, 0.0, 1.0))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(joint > 0, np.clip((joint - same) / joint, 0.0, 1.0), np.nan)


class Geometry:
    """Distances of one space by method id, sharing the pure distances with the hybrids."""

    def __init__(self, relations: dict | None, value_scale: float | None, relational_scale: float | None):
        self.relations, self.scales = relations, (value_scale, relational_scale)

    def between(self, a: dict, b: dict, method: str, cache: dict) -> np.ndarray:
        if method not in cache:
            cache[method] = np.round(self._raw(a, b, method, cache), DISTANCE_DIGITS)
        return cache[method]

    def _states_of(self, block: dict) -> np.ndarray:
        if "states" not in block:
            block["states"] = _states(block["q"], self.relations)
        return block["states"]

    def _raw(self, a: dict, b: dict, method: str, cache: dict) -> np.ndarray:
        if method == "V_EUC_PAM":
            return _euclidean(a["z"], b["z"])
        if method == "V_COR_PAM":
            return _correlation(a["z"], b["z"])
        if method == "R_FOOT_PAM":
            return _footrule(a["q"], b["q"])
        if method == "R_PAIR_PAM":
            return _hamming(self._states_of(a), self._states_of(b), self.relations["weight"])
        alpha = int(method[len(HYBRID_PREFIX) :].split("_")[0]) / 100.0
        value = self.between(a, b, "V_EUC_PAM", cache)
        pair = self.between(a, b, "R_PAIR_PAM", cache)
        return (1.0 - alpha) * value / self.scales[0] + alpha * pair / self.scales[1]


class Rough:
    """Distances of one space in 32 bits, each with a bound of its error, to tell which candidates need exact costs.

    ``between`` gives ``d, per row, per column``: an entry is off by at most the bound of its row plus that of its column,
    and by :data:`ROUGH_UNIT` a few times relative to itself.  NaN where the distance does not exist.
    """

    def __init__(self, exact: Geometry):
        self.exact = exact

    def between(self, a: dict, b: dict, method: str, cache: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if method not in cache:
            cache[method] = self._raw(a, b, method, cache)
        return cache[method]

    def _raw(self, a: dict, b: dict, method: str, cache: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if method == "V_EUC_PAM":
            return self._euclidean(a, b)
        if method == "V_COR_PAM":
            d = self._unit(a) @ self._unit(b).T
            np.clip(d, -1.0, 1.0, out=d)
            return self._even(a, b, np.subtract(1.0, d, out=d).astype(np.float32), 4 * ROUGH_UNIT)
        if method == "R_FOOT_PAM":
            return self._footrule(a, b)
        if method == "R_PAIR_PAM":
            return self._hamming(a, b)
        alpha = int(method[len(HYBRID_PREFIX) :].split("_")[0]) / 100.0
        share = ((1.0 - alpha) / self.exact.scales[0], alpha / self.exact.scales[1])
        value, pair = self.between(a, b, "V_EUC_PAM", cache), self.between(a, b, "R_PAIR_PAM", cache)
        d = value[0] * np.float32(share[0])
        d += pair[0] * np.float32(share[1])
        return d, *(share[0] * v + share[1] * p for v, p in zip(value[1:], pair[1:]))

    @staticmethod
    def _even(a: dict, b: dict, d: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return d, np.full(len(a["id"]), bound), np.zeros(len(b["id"]))

    def _euclidean(self, a: dict, b: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        for block in (a, b):
            if "norm" not in block:
                z = block["z"]
                block["square"] = (z * z).sum(axis=1)[:, None]
                block["norm"] = np.sqrt(block["square"][:, 0])
                one = np.ones_like(block["square"])
                block["rows"], block["columns"] = np.hstack([-2.0 * z, block["square"], one]), np.hstack([z, one, block["square"]])
        d = a["rows"] @ b["columns"].T
        np.maximum(d, 0.0, out=d)
        d = np.sqrt(d, out=d).astype(np.float32)
        # an error of the square is at most the root of it in the distance, whatever the distance
        worst = math.sqrt((2 * a["z"].shape[1] + 16) * 2.0**-52) + 2 * ROUGH_UNIT
        return d, worst * a["norm"] + 1e-12, worst * b["norm"]

    def _unit(self, block: dict) -> np.ndarray:
        if "unit" not in block:
            z = block["z"] - block["z"].mean(axis=1, keepdims=True)
            norm = np.sqrt((z * z).sum(axis=1, keepdims=True))
            block["unit"] = z / np.where(norm > 0, norm, np.nan)
        return block["unit"]

    def _footrule(self, a: dict, b: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = a["q"].shape[1]
        for block in (a, b):
            if "ranks" not in block:
                block["ranks"] = np.ascontiguousarray(block["q"].T, dtype=np.float32)
        d = np.zeros((a["ranks"].shape[1], b["ranks"].shape[1]), dtype=np.float32)
        for at in range(0, len(d), STEP_ROWS):
            part = d[at : at + STEP_ROWS]
            gap = np.empty_like(part)
            for column, row in zip(a["ranks"], b["ranks"]):
                np.subtract(column[at : at + STEP_ROWS, None], row[None, :], out=gap)
                part += np.abs(gap, out=gap)
        d *= np.float32((p - 1.0) / float(p * p // 2))
        return self._even(a, b, np.minimum(d, 1.0, out=d), (p + 8) * 2 * ROUGH_UNIT)

    def _hamming(self, a: dict, b: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        weights = self.exact.relations["weight"].astype(np.float32)
        for block in (a, b):
            if "marks" not in block:
                states = self.exact._states_of(block)
                marks = {s: (states == s).astype(np.float32) for s in (-1.0, 0.0, 1.0)}
                block["marks"] = {s: m for s, m in marks.items() if m.any()}
                known = ~np.isnan(states)
                block["known"] = None if known.all() else known.astype(np.float32)
                block["weighted"] = {s: m * weights for s, m in block["marks"].items()}
        same = np.zeros((len(a["id"]), len(b["id"])), dtype=np.float32)
        for state, mark in a["weighted"].items():
            if state in b["marks"]:
                same += mark @ b["marks"][state].T
        if a["known"] is None and b["known"] is None:
            joint = weights.sum(dtype=np.float64).astype(np.float32)
        else:
            left, right = (np.ones((len(x["id"]), len(weights)), np.float32) if x["known"] is None else x["known"] for x in (a, b))
            joint = (left * weights) @ right.T
        with np.errstate(invalid="ignore", divide="ignore"):
            d = np.clip((joint - same) / joint, 0.0, 1.0)
        if np.ndim(joint):
            d = np.where(joint > 0, d, np.float32(np.nan))
        return self._even(a, b, d, (len(weights) + 8) * 4 * ROUGH_UNIT)


# ---------------------------------------------------------------- Arrow helpers


def matrix(column: pa.Array) -> np.ndarray:
    """Equal-length list column -> rows x width matrix, NULL as NaN."""
    rows = len(column)
    flat = column.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(float)
    return values.reshape(rows, -1) if rows else values.reshape(0, 0)


def block_of(cells: pa.StructScalar) -> dict:
    """Unpack the cells of one block."""
    ids = cells["ids"].values.to_pylist()

    def numbers(name, kind):
        return np.frombuffer(cells[name].as_buffer(), dtype=kind).reshape(len(ids), -1)

    return {"id": ids, "z": numbers("z", float), "q": numbers("q", float), "member": numbers("member", bool)}


_CELLS = "struct<ids:array<string>,z:binary,q:binary,member:binary>"


def _with_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the numbers of each block's ``rows`` as bytes: tiles pass these on, not one number after the other."""
    for batch in batches:
        out = {"ids": [], "z": [], "q": [], "member": []}
        for i in range(batch.num_rows):
            rows = batch.column("rows").slice(i, 1).flatten()
            fields = dict(zip((f.name for f in rows.type), rows.flatten()))
            out["ids"].append(fields["sample_id"].to_pylist())
            out["z"].append(matrix(fields["z"]).tobytes())
            out["q"].append(matrix(fields["q"]).tobytes())
            out["member"].append(np.nan_to_num(matrix(fields["member"])).astype(bool).tobytes())
        kinds = {"ids": pa.list_(pa.string()), "z": pa.binary(), "q": pa.binary(), "member": pa.binary()}
        cells = pa.StructArray.from_arrays([pa.array(out[c], t) for c, t in kinds.items()], names=list(kinds))
        yield pa.RecordBatch.from_arrays([*batch.columns, cells], names=[*batch.schema.names, "cells"])


def medoid_block(medoids: list[dict]) -> dict:
    def stack(name):
        return np.array([[np.nan if v is None else v for v in m[name]] for m in medoids], dtype=float)

    return {"id": [m["sample_id"] for m in medoids], "z": stack("z"), "q": stack("q")}


def geometry_of(row: dict) -> Geometry:
    relations = None
    if row.get("pair_left") is not None:
        relations = {
            "left": np.array(row["pair_left"], dtype=int),
            "right": np.array(row["pair_right"], dtype=int),
            "weight": np.array(row["pair_weight"], dtype=float),
            "margin": float(row["margin"] or 0.0),
        }
    return Geometry(relations, row["value_scale"], row["relational_scale"])


MEDOIDS = "array<struct<sample_id:string,z:array<double>,q:array<double>>>"
PARAM_COLUMNS = ("pair_left", "pair_right", "pair_weight", "margin", "value_scale", "relational_scale")


def no_relations() -> list[Column]:
    """Parameter columns of a space without a relation model."""
    ints, doubles = "array<int>", "array<double>"
    types = (ints, ints, doubles, "double", "double", "double")
    return [F.lit(None).cast(t).alias(c) for c, t in zip(PARAM_COLUMNS, types)]


# ---------------------------------------------------------------- packing


def space_sizes(points: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Number of blocks per space, one small materialised row each."""
    blocks = F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int")
    return model_table(points.groupBy("space_id").agg(blocks.alias("_blocks")))


def pack(points: DataFrame, sizes: DataFrame) -> DataFrame:
    """``points(space_id, sample_id, z, q[, member])`` -> one row per block, rows sorted by sample id.

    A sample's block depends on its id and the size of its space only, so tiles are the same on any
    partition layout.
    """
    sized = points.join(sizes, "space_id")
    member = F.col("member") if "member" in points.columns else F.array(F.lit(True))
    row = F.struct("sample_id", "z", "q", member.alias("member"))
    return (
        sized.withColumn("block", F.pmod(F.xxhash64("sample_id"), F.col("_blocks")).cast("int"))
        .groupBy("space_id", "block")
        .agg(F.first("_blocks").alias("blocks"), F.array_sort(F.collect_list(row), _by_id).alias("rows"))
    )


def _by_id(a: Column, b: Column) -> Column:
    return (
        F.when(a["sample_id"] < b["sample_id"], -1).when(a["sample_id"] > b["sample_id"], 1).otherwise(0)
    )


@dataclass(frozen=True)
class Blocks:
    """The persisted table of blocks, one row each with the space's parameters; does any space have several?

    ``whole``: a task adds up the whole costs of the candidates in its partition.
    """

    rows: DataFrame
    several: bool
    whole: bool = False

    def unpersist(self) -> None:
        self.rows.unpersist()


#: Spaces whose parameters may be sent to every executor (a model of some thousand relations takes 64 KB).
_SENT_SPACES = BROADCAST_BYTES >> 16


def block_table(
    points: DataFrame,
    params: DataFrame,
    block_rows: int = BLOCK_ROWS,
    runs: DataFrame | int = 1,
    width: int = 1,
) -> Blocks:
    """Every block of every space once: ``space_id, block, blocks, rows, cells`` and the space's parameters; persisted.

    Partitions hold at most about ``PART_BLOCKS`` blocks and are enough that their pairs keep all cores busy.
    ``runs(space_id, ...)``, or their number per space, and the ``width`` of their costs tell how many partial sums
    those pairs would shuffle.  With more than ``MOST_PARTIAL_SUMS`` the partitions alone keep all cores busy, and
    hold neighbouring blocks of few spaces and at most ``HELD_SUMS`` sums if a block does.
    """
    sizes = space_sizes(points, block_rows)
    extent = sizes.agg(F.max("_blocks").alias("most"), F.sum("_blocks").alias("total")).first()
    total, several = int(extent["total"] or 0), (extent["most"] or 0) > 1
    models = checked_broadcast(cut(params.select("space_id", *PARAM_COLUMNS)), _SENT_SPACES)
    rows = pack(points, sizes)
    cells = rows.mapInArrow(_with_cells, rows.withColumn("cells", F.lit(None).cast(_CELLS)).schema)
    packed = cells.join(models, "space_id")
    tasks = 4 * points.sparkSession.sparkContext.defaultParallelism
    busy = math.isqrt(tasks) + 1 if several else tasks
    parts = max(1, min(total, max(busy, -(-total // PART_BLOCKS))))
    if several:
        fitted = total * runs if isinstance(runs, int) else runs.join(sizes, "space_id").agg(F.sum("_blocks")).first()[0]
        sums = int(fitted or 0) * block_rows * width
        if sums * 2 * parts > MOST_PARTIAL_SUMS:
            parts = max(1, min(total, max(tasks, -(-total // PART_BLOCKS), -(-sums // HELD_SUMS))))
            ranged = packed.repartitionByRange(parts, "space_id", "block")
            return Blocks(ranged.persist(StorageLevel.MEMORY_AND_DISK), several, whole=True)
    return Blocks(packed.repartition(parts, "space_id", "block").persist(StorageLevel.MEMORY_AND_DISK), several)


def space_blocks(blocks: Blocks) -> DataFrame:
    return blocks.rows.groupBy("space_id").agg(F.first("blocks").alias("blocks"))


def with_runs(blocks: Blocks, runs: DataFrame, fields: str, small: bool = False) -> DataFrame:
    """Attach the states of a space's runs to its blocks.

    ``small`` says that all states may be sent to every executor; others are copied once per block.
    """
    grouped = runs.groupBy("space_id").agg(
        F.expr("first(blocks) AS blocks"), F.expr(f"collect_list(struct({fields})) AS runs")
    )
    if small:
        return blocks.rows.join(F.broadcast(grouped.select("space_id", "runs")), "space_id")
    spread = grouped.selectExpr("space_id", "runs", "explode(sequence(0, blocks - 1)) AS block")
    return blocks.rows.join(spread, ["space_id", "block"])


def tiles(blocks: Blocks, runs: DataFrame, fields: str, small: bool = False) -> DataFrame:
    """Every unordered pair of blocks of a space once, with the space's runs; to be reduced, never stored.

    ``right`` is NULL where a block meets itself.  Each pair is anchored at one of its two blocks, alternating, so
    that anchors get equal work.
    """
    held = with_runs(blocks, runs, fields, small).withColumnRenamed("cells", "left")
    nothing = F.lit(None).cast(_CELLS)
    columns = ["space_id", "block", "other", "blocks", "left", "right", *PARAM_COLUMNS, "runs"]
    own = held.withColumn("other", F.col("block")).withColumn("right", nothing).select(*columns)
    if not blocks.several:
        return own
    partner = blocks.rows.where("blocks > 1").selectExpr("space_id AS _space", "block AS other", "cells AS right")
    # no equality: an equi-join would sort and shuffle a copy of each block for every block that it meets
    meet = F.expr(
        "space_id <= _space AND space_id >= _space AND "
        "(block < other AND (block + other) % 2 = 1 OR block > other AND (block + other) % 2 = 0)"
    )
    apart = held.where("blocks > 1").join(partner.hint("shuffle_replicate_nl"), meet)
    return own.unionByName(apart.select(*columns))


def whole_tiles(blocks: Blocks, runs: DataFrame, fields: str, small: bool = False) -> DataFrame:
    """Every ordered pair of blocks of a space: all blocks (``left``) stream past the candidates of a partition.

    A partition of the table of blocks is the candidates (``right``) of one task, which sees all their pairs.  ``right``
    is NULL where a block meets itself.
    """
    held = with_runs(blocks, runs, fields, small).withColumnRenamed("cells", "left").coalesce(1)
    candidates = blocks.rows.selectExpr("space_id AS _space", "block AS other", "cells AS right")
    met = held.join(
        candidates.hint("shuffle_replicate_nl"), F.expr("space_id <= _space AND space_id >= _space")
    )
    columns = ["space_id", "block", "other", "blocks", "left", *PARAM_COLUMNS, "runs"]
    return met.select(*columns, F.expr("if(block = other, NULL, right)").alias("right"))


# ---------------------------------------------------------------- reductions


def _nearest(d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest distance, its column (lowest on ties) and second-nearest distance per row."""
    near = np.argmin(d, axis=1)
    first = d[np.arange(len(d)), near]
    rest = d.copy()
    rest[np.arange(len(d)), near] = np.inf
    return first, near, rest.min(axis=1)


def _candidate_costs(d: np.ndarray, state, k: int, swapping: bool) -> np.ndarray:
    """Partial cost of each column as a new medoid (build) or as a replacement of each medoid (swap)."""
    if state is None:
        return d.sum(axis=0)[:, None]
    first, near, second = state
    kept = np.minimum(d, first[:, None])
    total = kept.sum(axis=0)[:, None]
    if not swapping:
        return total
    loss = np.minimum(d, second[:, None])
    loss -= kept
    owned = (near[None, :] == np.arange(k)[:, None]).astype(float)
    return total + (owned @ loss).T


class _Left:
    """The left block of consecutive tiles: what does not depend on the right block is made once.

    ``held``: how many bytes of coordinates of right blocks stay unpacked.
    """

    def __init__(self, held: int = 0):
        self.key, self.held, self.rights = None, held, {}

    def read(self, batch: pa.RecordBatch, i: int) -> tuple[dict, dict, dict | None]:
        row = batch.slice(i, 1)
        key = (row.column("space_id")[0].as_py(), row.column("block")[0].as_py())
        if key != self.key:
            self.key = key
            self.plain = row.drop_columns(["left", "right", "other"]).to_pylist()[0]
            self.space = geometry_of(self.plain)
            self.rows = block_of(row.column("left")[0])
        other = row.column("other")[0].as_py()
        return {**self.plain, "other": other}, self.rows, self._right(row, (key[0], other))

    def _right(self, row: pa.RecordBatch, key: tuple) -> dict | None:
        if not row.column("right")[0].is_valid:
            return None
        if key in self.rights:
            return self.rights[key]
        right = block_of(row.column("right")[0])
        if (len(self.rights) + 1) * (right["z"].nbytes + right["q"].nbytes) > self.held:
            self.rights.clear()
        if self.held:
            self.rights[key] = right
        return right


def _sides(plain: dict, left: dict, right: dict | None, whole: bool) -> tuple[dict, dict, list]:
    """The anchored pair of blocks and its sides (evaluated rows, candidates, their block, is it turned?).

    A whole tile is only the side whose candidates are the right block; the arithmetic is that of the anchored pair.
    """
    block, other = plain["block"], plain["other"]
    if right is None:
        return left, left, [(left, left, block, False)]
    if not whole:
        return left, right, [(left, right, other, False), (right, left, block, True)]
    if (block < other) == ((block + other) % 2 == 1):  # the anchor of :func:`tiles`
        return left, right, [(left, right, other, False)]
    return right, left, [(left, right, other, True)]


def _tile_costs(swapping: bool, every_candidate: bool, whole: bool = False, rough: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, sums, held, medoids, passed = _Left(HELD_BYTES if rough else 0), {}, 0, {}, set()
        for batch in batches:
            for i in range(batch.num_rows):
                before = reader.key
                plain, left, right = reader.read(batch, i)
                if reader.key != before and (before is None or reader.key[0] != before[0]):
                    medoids = {}
                if rough:
                    found = _rough_costs_of_pair(plain, reader.space, medoids, left, right, swapping, whole)
                else:
                    pair = _sides(plain, left, right, whole)
                    found = _costs_of_pair(plain, reader.space, medoids, pair, swapping, every_candidate or plain["blocks"] > 1)
                for part in found:
                    run_id, block, ids, costs, bad = part
                    if not len(ids):
                        continue
                    key = (plain["space_id"], run_id, block)
                    if not (np.abs(costs) < UNIT_COST).all():  # also a cost that is no number
                        passed.add(key)
                        yield _as_batch([part], exact=False)
                        continue
                    units = np.rint(costs * 10.0**COST_DIGITS).astype(np.int64)
                    known = sums.get(key)
                    if known is None:
                        sums[key] = [run_id, block, ids, units, bad.astype(np.int64)]
                        held += units.size
                    else:
                        known[3] += units
                        known[4] += bad
                    # many units fit a whole number of 64 bits, but not any number of them
                    full = known is not None and np.abs(known[3]).max() > 1 << 61
                    if full or (held > HELD_SUMS and not whole):
                        passed.update(sums)
                        yield _as_batch(list(sums.values()), exact=True)
                        sums, held = {}, 0
        # whole costs of a block: only the cheapest can win; not so where a part of them went its own way
        least = _possible if rough else _cheapest
        done = [v if every_candidate or not whole or key in passed else least(v) for key, v in sums.items()]
        if done:
            yield _as_batch(done, exact=True)

    return run


def _cheapest(part: list) -> list:
    """The candidates of a block with the lowest cost; the first one carries the undefined distances of all."""
    run_id, block, ids, costs, bad = part
    keep = costs.min(axis=1) <= costs.min()
    bad = np.where(np.arange(len(bad)) == np.argmax(keep), bad.sum(), 0)
    return [run_id, block, ids[keep], costs[keep], bad[keep]]


def _possible(part: list) -> list:
    """The candidates of a block that may be its cheapest by their rough costs and the bound in the last column."""
    run_id, block, ids, costs, bad = part
    keep = costs[:, :-1].min(axis=1) - costs[:, -1] <= (costs[:, :-1].min(axis=1) + costs[:, -1]).min()
    bad = np.where(np.arange(len(bad)) == np.argmax(keep), bad.sum(), 0)
    return [run_id, block, ids[keep], costs[keep], bad[keep]]


def _as_batch(parts: list, exact: bool) -> pa.RecordBatch:
    """Rows of (run, block, ids, costs, undefined) parts; costs are doubles or whole units of the last decimal."""
    sizes = [len(p[2]) for p in parts]
    rows, width = sum(sizes), parts[0][3].shape[1]
    flat = np.concatenate([p[3].ravel() for p in parts])
    listed = pa.ListArray.from_arrays(
        pa.array(np.arange(rows + 1) * width, pa.int32()), pa.array(flat, pa.int64() if exact else pa.float64())
    )
    empty = pa.nulls(rows, pa.list_(pa.float64() if exact else pa.int64()))
    return pa.RecordBatch.from_pydict(
        {
            "run_id": pa.array(np.repeat(np.array([p[0] for p in parts], dtype=object), sizes), pa.string()),
            "block": pa.array(np.repeat([p[1] for p in parts], sizes), pa.int32()),
            "sample_id": pa.array(np.concatenate([p[2] for p in parts]), pa.string()),
            "costs": empty if exact else listed,
            "units": listed if exact else empty,
            "undefined": pa.array(np.concatenate([p[4] for p in parts]), pa.int64()),
        }
    )


def _costs_of_pair(plain: dict, space: Geometry, medoids: dict, pair: tuple, swapping: bool, every_candidate: bool) -> Iterator[tuple]:
    """Per run and side of a tile: run, block, ids and costs of its candidates, undefined distances."""
    cache, holes = {}, {}
    first, second, sides = pair
    for rows, cols, block, turned in sides:
        for job in plain["runs"]:
            method, no = job["method_id"], job["member_no"]
            full = space.between(first, second, method, cache)
            if method not in holes:
                holes[method] = bool(np.isnan(full).any())
            full = full.T if turned else full
            inside, outside = rows["member"][:, no], cols["member"][:, no]
            d = full if inside.all() and outside.all() else full[np.ix_(inside, outside)]
            ids = np.array(cols["id"], dtype=object)[outside]
            bad = np.zeros(len(ids), dtype=np.int64)
            if holes[method]:
                bad = np.isnan(d).sum(axis=0)
                d = np.nan_to_num(d)
            state, current = None, job["medoids"] or []
            if current:
                near = rows.setdefault("near", {})
                if job["run_id"] not in near:
                    if job["run_id"] not in medoids:
                        medoids[job["run_id"]] = medoid_block(current)
                    near[job["run_id"]] = _nearest(space.between(rows, medoids[job["run_id"]], method, {})[inside])
                state = near[job["run_id"]]
            costs = np.round(
                _candidate_costs(d, state, len(current), swapping), COST_DIGITS
            )
            keep = ~np.isin(ids, [m["sample_id"] for m in current])
            if not every_candidate and keep.any():
                # a one-block space: these are totals already, only the cheapest can win
                keep &= costs.min(axis=1) <= costs[keep].min()
                bad = np.where(np.arange(len(bad)) == np.argmax(keep), bad.sum(), 0)
            yield job["run_id"], block, ids[keep], costs[keep], bad[keep]


def _near_medoids(rows: dict, job: dict, space: Geometry, medoids: dict, inside: np.ndarray) -> tuple | None:
    """Nearest distance, owner and second distance of a run's rows; kept with the block."""
    current = job["medoids"] or []
    if not current:
        return None
    near = rows.setdefault("near", {})
    if job["run_id"] not in near:
        if job["run_id"] not in medoids:
            medoids[job["run_id"]] = medoid_block(current)
        near[job["run_id"]] = _nearest(space.between(rows, medoids[job["run_id"]], job["method_id"], {})[inside])
    return near[job["run_id"]]


def _rough_costs(d: np.ndarray, inside: np.ndarray, state, k: int, swapping: bool) -> np.ndarray:
    """:func:`_candidate_costs` of the ``inside`` rows in 32 bits, a few rows at a time."""
    if state is None:
        return (inside.astype(np.float32) @ d).astype(float)[:, None]
    first, near, second = state
    total = np.zeros((d.shape[1], k if swapping else 1))
    kept, loss = (np.empty((STEP_ROWS, d.shape[1]), np.float32) for _ in range(2))
    at = np.flatnonzero(inside)
    first, second = (v.astype(np.float32)[:, None] for v in (first, second))
    for lo in range(0, len(at), STEP_ROWS):
        part = slice(lo, lo + STEP_ROWS)
        own = d if len(at) == len(d) else None
        rows = own[part] if own is not None else np.take(d, at[part], axis=0, out=loss[: len(at[part])], mode="clip")
        low = np.minimum(rows, first[part], out=kept[: len(rows)])
        total += (np.ones(len(rows), np.float32) @ low)[:, None]
        if swapping:
            more = np.minimum(rows, second[part], out=loss[: len(rows)])
            more -= low
            total += ((near[part][None, :] == np.arange(k)[:, None]).astype(np.float32) @ more).T
    return total


def _rough_costs_of_pair(
    plain: dict, space: Geometry, medoids: dict, left: dict, right: dict | None, swapping: bool, whole: bool
) -> Iterator[tuple]:
    """Like :func:`_costs_of_pair` in 32 bits; the last column bounds the error of the others."""
    rough, cache = Rough(space), {}
    block, other = plain["block"], plain["other"]
    one, two = left, left if right is None else right
    sides = [(one, two, other, False)] + ([(two, one, block, True)] if right is not None and not whole else [])
    ready = {}
    for rows, cols, at, turned in sides:
        for job in plain["runs"]:
            method, no = job["method_id"], job["member_no"]
            if (method, turned) not in ready:
                d, of_rows, of_cols = rough.between(one, two, method, cache)
                d, of_rows, of_cols = (np.ascontiguousarray(d.T), of_cols, of_rows) if turned else (d, of_rows, of_cols)
                gaps = np.isnan(d) if np.isnan(d.sum()) else None
                ready[method, turned] = (d if gaps is None else np.nan_to_num(d), gaps, of_rows, of_cols)
            d, gaps, of_rows, of_cols = ready[method, turned]
            inside, outside = rows["member"][:, no], cols["member"][:, no]
            bad = np.zeros(len(outside), dtype=np.int64) if gaps is None else gaps[inside].sum(axis=0)
            state = _near_medoids(rows, job, space, medoids, inside)
            current = job["medoids"] or []
            costs = _rough_costs(d, inside, state, len(current), swapping)
            # sums of 32 bits, rounding to the last decimal here and in the exact costs
            bound = of_rows[inside].sum() + inside.sum() * of_cols
            bound = bound + (len(inside) + 16) * 2 * ROUGH_UNIT * costs.max(axis=1) + 1e-9
            if "names" not in cols:
                cols["names"] = np.array(cols["id"], dtype=object)
            ids, taken = cols["names"], {m["sample_id"] for m in current}
            keep = outside & np.fromiter((s not in taken for s in cols["id"]), bool, len(ids))
            yield job["run_id"], at, ids[keep], np.column_stack([costs, bound])[keep], bad[keep]


def _pick_costs(swapping: bool):
    """Exact costs of the ``picks`` of every run: a block meets them all at once, totals per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, medoids, picked, plain, space = {}, {}, {}, {}, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                if not plain or plain["space_id"] != row.column("space_id")[0].as_py():
                    plain = row.drop_columns(["cells"]).to_pylist()[0]
                    space = geometry_of(plain)
                rows = block_of(row.column("cells")[0])
                for job in plain["runs"]:
                    if job["run_id"] not in picked:
                        picked[job["run_id"]] = medoid_block(job["picks"])
                    picks, inside = picked[job["run_id"]], rows["member"][:, job["member_no"]]
                    d = np.nan_to_num(space.between(rows, picks, job["method_id"], {})[inside])
                    state = _near_medoids(rows, job, space, medoids, inside)
                    costs = np.round(_candidate_costs(d, state, len(job["medoids"] or []), swapping), COST_DIGITS)
                    part = [job["run_id"], plain["block"], np.array(picks["id"], dtype=object), costs, np.zeros(len(costs), np.int64)]
                    if not (np.abs(costs) < UNIT_COST).all():
                        yield _as_batch([part], exact=False)
                        continue
                    units = np.rint(costs * 10.0**COST_DIGITS).astype(np.int64)
                    known = sums.get(job["run_id"])
                    if known is None:
                        sums[job["run_id"]] = [*part[:3], units, part[4]]
                    else:
                        known[3] += units
                        if np.abs(known[3]).max() > 1 << 61:
                            yield _as_batch([sums.pop(job["run_id"])], exact=True)
        if sums:
            yield _as_batch(list(sums.values()), exact=True)

    return run


def picked_costs(blocks: Blocks, runs: DataFrame, width: int, swapping: bool, small: bool = False) -> DataFrame:
    """Exact total costs of the candidates ``picks`` of every run: ``run_id, sample_id, c0..c{width-1}``."""
    held = with_runs(blocks, runs, "run_id, method_id, member_no, medoids, picks", small)
    partial = held.drop("rows").mapInArrow(_pick_costs(swapping), _PARTIAL)
    parts = _cost_parts(width)
    sums = [F.expr(f"CAST(sum({c}) AS {COST_TYPE}) AS c{m}") for m, c in enumerate(parts)]
    return partial.groupBy("run_id", "sample_id").agg(*sums)


_PARTIAL = "run_id string, block int, sample_id string, costs array<double>, units array<bigint>, undefined bigint"


def candidate_costs(
    blocks: Blocks,
    runs: DataFrame,
    width: int,
    swapping: bool,
    every_candidate: bool = False,
    small: bool = False,
    rough: bool = False,
) -> DataFrame:
    """Total cost per (run, candidate): decimals ``c0..c{width-1}`` and the count of undefined distances.

    Unless ``every_candidate``, a space of one block reports its cheapest candidates only.  ``small``: see
    :func:`with_runs`.  ``rough``: costs of 32 bits, the last of the ``width`` bounds the error of the others; only candidates
    that may be the cheapest are sure to be reported.
    """
    meet = whole_tiles if blocks.whole else tiles
    partial = meet(blocks, runs, "run_id, method_id, member_no, medoids", small).mapInArrow(
        _tile_costs(swapping, every_candidate, blocks.whole, rough), _PARTIAL
    )
    parts = _cost_parts(width)
    if not blocks.several:  # a block's sums are already totals
        return partial.selectExpr(
            "run_id", "block", "sample_id", *[f"{c} AS c{m}" for m, c in enumerate(parts)], "undefined"
        )
    sums = [F.expr(f"CAST(sum({c}) AS {COST_TYPE}) AS c{m}") for m, c in enumerate(parts)]
    return partial.groupBy("run_id", "block", "sample_id").agg(*sums, F.expr("sum(undefined) AS undefined"))


def _cost_parts(width: int) -> list[str]:
    """The partial costs of a row as decimals."""
    unit = f"CAST('1e-{COST_DIGITS}' AS decimal({COST_DIGITS},{COST_DIGITS}))"
    return [
        f"CASE WHEN units IS NULL THEN CAST(round(get(costs, {m}), {COST_DIGITS}) AS {COST_TYPE}) "
        f"ELSE CAST(CAST(get(units, {m}) AS decimal(19,0)) * {unit} AS {COST_TYPE}) END"
        for m in range(width)
    ]


def distance_sums(points: DataFrame, params: DataFrame, methods: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Sum of the distances from every sample to all samples of its space, per method.

    ``undefined`` counts the partners for which the distance does not exist; any such pair makes the
    method unusable on that space (see :func:`method_failures`).
    """
    blocks = block_table(points.drop("member"), params, block_rows, len(methods))
    runs = cut(space_blocks(blocks).select(
        "space_id", "blocks", F.explode(F.array(*[F.lit(m) for m in methods])).alias("method_id")
    ))
    small = at_most(runs, BROADCAST_ROWS)
    runs = runs.select(
        "space_id",
        "blocks",
        "method_id",
        F.concat(F.hex(F.encode("space_id", "utf-8")), F.lit(":"), "method_id").alias("run_id"),
        F.lit(0).alias("member_no"),
        F.lit(None).cast(MEDOIDS).alias("medoids"),
    )
    sums = candidate_costs(blocks, runs, 1, False, every_candidate=True, small=small)
    parts = F.split("run_id", ":", 2)  # the name of the space as hex digits: any name can be cut off again
    return sums.select(
        F.decode(F.unhex(parts[0]), "utf-8").alias("space_id"),
        parts[1].alias("method_id"),
        "sample_id",
        F.col("c0").cast("double").alias("total_distance"),
        "undefined",
    )


def method_failures(sums: DataFrame) -> DataFrame:
    """Methods that have an undefined distance on a space."""
    return (
        sums.groupBy("space_id", "method_id")
        .agg(F.sum("undefined").alias("_u"))
        .where(F.col("_u") > 0)
        .select("space_id", "method_id", F.lit("undefined distance").alias("reason"))
    )


# ---------------------------------------------------------------- exact quantile of all pair distances

#: Bits of a positive double (from the highest) by which the first pass of the search counts all distances.
FIRST_BITS = 24
#: Bits by which a later pass splits a prefix that holds a wanted rank: bounds the bins that a task passes on.
LATER_BITS = 14
#: A prefix with at most so many distances is not split any more: their values are passed on as they are.
LISTED_VALUES = 1 << 16


def _counted(bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct bins and their counts, without a sort where they lie close together."""
    if not len(bins) or np.ptp(bins) > 2 * len(bins):
        return np.unique(bins, return_counts=True)
    least = bins.min()
    counts = np.bincount(bins - least)
    at = np.flatnonzero(counts)
    return at + least, counts[at]


def _bins_of(values: np.ndarray, wanted: dict | None, left: int, bits: int) -> tuple[np.ndarray, ...]:
    """Bins, their counts and bounds of their values: of those with a wanted prefix, or of all values without bounds.

    ``left``: how many bits of a value the passes before have left open, ``bits``: how many this one splits by.
    """
    shift = left - bits
    if wanted is None:
        bins, counts = _counted(values >> shift)
        return bins, counts, bins, bins
    kept, counts = np.unique(values[(values >> left) == wanted["prefix"]], return_counts=True)
    if wanted["listed"] or not len(kept):
        return kept, counts, kept, kept
    return _merged([(kept >> shift, counts, kept, kept)])


def _merged(parts: list[tuple]) -> tuple[np.ndarray, ...]:
    """The distinct bins of all parts with the sums of their counts and the bounds of their values."""
    bins, counts, low, high = (np.concatenate(column) for column in zip(*parts))
    order = np.argsort(bins, kind="stable")
    bins = bins[order]
    at = np.flatnonzero(np.diff(bins, prepend=-1))
    sums = np.add.reduceat(counts[order], at)
    return bins[at], sums, np.minimum.reduceat(low[order], at), np.maximum.reduceat(high[order], at)


_BINS = "space_id string, method_id string, parent bigint, bin bigint, count bigint, low bigint, high bigint"


def _bins_batch(key: tuple, part: tuple) -> pa.RecordBatch:
    space_id, method, parent = key
    size = len(part[0])
    names = {"space_id": pa.array([space_id] * size, pa.string()), "method_id": pa.array([method] * size, pa.string())}
    numbers = (np.full(size, parent), *part)
    return pa.RecordBatch.from_pydict(
        names | {c: pa.array(x, pa.int64()) for c, x in zip(("parent", "bin", "count", "low", "high"), numbers)}
    )


def _tile_bins(left: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, parts, held = _Left(), {}, 0
        for batch in batches:
            for i in range(batch.num_rows):
                plain, rows, right = reader.read(batch, i)
                space, cache = reader.space, {}
                for job in plain["runs"]:
                    d = space.between(rows, rows if right is None else right, job["method_id"], cache)
                    d = d[np.triu_indices(len(d), 1)] if right is None else d.ravel()
                    values = d[d > 0].view(np.int64)
                    for wanted in job["wanted"] or [None]:
                        part = _bins_of(values, wanted, left, bits)
                        if len(part[0]):
                            key = (plain["space_id"], job["method_id"], wanted["prefix"] if wanted else 0)
                            parts.setdefault(key, []).append(part)
                            held += len(part[0])
                if held > HELD_SUMS:
                    parts = {key: [_merged(found)] for key, found in parts.items()}
                    held = sum(len(found[0][0]) for found in parts.values())
                    if 2 * held > HELD_SUMS:
                        yield from (_bins_batch(key, found[0]) for key, found in parts.items())
                        parts, held = {}, 0
        yield from (_bins_batch(key, _merged(found)) for key, found in parts.items())

    return run


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = batch.column("bin").to_numpy(zero_copy_only=False).astype(np.int64)
        yield batch.set_column(batch.schema.get_field_index("bin"), "bin", pa.array(bits.view(np.float64)))


def positive_median(points: DataFrame, params: DataFrame, methods: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact median of the positive distances over unordered sample pairs, per space and method.

    The order of positive doubles is the order of their bit patterns, so the two middle values are found by
    counting passes over bit prefixes.  Only the prefixes that hold them are split again, until all values of one are
    equal or few enough to be listed: a later pass emits at most ``2 ** LATER_BITS`` bins per task and prefix or
    ``LISTED_VALUES`` values per prefix, however many pairs there are.
    """
    blocks = block_table(points.drop("member"), params, block_rows)
    runs = cut(
        space_blocks(blocks).withColumn("method_id", F.explode(F.array(*[F.lit(m) for m in methods])))
    )
    key = ["space_id", "method_id"]
    small = at_most(runs, BROADCAST_ROWS)
    undecided, left = "low < high", 64
    found = None  # per key and rank slot: prefix so far, the remaining rank inside it, its count and the bounds of its values
    while found is None or found.where(undecided).limit(1).count():
        bits = FIRST_BITS if found is None else min(LATER_BITS, left)
        if found is None:
            jobs = runs.withColumn("wanted", F.lit(None).cast("array<struct<prefix:bigint,listed:boolean>>"))
        else:
            wanted = F.expr(f"collect_set(struct(bin AS prefix, count <= {LISTED_VALUES} AS listed)) AS wanted")
            jobs = found.where(undecided).groupBy(*key).agg(wanted).join(runs, key)
        joined = tiles(blocks, jobs, "method_id, wanted", small)
        group = W.partitionBy(*key, "parent")
        if found is None:  # bounds by the bin alone: its counts are the bulk of what is shuffled
            width = left - bits
            bounds = [F.expr(f"shiftleft(bin, {width}) AS low"), F.expr(f"shiftleft(bin + 1, {width}) - 1 AS high")]
        else:
            bounds = [F.min("low").alias("low"), F.max("high").alias("high")]
        counts = (
            joined.mapInArrow(_tile_bins(left, bits), _BINS)
            .groupBy(*key, "parent", "bin")
            .agg(F.sum("count").alias("count"), *bounds)
            .withColumn("_upto", F.sum("count").over(group.orderBy("bin")))
        )
        if found is None:
            ranks = F.array(F.floor((F.col("_total") - 1) / 2), F.ceil((F.col("_total") - 1) / 2))
            placed = counts.withColumn("_total", F.sum("count").over(group)).select(
                *counts.columns, F.posexplode(ranks).alias("slot", "rank")
            )
        else:
            open_ranks = found.where(undecided).select(*key, "slot", "rank", F.col("bin").alias("parent"))
            placed = counts.join(open_ranks, [*key, "parent"])
        placed = placed.where("rank < _upto AND rank >= _upto - count").selectExpr(
            *key, "slot", "bin", "rank - _upto + count AS rank", "count", "low", "high"
        )
        found = cut(placed if found is None else placed.unionByName(found.where("low = high")))
        left -= bits
    blocks.unpersist()
    values = found.select(*key, "slot", F.col("low").alias("bin")).mapInArrow(
        _decode, "space_id string, method_id string, slot int, bin double"
    )
    return values.groupBy(*key).agg(F.avg("bin").alias("scale"))
