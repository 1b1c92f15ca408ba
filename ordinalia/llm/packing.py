"""Packing by minimum bin slack.

A document's ids are followed by one end id.  Full windows are cut off from the front; what remains (shorter than a
window) is packed.  The remainders enter the plan only as a *count per length*, at most capacity - 1 numbers whatever
the size of the corpus.  For each window, a bitset subset-sum recurrence over the lengths still left (with their
counts) finds the reachable sums; the one with the least slack is taken, and walking back through the bitsets
gives how many remainders of each length it holds.  The filling is repeated as long as the counts allow, so a plan has
at most one entry per length that runs out.

Tasks then place every remainder by its rank among those of its length: ranks come from counts per (partition,
length), never from a global sort.  A length that holds a third of all documents stays spread over the partitions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ordinalia.llm.common import text_of
from ordinalia.llm.tokens import encoder
from ordinalia.runtime import cut

CAPACITY = 1024
END_ID = 0


def measured(docs: DataFrame, path: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, ``doc_tokens`` (with the end id) and ``crcs``, the crc32 of each piece in order."""
    end = int(END_ID).to_bytes(4, "little")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        size = 4 * capacity
        for batch in batches:
            tokens, crcs = [], []
            for found in words.encode_all(value.as_py() for value in batch.column(1)):
                ids = memoryview(found + end)
                tokens.append(len(ids) // 4)
                crcs.append([zlib.crc32(ids[i : i + size]) for i in range(0, len(ids), size)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(tokens, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))],
                names=["key", "doc_tokens", "crcs"],
            )

    kind = docs.select(key).schema[0].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), text_of(text).alias("text")).mapInArrow(
        measure, f"key {kind}, doc_tokens bigint, crcs array<bigint>"
    )


def padding(used: int, capacity: int = CAPACITY) -> int:
    """Padding of a sequence: none at a power of two, else up to the capacity."""
    return 0 if used & (used - 1) == 0 else capacity - used


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Fillings ([(length, how many in one window), ...], number of windows) that use up ``counts`` exactly.

    Every window starts from the longest remainder left (it is the hardest to place); the recurrence fills the rest.
    ``reach`` has bit s set if some multiset of the lengths seen so far adds up to s; a length with m copies enters as
    chunks of 1, 2, 4, ... copies, and the bitset before each chunk is kept for the walk back.
    """
    left = {length: n for length, n in counts.items() if n > 0}
    fillings = []
    while left:
        first = max(left)
        room = capacity - first
        mask = (1 << (room + 1)) - 1
        reach, steps = 1, []
        for length in sorted((x for x in left if x <= room), reverse=True):
            copies = min(left[length] - (length == first), room // length)
            chunk = 1
            while copies > 0:
                take = min(chunk, copies)
                steps.append((length, take, reach))
                reach |= (reach << (take * length)) & mask
                copies -= take
                chunk *= 2
            if reach >> room & 1:
                break
        best = min((s for s in range(room, -1, -1) if reach >> s & 1), key=lambda s: padding(first + s, capacity))
        used = {first: 1}
        for length, take, before in reversed(steps):
            if not before >> best & 1:
                best -= take * length
                used[length] = used.get(length, 0) + take
        times = min(left[length] // n for length, n in used.items())
        fillings.append((sorted(used.items(), reverse=True), times))
        for length, n in used.items():
            left[length] -= n * times
            if not left[length]:
                del left[length]
    return fillings


def places(fillings: list[tuple[list[tuple[int, int]], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, copies in a window, first window, offset), ordered by first rank."""
    rank: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    window = 0
    for used, times in fillings:
        offset = 0
        for length, copies in used:
            rows.setdefault(length, []).append((rank.get(length, 0), copies, window, offset))
            rank[length] = rank.get(length, 0) + copies * times
            offset += copies * length
        window += times
    return {length: np.array(r, dtype=np.int64) for length, r in rows.items()}


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is one piece, its end id.  Repeated rows are packed once each; an empty table gives an
    empty table; equal lengths are ranked by partition and order in it.  Windows of remainders are numbered from 0,
    full windows after them.  Other columns are dropped.
    """
    docs = cut(measured(docs, path, capacity, key, text))
    # partitions of a checkpoint are its files: the same rows in the same order whenever they are read
    rows = docs.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    rows = rows.withColumn("_rest", (F.col("doc_tokens") % capacity).cast("int")).withColumn(
        "_full", F.floor(F.col("doc_tokens") / capacity).cast("bigint")
    )
    tally = cut(rows.groupBy("_part", "_rest").agg(F.count(F.lit(1)).alias("n"), F.sum("_full").alias("full")))
    counts = {r["_rest"]: r["n"] for r in tally.where("_rest > 0").groupBy("_rest").agg(F.sum("n").alias("n")).collect()}
    fillings = plan(counts, capacity)
    at, windows = places(fillings), sum(times for _, times in fillings)

    earlier = W.partitionBy("_rest").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    firsts = tally.withColumn("_rank0", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    # full windows: those of shorter remainder classes come first, then those of earlier partitions
    classes = tally.groupBy("_rest").agg(F.sum("full").alias("all")).collect()
    before, total = {}, windows
    for r in sorted(classes, key=lambda r: r["_rest"]):
        before[r["_rest"]] = total
        total += r["all"]
    base = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])[F.col("_rest")] if before else F.lit(0)
    firsts = firsts.withColumn("_full0", base + F.coalesce(F.sum("full").over(earlier), F.lit(0)))

    group = W.partitionBy("_part", "_rest").orderBy("_at")
    ranked = (
        rows.join(firsts.select("_part", "_rest", "_rank0", "_full0"), ["_part", "_rest"])
        .withColumn("_rank", F.col("_rank0") + F.row_number().over(group) - 1)
        .withColumn(
            "_full0",
            F.col("_full0") + F.coalesce(F.sum("_full").over(group.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        )
        .select("key", "doc_tokens", "crcs", "_rest", "_rank", "_full0")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key_of = batch.column(0)
            tokens, rest, rank, full0 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 3, 4, 5))
            pieces = tokens // capacity + (rest > 0)
            doc = np.repeat(np.arange(len(tokens)), pieces)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            length = np.minimum(capacity, tokens[doc] - nth * capacity)
            sequence, offset = full0[doc] + nth, np.zeros(len(doc), dtype=np.int64)
            last = np.flatnonzero(length < capacity)
            for size in np.unique(length[last]):
                mine = last[length[last] == size]
                table, r = at[int(size)], rank[doc[mine]]
                row = table[np.searchsorted(table[:, 0], r, side="right") - 1]
                copy = r - row[:, 0]
                sequence[mine] = row[:, 2] + copy // row[:, 1]
                offset[mine] = row[:, 3] + copy % row[:, 1] * size
            yield pa.RecordBatch.from_arrays(
                [
                    key_of.take(pa.array(doc)),
                    pa.array(nth * capacity, pa.int64()),
                    pa.array(length, pa.int64()),
                    batch.column(2).flatten().cast(pa.int64()),
                    pa.array(tokens[doc], pa.int64()),
                    pa.array(sequence, pa.int64()),
                    pa.array(offset, pa.int64()),
                ],
                names=["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    kind = docs.schema["key"].dataType.simpleString()
    names = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return ranked.mapInArrow(place, f"key {kind}, {names}").withColumnRenamed("key", key)
