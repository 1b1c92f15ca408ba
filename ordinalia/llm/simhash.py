"""Near duplicates by SimHash fingerprints, found through deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments of 32, fewer than the two differing bits would need for an equal
one: of two segments one differs by at most one bit.  Each segment is indexed with each of its bits wildcarded in turn,
and once as it is, so two fingerprints within two bits meet under a key: the one whose wildcard hides the differing bit,
or that of the equal segment.  Keys are joined on equality and the pairs verified on all 64 bits.

Equal fingerprints are one node.  A key of two nodes is one pair, verified as it is counted.  The nodes of a larger key
are verified in one task, which returns a star for each set of nodes that links connect.  A key with more than GROUP
nodes is cut again in the same way: the other segment falls into two pieces of 16 bits, of which one has at most one of
the remaining differing bits (none, if the first segment used one up).  The nodes of such a key agree in all but 17 bits
at most, which bounds them, and neighbours are looked up by the differing bits.  So the work follows the nodes, not the
square of a group, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordinalia.llm.common import batches_of, text_of, written
from ordinalia.llm.ngram_join import merged
from ordinalia.runtime import checked_broadcast, cut

#: Seed of the shingle hashes; most differing bits of linked fingerprints.
SEED, DIFFERENT = 42, 2
#: A key with more nodes is cut again; texts and keys in an Arrow batch; shingles whose bits are counted at once.
GROUP, TEXTS, KEYS, AT_ONCE = 4096, 2000, 512, 65_536
_SEGMENT, _PIECE = 32, 16


def bits_of(text: bytes, n: int = 3) -> bytes:
    """The fingerprint (8 bytes, highest bit first) of UTF-8 text: bits that are set in over half of the shingle hashes.

    Shingles count as often as they occur; fewer than n words are one shingle, no words give no bit.
    """
    from xxhash import xxh64_digest

    words = text.lower().split()  # of bytes only A-Z are folded, only x20 and x09-x0D split
    if not words:
        return bytes(8)
    width = min(n, len(words))
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), AT_ONCE):
        cuts = zip(starts[at : at + AT_ONCE], ends[at : at + AT_ONCE])
        hashes = b"".join([xxh64_digest(joined[a:b], SEED) for a, b in cuts])
        counts += np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(starts)).tobytes()


def fingerprints(docs: DataFrame, n: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``bits`` (the fingerprint as a signed 64-bit integer) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = b"".join([bits_of(x, n) for x in batch.column(1).to_pylist()])
            bits = np.frombuffer(made, dtype=">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits)], names=["key", "bits"])

    rows = docs.select(F.col(key).alias("key"), text_of(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, bits bigint")


def _half(which: Column) -> Column:
    """Segment 0 (high bits) or 1 of ``bits``."""
    return F.when(which == 0, F.shiftrightunsigned("bits", _SEGMENT)).otherwise(F.col("bits").bitwiseAND((1 << _SEGMENT) - 1))


def _without(value: Column, bit: Column) -> Column:
    """``value`` with one bit (from 0) cleared."""
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.cast("int"))
    return value.bitwiseAND(F.bitwise_not(one))


def variants(nodes: DataFrame) -> DataFrame:
    """``bits``, ``k``, ``wild`` (the wildcarded bit, or the width: none) and ``side`` (the bit's value) of every key of a node."""
    number = _SEGMENT + 1
    rows = nodes.select("bits", F.explode(F.sequence(F.lit(0), F.lit(2 * number - 1))).alias("j"))
    rows = rows.select("bits", "j", (F.col("j") % number).alias("wild"), _half(F.floor(F.col("j") / number)).alias("half"))
    bit = F.col("wild")
    masked = F.when(bit == _SEGMENT, F.col("half")).otherwise(_without(F.col("half"), bit))
    side = F.when(bit == _SEGMENT, F.lit(0)).otherwise(F.getbit("half", F.least(bit, F.lit(_SEGMENT - 1))).cast("int"))
    return rows.select("bits", (F.col("j").cast("bigint") * (1 << _SEGMENT) + masked).alias("k"), "wild", side.alias("side"))


def cut_again(members: DataFrame) -> DataFrame:
    """Rows (bits, k, wild) with ``sub``, the keys by pieces of the segment that ``k`` leaves open."""
    number = _PIECE + 1
    segment = F.floor(F.shiftright("k", _SEGMENT) / (_SEGMENT + 1))
    every = F.sequence(F.lit(0), F.lit(2 * number - 1))
    equal = F.array(F.lit(_PIECE), F.lit(number + _PIECE))  # with a bit used up, one piece is equal
    rows = members.withColumn("other", _half(1 - segment))
    rows = rows.withColumn("j", F.explode(F.when(F.col("wild") == _SEGMENT, every).otherwise(equal)))
    piece = F.when(F.col("j") < number, F.shiftright("other", _PIECE)).otherwise(F.col("other").bitwiseAND((1 << _PIECE) - 1))
    bit = F.col("j") % number
    masked = F.when(bit == _PIECE, piece).otherwise(_without(piece, bit))
    return rows.select("bits", "k", (F.col("j").cast("bigint") * (1 << _PIECE) + masked).alias("sub"))


def stars(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among distinct fingerprints, as stars: each connected value but the least with the least of its set."""
    values = np.sort(values)
    size = len(values)
    least = np.arange(size)
    free = int(np.bitwise_or.reduce(values ^ values[0])) if size else 0
    single = [1 << b for b in range(64) if free >> b & 1]
    masks = single + [a | b for a, b in combinations(single, 2)]

    def join(a: np.ndarray, b: np.ndarray) -> None:
        while True:
            low = np.minimum(least[a], least[b])
            if np.array_equal(low, least[a]) and np.array_equal(low, least[b]):
                return
            for x in (least[a], least[b], a, b):
                np.minimum.at(least, x, low)
            least[:] = least[least]

    if size <= 2 * len(masks):
        a, b = np.nonzero(np.triu(np.bitwise_count(values[:, None] ^ values[None, :]) <= DIFFERENT, 1))
        join(a, b)
    else:
        for mask in masks:
            wanted = values ^ np.uint64(mask)
            at = np.minimum(np.searchsorted(values, wanted), size - 1)
            a = np.flatnonzero((values[at] == wanted) & (at > np.arange(size)))
            join(a, at[a])
    while not np.array_equal(least, least[least]):
        least = least[least]
    moved = np.flatnonzero(least != np.arange(size))
    return values[moved], values[least[moved]]


def _verified(groups: DataFrame) -> DataFrame:
    """Links (a, b) within rows of ``members``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [stars(x.values.to_numpy().view(np.uint64)) for x in batch.column(0)]
            both = [np.concatenate([f[i] for f in found]).view(np.int64) if found else np.zeros(0, np.int64) for i in (0, 1)]
            links = np.unique(np.column_stack(both), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(links[:, i])) for i in (0, 1)], names=["a", "b"])

    return groups.select("members").mapInArrow(run, "a bigint, b bigint")


def links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) that connect the same nodes as all links between the distinct ``bits`` of ``nodes`` do."""
    index = variants(nodes)
    keys = written(
        index.groupBy("k", "wild")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("side").alias("ones"), F.min("bits").alias("a"), F.max("bits").alias("b"))
        .where((F.col("n") > 1) & ((F.col("wild") == _SEGMENT) | ((F.col("ones") > 0) & (F.col("ones") < F.col("n")))))
    )
    pairs = keys.where((F.col("n") == 2) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DIFFERENT)).select("a", "b")
    several = index.select("bits", "k", "wild").join(
        checked_broadcast(keys.where((F.col("n") > 2) & (F.col("n") <= GROUP)).select("k")), "k"
    )
    dense = index.select("bits", "k", "wild").join(checked_broadcast(keys.where(F.col("n") > GROUP).select("k")), "k")
    with batches_of(nodes.sparkSession, KEYS):
        near = _verified(several.groupBy("k").agg(F.collect_list("bits").alias("members")))
        more = _verified(cut_again(dense).groupBy("k", "sub").agg(F.collect_list("bits").alias("members")).where(F.size("members") > 1))
        return written(pairs.unionAll(near).unionAll(more).distinct())


def grouped(docs: DataFrame, n: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ``fingerprint`` (16 hex digits) and ``component_id`` (least key reachable over links) of every row.

    Fingerprints of words in n-word shingles link at DIFFERENT or fewer differing bits.  Null, empty and wordless texts
    have the fingerprint zero, which links like any other; very long texts are counted in parts.  Repeated rows stay
    repeated, equal fingerprints are linked; a null key is a component's least key only if all its keys are null.  An
    empty table gives an empty table.  Other columns are dropped, whatever their names.
    """
    with batches_of(docs.sparkSession, TEXTS):
        rows = cut(fingerprints(docs, n, key, text))
    nodes = cut(rows.groupBy("bits").agg(F.min("key").alias("least")))
    labels = merged(links(nodes.select("bits")), nodes.select(F.col("bits").alias("node"), F.col("bits").alias("comp")))
    tagged = nodes.join(labels, nodes["bits"] == labels["node"]).select("bits", "least", "comp")
    least = tagged.groupBy("comp").agg(F.min("least").alias("component_id"))
    of_node = tagged.join(least, "comp").select("bits", "component_id")
    return rows.join(of_node, "bits").select(
        F.col("key").alias(key), F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id"
    )
