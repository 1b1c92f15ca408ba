"""Self-join of documents on the Jaccard similarity of their word n-grams, by token-combination prefixes.

A document's tokens (its distinct n-grams) are put in one global order: tokens of one document first, then rare ones,
then frequent ones by document frequency.  Of a set of n tokens that must share at least o with a partner, the first n - o + 1 hold a
shared token (prefix filter), the first n - o + s hold s of them (extended prefix).  Hence

* a token of one document needs no index key, for nobody shares it, but takes a place in the prefix;
* a rare token in the prefix is an index key by itself;
* a document whose prefix reaches into the frequent tokens also indexes *pairs* of frequent tokens from its extended
  prefix.  Frequent tokens have one of c colours (a hash); with s = c + 1 shared tokens two have the same colour, so
  pairs of one colour suffice, and there are about as many pairs as tokens.  c and s belong to a size class; a
  document takes part in the classes that its possible partners can be in.

A key row carries the size of its set and the place of its token in the order.  Two sets that share a token share at most
the tokens behind it besides those before it, and of the tokens that they share the first one is a key too; so a key
of few nodes is dropped before any pair exists if no two of them can reach the overlap, by size or by place.

Documents with equal sets are one node (the digest of the set).  Nodes that share a key are verified on their whole
sets.  Only connected components are wanted, so links need not be written out: the few nodes of a sparse key are
compared as pairs; nodes that dense keys connect form a cluster, which is cut into blocks, and each block is compared
with the others in cells of at most STRIP blocks, which return a spanning forest of the links that they find.  A large
group of near copies is thus spread over its cells and never multiplied out into rows.  Which set goes to which cell is
decided on narrow rows (node and size); the sets are shuffled twice, once to their nodes and once to their cells, where
the set or block that meets the others is held and these stream past.  Everything is exact but for 64-bit token hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordinalia.llm.common import batches_of, release, text_of, written
from ordinalia.runtime import at_most, cut

#: A token is frequent from this document frequency on; the list of frequent tokens has at most LISTED entries, so with
#: more than LISTED * FREQUENT tokens the bound on the frequency rises.  Ranges of 2 ** (64 - MAP_BITS) hashes in which
#: some token occurs twice are marked in a map of 2 ** MAP_BITS bits; where it fills up, tokens of one document
#: count as rare.  Both change the order and the work, not the result.
FREQUENT, LISTED, MAP_BITS = 32, 2_000_000, 27
#: Largest list of node digests (16 bytes each) that is sent to the tasks that look for their sets.
SENT = 2_000_000
#: A key with more nodes than this is dense; nodes of a block; blocks that one cell meets; sets and texts in an Arrow batch.
DENSE, BLOCK, STRIP, BATCH, TEXTS = 6, 1536, 8, 128, 500
#: Bytes of the sets of a block, on average.
BLOCK_BYTES = 4 << 20
#: Rows of one key that a task gathers before it hands them on; above DENSE whatever that is.
HELD = 20_000
WORDS_KEPT = 100_000
SINGLE_UNDER = 8  # size classes below this index frequent tokens one by one

_A, _B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)  # published mixing constants
_33 = np.uint64(33)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _33)) * _A
    x = (x ^ (x >> _33)) * _B
    return x ^ (x >> _33)


class _Words(dict):
    """64-bit hash of each word met in this task."""

    def __init__(self) -> None:
        import xxhash

        self.hash = xxhash.xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS_KEPT:
            self.clear()
        value = self[word] = self.hash(word)
        return value


def tokens_of(text: bytes, n: int, words: _Words) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; fewer than n words are one n-gram, no words are none.

    ``text`` is UTF-8: of bytes only A-Z are folded, and only x20 and x09-x0D split.
    """
    found = text.lower().split()
    size = len(found)
    if not size:
        return np.zeros(0, dtype=np.uint64)
    one = np.fromiter(map(words.__getitem__, found), dtype=np.uint64, count=size)
    width = min(n, size)
    factor = int(_A) + 2 * width  # odd; a short sequence differs from the n-grams that begin alike
    made = np.zeros(size - width + 1, dtype=np.uint64)
    for i in range(width):  # a polynomial of hashes that are uniform themselves
        made = (made + one[i : size - width + 1 + i]) * np.uint64(factor)
    made.sort()
    fresh = np.empty(len(made), dtype=bool)
    fresh[0] = True
    np.not_equal(made[1:], made[:-1], out=fresh[1:])
    return made if fresh.all() else made[fresh]


def least_overlap(size, num: int, den: int):
    """Tokens that a set of this size shares with any partner."""
    return -(-num * size // den)


class Order:
    """Token classes: a map of the ranges with repeated tokens; frequent tokens (truncated, sorted) and their counts."""

    def __init__(self, shift: int, repeated: np.ndarray, tokens: np.ndarray, counts: np.ndarray) -> None:
        self.shift, self.repeated, self.tokens, self.counts = shift, repeated, tokens, counts

    def arranged(self, tokens: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        """Number of tokens of one document; rare tokens by hash; frequent ones by (document frequency, hash)."""
        place = (tokens >> np.uint64(64 - MAP_BITS)).astype(np.int64)
        several = tokens[(self.repeated[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0]
        alone = len(tokens) - len(several)
        if not len(self.tokens):
            return alone, several, several[:0]
        short = several >> np.uint64(self.shift)
        at = np.minimum(np.searchsorted(self.tokens, short), len(self.tokens) - 1)
        frequent = self.tokens[at] == short
        often = several[frequent]
        return alone, several[~frequent], often[np.lexsort((often, self.counts[at[frequent]]))]


def keys_of(tokens: np.ndarray, order: Order, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of a set, and the place of each key's token in the order (0 for frequent tokens)."""
    size = len(tokens)
    least = int(least_overlap(size, num, den))
    prefix = size - least + 1
    alone, rare, often = order.arranged(tokens)
    keys = [rare[: max(0, prefix - alone)]]
    before = alone + len(rare)
    if before < prefix:
        smallest = max(1, least)
        for level in range(smallest.bit_length() - 1, size.bit_length()):
            top = (2 << level) - 1
            seed = _mix(np.array([level + 1], dtype=np.uint64))
            colours = top - int(least_overlap(top, num, den)) + 1
            # a pair meets in the level of its smaller set; two shared tokens of one colour need more tokens than colours
            if 1 << level < SINGLE_UNDER or least_overlap(1 << level, num, den) <= colours:
                keys.append(_mix(often[: prefix - before] ^ seed))
                continue
            used = often[: max(0, size - least + colours + 1 - before)]
            colour = (_mix(used) % np.uint64(colours)).astype(np.int64)
            by = np.argsort(colour, kind="stable")
            used, colour = used[by], colour[by]
            gap = 1
            while gap < len(used):  # pairs of one colour are neighbours at some distance
                same = colour[gap:] == colour[:-gap]
                if not same.any():
                    break
                a, b = used[:-gap][same], used[gap:][same]
                keys.append(_mix(_mix(np.minimum(a, b) ^ seed) + np.maximum(a, b)))
                gap += 1
    keys, first = np.unique(np.concatenate(keys), return_index=True)
    own = rare[: max(0, prefix - alone)]
    return keys, np.where(first < len(own), alone + first, 0)


def _rows(docs: DataFrame, text: str, make, schema: str) -> DataFrame:
    """``make`` yields record batches from batches of whole texts."""
    return docs.select(text_of(text).cast("binary").alias("text")).mapInArrow(make, schema)


def nodes(docs: DataFrame, n: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ``n_shingles``, ``node`` (digest of the set, null if it is empty) and ``digest`` (of the text) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        words = _Words()
        for batch in batches:
            sizes, sets, texts = [], [], []
            for value in batch.column(1).to_pylist():
                tokens = tokens_of(value, n, words)
                sizes.append(len(tokens))
                sets.append(xxhash.xxh3_128_digest(tokens) if len(tokens) else None)
                texts.append(xxhash.xxh3_128_digest(value))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary()), pa.array(texts, pa.binary())],
                names=["key", "n_shingles", "node", "digest"],
            )

    kind = docs.select(key).schema[0].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), text_of(text).cast("binary").alias("text")).mapInArrow(
        run, f"key {kind}, n_shingles bigint, node binary, digest binary"
    )


def counted(docs: DataFrame, n: int, total: int, text: str = "text") -> Order:
    """Document frequencies of all tokens of all documents, as an :class:`Order`.

    Tokens are sent as blobs of 3-byte remainders per range of hashes; there are as many ranges as the counted
    tokens need (about a million tokens each), and each is counted by one task.  What comes back has a fixed bound:
    the map and the list.
    """
    bits = min(MAP_BITS - 3, max(6, math.ceil(math.log2(max(total, 1) / 1_000_000 + 1))))
    shift = 64 - bits - 24
    bound = max(FREQUENT, total // LISTED)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            made = [tokens_of(x, n, words) >> np.uint64(shift) for x in batch.column(0).to_pylist()]
            if not made:
                continue
            short = np.sort(np.concatenate(made))
            part, first = np.unique(short >> np.uint64(24), return_index=True)
            low = short.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
            blobs = [low[a:b].tobytes() for a, b in zip(first, [*first[1:], len(short)])]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int64)), pa.array(blobs, pa.binary())], names=["part", "low"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(part: int, blobs: list[bytes]) -> pa.RecordBatch:
            raw = np.frombuffer(b"".join(blobs), dtype=np.uint8).reshape(-1, 3).astype(np.int64)
            value, often = np.unique(raw[:, 0] | raw[:, 1] << 8 | raw[:, 2] << 16, return_counts=True)
            marks = np.zeros(1 << (MAP_BITS - bits), dtype=np.uint8)
            twice = value[often > 1]
            marks[twice >> (24 + bits - MAP_BITS) if 24 + bits >= MAP_BITS else twice << (MAP_BITS - 24 - bits)] = 1
            kept = often >= bound
            listed = ((part << 24) | value[kept]).astype("<i8").tobytes()
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int64()),
                    pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary()),
                    pa.array([listed], pa.binary()),
                    pa.array([often[kept].astype("<i8").tobytes()], pa.binary()),
                ],
                names=["part", "marks", "listed", "often"],
            )

        part, blobs = None, []
        for batch in batches:
            for p, low in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if p != part and blobs:
                    yield done(part, blobs)
                    blobs = []
                part = p
                blobs.append(low)
        if blobs:
            yield done(part, blobs)

    blobs = _rows(docs, text, split, "part bigint, low binary").repartition("part").sortWithinPartitions("part")
    rows = blobs.mapInArrow(count, "part bigint, marks binary, listed binary, often binary").collect()
    repeated = np.zeros(1 << (MAP_BITS - 3), dtype=np.uint8)
    size = 1 << (MAP_BITS - 3 - bits)
    rows.sort(key=lambda r: r["part"])
    for r in rows:
        repeated[r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(r["marks"], dtype=np.uint8)
    join = lambda name, kind: np.frombuffer(b"".join(bytes(r[name]) for r in rows), dtype="<i8").astype(kind)
    return Order(shift, repeated, join("listed", np.uint64), join("often", np.int64))


def _linkable(rows: pa.RecordBatch, going: int | None, dense: int | None, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Rows of keys (all their rows are here, but for keys ``going`` and ``dense``) with a node that they may link to."""
    if not rows.num_rows:
        return
    k = rows.column(0).to_numpy()
    node = np.frombuffer(b"".join(rows.column(1).to_pylist()), dtype="<u8").reshape(-1, 2)
    fresh = np.ones(len(k), dtype=bool)
    fresh[1:] = (k[1:] != k[:-1]) | (node[1:] != node[:-1]).any(axis=1)
    at = np.flatnonzero(fresh)  # a node's rows from several tasks are one
    k, size, place = k[at], *(rows.column(i).to_numpy()[at].astype(np.int64) for i in (2, 3))
    starts = np.flatnonzero(np.diff(k, prepend=k[0] - 1 if k[0] > np.iinfo(np.int64).min else 0))
    many = np.repeat(counts := np.diff([*starts, len(k)]), counts)
    keep = many > DENSE
    if going is not None:
        keep |= k == going
    if dense is not None:
        keep |= k == dense
    for gap in range(1, DENSE):
        a = np.flatnonzero((k[gap:] == k[:-gap]) & (many[gap:] <= DENSE))
        b = a + gap
        least = np.minimum(size[a] - place[a], size[b] - place[b])
        near = (den * np.minimum(size[a], size[b]) >= num * np.maximum(size[a], size[b])) & ((num + den) * least >= num * (size[a] + size[b]))
        keep[a[near]] = keep[b[near]] = True
    if keep.any():
        yield rows.take(pa.array(at[keep]))


def shared_keys(docs: DataFrame, n: int, order: Order, num: int, den: int, text: str = "text") -> DataFrame:
    """``k``, ``node``, ``size``, ``place`` for every index key that two nodes have which may link by size and place."""
    sent = docs.sparkSession.sparkContext.broadcast(order.__dict__)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        words, own, seen = _Words(), Order(**sent.value), set()
        for batch in batches:
            made, places, digests, sizes = [], [], [], []
            for value in batch.column(0).to_pylist():
                tokens = tokens_of(value, n, words)
                keys, place = keys_of(tokens, own, num, den) if len(tokens) else (tokens, tokens)
                if not len(keys):
                    continue
                node = xxhash.xxh3_128_digest(tokens)
                if node not in seen:  # copies within a task are indexed once
                    seen.add(node)
                    made.append(keys)
                    places.append(place)
                    digests.append(node)
                    sizes.append(len(tokens))
            if made:
                doc = np.repeat(np.arange(len(made)), [len(k) for k in made])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(made).view(np.int64)),
                        pa.array(digests, pa.binary()).take(pa.array(doc)),
                        pa.array(np.array(sizes, dtype=np.int32)[doc]),
                        pa.array(np.concatenate(places).astype(np.int32)),
                    ],
                    names=["k", "node", "size", "place"],
                )

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of keys with two nodes that may link; rows come sorted by (k, node), a key may go over batches."""
        held, going = None, None  # rows of the last key; a key of which rows were given out already
        for batch in batches:
            if held is not None:
                batch = pa.concat_batches([held, batch])
            k = batch.column(0).to_numpy()
            at = int(np.searchsorted(k, k[-1])) if len(k) else 0
            if len(k) - at > HELD:  # a dense key is kept whatever follows
                yield from _linkable(batch, going, int(k[-1]), num, den)
                held, going = None, int(k[-1])
            else:
                yield from _linkable(batch.slice(0, at), going, None, num, den)
                held = batch.slice(at)
        if held is not None:
            yield from _linkable(held, going, None, num, den)

    schema = "k bigint, node binary, size int, place int"
    keyed = _rows(docs, text, index, schema).repartition("k").sortWithinPartitions("k", "node")
    return keyed.mapInArrow(several, schema)


def sets_of(docs: DataFrame, n: int, wanted: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``node`` and ``tokens`` (little-endian 64-bit hashes), one row for each wanted ``digest`` of a text.

    ``wanted``: the digest, the node of its text and ``source``, the hash of a key that has it; a node is wanted once.
    """
    spark = docs.sparkSession
    few = at_most(wanted, SENT)
    sent = spark.sparkContext.broadcast({bytes(r["digest"]): r["source"] for r in wanted.toLocalIterator()}) if few else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        words, seen, asked = _Words(), set(), sent.value if sent else None
        for batch in batches:
            texts, nodes_, sets = [], [], []
            for source, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                digest = xxhash.xxh3_128_digest(value)
                if digest in seen or (asked is not None and asked.get(digest) != source):
                    continue
                seen.add(digest)
                tokens = tokens_of(value, n, words)
                if len(tokens):
                    texts.append(digest)
                    nodes_.append(xxhash.xxh3_128_digest(tokens))
                    sets.append(tokens.astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in (texts, nodes_, sets)], names=["digest", "node", "tokens"])

    whole = docs.select(F.xxhash64(key).alias("source"), text_of(text).cast("binary").alias("text"))
    found = whole.mapInArrow(run, "digest binary, node binary, tokens binary")
    if not few:
        found = found.join(wanted.select("digest"), "digest", "left_semi")
    return found.dropDuplicates(["node"]).select("node", "tokens")


def merged(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``labels`` (node, comp) after merging the components that ``edges`` (a, b: components) connect.

    Least labels spread over the edges, then every label is replaced by its own label, until nothing changes.  Tables
    of an iteration are written files: a checkpoint keeps the estimated size of its plan, which the joins of each
    round would multiply.
    """
    both = written(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    if both.isEmpty():
        return labels
    own = both.select(F.col("a").alias("id")).distinct().withColumn("to", F.col("id"))
    own = written(own)
    while True:
        near = (
            both.join(own.select(F.col("id").alias("b"), F.col("to")), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("to").alias("near"))
        )
        step = own.join(near, "id").select("id", F.least("to", "near").alias("next"), F.col("to").alias("was"))
        jump = step.select(F.col("id").alias("next"), F.col("next").alias("jump"))
        new = written(step.join(jump, "next").select("id", F.least("next", "jump").alias("to"), "was"))
        if new.where("to != was").isEmpty():
            break
        own = new.select("id", "to")
    return written(
        labels.join(new.select(F.col("id").alias("comp"), "to"), "comp", "left").select(
            "node", F.coalesce("to", "comp").alias("comp")
        )
    )


def compared(first: list[tuple[bytes, np.ndarray]], second: list[tuple[bytes, np.ndarray]], num: int, den: int) -> list[tuple[bytes, bytes]]:
    """Links between two blocks of (node, sorted tokens), as a spanning forest.

    The tokens of the second block form an inverted index; one count per set of the first gives its overlaps with all.
    """
    names = [name for name, _ in first] + [name for name, _ in second]
    place = {name: i for i, name in enumerate(dict.fromkeys(names))}
    above = list(range(len(place)))

    def root(i: int) -> int:
        while above[i] != i:
            above[i] = above[above[i]]
            i = above[i]
        return i

    sizes = np.array([len(t) for _, t in second], dtype=np.int64)
    tokens = np.concatenate([t for _, t in second])
    owner = np.repeat(np.arange(len(second)), sizes)
    by = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[by], owner[by]
    out = []
    for name, own in first:
        low, high = np.searchsorted(tokens, own), np.searchsorted(tokens, own, side="right")
        runs = high - low
        at = np.repeat(low - (np.cumsum(runs) - runs), runs) + np.arange(runs.sum())
        both = np.bincount(owner[at], minlength=len(second))
        for j in np.flatnonzero(den * both >= num * (len(own) + sizes - both)):
            a, b = root(place[name]), root(place[second[j][0]])
            if a != b:
                above[max(a, b)] = min(a, b)
                out.append((name, second[j][0]))
    return out


#: What a set is in a cell: of the block that is compared with itself and the others, with the others only, of the others.
_OWN, _ANCHOR, _OTHER = 0, 1, 2
_CELLS = "array<struct<level bigint, block bigint, strip bigint, role int>>"


def pair_cells(pairs: DataFrame) -> DataFrame:
    """``cell``, ``role``, ``node``: a node ``a`` of the pairs (a, b) meets all its ``b`` in a cell of its own."""
    own = pairs.select(F.col("a").alias("cell"), F.lit(_ANCHOR).alias("role"), F.col("a").alias("node")).distinct()
    return own.unionAll(pairs.select(F.col("a").alias("cell"), F.lit(_OTHER).alias("role"), F.col("b").alias("node")))


def cluster_cells(clusters: DataFrame, num: int, den: int) -> DataFrame:
    """``cell``, ``role``, ``node`` for ``clusters`` (node, size, cluster), such that all that may link meet in a cell.

    Sizes of linked sets differ by den / num at most, so a block holds sets of one level of sizes, and levels are as
    wide as that: a block meets itself, the later blocks of its level and all blocks of the next level.  These are
    dealt to cells of STRIP blocks, each with a copy of the block that they meet.
    """
    level = F.floor(F.ln("size") / (math.log(den / num) * 1.000001)) if num < den else F.col("size").cast("bigint")
    placed = clusters.withColumn("level", level)
    rows, held = F.count(F.lit(1)) / BLOCK, F.sum(F.col("size").cast("bigint") * 8) / BLOCK_BYTES
    levels = placed.groupBy("cluster", "level").agg(
        F.count(F.lit(1)).alias("members"), F.ceil(F.greatest(rows, held)).cast("bigint").alias("blocks")
    )
    levels = written(levels)
    beside = lambda step, name: levels.select("cluster", (F.col("level") + step).alias("level"), F.col("blocks").alias(name))
    around = levels.join(beside(1, "before"), ["cluster", "level"], "left").join(beside(-1, "after"), ["cluster", "level"], "left")
    around = around.fillna(0, ["before", "after"])
    met = f"""concat(
        if(members > 1 OR after > 0, transform(
            sequence(0L, greatest(1L, ceil((blocks - block - 1 + after) / {STRIP})) - 1),
            s -> struct(level, block, s AS strip, if(s = 0, {_OWN}, {_ANCHOR}) AS role)), CAST(array() AS {_CELLS})),
        if(block > 0, transform(sequence(0L, block - 1),
            i -> struct(level, i AS block, (block - i - 1) div {STRIP} AS strip, {_OTHER} AS role)), CAST(array() AS {_CELLS})),
        if(before > 0, transform(sequence(0L, before - 1),
            i -> struct(level - 1 AS level, i AS block, (before - i - 1 + block) div {STRIP} AS strip, {_OTHER} AS role)), CAST(array() AS {_CELLS})))"""
    return (
        placed.join(around, ["cluster", "level"])
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
        .select("node", "cluster", F.explode(F.expr(met)).alias("at"))
        .select(
            F.concat("cluster", F.concat_ws(":", "at.level", "at.block", "at.strip").cast("binary")).alias("cell"),
            F.col("at.role").alias("role"),
            "node",
        )
    )


def links_of(cells: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) between sets that meet in a cell, as spanning forests; a cell holds one block, the others stream past."""
    bytes_held, many = BLOCK_BYTES, 20_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, own, others, held, alone, links = None, [], [], 0, True, []

        def meet() -> None:
            if own and not alone:
                links.extend(compared(own, own, num, den))
            if own and others:
                links.extend(compared(own, others, num, den))

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[c] for x in links], pa.binary()) for c in (0, 1)], names=["a", "b"])

        for batch in batches:
            ids, roles, names = (batch.column(i).to_pylist() for i in range(3))
            for at, role, name, tokens in zip(ids, roles, names, batch.column(3)):
                if at != cell:
                    meet()
                    cell, own, others, held, alone = at, [], [], 0, True
                found = (name, np.frombuffer(tokens.as_buffer(), dtype="<u8"))
                if role != _OTHER:
                    own.append(found)
                    alone = alone and role != _OWN
                    continue
                others.append(found)
                held += found[1].nbytes
                if held > bytes_held:
                    meet()
                    others, held, alone = [], 0, True
            if len(links) > many:
                yield out()
                links.clear()
        meet()
        yield out()

    dealt = cells.join(sets, "node").select("cell", "role", "node", "tokens")
    dealt = dealt.repartition("cell").sortWithinPartitions("cell", "role")
    with batches_of(cells.sparkSession, BATCH):
        return written(dealt.mapInArrow(run, "a binary, b binary"))


def components(
    docs: DataFrame, known: DataFrame, n: int, num: int, den: int, total: int, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``node``, ``comp`` (a node) for the nodes that share an index key with another one.

    ``known``: node, and ``one``: the digest of one text that has this set, with the hash of a key that has that text.
    """
    order = counted(docs, n, total, text)
    shared = written(shared_keys(docs, n, order, num, den, text))
    sizes = shared.groupBy("node").agg(F.first("size").alias("size"))
    labels = written(sizes.withColumn("comp", F.col("node")))
    if labels.isEmpty():
        return labels.select("node", "comp")
    keys = written(shared.groupBy("k").agg(F.countDistinct("node").alias("m"), F.min("node").alias("first")))

    few = shared.join(keys.where(F.col("m") <= DENSE).select("k"), "k").select(
        "k", F.col("node").alias("a"), F.col("size").alias("s"), (F.col("size") - F.col("place")).alias("left_a")
    )
    other = few.select("k", F.col("a").alias("b"), F.col("s").alias("t"), F.col("left_a").alias("left_b"))
    pairs = few.join(other, "k").where(
        (F.col("a") < F.col("b"))
        & (den * F.least("s", "t") >= num * F.greatest("s", "t"))
        & ((num + den) * F.least("left_a", "left_b") >= num * (F.col("s") + F.col("t")))
    )
    pairs = pairs.select("a", "b").distinct()

    many = shared.join(keys.where(F.col("m") > DENSE).select("k", "first"), "k")
    spokes = written(many.where("node != first").select(F.col("node").alias("a"), F.col("first").alias("b")).distinct())
    if spokes.isEmpty():
        cells = pair_cells(written(pairs))
    else:
        ends = spokes.select("a").unionAll(spokes.select("b")).distinct()
        clusters = merged(spokes, ends.select(F.col("a").alias("node"), F.col("a").alias("comp")))
        of = lambda side: clusters.select(F.col("node").alias(side), F.col("comp").alias(f"of_{side}"))
        apart = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where("NOT coalesce(of_a = of_b, false)")
        placed = clusters.join(labels.select("node", "size"), "node").withColumnRenamed("comp", "cluster")
        cells = pair_cells(written(apart.select("a", "b"))).unionAll(cluster_cells(placed, num, den))
    cells = written(cells)
    wanted = known.join(cells.select("node").distinct(), "node", "left_semi").select("node", "one.*")
    links = links_of(cells, sets_of(docs, n, written(wanted), key, text), num, den)
    release(shared, keys, cells)
    return merged(links, labels.select("node", "comp"))


def linked(
    docs: DataFrame, n: int = 5, threshold: tuple[int, int] = (8, 10), key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """key, ``n_shingles`` and ``component_id`` (least key reachable over links, its own included) of every row.

    Two rows link when den * |intersection| >= num * |union| of their sets.  A null text is empty; a row without words
    is alone.  Rows with the same set are linked whatever their keys, repeated rows stay repeated; a null key never
    is a component's least key unless all its keys are null.  Other columns are dropped.
    """
    num, den = threshold
    if not 0 < num <= den:
        raise ValueError("the threshold must be above 0 and at most 1")
    with batches_of(docs.sparkSession, TEXTS):
        return _linked(docs, n, num, den, key, text)


def _linked(docs: DataFrame, n: int, num: int, den: int, key: str, text: str) -> DataFrame:
    rows = cut(nodes(docs, n, key, text))
    total = rows.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    known = rows.where("node IS NOT NULL").groupBy("node").agg(
        F.min("key").alias("least"), F.min(F.struct("digest", F.xxhash64("key").alias("source"))).alias("one")
    )
    known = cut(known)
    labels = components(docs, known, n, num, den, total, key, text)
    tagged = cut(known.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    least = tagged.groupBy("comp").agg(F.min("least").alias("component_id"))
    of_node = tagged.join(least, "comp").select("node", "component_id")
    return (
        rows.join(of_node, "node", "left")
        .select(F.col("key").alias(key), "n_shingles", F.when(F.col("node").isNull(), F.col("key")).otherwise(F.col("component_id")).alias("component_id"))
    )
