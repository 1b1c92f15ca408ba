"""Language-model scoring by cross-entropy difference.

Two n-gram models of the same kind, one of a target corpus and one of the background, share one vocabulary: the words
with LEAST or more occurrences in both corpora together; every other word is one unknown word.  A model interpolates
the probability of a word after its predecessor with the word's own probability.  A document's score is the mean, over
its tokens, of background loss minus target loss: the higher, the more it reads like the target.

Counts of words and of (predecessor, word) pairs are exact, and no table is held in one place.  The documents are cut
into chunks of about CHUNK tokens, tokenised once.  A chunk hands out each of its distinct words and pairs once, with
its own counts; they are summed by word and by pair, and the chunk gets the sums back.  So what a task holds follows
the chunk, and a key has at most one row per chunk, however frequent it is.  What comes back is the count in the other
chunks, which is zero for most pairs.  Words of the vocabulary are numbered, and a pair is the number of its two words,
mixed one to one within its bits: different pairs never meet.

A document of the corpus is scored by models without it: its own words and pairs are taken off both counts (off the
target's if it is a target document), or its score would repeat its label.
"""

from __future__ import annotations

import gc
import io
import math
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordinalia.llm.common import batches_of, release, text_of, written

#: Least count of a word of the shared vocabulary.
LEAST = 3
#: Tokens of a chunk; pairs of a range that one task sums; texts and chunks in an Arrow batch.
CHUNK, RANGE, TEXTS, CHUNKS = 1_000_000, 500_000, 1000, 1
#: Added to every word count; share of the pair model.
ALPHA, PAIR_SHARE = 0.5, 0.4
#: Ids of chunks that are not of the corpus start here; bits of a word's number at most.
_OTHER, _BITS = 1 << 61, 32
_NAMES = ["n_tokens", "background_loss", "target_loss", "score"]
_A, _B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def words_of(text: str | None) -> list[str]:
    """Words in lower case, without the punctuation around them."""
    return [w.strip(".,;:!?\"'()[]") for w in (text or "").lower().split()]


def _packed(values: np.ndarray) -> bytes:
    """Integers as planes of bytes, compressed: the planes of high bytes are nearly empty."""
    return zlib.compress(np.ascontiguousarray(values.astype("<i8")).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpacked(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(blob), dtype=np.uint8).reshape(8, -1).T).view("<i8").reshape(-1)


def _release(spark: SparkSession, *tables: DataFrame) -> None:
    """Gives back the disk of written ``tables`` that are read no more, and of the shuffles behind finished steps.

    Shuffle files go with the driver's garbage, which is rarely collected by itself.
    """
    release(*tables)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class _Numbers(dict):
    """Numbers of the words of a chunk, in order of appearance."""

    def __missing__(self, word: str) -> int:
        value = self[word] = len(self)
        return value


def _rest(docs: DataFrame, text: str) -> DataFrame:
    return docs.drop(text, *[c for c in _NAMES if c in docs.columns])


def chunked(docs: DataFrame, text: str, target: str | None = None, rows: bool = True, first: int = 0) -> DataFrame:
    """Chunks of documents: their other columns (if ``rows``), token numbers, lengths, targets, and words with counts."""
    rest = _rest(docs, text) if rows else docs.select()
    mine = F.coalesce(F.col(target), F.lit(False)) if target else F.lit(False)
    width = len(rest.columns)
    source = docs.select(*[docs[c] for c in rest.columns], text_of(text).alias("_text"), mine.alias("_target"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = first + (TaskContext.get().partitionId() << 32)
        numbers, tokens, targets, parts, held = _Numbers(), [], [], [], 0

        def out() -> pa.RecordBatch:
            ids = np.concatenate(tokens) if tokens else np.zeros(0, dtype=np.int32)
            lengths = np.array([len(x) for x in tokens], dtype=np.int64)
            flags = np.array(targets, dtype=bool)
            n = np.bincount(ids, minlength=len(numbers))
            often = np.argsort(-n, kind="stable")  # small numbers for frequent words take less room
            ids, n = np.argsort(often)[ids], n[often]
            n_target = np.bincount(ids[np.repeat(flags, lengths)], minlength=len(numbers))
            sink = io.BytesIO()
            with pa.ipc.new_stream(sink, parts[0].schema) as stream:
                for part in parts:
                    stream.write_batch(part)
            words = pa.StructArray.from_arrays(
                [pa.array(list(numbers), pa.string()).take(pa.array(often)), pa.array(n, pa.int64()), pa.array(n_target, pa.int64())],
                names=["word", "n", "n_target"],
            )
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()),
                    pa.array([zlib.compress(sink.getvalue(), 1)], pa.binary()),
                    pa.array([_packed(ids)], pa.binary()),
                    pa.array([_packed(lengths)], pa.binary()),
                    pa.array([_packed(flags)], pa.binary()),
                    pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words),
                ],
                names=["chunk", "rows", "tokens", "lengths", "targets", "words"],
            )

        for batch in batches:
            begin = 0
            others = batch.select(list(range(width)))
            for i, (value, flag) in enumerate(zip(batch.column(width), batch.column(width + 1).to_pylist())):
                words = words_of(value.as_py())
                tokens.append(np.fromiter(map(numbers.__getitem__, words), dtype=np.int32, count=len(words)))
                targets.append(flag)
                held += len(words)
                if held >= CHUNK:
                    parts.append(others.slice(begin, i + 1 - begin))
                    yield out()
                    number, begin, held = number + 1, i + 1, 0
                    numbers, tokens, targets, parts = _Numbers(), [], [], []
            if begin < batch.num_rows:
                parts.append(others.slice(begin))
        if tokens:
            yield out()

    kind = "array<struct<word: string, n: bigint, n_target: bigint>>"
    with batches_of(docs.sparkSession, TEXTS):
        return written(
            source.mapInArrow(run, f"chunk bigint, rows binary, tokens binary, lengths binary, targets binary, words {kind}")
        )


class Models:
    """Counts of background and target: the corpus in chunks, the vocabulary, the tokens of all and of target rows.

    ``vocabulary``: word, id, n, n_target; ids are 0, 1, ... from the most frequent word on.
    """

    def __init__(self, chunks: DataFrame, vocabulary: DataFrame, size: int, total: np.ndarray, unknown: np.ndarray) -> None:
        self.chunks, self.vocabulary, self.size, self.total, self.unknown = chunks, vocabulary, size, total, unknown

    @cached_property
    def known(self) -> dict[str, int]:
        """Ids by word, on the driver: to look into small models."""
        return {r["word"]: r["id"] for r in self.vocabulary.collect()}

    @cached_property
    def words(self) -> np.ndarray:
        """Word counts of both models by id, the last is the unknown word, on the driver: to look into small models."""
        rows = sorted((r["id"], r["n"], r["n_target"]) for r in self.vocabulary.collect())
        return np.column_stack([np.array([r[1:] for r in rows], dtype=np.int64).reshape(-1, 2).T, self.unknown])

    @cached_property
    def pairs(self) -> np.ndarray:
        """Pair counts of both models, on the driver: to look into small models."""
        with batches_of(self.chunks.sparkSession, CHUNKS):
            blobs = _pair_counts(self.chunks.withColumn("asks", F.lit(False)), self, 1).collect()
        made = [[_unpacked(r[c]) for r in blobs] for c in ("keys", "n", "n_target")]
        made[0] = [np.cumsum(x.view(np.uint64), dtype=np.uint64) for x in made[0]]
        return _sums(*[np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in made])[1]


def fit(corpus: DataFrame, text: str = "text", target: str = "target", size: int | None = None) -> Models:
    """Counts both models over all rows of ``corpus``; rows with a true ``target`` are the target corpus.

    Every word with LEAST or more occurrences is in the vocabulary.  With a ``size``, only those that are more frequent
    than the one in place ``size + 1``.
    """
    return _fitted(chunked(corpus, text, target, rows=False), size)


def _fitted(chunks: DataFrame, size: int | None) -> Models:
    one = chunks.select(F.explode("words").alias("w")).select("w.*")
    words = written(one.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target")))
    sums = [F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "n_target")]
    total = np.array(words.agg(*sums).first(), dtype=np.int64)
    listed = words.where((F.col("n") >= LEAST) & (F.col("word") != "")).orderBy(F.desc("n"), "word")
    # places within ordered partitions, then the words before each partition (one row a partition)
    placed = written(listed.withColumn("place", F.monotonically_increasing_id()))
    _release(chunks.sparkSession, words)
    counts = placed.groupBy(F.shiftright("place", 33).alias("part")).count().orderBy("part").collect()
    before, starts = 0, []
    for r in counts:
        starts.append((r["part"], before))
        before += r["count"]
    if before.bit_length() > _BITS:
        raise ValueError(f"{before} words do not fit into 32 bits")
    offsets = chunks.sparkSession.createDataFrame(starts, "part bigint, before bigint")
    numbered = placed.join(F.broadcast(offsets), F.shiftright("place", 33) == F.col("part")).select(
        "word", (F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1)).alias("id"), "n", "n_target"
    )
    beyond = None if size is None else numbered.where(F.col("id") == size).first()
    if beyond is not None:
        numbered = numbered.where(F.col("n") > beyond["n"])
    held = numbered.agg(F.count(F.lit(1)), *sums).first()
    return Models(chunks, numbered, held[0], total, total - np.array(held[1:], dtype=np.int64))


def _mix(x: np.ndarray, bits: int) -> np.ndarray:
    """One to one on numbers of this many bits (at least two)."""
    half, mask = np.uint64(bits // 2), np.uint64((1 << bits) - 1)
    for factor in (_A, _B):
        x = ((x ^ (x >> half)) * factor) & mask
    return x ^ (x >> half)


def _sums(keys: np.ndarray, n: np.ndarray, n_target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key its place among the distinct ones, and the sums by place (as rows: all, target)."""
    distinct, place = np.unique(keys, return_inverse=True)
    out = np.zeros((2, len(distinct)), dtype=np.int64)
    for row, values in zip(out, (n, n_target)):
        np.add.at(row, place, values)
    return place, out


class _Chunk:
    """A chunk with what its words are in the vocabulary."""

    def __init__(self, row: dict, unknown: np.ndarray, known: int) -> None:
        self.of_corpus = row["chunk"].as_py() < _OTHER
        self.tokens = _unpacked(row["tokens"].as_buffer())
        self.lengths = _unpacked(row["lengths"].as_buffer())
        self.targets = _unpacked(row["targets"].as_buffer()) > 0
        size = int(self.tokens.max()) + 1 if len(self.tokens) else 0
        self.ids = np.full(size, known, dtype=np.uint64)  # the unknown word comes after the others
        self.counts = np.repeat(unknown[:, None], size, axis=1)
        found = row["found"].values
        if found is not None:
            at, number, n, n_target = (found.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            self.ids[at] = number
            self.counts[:, at] = n, n_target
        starts = (np.cumsum(self.lengths) - self.lengths)[self.lengths > 0]
        follows = np.ones(len(self.tokens), dtype=bool)
        follows[starts] = False
        #: Tokens that have a predecessor in their document; the distinct pairs, and the place of each token's pair.
        self.at = np.flatnonzero(follows)
        ids = self.ids[self.tokens]
        pairs = ids[self.at - 1] << np.uint64(known.bit_length()) | ids[self.at]
        self.keys, self.place = np.unique(_mix(pairs, 2 * max(1, known.bit_length())), return_inverse=True)
        self.doc = np.repeat(np.arange(len(self.lengths)), self.lengths)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """How often the chunk's documents have each distinct pair: all, target; zero if they are not of the corpus."""
        size = len(self.keys)
        if not self.of_corpus:
            return np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
        mine = self.targets[self.doc[self.at]]
        return np.bincount(self.place, minlength=size), np.bincount(self.place[mine], minlength=size)

    def own(self) -> tuple[np.ndarray, np.ndarray]:
        """For each token (and each token of ``at``): how often its document has its word (and its pair)."""

        def repeats(values: np.ndarray, doc: np.ndarray) -> np.ndarray:
            _, place, n = np.unique(doc * (int(values.max(initial=0)) + 1) + values, return_inverse=True, return_counts=True)
            return n[place]

        return repeats(self.ids[self.tokens].astype(np.int64), self.doc), repeats(self.place, self.doc[self.at])


def _chunks(batches: Iterator[pa.RecordBatch], unknown: np.ndarray, known: int) -> Iterator[tuple[dict, _Chunk]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i] for name in batch.schema.names}
            yield row, _Chunk(row, unknown, known)


def _with_words(chunks: DataFrame, models: Models) -> DataFrame:
    """``chunks`` with ``found``: place in the chunk, id and counts of those of its words that are in the vocabulary."""
    asked = chunks.select("chunk", F.posexplode("words").alias("at", "w")).select("chunk", "at", F.col("w.word").alias("word"))
    met = asked.join(models.vocabulary, "word").select("chunk", F.struct("at", "id", "n", "n_target").alias("f"))
    found = met.groupBy("chunk").agg(F.collect_list("f").alias("found"))
    return chunks.drop("words").join(found, "chunk", "left")


def _pair_counts(chunks: DataFrame, models: Models, ranges: int, worded: DataFrame | None = None) -> DataFrame:
    """One row for each chunk and range of keys: the chunk's distinct pairs and how often it counts them."""
    unknown, known, width = models.unknown, models.size, 2 * max(1, models.size.bit_length())
    bits = min(width, max(1, math.ceil(math.log2(ranges))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(width - bits)
        for row, chunk in _chunks(batches, unknown, known):
            n, n_target = chunk.pairs()
            cuts = [0, *np.searchsorted(chunk.keys, edges).tolist(), len(chunk.keys)]
            some = [(p, a, b) for p, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
            steps = [np.diff(chunk.keys[a:b], prepend=np.uint64(0)).view(np.int64) for _, a, b in some]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([p for p, _, _ in some], pa.int32()),
                    pa.array([row["chunk"].as_py()] * len(some), pa.int64()),
                    pa.array([row["asks"].as_py()] * len(some), pa.bool_()),
                    pa.array([_packed(x) for x in steps], pa.binary()),
                    pa.array([_packed(n[a:b]) for _, a, b in some], pa.binary()),
                    pa.array([_packed(n_target[a:b]) for _, a, b in some], pa.binary()),
                ],
                names=["part", "chunk", "asks", "keys", "n", "n_target"],
            )

    rows = (worded or _with_words(chunks, models)).drop("rows")
    return rows.mapInArrow(run, "part int, chunk bigint, asks boolean, keys binary, n binary, n_target binary")


def _pair_sums(counts: DataFrame) -> DataFrame:
    """For the rows that ask: the sums of their pairs over all other chunks, in the order of the pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: list[dict]) -> pa.RecordBatch:
            keys = [np.cumsum(_unpacked(r["keys"]).view(np.uint64), dtype=np.uint64) for r in rows]
            own = [np.concatenate([_unpacked(r[c]) for r in rows]) for c in ("n", "n_target")]
            place, sums = _sums(np.concatenate(keys), *own)
            rest = [total[place] - mine for total, mine in zip(sums, own)]
            ends = np.cumsum([len(k) for k in keys])
            asked = [(r, slice(e - len(k), e)) for r, k, e in zip(rows, keys, ends) if r["asks"]]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r["chunk"] for r, _ in asked], pa.int64()),
                    pa.array([r["part"] for r, _ in asked], pa.int32()),
                    *[pa.array([_packed(x[p]) for _, p in asked], pa.binary()) for x in rest],
                ],
                names=["chunk", "part", "n", "n_target"],
            )

        part, rows = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["part"] != part and rows:
                    yield done(rows)
                    rows = []
                part = r["part"]
                rows.append(r)
        if rows:
            yield done(rows)

    dealt = counts.repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(run, "chunk bigint, part int, n binary, n_target binary")


def _scored(chunks: DataFrame, models: Models, rest: DataFrame, own: list[DataFrame]) -> DataFrame:
    """Scores of the rows of the ``chunks`` that ask; ``rest`` has the schema of their other columns.

    ``own``: tables behind ``chunks`` that nobody else needs.
    """
    others = chunks.where(F.col("chunk") >= _OTHER).select(F.explode("words.n").alias("n"))
    tokens = int(models.total[0]) + others.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    worded = written(_with_words(chunks, models))
    _release(rest.sparkSession, *own)
    sums = written(_pair_sums(_pair_counts(chunks, models, max(2, math.ceil(tokens / RANGE)), worded)))
    _release(rest.sparkSession)
    replies = sums.groupBy("chunk").agg(F.collect_list(F.struct("part", "n", "n_target")).alias("sums"))
    unknown, total, size = models.unknown, models.total, models.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, chunk in _chunks(batches, unknown, size):
            answered = sorted(row["sums"].as_py() or [], key=lambda r: r["part"])
            held = np.stack([np.ones(len(chunk.doc), dtype=bool), chunk.targets[chunk.doc]]) & chunk.of_corpus
            own_words, own_pairs = chunk.own()
            losses = []
            for c, (name, mine) in enumerate(zip(("n", "n_target"), chunk.pairs())):
                counts = chunk.counts[c][chunk.tokens] - own_words * held[c]
                p = (counts + ALPHA) / (total[c] - chunk.lengths[chunk.doc] * held[c] + ALPHA * (size + 1))
                if len(chunk.at):
                    # the predecessor's count, without this document's
                    before = counts[chunk.at - 1]
                    pairs = (np.concatenate([_unpacked(r[name]) for r in answered]) + mine)[chunk.place]
                    after = (pairs - own_pairs * held[c][chunk.at]) / np.maximum(before, 1)
                    p[chunk.at] = np.where(before > 0, PAIR_SHARE * after + (1 - PAIR_SHARE) * p[chunk.at], p[chunk.at])
                losses.append(-np.log(p))
            ends = np.cumsum(chunk.lengths)
            rows = []
            for n, end in zip(chunk.lengths.tolist(), ends.tolist()):
                means = [float(x[end - n : end].sum()) / n if n else 0.0 for x in losses]
                rows.append((n, *means, means[0] - means[1]))
            added = [pa.array([r[i] for r in rows], pa.int64() if i == 0 else pa.float64()) for i in range(4)]
            kept = pa.ipc.open_stream(zlib.decompress(row["rows"].as_buffer())).read_all().combine_chunks()
            columns = [pa.concat_arrays(x.chunks) if x.num_chunks != 1 else x.chunk(0) for x in kept.columns]
            yield pa.RecordBatch.from_arrays([*columns, *added], names=[*kept.schema.names, *_NAMES])

    schema = rest.withColumn("n_tokens", F.lit(0).cast("bigint"))
    for name in _NAMES[1:]:
        schema = schema.withColumn(name, F.lit(0.0))
    return written(worded.where("asks").join(replies, "chunk", "left").mapInArrow(run, schema.schema))


def scored(docs: DataFrame, models: Models, text: str = "text") -> DataFrame:
    """Adds ``n_tokens``, ``background_loss``, ``target_loss`` (means per token) and ``score`` (their difference).

    The text is dropped.  A null or empty text has no tokens and scores 0.  Rows and other columns stay; columns
    of these names are replaced.
    """
    own = chunked(docs, text, first=_OTHER)
    both = models.chunks.withColumn("asks", F.lit(False)).unionAll(own.withColumn("asks", F.lit(True)))
    with batches_of(docs.sparkSession, CHUNKS):
        return _scored(both, models, _rest(docs, text), [own])


def fitted_and_scored(corpus: DataFrame, text: str = "text", target: str = "target", size: int | None = None) -> DataFrame:
    """Fits both models on ``corpus`` and scores each of its rows by the models without that row; texts are read once.

    The added columns are those of :func:`scored`.  An empty table gives an empty table; a repeated row is a document of
    its own, so its copies stay in the models that score it.
    """
    chunks = chunked(corpus, text, target)
    with batches_of(corpus.sparkSession, CHUNKS):
        return _scored(chunks.withColumn("asks", F.lit(True)), _fitted(chunks, size), _rest(corpus, text), [chunks])
