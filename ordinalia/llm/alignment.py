"""Alignment of two tokenizers' ids: groups of ids that cover the same bytes, and how often ids are linked.

For a text both lists of cumulative byte ends become dictionaries from an end to the place after it; the intersection of
their keys, sorted, cuts both id lists into groups.  All pairs of a group are links.  A link's count is the number of
documents of the corpus that hold it.

Atoms.  A byte-level BPE cuts a text into words before it merges, and a BPE of pieces never merges two characters
that stand next to each other in none of its pieces.  Where both hold, a text falls into atoms whose ids do not depend
on their neighbours; every atom ends a group, so a text's groups are those of its atoms.  Each worker remembers
atoms.  Texts with characters on which engines might disagree are aligned whole, in the same way.

Counts.  Texts are read once, into chunks of about CHUNK atoms: a chunk numbers its distinct atoms and holds its documents
as lists of numbers.  It hands out each of its distinct links once, with the number of its documents that hold it, to
ranges of first ids; there they are summed, compared with the highest count of their first id, and sent
back.  So no table of all links is held anywhere, and what a task holds follows the chunk.
"""

from __future__ import annotations

import gc
import json
import math
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordinalia.llm.common import Memory, batches_of, kept, text_of, written
from ordinalia.llm.tokens import OLD, byte_of

#: Atoms of a generation of a worker's memory; atoms of a chunk; links of a range that one task sums; texts in a batch.
MEMORY, CHUNK, RANGE, TEXTS = 130_000, 1_000_000, 400_000, 500
MARK = "▁"
#: A space and letters; other characters up to letters or up to the space before them; other characters with the letters
#: behind them, if two white spaces or an apostrophe stand between: there the words of the first tokenizer depend on them.
ATOM = re.compile(r" ?[^\W\d_]+|[\W\d_]*(?:\s\s|')[^\W\d_]+|[\W\d_]+(?= [^\W\d_])|[\W\d_]+")


def cuts(a_sizes: list[int], b_sizes: list[int]) -> list[tuple[int, int]]:
    """Places in both lists after each group, in order."""

    a = dict(zip(accumulate(a_sizes), range(1, len(a_sizes) + 1)))
    b = dict(zip(accumulate(b_sizes), range(1, len(b_sizes) + 1)))
    return [(a[end], b[end]) for end in sorted(a.keys() & b.keys())]


class Pair:
    """Two loaded tokenizers: byte-level BPE of a JSON file, BPE of pieces of a model file."""

    def __init__(self, first: str, second: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2
        from tokenizers import Tokenizer

        with open(first, encoding="utf-8") as file:
            settings = json.load(file)
        with open(second, "rb") as file:
            blob = file.read()
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(blob)
        self.a = Tokenizer.from_file(first)
        self.a.encode_special_tokens = True  # their strings are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_proto=blob)
        byte = byte_of()
        size = max(self.a.get_vocab().values(), default=-1) + 1
        self.a_bytes: list[bytes] = [b""] * size
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.b_bytes = [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.replace(MARK, " ").encode() for p in model.pieces]
        self.a_sizes, self.b_sizes = list(map(len, self.a_bytes)), list(map(len, self.b_bytes))
        self.shift = 1 << max(1, (len(self.b_bytes) - 1).bit_length())  # a link is first id * shift + second id
        self.space = self.b.piece_to_id(MARK)
        self.atoms = Memory(MEMORY)
        spec, own, before = model.normalizer_spec, model.trainer_spec, settings["pre_tokenizer"] or {}
        real = [p.piece for p in model.pieces if p.type in (1, 4)]
        self.by_atom = (
            settings["normalizer"] is None
            and before.get("type") == "ByteLevel"
            and before.get("use_regex") is True
            and not before.get("add_prefix_space")
            and not settings["model"].get("dropout")
            and not spec.precompiled_charsmap
            and spec.add_dummy_prefix
            and spec.escape_whitespaces
            and not spec.remove_extra_whitespaces
            and not own.treat_whitespace_as_suffix
            and own.model_type == 2
            and own.byte_fallback
            and not any(p.type == 4 for p in model.pieces)
            and not any(MARK in p.lstrip(MARK) or "\n" in p for p in real)
            # letters join with letters and with a mark in front only
            and not any(x.isalpha() != y.isalpha() and x != MARK for p in real for x, y in zip(p, p[1:]))
        )

    def aligned(self, a: list[int], b: list[int], size: int) -> tuple[str, int, int, int, bytes] | None:
        """Groups as text, numbers of ids of both, of groups, and all links; None if a side does not cover ``size`` bytes."""
        sizes = [list(map(self.a_sizes.__getitem__, a)), list(map(self.b_sizes.__getitem__, b))]
        if sum(sizes[0]) != size or sum(sizes[1]) != size:
            return None
        groups, links, i, j, shift = [], [], 0, 0, self.shift
        for x, y in cuts(*sizes):
            if x == i + 1 and y == j + 1:
                groups.append(f"{a[i]}|{b[j]}")
                links.append(a[i] * shift + b[j])
            else:
                one, other = a[i:x], b[j:y]
                groups.append(f"{','.join(map(str, one))}|{','.join(map(str, other))}")
                links += [u * shift + v for u in one for v in other]
            i, j = x, y
        return ";".join(groups), len(a), len(b), len(groups), array("Q", links).tobytes()

    def whole(self, text: str) -> tuple[str, int, int, int, bytes] | None:
        """A space and ``text``, aligned as one atom; None if the ids of a side do not give it back."""
        raw = f" {text}".encode()
        a, b = self.a.encode(f" {text}", add_special_tokens=False).ids, self.b.encode(text)
        if b"".join([self.a_bytes[i] for i in a]) != raw or b"".join([self.b_bytes[i] for i in b]) != raw:
            return None
        return self.aligned(a, b, len(raw))

    def _learn(self, new: list[str]) -> None:
        if not new:
            return
        first = self.a.encode_batch_fast(new, add_special_tokens=False)
        # the library puts a mark in front: for an atom's own space, or, cut off again with a line break, for nothing
        second = self.b.encode([x[1:] if x[0] == " " else f"\n{x}" for x in new], num_threads=1)
        for x, a, b in zip(new, first, second):
            b = ([self.space] if x == " " else b) if x[0] == " " else b[2:]
            # an atom has no mark of its own, so pieces of its length are its bytes
            self.atoms.young[x] = self.aligned(a.ids, b, len(x.encode())) or ()

    def known(self, atoms: list[str]) -> list[tuple]:
        """What is known of distinct atoms, in their order; () where a side does not give the atom."""
        out: list[tuple] = []
        for at in range(0, len(atoms), MEMORY):
            some = atoms[at : at + MEMORY]
            new = self.atoms.missing(some)
            gc.disable()  # many small objects and no cycles among them
            try:
                self._learn(new)
            finally:
                gc.enable()
            out += map(self.atoms.young.__getitem__, some)
        return out


def pair(first: str, second: str) -> Pair:
    """One pair per worker process and files."""
    return kept(f"pair {first} {second}", lambda: Pair(first, second))


def _packed(values: np.ndarray) -> bytes:
    """Integers as planes of bytes, compressed: the planes of high bytes are nearly empty."""
    return zlib.compress(np.ascontiguousarray(values.astype("<i8")).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpacked(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(blob), dtype=np.uint8).reshape(8, -1).T).view("<i8").reshape(-1)


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places starts[0], starts[0] + 1, ... of all runs, one after another."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


class _Numbers(dict):
    """Numbers of the atoms of a chunk, in order of appearance."""

    def __missing__(self, atom: str) -> int:
        value = self[atom] = len(self)
        return value


class _Chunk:
    """Documents as lists of atom numbers, and what is known of the atoms."""

    def __init__(self, tokens: Pair) -> None:
        self.tokens = tokens
        self.numbers, self.keys, self.places, self.held = _Numbers(), [], [], 0
        self.infos: list[tuple] = []
        self.whole: dict[int, tuple] = {}

    def add(self, key: object, text: str) -> None:
        own = self.tokens
        if not text:
            places = np.zeros(0, dtype=np.int64)
        elif own.by_atom and not OLD.search(text):
            places = np.array(list(map(self.numbers.__getitem__, ATOM.findall(f" {text}"))), dtype=np.int64)
        else:  # one atom that no other text shares
            info = own.whole(text)
            places = np.zeros(0, dtype=np.int64)
            if info is not None:
                number = self.numbers[f"\0{len(self.numbers)}"]
                self.whole[number] = info
                places = np.array([number], dtype=np.int64)
        self.keys.append(key)
        self.places.append(places)
        self.held += max(1, len(places), len(text) // 8 if len(places) == 1 else 0)

    def row(self, number: int, key_type: pa.DataType) -> pa.RecordBatch:
        atoms = list(self.numbers)
        plain = iter(self.tokens.known([x for i, x in enumerate(atoms) if i not in self.whole]))
        infos = [self.whole[i] if i in self.whole else next(plain) for i in range(len(atoms))]
        bad = np.array([not x for x in infos], dtype=bool)
        if bad.any():  # texts with such an atom have no tokens
            self.places = [p[:0] if bad[p].any() else p for p in self.places]
            infos = [x or ("", 0, 0, 0, b"") for x in infos]
        lengths = np.array([len(p) for p in self.places], dtype=np.int64)
        places = np.concatenate(self.places) if self.places else np.zeros(0, dtype=np.int64)
        often = np.argsort(-np.bincount(places, minlength=len(infos)), kind="stable")  # small numbers for frequent atoms
        places = np.argsort(often)[places] if len(often) else places
        infos = [infos[i] for i in often.tolist()]
        sizes = np.array([len(x[4]) // 8 for x in infos], dtype=np.int64)
        flat = np.frombuffer(b"".join([x[4] for x in infos]), dtype="<u8").astype(np.int64)
        links, place = np.unique(flat, return_inverse=True)
        # documents per link: distinct (document, atom), then distinct (document, link)
        n = np.zeros(len(links), dtype=np.int64)
        starts, document = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(lengths)), lengths)
        edge = np.cumsum(lengths)
        begin = 0
        while begin < len(lengths):  # some documents at a time
            stop = max(begin + 1, int(np.searchsorted(edge, (edge[begin - 1] if begin else 0) + 200_000)))
            some = slice(int(edge[begin - 1]) if begin else 0, int(edge[stop - 1]))
            held = np.unique(document[some] * max(1, len(infos)) + places[some])
            atom, doc = held % max(1, len(infos)), held // max(1, len(infos))
            each = np.unique(np.repeat(doc, sizes[atom]) * max(1, len(links)) + place[_runs(starts[atom], sizes[atom])])
            n += np.bincount(each % max(1, len(links)), minlength=len(links))
            begin = stop
        as_list = lambda x: pa.array([x], pa.binary())
        keys = pa.ListArray.from_arrays(pa.array([0, len(self.keys)], pa.int32()), pa.array(self.keys, key_type))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number], pa.int64()),
                keys,
                as_list(_packed(lengths)),
                as_list(_packed(places)),
                as_list(zlib.compress("\n".join([x[0] for x in infos]).encode(), 1)),
                as_list(_packed(np.array([x[1:4] for x in infos], dtype=np.int64).reshape(-1))),
                as_list(_packed(sizes)),
                as_list(_packed(place)),
                as_list(_packed(np.diff(links, prepend=0))),
                as_list(_packed(n)),
                pa.array([len(links)], pa.int64()),
            ],
            names=["chunk", "keys", "lengths", "places", "groups", "numbers", "sizes", "place", "links", "n", "n_links"],
        )


def chunked(docs: DataFrame, first: str, second: str, key: str, text: str) -> DataFrame:
    """Chunks of documents; see :class:`_Chunk`."""
    rows = docs.select(F.col(key).alias("key"), text_of(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = pair(first, second)
        chunk, number, key_type = _Chunk(tokens), TaskContext.get().partitionId() << 32, None
        for batch in batches:
            key_type = batch.schema.field(0).type
            for key_, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                chunk.add(key_, value.as_py())
                if chunk.held >= CHUNK:
                    yield chunk.row(number, key_type)
                    chunk, number = _Chunk(tokens), number + 1
        if chunk.keys:
            yield chunk.row(number, key_type)

    blobs = ", ".join(f"{x} binary" for x in ("lengths", "places", "groups", "numbers", "sizes", "place", "links", "n"))
    with batches_of(docs.sparkSession, TEXTS):
        return written(rows.mapInArrow(run, f"chunk bigint, keys array<{kind}>, {blobs}, n_links bigint"))


def _by_part(links: np.ndarray, shift: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the links in order of the ranges that sum them, and the ranges' edges; a first id is in one range."""
    part = (links // shift * 2654435761 % (1 << 32)) * parts >> 32
    by = np.argsort(part, kind="stable")
    return by, np.searchsorted(part[by], np.arange(parts + 1))


def _sums(chunks: DataFrame, shift: int, parts: int) -> DataFrame:
    """For each chunk and range: count of each of the chunk's links, and whether it is its first id's highest."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, links, n in zip(*[batch.column(i) for i in range(3)]):
                links, n = np.cumsum(_unpacked(links.as_buffer())), _unpacked(n.as_buffer())
                by, edges = _by_part(links, shift, parts)
                some = [(p, by[a:b]) for p, (a, b) in enumerate(zip(edges, edges[1:])) if a < b]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([p for p, _ in some], pa.int32()),
                        pa.array([chunk.as_py()] * len(some), pa.int64()),
                        pa.array([_packed(np.diff(links[x], prepend=0)) for _, x in some], pa.binary()),
                        pa.array([_packed(n[x]) for _, x in some], pa.binary()),
                    ],
                    names=["part", "chunk", "links", "n"],
                )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(part: int, rows: list[dict]) -> pa.RecordBatch:
            links = [np.cumsum(_unpacked(r["links"])) for r in rows]
            distinct, place = np.unique(np.concatenate(links), return_inverse=True)
            total = np.bincount(place, weights=np.concatenate([_unpacked(r["n"]) for r in rows])).astype(np.int64)
            owner = distinct // shift
            begins = np.flatnonzero(np.diff(owner, prepend=-1))
            highest = np.repeat(np.maximum.reduceat(total, begins), np.diff([*begins, len(owner)]))
            value = 2 * total + (total == highest)
            ends = np.cumsum([len(x) for x in links])
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r["chunk"] for r in rows], pa.int64()),
                    pa.array([part] * len(rows), pa.int32()),
                    pa.array([_packed(value[place[e - len(x) : e]]) for x, e in zip(links, ends)], pa.binary()),
                ],
                names=["chunk", "part", "value"],
            )

        part, rows = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["part"] != part and rows:
                    yield done(part, rows)
                    rows = []
                part = r["part"]
                rows.append(r)
        if rows:
            yield done(part, rows)

    asked = chunks.select("chunk", "links", "n").mapInArrow(ask, "part int, chunk bigint, links binary, n binary")
    dealt = asked.repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(answer, "chunk bigint, part int, value binary")


def aligned(docs: DataFrame, first: str, second: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum and ``groups`` (`a1,a2|b1;a3|b2,b3`) of every row.

    ``first`` is a byte-level BPE that reads a space and the text, ``second`` a model of pieces that adds the space
    itself.  n_best counts the links with the highest count of their first id, count_sum adds the counts of all links.
    A text that is null or empty, or whose ids of one side do not give it back, has no ids: zeros and an empty string.
    Very long texts are held whole.  A repeated row is a document of its own; an empty table gives an empty table.
    Other columns are dropped, whatever their names.
    """
    import sentencepiece

    shift = 1 << max(1, (sentencepiece.SentencePieceProcessor(model_file=second).get_piece_size() - 1).bit_length())
    with batches_of(docs.sparkSession, 1):
        chunks = chunked(docs, first, second, key, text)
        links = chunks.agg(F.coalesce(F.sum("n_links"), F.lit(0))).first()[0]
        parts = max(8, math.ceil(links / RANGE))
        replies = written(_sums(chunks, shift, parts)).groupBy("chunk").agg(F.collect_list(F.struct("part", "value")).alias("replies"))
        return _finished(chunks.drop("n", "n_links").join(replies, "chunk", "left"), shift, parts, key)


def _finished(chunks: DataFrame, shift: int, parts: int, key: str) -> DataFrame:
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                lengths, places, sizes, place = (_unpacked(row[x].as_buffer()) for x in ("lengths", "places", "sizes", "place"))
                numbers = _unpacked(row["numbers"].as_buffer()).reshape(-1, 3)
                links = np.cumsum(_unpacked(row["links"].as_buffer()))
                groups = zlib.decompress(row["groups"].as_buffer()).decode().split("\n")
                value = np.zeros(len(links), dtype=np.int64)
                by, edges = _by_part(links, shift, parts)
                for r in row["replies"].as_py() or []:
                    value[by[edges[r["part"]] : edges[r["part"] + 1]]] = _unpacked(r["value"])
                # sums over an atom's links, then over a document's atoms
                begin, end = np.cumsum(sizes) - sizes, np.cumsum(sizes)
                added = lambda x: (np.concatenate([[0], np.cumsum(x[place])])[np.stack([end, begin])] * [[1], [-1]]).sum(axis=0)
                atoms = np.column_stack([numbers, sizes, added(value & 1), added(value >> 1)])
                edges = np.cumsum(lengths)
                columns = [np.concatenate([[0], np.cumsum(c[places])]) for c in atoms.T]
                totals = [pa.array(c[edges] - c[edges - lengths], pa.int64()) for c in columns]
                listed = places.tolist()
                texts = [";".join(map(groups.__getitem__, listed[e - n : e])) for n, e in zip(lengths.tolist(), edges.tolist())]
                for at in range(0, len(texts), 200):  # long strings: few rows in a batch
                    yield pa.RecordBatch.from_arrays(
                        [row["keys"].values.slice(at, 200), *[t.slice(at, 200) for t in totals], pa.array(texts[at : at + 200], pa.string())],
                        names=["key", *names, "groups"],
                    )

    kind = chunks.schema["keys"].dataType.elementType.simpleString()
    out = chunks.mapInArrow(run, f"key {kind}, {', '.join(f'{x} bigint' for x in names)}, groups string")
    return out.withColumnRenamed("key", key)
