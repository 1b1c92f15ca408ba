"""SentencePiece encoding with byte offsets, and decoding.

Normalisation is done here: at each place the longest prefix that the model's compiled character map knows is replaced
(otherwise one character is copied), and for every byte of the result the byte of the source that it came from is
recorded.  Pieces are runs of normalised bytes, so that record projects each piece to its source bytes.  The ids are
those of the sentencepiece library.

If no piece of the vocabulary holds a space mark after another character, merges never cross the start of a run of
spaces (nor a line break that no piece holds), so a text is encoded segment by segment and a bounded memory of
segments spares most calls.  Models or texts for which that does not hold are encoded whole.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordinalia.llm.common import kept, without

MARK = "▁"
#: Segments kept per worker process.
MEMORY = 400_000


class CharacterMap:
    """The compiled character map: a length, a double-array trie of that many bytes, NUL-ended replacements."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, dtype="<u4", count=size // 4, offset=4).tolist() if blob else []
        self.results = blob[4 + size :] if blob else b""
        self.starts = {b for b in range(256) if self._first(b)}

    def _first(self, byte: int) -> bool:
        if not self.units:
            return False
        unit = self.units[self._offset(self.units[0]) ^ byte]
        return unit & 0x800000FF == byte

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, source: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest known prefix of ``source[at:]``."""
        units, found = self.units, None
        if not units:
            return None
        node = self._offset(units[0])
        for i in range(at, len(source)):
            byte = source[i]
            if not byte:
                break
            node ^= byte
            unit = units[node]
            if unit & 0x800000FF != byte:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                value = units[node] & 0x7FFFFFFF
                found = (i + 1 - at, self.results[value : self.results.index(0, value)])
        return found


class Codec:
    """A loaded model: normalisation with alignment, ids, spans, decoding."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as file:
            blob = file.read()
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(blob)
        self._set(model.normalizer_spec)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=blob)
        pieces = [p.piece for p in model.pieces if p.type in (1, 4)]
        self.sizes = [1 if p.type == 6 else len(p.piece.encode()) for p in model.pieces]
        self.covers = [1 if p.type == 6 else len(p.piece.replace(MARK, " ").encode()) for p in model.pieces]
        self.unknown = self.model.unk_id()
        own = model.trainer_spec
        self.by_segment = (
            not self.map.units
            and self.prefix
            and self.marked
            and not self.trimmed
            and not own.treat_whitespace_as_suffix
            and own.model_type == 2
            and own.byte_fallback
            and not any(p.type == 4 for p in model.pieces)
            and not any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces)
        )
        self.memory: dict[str, tuple[str, bytes, str]] = {}

    def _set(self, spec) -> None:
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.trimmed, self.marked = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them (and for the end) the source byte at which it starts."""
        source = text.encode()
        space = MARK.encode() if self.marked else b" "
        out, align = bytearray(), []
        at, size = 0, len(source)
        chunks = []
        while at < size:
            known = self.map.longest(source, at) if source[at] in self.map.starts else None
            if known is None:
                lead = source[at]
                known = (n := 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4, source[at : at + n])
            chunks.append((at, *known))
            at += known[0]
        if self.trimmed:  # leading and trailing white space, and all but the first of a run
            while chunks and chunks[0][2] == b" ":
                chunks.pop(0)
        end = chunks[0][0] if chunks else size
        if chunks and self.prefix:
            out += space
            align += [end] * len(space)
        after_space = self.trimmed
        for start, length, new in chunks:
            if after_space and self.trimmed:
                new = new.lstrip(b" ")
            if new:
                made = new.replace(b" ", space)
                out += made
                copied = made == source[start : start + length]  # byte for byte; else all bytes come from the start
                align += range(start, start + length) if copied else [start] * len(made)
                after_space = new.endswith(b" ")
            end = start + length
            if not self.trimmed:
                after_space = False
        if self.trimmed:
            while out.endswith(space):
                del out[-len(space) :]
                end = align[-len(space)]
                del align[-len(space) :]
        return bytes(out), np.array([*align, end], dtype=np.int64)

    def _whole(self, text: str) -> tuple[list[int], list[int]]:
        """Ids by the library, and the normalised bytes of each piece."""
        ids = self.model.encode(text)
        if self.unknown in ids:  # an unknown piece keeps its normalised characters
            pieces = self.model.encode(text, return_type=str)
            return ids, [1 if self.model.is_byte(i) else len(p.encode()) for i, p in zip(ids, pieces)]
        return ids, [self.sizes[i] for i in ids]

    def _project(self, text: str, sizes: list[int]) -> np.ndarray:
        """Source bytes that each piece covers: starts, then the end of the last."""
        normal, align = self.normalise(text)
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        if ends[-1] != len(normal):
            raise ValueError(f"pieces cover {ends[-1]} normalised bytes of {len(normal)}")
        return align[ends]

    def _learn(self, segments: list[str]) -> None:
        """Remember comma-joined ids, source bytes of each piece and decoded text of segments inside a document.

        Without a character map every normalised byte comes from the source byte of its character and a mark from
        its space, so a piece covers as many source bytes as its text has with spaces for marks.
        """
        # the mark that the library puts in front stands for a segment's own first space
        encoded = self.model.encode([x[1:] if x[0] == " " else x for x in segments], num_threads=1)
        for segment, ids in zip(segments, encoded):
            if segment == " ":
                ids = [self.model.piece_to_id(MARK)]
            covered = [self.covers[i] for i in ids]
            decoded = self.model.decode(ids)
            if segment[0] == " ":
                decoded = " " + decoded
            else:  # a line break: the library's mark is not there inside a document
                ids, covered = ids[1:], covered[1:]
            self.memory[segment] = (
                ",".join(map(str, ids)),
                struct.pack(f"<{len(covered)}I", *covered),
                segment if decoded == segment else decoded,
            )

    def encode(self, text: str) -> tuple[str, np.ndarray, str]:
        """Comma-joined ids, source byte bounds of the pieces (starts and the last end), text decoded from the ids."""
        if not text:
            return "", np.zeros(1, dtype=np.int64), ""
        if not self.by_segment or MARK in text or "\0" in text:
            ids, sizes = self._whole(text)
            return ",".join(map(str, ids)), self._project(text, sizes), self.model.decode(ids)
        parts = re.findall(r" +[^ \n]*|\n[^ \n]*", " " + text)
        memory = self.memory
        new = [x for x in dict.fromkeys(parts) if x not in memory]
        if new:
            if len(memory) + len(new) > MEMORY:
                memory.clear()
                new = list(dict.fromkeys(parts))
            self._learn(new)
        found = [memory[x] for x in parts]
        bounds = np.concatenate([[0], np.cumsum(np.frombuffer(b"".join([x[1] for x in found]), dtype="<u4"), dtype=np.int64)])
        bounds[1:] -= 1  # the first mark stands for nothing in the source
        return ",".join([x[0] for x in found]), bounds, "".join([x[2] for x in found])[1:]


def codec(path: str) -> Codec:
    """One codec per worker process and file."""
    return kept(f"pieces {path}", lambda: Codec(path))


def encoded(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Adds ``ids`` (array<int>) and ``bounds`` (array<bigint>): piece i covers source bytes bounds[i] to bounds[i+1].

    A null or empty text has no ids and bounds [0].  Rows, order and other columns stay; columns of these names are
    replaced.
    """

    def row(c: Codec, value: str) -> tuple:
        ids, bounds, _ = c.encode(value)
        return [int(i) for i in ids.split(",")] if ids else [], bounds.tolist()

    return _mapped(docs, path, text, row, {"ids": ("array<int>", pa.list_(pa.int32())), "bounds": ("array<bigint>", pa.list_(pa.int64()))})


def decoded(docs: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded``, the library's text for an array of ids; a null or empty array gives an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(path).model
        for batch in batches:
            at = batch.schema.get_field_index(ids)
            texts = [model.decode(x or []) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    rest = docs.drop("decoded")
    return rest.mapInArrow(run, rest.withColumn("decoded", F.lit("")).schema)


def digests(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Adds n_tokens, ids_sha256, decoded_sha256, n_bytes (source bytes covered) and spans_crc32, without storing ids.

    ``spans_crc32`` is the crc32 of the piece bounds as little-endian signed 64-bit integers.
    """

    def row(c: Codec, value: str) -> tuple:
        ids, bounds, back = c.encode(value)
        return (
            len(bounds) - 1,
            hashlib.sha256(ids.encode()).hexdigest(),
            hashlib.sha256(back.encode()).hexdigest(),
            int(bounds[-1]),
            zlib.crc32(bounds.astype("<i8").tobytes()),
        )

    return _mapped(
        docs,
        path,
        text,
        row,
        {
            "n_tokens": ("bigint", pa.int64()),
            "ids_sha256": ("string", pa.string()),
            "decoded_sha256": ("string", pa.string()),
            "n_bytes": ("bigint", pa.int64()),
            "spans_crc32": ("bigint", pa.int64()),
        },
    ).drop(text)


def _mapped(docs: DataFrame, path: str, text: str, row, added: dict[str, tuple[str, pa.DataType]]) -> DataFrame:
    rest = without(docs, text, *added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            rows = [row(c, value.as_py() or "") for value in batch.column(at)]
            columns = [pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(added.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *added])

    schema = rest.select("*", *[F.lit(None).cast(kind).alias(name) for name, (kind, _) in added.items()]).schema
    return rest.mapInArrow(run, schema)
