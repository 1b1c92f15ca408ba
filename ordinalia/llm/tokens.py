"""Byte-level BPE ids by the tokenizers library, word by word with a bounded memory of words.

The pre-tokenizer cuts a text into words that are encoded independently of each other, so the ids of a text are
the ids of its words in order.  Prose repeats its words: each worker keeps the ids of words it has met (two generations
of at most `MEMORY`) and asks the library only for new ones, those of many texts at a time: words of a space and letters
stay words when they are written one after another, and the bytes that each id stands for tell where a word ends.  Texts with characters on which two regular-expression
engines might disagree, or with a special token's string, go to the library whole.
"""

from __future__ import annotations

import gc
import json
import os
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np

from ordinalia.llm.common import Memory, kept

#: Words of a generation of a worker's memory, characters of the longest one that is kept (which bounds the bytes);
#: characters of texts whose new words are learned together.
MEMORY, LONGEST, TOGETHER = 500_000, 64, 1_000_000
#: The published split pattern of this kind of vocabulary, for texts of the characters below only: there a letter is
#: what \w holds besides digits and the underscore.
SPLIT = re.compile(r" ?[^\W\d_]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Characters whose classes are the same in every Unicode version and engine; other texts go to the library whole.
OLD = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-ʯΑ-ΡА-я‐-‧‰-⁞€]")
PLAIN = re.compile(r" [^\W\d_]+").fullmatch


def byte_of() -> dict[str, int]:
    """The byte of each character of byte-level vocabularies: printable ones are themselves, the others count from 256."""
    printable = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c <= 255]
    others = [c for c in range(256) if c not in printable]
    return {chr(c): c for c in printable} | {chr(256 + i): c for i, c in enumerate(others)}


class WordEncoder:
    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            settings = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [x["content"] for x in settings["added_tokens"]]
        before = settings["pre_tokenizer"] or {}
        self.by_word = (
            settings["normalizer"] is None
            and before.get("type") == "ByteLevel"
            and before.get("use_regex") is True
            and not before.get("add_prefix_space")
            and not settings["model"].get("dropout")
        )
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes_of = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)  # byte-level vocabularies write one character for each byte
        self.quick = self._quick(settings["model"], vocabulary) if self.by_word else None
        self.memory = Memory(MEMORY)

    @staticmethod
    def _quick(model: dict, vocabulary: dict[str, int]):
        """The same vocabulary for another library, which is quicker with new words; None if ids don't follow the merges.

        It merges the pair with the smallest id first, which is the first merge if the ids count the merges.
        """
        import tiktoken

        byte = byte_of()
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        ids = [vocabulary.get(m) for m in merges]
        if model.get("ignore_merges") or ids != list(range(256, 256 + len(ids))) or len(set(merges)) < len(merges):
            return None
        ranks = {bytes(byte[c] for c in t): i for t, i in vocabulary.items() if i < 256 + len(ids)}
        return tiktoken.Encoding("words", pat_str=" [^ ]+", mergeable_ranks=ranks, special_tokens={})

    def _pack(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in encoded]

    def encode(self, text: str) -> bytes:
        """Ids of the whole text as little-endian unsigned 32-bit integers."""
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of whole texts, in their order; new words of TOGETHER characters of texts are learned at once."""
        waiting: list[str] = []
        held = 0
        for text in texts:
            waiting.append(text)
            held += len(text)
            if held >= TOGETHER:
                yield from self._encode(waiting)
                waiting, held = [], 0
        yield from self._encode(waiting)

    def _encode(self, texts: list[str]) -> list[bytes]:
        gc.disable()  # many small objects and no cycles among them
        try:
            return self._joined(texts)
        finally:
            gc.enable()

    def _joined(self, texts: list[str]) -> list[bytes]:
        whole = [not self.by_word or bool(OLD.search(x)) or any(s in x for s in self.specials) for x in texts]
        get = self.memory.young.get
        words = [[] if w else SPLIT.findall(x) for w, x in zip(whole, texts)]
        found = [list(map(get, x)) for x in words]
        open_ = [i for i, x in enumerate(found) if None in x]
        if open_:
            fresh: dict[str, bytes] = dict.fromkeys(w for i in open_ for w, ids in zip(words[i], found[i]) if ids is None)
            long = [w for w in fresh if len(w) > LONGEST]
            fresh.update(zip(long, self._pack(long)))
            asked = [w for w in fresh if len(w) <= LONGEST]
            for at in range(0, len(asked), MEMORY):
                some = asked[at : at + MEMORY]
                new = self.memory.missing(some)
                if new:
                    self._learn(new)
                fresh.update(zip(some, map(self.memory.young.__getitem__, some)))
            for i in open_:
                found[i] = [fresh[w] if ids is None else ids for w, ids in zip(words[i], found[i])]
        return [(self._pack([x])[0] if x else b"") if w else b"".join(f) for w, x, f in zip(whole, texts, found)]

    def _ids(self, words: str) -> np.ndarray:
        if self.quick:
            return self.quick.encode_to_numpy(words, disallowed_special=()).astype("<u4")
        return np.array(self.tokenizer.encode_batch_fast([words], add_special_tokens=False)[0].ids, dtype="<u4")

    def _learn(self, new: list[str]) -> None:
        young = self.memory.young
        together = [w for w in new if PLAIN(w)]
        if together:
            ids = self._ids("".join(together))
            ends = np.cumsum(self.bytes_of[ids])
            wanted = np.cumsum([len(w.encode()) for w in together])
            last = np.searchsorted(ends, wanted)
            if not np.array_equal(ends[last], wanted):
                raise ValueError("a word was not encoded by itself")
            raw, cuts = ids.tobytes(), [0, *((last + 1) * 4).tolist()]
            young.update(zip(together, [raw[a:b] for a, b in zip(cuts, cuts[1:])]))
        others = [w for w in new if w not in young]
        if others:
            young.update(zip(others, self._pack(others)))


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and file."""
    return kept(f"bpe {path}", lambda: WordEncoder(path))
