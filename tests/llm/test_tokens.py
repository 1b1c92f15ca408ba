"""SentencePiece with offsets, byte-level BPE, packing."""

from __future__ import annotations

import random
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ordinalia.llm import packing, pieces, tokens

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = [*"ab  \n\n\t'sx09.,!é漢字😀▁²ßЖ_", "\0", "\x1c", "\x85", "<s>", "</s>", "<|endoftext|>", "'ll", "  ", " ", "the ", "word"]


def texts(n, seed):
    rng = random.Random(seed)
    made = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 40))) for _ in range(n)]
    return [*made, "", " ", "  ", "\n", "a ", " a", "▁", "﻿x", "long word " * 30_000]


def test_piece_ids_and_spans_agree_with_the_library():
    codec = pieces.codec(PIECES)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert codec.by_segment
    for text in texts(2000, 1):
        ids, bounds, back = codec.encode(text)
        wanted = library.encode(text)
        assert ids == ",".join(map(str, wanted)) and back == library.decode(wanted)
        assert len(bounds) == len(wanted) + 1 and bounds[0] == 0 and bounds[-1] == len(text.encode())
        if text and len(text) < 1000:  # the general path, through normalisation and its alignment
            whole, sizes = codec._whole(text)
            assert whole == wanted and codec._project(text, sizes).tolist() == bounds.tolist()


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "identity"])
def test_normalisation_agrees_with_the_library(rule):
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(library.serialized_model_proto())
    own = pieces.Codec.__new__(pieces.Codec)
    own._set(model.normalizer_spec)
    samples = ["", " ", "  a  b ", "ﬁne Ａ１ ½ é é ㍿ ① x", "HeLLo　World", "​x y", *texts(200, 2)[:200]]
    for text in samples:
        if "\0" in text:
            continue
        made, align = own.normalise(text)
        assert made.decode() == library.normalize(text), repr(text)
        assert len(align) == len(made) + 1 and (np.diff(align) >= 0).all() and align[-1] <= len(text.encode())


def test_piece_operator(spark):
    rows = [(1, "Hello world", 5), (2, None, 6), (3, "", 7), (1, "Hello world", 5)]
    frame = spark.createDataFrame(rows, "doc_id int, text string, ids int")
    out = pieces.decoded(pieces.encoded(frame, PIECES), PIECES).collect()
    assert [r["decoded"] for r in out] == ["Hello world", "", "", "Hello world"]
    r = out[0]
    covered = ["Hello world".encode()[a:b].decode() for a, b in zip(r["bounds"], r["bounds"][1:])]
    assert "".join(covered) == "Hello world" and len(covered) == len(r["ids"])
    digest = {x["doc_id"]: x for x in pieces.digests(frame, PIECES).collect()}
    assert digest[2]["n_tokens"] == 0 and digest[2]["ids_sha256"] == brute.sha256("")
    assert digest[1]["decoded_sha256"] == brute.sha256("Hello world")
    assert pieces.digests(frame.limit(0), PIECES).count() == 0


def test_byte_ids_agree_with_the_library(monkeypatch):
    library = Tokenizer.from_file(BYTES)
    unicode = [chr(i) for i in range(1, 0x2100)]
    rng = random.Random(7)
    samples = texts(1500, 3) + ["".join(rng.choices(unicode, k=20)) for _ in range(1000)] + [f"a{x}b {x}1{x}" for x in unicode[::7]]
    for memory in (tokens.MEMORY, 50):  # the second one changes generations all the time
        monkeypatch.setattr(tokens, "MEMORY", memory)
        own = tokens.WordEncoder(BYTES)
        for text in samples:
            assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)[:80]


def exhausted(fillings):
    used = {}
    for contents, times in fillings:
        for length, copies in contents:
            used[length] = used.get(length, 0) + copies * times
    return used


def test_plan_uses_every_remainder_once_and_fills_windows():
    rng = random.Random(9)
    for capacity in (16, 64, 1024):
        counts = {rng.randint(1, capacity - 1): rng.randint(1, 500) for _ in range(min(60, capacity))}
        fillings = packing.plan(counts, capacity)
        assert exhausted(fillings) == counts
        assert all(sum(a * b for a, b in contents) <= capacity for contents, _ in fillings)
        assert len(fillings) <= 2 * len(counts)


def test_first_filling_has_least_slack():
    from itertools import product

    counts, capacity = {9: 1, 5: 2, 4: 1, 3: 3}, 16
    fillings = packing.plan(counts, capacity)
    first = sum(a * b for a, b in fillings[0][0])
    best = min(
        packing.padding(9 + 5 * a + 4 * b + 3 * c, capacity)
        for a, b, c in product(range(3), range(2), range(4))
        if 9 + 5 * a + 4 * b + 3 * c <= capacity
    )
    assert packing.padding(first, capacity) == best


def test_packing_is_whole_and_gapless(spark):
    library = Tokenizer.from_file(BYTES)
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choices(["the", "house", "xyzzy", "é", "\n"], k=rng.choice([0, 3, 40, 900, 3000]))), "x") for i in range(120)]
    rows += [(500, None, "x"), (None, "no id", "x"), (3, rows[3][1], "x")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, offset string").repartition(5)
    got = packing.pack(frame, BYTES, capacity=64).toPandas()
    sequences = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    for _, s in sequences:
        assert s["offset"].tolist() == [0, *s["length"].cumsum().tolist()[:-1]] and s["length"].sum() <= 64
    assert got["length"].sum() == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in rows)
    for key, text, _ in rows[:100]:
        if key == 3:
            continue
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        mine = got[got["doc_id"] == key].sort_values("start")
        assert mine["start"].tolist() == list(range(0, len(ids), 64)) and set(mine["doc_tokens"]) == {len(ids)}
        for r in mine.itertuples():
            assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    assert len(got[got["doc_id"] == 3]) == 2 * len(range(0, len(library.encode(rows[3][1]).ids) + 1, 64))
    padding = sum(packing.padding(n, 64) for n in sequences["length"].sum())
    assert padding <= 64 + 0.02 * got["length"].sum()
    assert packing.pack(frame.limit(0), BYTES).count() == 0
