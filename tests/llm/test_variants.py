"""SimHash near duplicates, spelling variants, alignment of tokenizers."""

from __future__ import annotations

import random
from collections import Counter

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from ordinalia.llm import alignment, simhash, spelling
from ordinalia.llm.common import Memory
from ordinalia.llm.tokens import OLD

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id bigint, text string"


def shuffled(rng, kinds, most=60):
    """Texts of a few kinds of words with copies, near copies, edge cases."""
    texts = [None, "", " \n\t", "One", "one", "one two", "a b c", "A  B\nc"]
    for _ in range(kinds):
        base = [f"w{rng.randint(0, 300)}" for _ in range(rng.randint(1, most))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 5)):
            other = list(base)
            for _ in range(rng.randint(0, 2)):
                other[rng.randrange(len(other))] = f"w{rng.randint(0, 300)}"
            texts.append(" ".join(other).replace("w", rng.choice("wW")))
    rng.shuffle(texts)
    return list(enumerate(texts))


# --- SimHash


@pytest.mark.parametrize("group", [4096, 2])
def test_simhash_agrees_with_all_pairs(spark, monkeypatch, group):
    monkeypatch.setattr(simhash, "GROUP", group)  # 2: every key of more nodes is cut again
    monkeypatch.setattr(simhash, "AT_ONCE", 7)
    rows = shuffled(random.Random(3), 40)
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("Bits", F.lit(1)).withColumn("K", F.lit("x")).repartition(3)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.grouped(frame).collect()}
    assert got == brute.simhash_components(rows)


@pytest.mark.parametrize("group", [4096, 3])
def test_links_of_dense_fingerprints(spark, monkeypatch, group):
    """Clouds of fingerprints around few centres: chains, both segments, equal segments with many members."""
    monkeypatch.setattr(simhash, "GROUP", group)
    rng = random.Random(5)
    values = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(40):
            value = centre
            for _ in range(rng.choice([0, 1, 2, 3, 4, 6])):
                value ^= 1 << rng.choice([*range(64), *range(8), *range(30, 34)])
            values.add(value)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "bits bigint")
    links = [(r["a"], r["b"]) for r in simhash.links(frame).collect()]

    def classes(pairs, nodes):
        least = {v: v for v in nodes}

        def root(v):
            while least[v] != v:
                v = least[v]
            return v

        for a, b in pairs:
            x, y = sorted((root(a), root(b)))
            least[y] = x
        return {v: root(v) for v in nodes}

    wanted = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2]
    assert len(wanted) > 200
    assert classes(links, signed) == classes(wanted, signed)


def test_stars_by_lookup_and_by_matrix_agree():
    rng = np.random.default_rng(1)
    values = np.unique(rng.integers(0, 1 << 11, 900, dtype=np.uint64))
    first, second = simhash.stars(values), {}
    for a, b in zip(*[x.tolist() for x in first]):
        second[a] = b
    assert len(second) > 300
    spread = values << np.uint64(40)  # the same bits elsewhere
    assert {int(a) << 40: int(b) << 40 for a, b in second.items()} == dict(zip(*[x.tolist() for x in simhash.stars(spread)]))
    assert len(simhash.stars(values[:0])[0]) == 0 and len(simhash.stars(values[:1])[0]) == 0


def test_simhash_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.grouped(empty).collect() == []
    long = "x y z " * 100_000
    rows = [(1, long), (2, long + "x"), (None, ""), (4, None), (5, " "), (5, " ")]
    got = sorted(map(tuple, simhash.grouped(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    zero = "0" * 16
    assert [r for r in got if r[1] == zero] == [(4, zero, 4), (5, zero, 4), (5, zero, 4), (None, zero, 4)]
    assert f"{brute.fingerprint(rows[0][1][:600]):016x}" == next(r[1] for r in got if r[0] == 1)


# --- spelling


@pytest.mark.parametrize("group", [5000, 3])
def test_spelling_agrees_with_all_edits(spark, monkeypatch, group):
    monkeypatch.setattr(spelling, "GROUP", group)  # 3: groups are halved down to single places
    monkeypatch.setattr(spelling, "COUNTED", 50)
    rng = random.Random(7)
    stems = ["".join(rng.choice("abß") for _ in range(rng.randint(3, 8))) for _ in range(60)] + ["aaaaa", "aaaaaa", "aaaaaaa"]
    rows = [(i, " ".join(stems[int(63 * rng.random() ** 4)] + rng.choice([",", "", ".", "1x"]) for _ in range(60))) for i in range(120)]
    rows += [(900, None), (901, ""), (902, "AaAaAé ×÷ÿ ĀBCDE  ")] * 3 + [(903, "Straße STRASSE straße " * 50)]
    rows += [(904, "abbaab " * 300 + "abbaat " * 100 + "abbact " * 40 + "abcact " * 16 + "abcactt " * 6)]  # a chain of forms
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("Word", F.lit(1)).withColumn("N", F.lit(2)).repartition(3)
    got = {r["word"]: tuple(r)[1:] for r in spelling.grouped(frame).collect()}
    wanted = brute.spelling(brute.spelling_words(rows))
    assert len(wanted) > 50 and any(w[0] not in (None, w[1]) for w in wanted.values())
    assert got == wanted


def test_near_words_agree_with_edits():
    rng = random.Random(11)
    for alphabet, size, most in (("ab", 200, 9), ("abc", 400, 7), ("abcdefgh", 600, 4)):
        words = sorted({"".join(rng.choice(alphabet) for _ in range(rng.randint(1, most))) for _ in range(size)})
        place = {w: i for i, w in enumerate(words)}
        wanted = {(i, place[v]) for i, w in enumerate(words) for v in brute.edits(w, alphabet) if place.get(v, -1) > i}
        found = list(spelling.near(words))
        assert len(found) == len(set(found)) and set(found) == wanted


def test_spelling_edges(spark):
    assert spelling.grouped(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(None, "letter " * 30_000), (2, "lettre letter"), (2, "lettre letter"), (2, "lettre letter")]
    got = {r["word"]: tuple(r) for r in spelling.grouped(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {w: (w, *x) for w, x in brute.spelling(brute.spelling_words([("", rows[0][1]), *rows[1:]])).items()}


# --- alignment

TEXTS = [
    None, "", " ", "  ", "\n", "\n\n", "Hello world", " Hello", "Hello ", "a  b   c    d", "tab\tand\r\nlines\n\nnew  line\n",
    "don't can't 'there 'tis ''s rock'n'roll I'LL", "x''s 's", "3.14 and 1,000,000 (2023) v2.0-beta", "!!word!! \nNext, \nline",
    "<|endoftext|> <s> </s> <unk> <0x0A>", "café naïve über Straße ¿qué?", "mark ▁ here", "nul \0 byte", "emoji \U0001f600 你好",
    " nbsp x", "a_b_c __init__ snake_case", "``` code\n    indent\n\tdef f(x):\n", "trailing  \n ", "नमस्ते", " sep", "é combining", "Hello world",
    " \t x", "\t\tx", "a\t b", "9² ½ ºª", "\x1c\x1d control \x7f", "word word word's ’s ‘q’",
]


def as_rows(frame):
    return sorted(map(tuple, frame.collect()))


@pytest.mark.parametrize(("memory", "chunk"), [(150_000, 600_000), (40, 30)])
def test_alignment_agrees_with_whole_texts(spark, monkeypatch, memory, chunk):
    monkeypatch.setattr(alignment, "MEMORY", memory)
    monkeypatch.setattr(alignment, "CHUNK", chunk)
    monkeypatch.setattr(alignment, "RANGE", 50 if chunk < 100 else 400_000)
    monkeypatch.setattr(alignment, "kept", lambda name, make: make())
    rng = random.Random(13)
    rows = list(enumerate(TEXTS))
    words = [w for t in TEXTS if t and "▁" not in t and "\0" not in t for w in t.split(" ")]
    rows += [(100 + i, "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\n", ", ", "'", ""]) for _ in range(25))) for i in range(150)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("Groups", F.lit(1)).withColumn("N_a", F.lit(1)).repartition(3)
    assert as_rows(alignment.aligned(frame, A, B)) == sorted(brute.aligned(rows, A, B))


def test_alignment_of_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    short = [r for r in rows if r[1] is None or len(r[1]) < 4000]
    got = as_rows(alignment.aligned(spark.createDataFrame(short, SCHEMA), A, B))
    assert got == sorted(brute.aligned(short, A, B))


def test_alignment_edges(spark):
    assert alignment.aligned(spark.createDataFrame([], SCHEMA), A, B).collect() == []
    long = "the quick brown fox, " * 20_000
    rows = [(1, long), (1, long), (None, "the fox")]
    got = alignment.aligned(spark.createDataFrame(rows, SCHEMA), A, B).collect()
    assert len({tuple(r) for r in got if r["doc_id"] == 1}) == 1 and len(got) == 3
    assert all(r["n_best"] > 0 and r["count_sum"] >= r["n_links"] for r in got)


def test_atoms_of_odd_texts_align_like_whole_texts():
    rng = random.Random(17)
    own = alignment.Pair(A, B)
    assert own.by_atom
    parts = [" ", "  ", "\n", "\t", "'", "s", "t", "re", "Word", "wort", "12", "7", ".", ",", "!!", "_", "é", "(", "²", "\r", "-", "’", "€"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        if OLD.search(text):
            continue  # such texts are aligned whole
        whole = own.whole(text)
        infos = own.known(list(dict.fromkeys(atoms := alignment.ATOM.findall(f" {text}"))))
        assert "".join(atoms) == f" {text}"
        of = dict(zip(dict.fromkeys(atoms), infos))
        made = ";".join(of[x][0] for x in atoms) if all(of[x] for x in atoms) else None
        assert made == (whole[0] if whole else None), repr(text)


def test_memory_keeps_what_is_asked_again():
    memory = Memory(4)
    asked = Counter()
    for i in range(60):
        words = list(dict.fromkeys(["often", f"new{i}", f"new{i // 2}"]))
        for w in memory.missing(words):
            asked[w] += 1
            memory.young[w] = w
        assert all(memory.young[w] == w for w in words)
        assert len(memory.young) <= 4 and len(memory.old) <= 4
    assert asked["often"] == 1
