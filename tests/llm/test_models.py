"""Classifiers, toxicity, language models."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordinalia.llm import language, quality, toxicity
from ordinalia.llm.common import crc32_of_id

GOOD = ["river", "house", "garden", "morning", "quiet", "walked", "slowly", "letter", "window", "silver"]
BAD = ["###buy", "now!!!", "click", "$$$", "cheap!!", "offer", "WIN", "FREE"]


def labelled(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        good = rng.random() < 0.6
        words = rng.choices(GOOD + [f"x{rng.randint(0, 300)}"], k=30) + (rng.choices(BAD, k=8) if not good else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(good)))
    return rows


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(20, 5, replace=False)) for _ in range(60)]
    truth = rng.normal(size=20)
    y = np.where([truth[r].sum() > 0 for r in rows], 1, -1)
    scale = np.ones(20)
    cost = 0.5

    def primal(w, b):
        costs = np.where(y > 0, cost * len(y) / (2 * (y > 0).sum()), cost * len(y) / (2 * (y < 0).sum()))
        margins = np.array([w[r].sum() / math.sqrt(5) + b for r in rows])
        return 0.5 * (w @ w + b * b) + (costs * np.maximum(0, 1 - y * margins)).sum()

    w, b = quality.descend(rows, y, scale, cost=cost, passes=400)
    best = primal(w, b)
    for _ in range(300):  # no small step is better
        assert primal(w + rng.normal(size=20) * 0.02, b + rng.normal() * 0.02) >= best - 1e-3


def test_naive_bayes_blend_agrees_with_a_dense_version(monkeypatch):
    """Interpolation of the trained weights with their mean magnitude, on indicators scaled by log-count ratios."""
    rng = np.random.default_rng(3)
    rows = [np.sort(rng.choice(50, 8, replace=False)) for _ in range(80)]
    y = np.where([(r < 20).sum() > 3 for r in rows], 1, -1)
    model = quality._train(rows, y)
    dense = np.zeros((80, 50))
    for i, r in enumerate(rows):
        dense[i, r] = 1
    size = 1 << quality.BITS
    up, down = quality.ALPHA + dense[y > 0].sum(axis=0), quality.ALPHA + dense[y < 0].sum(axis=0)
    ratio = np.log(up / (up.sum() + quality.ALPHA * (size - 50))) - np.log(down / (down.sum() + quality.ALPHA * (size - 50)))
    assert np.allclose(ratio, model.scale[:50])
    w, bias = quality.descend(rows, y, model.scale)
    mixed = (1 - quality.BLEND) * np.abs(w[:50]).mean() + quality.BLEND * w[:50]
    for i, r in enumerate(rows):
        f = dense[i] * ratio
        assert model.margin(r) == pytest.approx(f @ mixed / np.sqrt(f @ f) + bias)
    bayes = np.array([dense[i] @ ratio for i in range(80)])  # the part that the blend adds points to the class
    assert bayes[y > 0].mean() > 0 > bayes[y < 0].mean() and (1 - quality.BLEND) * np.abs(w[:50]).mean() > 0


def test_quality_on_held_out_rows(spark):
    rows = labelled(600, 1)
    docs = spark.createDataFrame([(i, t, 0.5, "x") for i, t, _ in rows], "doc_id bigint, text string, score double, label string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None), (5, 7)], "doc_id bigint, quality int")
    held = crc32_of_id() % 3 == 1
    model = quality.learn(docs, labels, ~held)
    out = quality.scored(docs, model).select("doc_id", "predicted", "score", "label", held.alias("held")).collect()
    assert len(out) == 600 and all(0 <= r["score"] <= 1 and r["label"] == "x" for r in out)
    right = [r["predicted"] == rows[r["doc_id"]][2] for r in out if r["held"]]
    assert sum(right) / len(right) > 0.97


def test_quality_labels_of_held_out_rows_do_not_matter(spark):
    rows = labelled(200, 2)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    held = crc32_of_id() % 3 == 1
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, quality int")
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.learn(docs, x, ~held) for x in (labels, turned))
    assert np.array_equal(a.weights, b.weights) and (a.bias, a.slope, a.offset) == (b.bias, b.slope, b.offset)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a"), (2, ""), (4, "word " * 60_000)], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    model = quality.learn(docs, none, F.lit(True))
    out = quality.scored(docs, model).collect()
    assert len(out) == 5 and {r["score"] for r in out} == {0.5}
    one = quality.learn(docs, spark.createDataFrame([(1, 1), (2, 1)], "doc_id bigint, quality int"), F.lit(True))
    assert {r["predicted"] for r in quality.scored(docs, one).collect()} == {1}
    assert quality.scored(docs.limit(0), model).count() == 0


@pytest.mark.parametrize(
    ("text", "plain"),
    [("ІDІOT", "idiot"), ("1d10t", "idiot"), ("m0r0n!", "moron!"), ("tr@sh", "trash"), ("paid 100 $", "paid 100 $"), ("5", "5"), ("word$$$ x", "word$$$ x")],
)
def test_folding(text, plain):
    assert toxicity.folded(text) == plain


def test_lexicon_matching_agrees_with_a_scan_of_words():
    lexicon = toxicity.Lexicon({"fool": 2.0, "jerk*": 1.5, "jerk": 1.0}, ["no fool"])
    matcher = lexicon.matcher()
    hits = lambda t: [(t[a:b], w) for a, b, w in matcher.hits(toxicity.folded(t))]
    assert hits("you fool") == [("fool", 2.0)]
    assert hits("foolish befool fool") == [("fool", 2.0)]
    assert hits("he is no fool but a f00l") == [("f00l", 2.0)]
    assert hits("jerk jerks") == [("jerk", 1.0), ("jerk", 1.5)]
    assert hits("") == [] and toxicity.Lexicon({}).matcher().hits("fool") == []


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(6)
    mean = ["idiot", "moron", "scumbag"]
    rows = []
    for i in range(500):
        toxic = rng.random() < 0.2
        words = [rng.choice(GOOD) + rng.choice(["", "s", "ing"]) for _ in range(40)]
        if toxic:
            for _ in range(4):
                words.insert(rng.randint(0, len(words)), rng.choice(mean + ["m0ron", "IDIОT"]))
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([(i, t, 1) for i, t, _ in rows], "doc_id bigint, text string, predicted int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    held = crc32_of_id() % 5 == 0
    lexicon = toxicity.learn(docs, labels, ~held)
    out = toxicity.scored(docs, lexicon).collect()
    assert all(r["predicted"] == rows[r["doc_id"]][2] for r in out) and len(out) == 500
    edges = spark.createDataFrame([(1, None), (1, None), (None, ""), (4, "idiot " * 60_000)], "doc_id bigint, text string")
    got = [r["predicted"] for r in toxicity.scored(edges, lexicon).collect()]
    assert got == [0, 0, 0, 1]
    assert toxicity.scored(edges.limit(0), lexicon).count() == 0
    empty = toxicity.learn(docs, labels.limit(0), F.lit(True))
    assert {r["predicted"] for r in toxicity.scored(docs, empty).collect()} == {0}


def test_language_models_agree_with_plain_counts(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(GOOD if i % 3 else GOOD[:4] + ["rare"], k=rng.randint(0, 30))), i % 3 == 0) for i in range(120)]
    rows += [(200, None, True), (201, "", False), (202, "Unknownword, River.", None)]
    frame = spark.createDataFrame(rows, "doc_id int, text string, target boolean").repartition(4)
    models = language.fit(frame, size=10)
    words = [[language.words_of(t) for _, t, _ in rows], [language.words_of(t) for _, t, x in rows if x]]
    counts = [Counter(w for row in part for w in row) for part in words]
    ordered = sorted((w for w, n in counts[0].items() if n >= language.LEAST), key=lambda w: (-counts[0][w], w))
    top = ordered[:10] if len(ordered) <= 10 or counts[0][ordered[9]] != counts[0][ordered[10]] else [w for w in ordered if counts[0][w] > counts[0][ordered[10]]]
    assert len(top) < len(ordered)
    assert sorted(models.known, key=models.known.get) == top
    for c, own, part in zip(counts, models.words, words):
        assert [c[w] for w in top] == own[:-1].tolist()
        assert own.sum() == sum(c.values())
    for part, pairs in zip(words, models.pairs):
        assert pairs.sum() == sum(max(0, len(row) - 1) for row in part)
    out = {r["doc_id"]: r for r in language.scored(frame, models).collect()}
    assert out[200]["score"] == 0.0 and out[201]["n_tokens"] == 0
    for i, text, _ in rows[:20]:
        row = language.words_of(text)
        if not row:
            continue
        losses = []
        for c, part, pairs in zip(models.words, words, models.pairs):
            ids = [models.known.get(w, len(top)) for w in row]
            single = [(x + language.ALPHA) / (c.sum() + language.ALPHA * len(c)) for x in c.tolist()]
            after = Counter((models.known.get(a, len(top)), models.known.get(b, len(top))) for r in part for a, b in zip(r, r[1:]))
            total = -math.log(single[ids[0]])
            for a, b in zip(ids, ids[1:]):
                p = single[b]
                if c[a]:
                    p = language.PAIR_SHARE * min(1.0, after[a, b] / c[a]) + (1 - language.PAIR_SHARE) * p
                total -= math.log(p)
            losses.append(total / len(row))
        assert out[i]["score"] == pytest.approx(losses[0] - losses[1], abs=1e-9)
    target = [out[i]["score"] for i in range(0, 120, 3) if out[i]["n_tokens"]]
    others = [out[i]["score"] for i in range(1, 120, 3) if out[i]["n_tokens"]]
    assert sum(target) / len(target) > sum(others) / len(others)


def test_empty_corpora(spark):
    empty = spark.createDataFrame([], "doc_id int, text string, target boolean")
    models = language.fit(empty)
    assert language.scored(empty, models).count() == 0
    one = spark.createDataFrame([(1, "word")], "doc_id int, text string")
    assert math.isfinite(language.scored(one, models).first()["score"])


def test_every_pair_has_its_own_count(spark, monkeypatch):
    """More distinct pairs than the 2 ** 20 hashed places there once were, over several chunks and ranges."""
    rng = np.random.default_rng(4)
    words = 3000
    texts = [" ".join(f"w{x}" for x in rng.integers(0, words, size=20_000)) for _ in range(80)]
    frame = spark.createDataFrame([(i, t, i % 4 == 0) for i, t in enumerate(texts)], "doc_id int, text string, target boolean").repartition(4)
    monkeypatch.setattr(language, "CHUNK", 90_000)
    monkeypatch.setattr(language, "RANGE", 200_000)
    after = [Counter(), Counter()]
    single = [Counter(), Counter()]
    for i, t in enumerate(texts):
        own = t.split()
        for m in range(2 if i % 4 == 0 else 1):
            single[m].update(own)
            after[m].update(zip(own, own[1:]))
    assert len(after[0]) > 1 << 20
    models = language.fit(frame)
    assert [len(p[p > 0]) for p in models.pairs] == [len(a) for a in after]
    whole = {r["doc_id"]: r for r in language.fitted_and_scored(frame).collect()}
    apart = {r["doc_id"]: r for r in language.scored(frame.where("doc_id < 3"), models).collect()}
    for i in (0, 1, 2):
        own = texts[i].split()
        for got, without in ((whole[i], True), (apart[i], False)):  # a document of the corpus is scored without itself
            losses = []
            for m, (c, pairs) in enumerate(zip(single, after)):
                if without and (m == 0 or i % 4 == 0):
                    c, pairs = c - Counter(own), pairs - Counter(zip(own, own[1:]))
                p = [(c[w] + language.ALPHA) / (c.total() + language.ALPHA * (len(single[0]) + 1)) for w in own]
                mixed = [language.PAIR_SHARE * pairs[a, b] / c[a] + (1 - language.PAIR_SHARE) * x if c[a] else x for a, b, x in zip(own, own[1:], p[1:])]
                losses.append(-sum(map(math.log, [p[0], *mixed])) / len(own))
            assert (got["background_loss"], got["target_loss"]) == pytest.approx(losses, abs=1e-9)
    assert len(whole) == 80


def test_labels_without_signal_give_scores_without_signal(spark):
    rng = random.Random(21)
    rows = [(i, " ".join(f"w{rng.randint(0, 900)}" for _ in range(40)), rng.random() < 0.5) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id int, text string, target boolean")
    out = {r["doc_id"]: r["score"] for r in language.fitted_and_scored(frame).collect()}
    mean = [np.mean([out[i] for i, _, x in rows if x is of]) for of in (True, False)]
    spread = np.std(list(out.values()))
    assert abs(mean[0] - mean[1]) < 0.5 * spread


def test_language_model_edges(spark):
    empty = spark.createDataFrame([], "doc_id int, text string, target boolean")
    assert language.fitted_and_scored(empty).count() == 0
    rows = [(1, "a b a b c " * 30_000, True), (2, None, None), (2, "", False), (3, "one", True), (3, "one", True)]
    got = [tuple(r) for r in language.fitted_and_scored(spark.createDataFrame(rows, "doc_id int, text string, target boolean")).collect()]
    assert len(got) == 5 and all(math.isfinite(x) for r in got for x in r[-3:])
    assert [r[-1] for r in got if r[0] == 2] == [0.0, 0.0]


def test_every_word_with_enough_occurrences_is_in_the_vocabulary(spark):
    words = [f"w{i}" for i in range(120_000)]
    rows = [(i, " ".join(words + ["twice"] * (i < 2)), i == 0) for i in range(3)]
    frame = spark.createDataFrame(rows, "doc_id int, text string, target boolean")
    models = language.fit(frame)
    assert set(models.known) == set(words) and sorted(models.known.values()) == list(range(len(words)))
    assert models.unknown.tolist() == [2, 1]
    # all words tie beyond the wanted size: none is more frequent, every word is the unknown one
    none = language.fit(frame, size=10)
    assert none.known == {} and none.unknown.tolist() == [360_002, 120_001]
    assert {r["n_tokens"] for r in language.scored(frame, none).collect()} == {120_000, 120_001}


def test_marks_at_the_end_and_long_runs_are_read_as_letters():
    words = ["idiot", "loser", "asshole", "whore", "pathetic", "clowns", "useless", "word"]
    matcher = toxicity.Lexicon({w: 2.0 for w in words}).matcher()
    for disguised in ["idi07", "l053r", "asshol3", "wh0r3", "p47h371c", "cl0wn5", "u5el3s5", "word$$$", "1d10t"]:
        assert matcher.weight(toxicity.folded(f"you {disguised} there")) == 2.0, disguised
    assert matcher.weight(toxicity.folded("paid 100 $ in 2015")) == 0.0
