"""Jaccard join, nearest neighbours, pipeline."""

from __future__ import annotations

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ordinalia.llm import neighbours, ngram_join, secrets, toxicity


def corpus(seed, copies=14):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 400)}"
    texts = [None, "", "  \n", "One", "one", "one two", "ONE two", "one two three"]
    passage = [word() for _ in range(30)]
    for _ in range(25):
        base = [word() for _ in range(rng.choice([3, 5, 8, 12, 20, 60, 150]))]
        if rng.random() < 0.5:
            base += passage
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, copies)):
            other = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                other[rng.randrange(len(other))] = word()
            texts.append(" ".join(other).replace("w", rng.choice(["w", "W"])))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(
    ("n", "num", "frequent", "dense", "bits"),
    [(3, 90, 32, 6, 27), (3, 90, 3, 1, 27), (5, 80, 2, 2, 27), (2, 60, 2, 1, 10), (1, 50, 4, 6, 12)],
)
def test_components_agree_with_all_pairs(spark, monkeypatch, n, num, frequent, dense, bits):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_join, "DENSE", dense)  # 1: every key is dense
    monkeypatch.setattr(ngram_join, "BLOCK", 3 + 10 * dense)
    monkeypatch.setattr(ngram_join, "STRIP", 2)
    monkeypatch.setattr(ngram_join, "MAP_BITS", bits)
    rows = corpus(n)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("node", F.lit("x")).repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.linked(frame, n, (num, 100)).collect()}
    assert got == brute.components(rows, n, num, 100)


def test_join_with_sent_sets_and_with_a_join(spark, monkeypatch):
    rows = corpus(77, copies=3)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    wanted = brute.components(rows, 3, 90, 100)
    monkeypatch.setattr(ngram_join, "SENT", 0)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.linked(frame, 3, (90, 100)).collect()}
    assert got == wanted


def test_index_keys_meet_for_every_similar_pair():
    """Sets of a shared order: whenever two reach the threshold they have a key in common."""
    rng = random.Random(5)
    universe = np.unique(np.array([rng.getrandbits(64) for _ in range(600)], dtype=np.uint64))
    often = np.sort(universe[::2] >> np.uint64(20))
    full = np.full(1 << (ngram_join.MAP_BITS - 3), 255, dtype=np.uint8)
    order = ngram_join.Order(20, full, often, np.arange(len(often)) % 7)
    met = 0
    for _ in range(1500):
        num = rng.choice([60, 80, 90])
        x = rng.sample(universe.tolist(), rng.choice([1, 2, 6, 7, 8, 9, 15, 16, 17, 40, 130]))
        y = set(x)
        for _ in range(rng.randint(0, max(1, len(x) // 4))):
            y.symmetric_difference_update([rng.choice(universe.tolist())])
        if not y:
            continue
        both = len(set(x) & y)
        if 100 * both >= num * (len(x) + len(y) - both):
            met += 1
            a, b = (ngram_join.keys_of(np.array(sorted(s), dtype=np.uint64), order, num, 100)[0] for s in (x, y))
            assert len(np.intersect1d(a, b))
    assert met > 300


def test_join_edges(spark):
    rows = [(7, "a b c d"), (7, "a b c d"), (None, "a b c d"), (3, "A B C D"), (9, "word " * 60_000), (8, None), (8, None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(tuple(r) for r in ngram_join.linked(frame, 3, (90, 100)).fillna(-1).collect())
    assert got == [(-1, 2, 3), (3, 2, 3), (7, 2, 3), (7, 2, 3), (8, 0, 8), (8, 0, 8), (9, 1, 9)]
    assert ngram_join.linked(frame.limit(0)).count() == 0


def nearest_by_force(rows, queries, k):
    good = [(i, np.array(v, dtype=float)) for i, v in rows if v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v)]
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good])
    length = np.sqrt((x * x).sum(1))
    out = {}
    for q in queries:
        if q not in ids:
            continue
        at = int(np.flatnonzero(ids == q)[0])
        score = neighbours.cosine(x[at], x, length)
        order = sorted((-s, i) for s, i in zip(score, ids) if i != q)[:k]
        out[q] = [(i, -s) for s, i in order]
    return out


def test_neighbours_find_the_nearest(spark):
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(30, 16))
    rows = [(i, (middle[i % 30] + 0.4 * rng.normal(size=16)).astype("f4").tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[7][1]) for i in range(300)]  # one vector many times
    rows += [(5000, None), (5001, []), (5050, [0.0] * 16), (5051, [float("nan")] * 16), (5052, [1.0] * 15 + [None]), (5053, [1.0, 2.0]), (None, [1.0] * 16)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", F.lit(1)).repartition(4)
    wanted = nearest_by_force([r for r in rows if r[0] is not None and (r[1] is None or len(r[1]) != 2)], range(0, 6000, 50), 5)
    got: dict = {}
    for r in neighbours.nearest(frame, F.col("id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(wanted) and all(len(x) == 5 for x in got.values())
    found = sum(len({i for i, _ in got[q]} & {i for i, _ in wanted[q]}) for q in wanted)
    assert found >= 0.9 * 5 * len(wanted)
    for q, mine in got.items():
        exact = dict(wanted[q])
        assert all(s == pytest.approx(exact[i], abs=1e-12) for i, s in mine if i in exact)
        assert mine == sorted(mine, key=lambda x: (-x[1], x[0]))
    whole: dict = {}  # with every cell visited the result is exact, ties included
    for r in neighbours.nearest(frame, F.col("id") % 50 == 0, wanted=10**9).orderBy("query_id", "rank").collect():
        whole.setdefault(r["query_id"], []).append(r["vec_id"])
    assert whole == {q: [i for i, _ in x] for q, x in wanted.items()}


def test_cells_come_in_order_of_summed_distance():
    rng = np.random.default_rng(1)
    a, b = rng.random(7), rng.random(5)
    cells = neighbours.visits(a, b, dict.fromkeys(range(35), 1), 35)
    assert cells == sorted(range(35), key=lambda c: a[c // 5] + b[c % 5])
    assert neighbours.visits(a, b, dict.fromkeys(range(35), 10), 35) == cells[:4]


def test_few_vectors(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (50, [0.0, 1.0]), (3, [1.0, 1.0])], "vec_id int, embedding array<double>")
    got = [tuple(r)[:3] for r in neighbours.nearest(frame, F.col("id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 3), (0, 2, 50), (50, 1, 3), (50, 2, 0)]
    assert neighbours.nearest(frame.limit(0), F.col("id") % 50 == 0).count() == 0


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """The smallest tables with edges added."""
    where = tmp_path_factory.mktemp("tables")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    more = docs.limit(3).unionAll(docs.limit(1).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(10**6)))
    none = docs.limit(1).withColumn("doc_id", F.lit(None).cast("bigint"))
    docs.unionAll(more).unionAll(none).withColumn("score", F.lit("kept")).write.parquet(f"{where}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{where}/labels.parquet")
    return str(where)


def test_stages_against_plain_python(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    for name in ("quality classifier", "toxicity"):
        kept = stage[name](spark, docs, small)
        assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
        assert kept.exceptAll(docs).isEmpty()

    near = stage["n-gram Jaccard join"](spark, docs, small)
    assert near.columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in docs.where("doc_id IS NOT NULL").collect()]
    wanted = brute.components(list(dict(rows).items()), 5, 80, 100)
    assert sorted(r["doc_id"] for r in near.collect()) == sorted({c for _, c in wanted.values()})

    masked = stage["secret scans"](spark, docs, small)
    assert masked.columns == docs.columns and masked.count() == docs.count()
    assert sum(len(brute.base_secrets(r["text"])) for r in masked.collect()) == 0
    changed = masked.exceptAll(docs).collect()
    assert len(changed) == sum(bool(brute.base_secrets(t)) for _, t in [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert all(r["n_chars"] == len(r["text"]) for r in changed)


def test_stages_on_an_empty_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, small).count() == 0, name


def test_run_is_the_stages_in_order(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, small))
    pick = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, docs.select(pick).collect())) == sorted(map(tuple, corpus_pipeline.run(spark, small).select(pick).collect()))
    assert secrets.KINDS[3] == "random" and toxicity.PER_CLASS > 0


@pytest.mark.parametrize("name", [f"op{i}_" for i in range(1, 11)])
def test_registered_queries_return_a_row_for_each_document(spark, name):
    import __spark_entry__

    queries = {k: v for k, v in __spark_entry__.queries().items() if k.startswith(name)}
    assert len(queries) == 1
    frame = next(iter(queries.values()))(spark, "/root/testdata/sf0.001")
    key = {"op8_": "query_id"}.get(name, "doc_id")
    ids = {r[0] for r in frame.select(key).distinct().collect()}
    table = "embeddings" if name == "op8_" else "documents"
    own = {r[0] for r in spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").select("vec_id" if name == "op8_" else "doc_id").collect()}
    assert ids == ({i for i in own if i % 50 == 0} if name == "op8_" else own)


@pytest.mark.parametrize(("num", "shared"), [(50, 6), (60, 6)])
def test_pairs_of_few_shared_frequent_tokens_have_a_common_key(num, shared):
    rng = random.Random(9)
    full = np.full(1 << (ngram_join.MAP_BITS - 3), 255, dtype=np.uint8)
    for _ in range(300):
        tokens = [rng.getrandbits(64) for _ in range(16 - shared)]
        often = np.sort(np.array(tokens, dtype=np.uint64) >> np.uint64(20))
        order = ngram_join.Order(20, full, often, np.arange(len(often)) % 3)
        x, y = tokens[:8], tokens[8 - shared : 16 - shared]
        assert 100 * shared >= num * (16 - shared)
        a, b = (ngram_join.keys_of(np.array(sorted(s), dtype=np.uint64), order, num, 100)[0] for s in (x, y))
        assert len(np.intersect1d(a, b))


def test_one_id_on_two_texts(spark):
    base = [f"w{i}" for i in range(60)]
    near, alone = " ".join([*base[:59], "other"]), " ".join(f"v{i}" for i in range(40))
    twin = [f"u{i}" for i in range(60)]
    rows = [(1, " ".join(base)), (2, near), (2, alone), (3, " ".join(twin)), (3, " ".join([*twin[:59], "end"])), (None, alone + " x")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    left = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, frame, "").collect()]
    assert (1, rows[0][1]) in left and (2, alone) in left
    assert [i for i, _ in left].count(3) == 1 and len(left) == 3
