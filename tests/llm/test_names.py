"""User columns whose names clash with those of the operators."""

from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from ordinalia.llm import licences, pieces, quality, rules, secrets, toxicity

TEXT = 'token = "abcdefgh" Permission is hereby granted. ' + "word other " * 40
OWN = ["_t", "_added", "_tokens", "_row", "_w", "_l", "_s", "share", "_c0", "x"]


def run(name, docs):
    if name == "secrets":
        return secrets.scan(docs, with_text=True)
    if name == "rules":
        return rules.judge(docs)
    if name == "licences":
        return licences.scan(docs)
    if name == "pieces":
        return pieces.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"))
    labels = docs.select("doc_id", F.lit(1).alias("label"))
    if name == "quality":
        return quality.scored(docs, quality.learn(docs, labels.withColumnRenamed("label", "quality"), F.lit(True)))
    return toxicity.scored(docs, toxicity.Lexicon({"word": 1.0}, []))


@pytest.mark.parametrize(
    ("name", "taken"),
    [
        ("secrets", ["Base", "SPANS"]), ("rules", ["N_words", "Kept"]), ("licences", ["Licences"]),
        ("pieces", ["Bounds", "IDS"]), ("quality", ["Score", "PREDICTED"]), ("toxicity", ["Predicted"]),
    ],
)
def test_clashing_names(spark, name, taken):
    docs = spark.createDataFrame([(1, TEXT), (2, None)], "doc_id bigint, text string")
    plain = [r.asDict() for r in run(name, docs).orderBy("doc_id").collect()]
    odd = docs
    for i, c in enumerate([*OWN, *taken]):
        odd = odd.withColumn(c, F.lit(100 + i))
    out = run(name, odd).orderBy("doc_id")
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    for got, want in zip([r.asDict() for r in out.collect()], plain):
        assert {k: v for k, v in got.items() if k in want} == want
        assert [got[c] for c in OWN] == [100 + i for i in range(len(OWN))]
