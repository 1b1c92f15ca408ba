"""Quality rules as weak supervision [native].

Rules look at counts of a text and vote good, vote bad or abstain.  Bad documents are bad in different ways, so the
latent classes are "good" and one kind of defect per rule; expectation-maximisation over the vote patterns of
*all* documents estimates how each rule votes in each class, and the posterior probability of "good" replaces
"all rules must pass".  Only DataFrame functions touch the documents: what reaches
the driver is one count per vote pattern, at most 3 ** len(RULES) rows whatever the size of the corpus.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordinalia.llm.common import WORD_BREAK, restored, shielded, text_of
from ordinalia.runtime import cut

GOOD, BAD, ABSTAIN = 1, 2, 0
#: name -> (share as SQL over the counts, good where, bad where); a rule abstains elsewhere and on a null share.
RULES: dict[str, tuple[str, str, str]] = {
    "length": ("CAST(n_words AS DOUBLE)", "share >= 80", "share < 50"),
    "word_length": ("word_chars / nullif(n_words, 0)", "share BETWEEN 3 AND 12", "share < 2 OR share > 20"),
    "symbols": ("n_symbols / nullif(n_words, 0)", "share <= 0.02", "share > 0.1"),
    "repetition": ("n_repeat_words / nullif(n_words, 0)", "share <= 0.15", "share > 0.3"),
    "lines": ("n_dup_lines / nullif(n_lines, 0)", "share <= 0.05", "share > 0.5"),
    "capitals": ("n_capitals / nullif(word_chars, 0)", "share <= 0.15", "share > 0.4"),
    "marks": ("n_marks / nullif(n_words, 0)", "share <= 0.3", "share > 0.6"),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks")
WINDOW = 3
ROUNDS = 60


def _left(text: Column, dropped: str) -> Column:
    """Code points of ``text`` that remain when runs of ``dropped`` are cut out."""
    return F.length(F.regexp_replace(text, dropped, "")).cast("bigint")


def _repeated(words: Column) -> Column:
    """Words inside a 3-word window that occurs twice or more in the text.

    A text whose window hashes are all distinct has none.  Otherwise the high bits of each hash are packed with the
    window's position and sorted; neighbours whose bits agree and whose words agree are twins; the words that
    the twins cover are added up.
    """
    rest = lambda k: F.slice(words, F.lit(k), F.size(words))
    pairs = F.zip_with(words, rest(2), lambda a, b: F.xxhash64(a, b))
    windows = F.slice(F.zip_with(pairs, rest(3), lambda a, b: F.xxhash64(a, b)), F.lit(1), F.size(words) - (WINDOW - 1))
    hashes = F.when(F.size(words) > WINDOW, windows).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        bits = F.ceil(F.log2(F.size(h).cast("double") + 1)).cast("int")
        shift = lambda name, x: F.call_function(name, x, bits)
        packed = F.sort_array(F.transform(h, lambda x, i: shift("shiftleft", x).bitwiseOR(i.cast("bigint"))))
        place = lambda x: (x - shift("shiftleft", shift("shiftright", x))).cast("int")
        word = lambda x, k: F.get(words, place(x) + k)

        def total(p: Column) -> Column:
            twins = F.filter(
                F.arrays_zip(p.alias("a"), F.slice(p, F.lit(2), F.size(p)).alias("b")),
                lambda x: (shift("shiftright", x["a"]) == shift("shiftright", x["b"]))
                & (word(x["a"], 0) == word(x["b"], 0))
                & (word(x["a"], 1) == word(x["b"], 1))
                & (word(x["a"], 2) == word(x["b"], 2)),
            )
            at = F.concat(F.transform(twins, lambda x: place(x["a"])), F.transform(twins, lambda x: place(x["b"])))
            return F.aggregate(
                F.sort_array(F.array_distinct(at)),
                F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-WINDOW).alias("last")),
                lambda acc, x: F.struct(
                    (acc["n"] + F.least(F.lit(WINDOW), x - acc["last"])).cast("bigint").alias("n"), x.alias("last")
                ),
                lambda acc: acc["n"],
            )

        return _let(packed, total)

    return _let(
        hashes,
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(covered(h)),
    )


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns COUNTS added for the whole text (null: empty)."""
    whole = docs.withColumn("_t", text_of(text))
    split = whole.withColumn("_w", F.array_remove(F.split("_t", WORD_BREAK, -1), "")).withColumn(
        "_l", F.filter(F.split("_t", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    )
    marks = split.withColumn("_s", F.regexp_replace("_t", r"[^#*$%&|<>A-Z!?;:=]+", ""))
    return (
        marks.withColumn("n_words", F.size("_w").cast("bigint"))
        .withColumn("word_chars", F.length(F.array_join("_w", "")).cast("bigint"))
        .withColumn("n_symbols", _left(F.col("_s"), r"[^#*$%&|<>]+"))
        .withColumn("n_lines", F.size("_l").cast("bigint"))
        .withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint"))
        .withColumn("n_capitals", _left(F.col("_s"), r"[^A-Z]+"))
        .withColumn("n_marks", _left(F.col("_s"), r"[^!?;:=]+"))
        .withColumn("n_repeat_words", _repeated(F.col("_w")))
        .drop("_t", "_w", "_l", "_s")
    )


def votes(counted: DataFrame) -> DataFrame:
    """One column ``vote_<rule>`` per rule: 1 good, 2 bad, 0 abstain (also where a share does not exist)."""
    out = counted
    for name, (share, good, bad) in RULES.items():
        vote = F.when(F.expr(bad), BAD).when(F.expr(good), GOOD).otherwise(ABSTAIN)
        out = out.withColumn("share", F.expr(share)).withColumn(f"vote_{name}", vote).drop("share")
    return out


#: A rule's bad votes are this frequent at least in its own kind of defect, and at most in good documents.
OWN_LEAST, GOOD_MOST = 0.7, 0.02


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> list[tuple[float, list[float]]]:
    """Expectation-maximisation; ``patterns``: (votes, documents).  Returns (weight, bad rate per rule) of each class.

    The first class is "good", then comes a kind of defect for each rule.  A rate is the probability of a bad vote
    given a vote; an abstention says nothing.  Rates are smoothed with one vote on each side, weights with one document;
    OWN_LEAST and GOOD_MOST say that rules are better than chance.  Without documents the start values stay.
    """
    rules = len(RULES)
    model = [(0.8, [0.03] * rules)]
    model += [(0.2 / rules, [0.9 if i == j else 0.1 for i in range(rules)]) for j in range(rules)]
    for _ in range(rounds if patterns else 0):
        weights, tally = [1.0] * (rules + 1), [[[1.0, 1.0] for _ in range(rules)] for _ in range(rules + 1)]
        for votes_, n in patterns:
            shares = class_shares(model, votes_)
            for c, share in enumerate(shares):
                weights[c] += share * n
                for j, vote in enumerate(votes_):
                    if vote:
                        tally[c][j][vote - 1] += share * n
        rates = [[t[1] / (t[0] + t[1]) for t in row] for row in tally]
        rates[0] = [min(r, GOOD_MOST) for r in rates[0]]
        for j in range(rules):
            rates[j + 1][j] = max(rates[j + 1][j], OWN_LEAST)
        total = sum(weights)
        model = [(w / total, r) for w, r in zip(weights, rates)]
    return model


def class_shares(model: list[tuple[float, list[float]]], votes_: tuple[int, ...]) -> list[float]:
    """Posterior probability of each class for a vote pattern."""
    logs = [
        math.log(weight) + sum(math.log(r if v == BAD else 1 - r) for r, v in zip(rates, votes_) if v)
        for weight, rates in model
    ]
    top = max(logs)
    made = [math.exp(x - top) for x in logs]
    return [x / sum(made) for x in made]


def posterior(model: list[tuple[float, list[float]]]) -> Column:
    """Probability of the good class from the ``vote_`` columns."""
    classes = []
    for weight, rates in model:
        terms = [F.lit(math.log(weight))]
        for name, rate in zip(RULES, rates):
            vote = F.col(f"vote_{name}")
            terms.append(F.when(vote == BAD, math.log(rate)).when(vote == GOOD, math.log(1 - rate)).otherwise(0.0))
        classes.append(reduce(lambda a, b: a + b, terms))
    good = classes[0]
    return 1 / (1 + reduce(lambda a, b: a + b, [F.exp(c - good) for c in classes[1:]]))


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """Counts, votes, ``p_good``, ``base_failed`` and ``kept`` for each row of ``docs`` (its text column is dropped).

    ``base_failed``: fewer than 50 words, or more than half of the words in repeated 3-word windows.  A failed
    base is final; every other document is kept if its posterior is at least 0.5.  Null and empty texts fail
    the base; repeated rows stay repeated; an empty table gives an empty table; other columns stay but those of the added names,
    in any case, which are replaced.
    """
    names = [f"vote_{name}" for name in RULES]
    rows, back = shielded(docs, text, *COUNTS, *names, "p_good", "base_failed", "kept")
    voted = cut(restored(votes(counts(rows, text)).drop(text), back))
    patterns = [(tuple(r[:-1]), r[-1]) for r in voted.groupBy(*names).count().orderBy(*names).collect()]
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        voted.withColumn("p_good", posterior(fit(patterns)))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))
    )
