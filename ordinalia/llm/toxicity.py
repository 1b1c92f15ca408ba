"""Toxicity: a weighted lexicon matched by Aho-Corasick, normalised by length, with exception phrases.

Texts are folded first: lower case, homoglyphs of other scripts and digit substitutions become plain letters, so that
a disguised word meets its lexicon entry.  One automaton holds the lexicon and the exception phrases; a hit counts if
it stands between word breaks (entries that end in * match as the start of a word) and not inside an exception.
The weight of the hits, per square root of the number of words, goes through a sigmoid.

Words, word starts and weights are learned from labelled rows: log-odds of the class of toxic rows against the others.
A word is an entry if it marks toxic rows with a lower confidence bound; a phrase of an entry and a neighbour
is an exception if it is common in rows that are not toxic.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordinalia.llm.common import without
from ordinalia.llm.labelled import sample

#: Look-alikes of Latin letters in other scripts, and digits and marks that stand for letters (fixed values).
HOMOGLYPHS = dict(zip("аеорсхуіјѕԁһкмтнвαεορτυικνχ", "aeopcxyijsdhkmthbaeoptuiknx", strict=True))
DIGITS = dict(zip("0134578@$", "oieastbas", strict=True))
_FOLD = str.maketrans(HOMOGLYPHS)
_DIGIT = str.maketrans(DIGITS)
#: One or two such digits or marks before a letter, inside a word or at its start.
_MIXED = re.compile(r"(?<![0-9@$])[0134578@$]{1,2}(?=[^\W\d_])")
#: Any run of them after a letter, for the second reading.
_AFTER = re.compile(r"(?<=[^\W\d_])[0134578@$]+")
WORD = re.compile(r"[^\W\d_]{2,}")

#: Bounds of the sample: rows of each class, code points in all; lengths of word starts.
PER_CLASS, CODE_POINTS, STARTS = 4000, 60_000_000, (3, 4, 5, 6)
#: A word enters if the lower end of its log-odds (this many standard errors) is above the floor,
#: and if so many toxic rows, and such a share of them, hold it.
ERRORS, FLOOR, LEAST_ROWS, LEAST_SHARE = 2.0, 1.5, 4, 0.005
#: Words that an entry must follow at least (or half as many as the toxic rows that hold it); rows for an exception.
CONTEXTS, EXCEPTION_ROWS = 8, 5


def folded(text: str) -> str:
    """Lower case, homoglyphs as Latin letters, digits and marks inside a word as the letters they stand for."""
    low = text.lower()
    if not low.isascii():
        low = low.translate(_FOLD)
    return _MIXED.sub(lambda m: m[0].translate(_DIGIT), low)


def reread(low: str) -> str:
    """The second reading of a folded text: all marks that follow a letter are letters too; of the same length."""
    return _AFTER.sub(lambda m: m[0].translate(_DIGIT), low)


class Lexicon:
    """entries: word or ``start*`` -> weight; exceptions: phrases; bias and slope of the score."""

    def __init__(self, entries: dict[str, float], exceptions: Iterable[str] = (), bias: float = 1.0, slope: float = 4.0) -> None:
        self.entries, self.exceptions, self.bias, self.slope = entries, sorted(exceptions), bias, slope

    def matcher(self) -> Matcher:
        return Matcher(self)


class Matcher:
    def __init__(self, lexicon: Lexicon) -> None:
        import ahocorasick

        self.lexicon = lexicon
        self.automaton = ahocorasick.Automaton()
        known: dict[str, list] = {}  # length, weight as a word, weight as a start, exception
        for entry, weight in lexicon.entries.items():
            stem = entry.rstrip("*")
            known.setdefault(stem, [len(stem), 0.0, 0.0, False])[2 if entry.endswith("*") else 1] = weight
        for phrase in lexicon.exceptions:
            known.setdefault(phrase, [len(phrase), 0.0, 0.0, False])[3] = True
        for pattern, facts in known.items():
            self.automaton.add_word(pattern, tuple(facts))
        if len(self.automaton):
            self.automaton.make_automaton()

    def hits(self, text: str) -> list[tuple[int, int, float]]:
        """Start, end (code points of the folded text) and weight of each hit; the heaviest of a word counts."""
        if not len(self.automaton) or not text:
            return []
        found: dict[int, tuple[int, int, float]] = {}
        covered: list[tuple[int, int]] = []
        size = len(text)
        for last, (length, whole, start, exception) in self.automaton.iter(text):
            at, end = last - length + 1, last + 1
            if at and text[at - 1].isalpha():
                continue
            ends = end == size or not text[end].isalpha()
            if exception and ends:
                covered.append((at, end))
            weight = whole if ends else start  # a start stands for longer words, as in learning
            if weight > found.get(at, (0, 0, 0.0))[2]:
                found[at] = (at, end, weight)
        return [h for h in found.values() if not any(a <= h[0] and h[1] <= b for a, b in covered)]

    def weight(self, low: str) -> float:
        """Weight of the hits of a folded text; of its two readings the heavier hit of a word counts."""
        found = {h[0]: h[2] for h in self.hits(low)}
        second = reread(low)
        if second != low:
            for at, _, weight in self.hits(second):
                found[at] = max(weight, found.get(at, 0.0))
        return sum(found.values())

    def score(self, text: str) -> float:
        low = folded(text)
        words = len(low.split())
        weight = self.weight(low)
        z = self.lexicon.slope * (weight / math.sqrt(max(words, 1)) - self.lexicon.bias)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def learn_lexicon(rows: Iterable[tuple[str, int]]) -> Lexicon:
    """Entries, exceptions and score scale from (text, label) rows; without rows of both classes the lexicon is empty."""
    docs = [(folded(text), label) for text, label in rows]
    size = Counter(label for _, label in docs)
    if not size[1] or not size[0]:
        return Lexicon({})
    seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for text, label in docs:
        kinds = set(WORD.findall(text))
        seen[label].update(kinds | {f"{w[:n]}*" for w in kinds for n in STARTS if len(w) > n})
    entries = {}
    for entry, toxic in seen[1].items():
        if toxic < max(LEAST_ROWS, LEAST_SHARE * size[1]):
            continue
        a, b = toxic + 0.5, seen[0][entry] + 0.5
        odds = math.log(a / (size[1] + 1 - a + 0.5)) - math.log(b / (size[0] + 1 - b + 0.5))
        error = math.sqrt(1 / a + 1 / b)
        if odds - ERRORS * error > FLOOR:
            entries[entry] = round(odds - ERRORS * error, 4)
    entries = _spread(docs, entries, seen[1])
    # a start that says no more than one longer entry goes; then what a remaining start covers goes
    for entry in sorted((e for e in entries if e.endswith("*")), key=len, reverse=True):
        if any(other.startswith(entry[:-1]) and weight > entries[entry] - 0.25 for other, weight in entries.items() if other != entry):
            del entries[entry]
    for entry in sorted(entries, key=len, reverse=True):
        stem = entry.rstrip("*")
        if any(entries.get(f"{stem[:n]}*", 0.0) >= entries[entry] for n in STARTS if n < len(stem)):
            del entries[entry]
    entries = dict(sorted(entries.items(), key=lambda x: (-x[1], x[0])))
    exceptions = _exceptions(docs, entries)
    lexicon = Lexicon(entries, exceptions)
    matcher = lexicon.matcher()
    marks = [(matcher.weight(t) / math.sqrt(max(1, len(t.split()))), label) for t, label in docs]
    lexicon.bias = _cut(marks, size)
    lexicon.slope = 4.0 / max(lexicon.bias, 1e-6)
    return lexicon


def _spread(docs: list[tuple[str, int]], entries: dict[str, float], rows: Counter) -> dict[str, float]:
    """Entries that follow different words in the toxic rows; those that come with one copied passage go."""
    before: dict[str, set[str]] = {entry: set() for entry in entries}
    for text, label in docs:
        if label:
            words = WORD.findall(text)
            for last, word in zip(["", *words], words):
                for entry in (word, *(f"{word[:n]}*" for n in STARTS if len(word) > n)):
                    if entry in before:
                        before[entry].add(last)
    return {entry: weight for entry, weight in entries.items() if len(before[entry]) >= min(CONTEXTS, rows[entry] / 2)}


def _exceptions(docs: list[tuple[str, int]], entries: dict[str, float]) -> set[str]:
    """Two-word phrases with an entry that are far commoner in rows that are not toxic."""
    plain, toxic = Counter(), Counter()
    for text, label in docs:
        words = WORD.findall(text)
        pairs = {f"{a} {b}" for a, b in zip(words, words[1:]) if a in entries or b in entries}
        (toxic if label else plain).update(pairs)
    return {p for p, n in plain.items() if n >= EXCEPTION_ROWS and n > 4 * toxic[p]}


def _cut(marks: list[tuple[float, int]], size: Counter) -> float:
    """Weight per root of length above which errors, as shares of either class, are fewest; midway to the next value."""
    tally: dict[float, list[int]] = {}
    for mark, label in marks:
        tally.setdefault(mark, [0, 0])[label] += 1
    values = sorted(tally)
    missed, false, best, at = 0.0, 1.0, None, values[-1] + 1.0
    for value, after in zip(values, [*values[1:], values[-1] + 1.0]):
        missed += tally[value][1] / size[1]
        false -= tally[value][0] / size[0]
        wrong = missed + false
        if best is None or wrong < best - 1e-12:
            best, at = wrong, (value + after) / 2
    return max(at, 1e-3)


def learn(docs: DataFrame, labels: DataFrame, allowed: Column, label: str = "toxic", per_class: int = PER_CLASS) -> Lexicon:
    """Lexicon from whole texts of a bounded sample, read partition by partition up to CODE_POINTS code points."""

    def rows() -> Iterator[tuple[str, int]]:
        total = 0
        for r in sample(docs, labels, label, allowed, per_class).orderBy(F.xxhash64("doc_id"), "doc_id").toLocalIterator():
            total += len(r["text"])
            if total > CODE_POINTS:
                return
            yield r["text"], r["label"]

    return learn_lexicon(rows())


def scored(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` to every row; the whole text is matched.

    A null or empty text has no hits.  Rows and other columns stay, columns of these names are replaced.
    """
    kept = without(docs, text, "score", "predicted")
    at = kept.columns.index(text)
    sent = docs.sparkSession.sparkContext.broadcast(lexicon.__dict__)  # the sample bounds the entries and their exceptions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        matcher = Lexicon(**known).matcher()
        for batch in batches:
            scores = [matcher.score(x.as_py() or "") for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())],
                names=[*batch.schema.names, "score", "predicted"],
            )

    return kept.mapInArrow(run, kept.withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0)).schema)
