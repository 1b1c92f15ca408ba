"""Spelling variants: words within one edit of each other, by dynamic programming over sorted vocabularies.

A vocabulary is scanned in sorted order.  For a word, the banded rows of its edit matrix (three cells: one edit) are
kept for each prefix of the current entry; the next entry shares a prefix with it (their LCP), so only the rows behind
that prefix are computed.  Where all cells of a row exceed one edit, every entry with that prefix is skipped at
once.

The vocabulary is not held in one place.  Two near words with a shorter length l agree in their first p code points, p
being the length of their common prefix, and in their last l - p (a replaced code point: l - p - 1).  So either p is
at least half of l, and they share their first half, or it is less, and they share the rest.  Words are therefore
dealt out twice for each shorter length they can stand in: by their first half, sorted as they are, and by their
last, sorted backwards.  A group of more than GROUP words is halved again in the same way: it covers a window of
values of p, and both halves of the window again mean a longer shared part.  A pair has one p, so it is found in one
group only.  At a window of one place, words differ in that place only and the alphabet bounds the group.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordinalia.llm.common import batches_of, text_of, written
from ordinalia.runtime import checked_broadcast, cut

#: Fixed values of the contract: least code points and occurrences of a word, one run in CHANGED loses a code point,
#: times that a form is as frequent as its variant.
LEAST_LENGTH, LEAST, CHANGED, TIMES = 5, 3, 97, 2
#: Words of a group; distinct words that a task counts before it hands them on; texts in an Arrow batch.
GROUP, COUNTED, TEXTS = 5000, 300_000, 2000
#: Latin-1 codes: A-Z become a-z, other letters stay, all else is a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def counted(text: str, key: object, counts: Counter) -> None:
    """Adds the words of a text: its runs of letters in lower case, some of them with a code point deleted."""
    start = zlib.crc32(f"{'' if key is None else key}:".encode())
    runs = Counter(text.encode("latin-1", "replace").translate(_FOLD).split())
    for run, n in runs.items():
        if len(run) < LEAST_LENGTH:
            continue  # too short with or without a deletion
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if h % CHANGED == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < LEAST_LENGTH:
                continue
        counts[run] += n


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word`` and ``n`` of every word with LEAST or more occurrences in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in counts], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        counts: Counter = Counter()
        for batch in batches:
            for key_, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                counted(value.as_py(), key_, counts)
                if len(counts) > COUNTED:
                    yield out()
                    counts.clear()
        yield out()

    rows = docs.select(F.col(key).cast("string").alias("key"), text_of(text).alias("text"))
    with batches_of(docs.sparkSession, TEXTS):
        parts = rows.mapInArrow(run, "word string, n bigint")
        return written(parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST))


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows (word, n, l, lo, hi) with their group ``g`` and ``w``, the word in the direction in which it is sorted."""
    tail = F.greatest(F.col("l") - F.col("hi"), F.lit(0))
    ends = F.when(tail > 0, F.expr("substring(word, -greatest(l - hi, 0))")).otherwise(F.lit(""))
    g = F.concat_ws(" ", "l", "lo", "hi", F.expr("substring(word, 1, lo)"), ends)
    return rows.select("word", "n", "l", "lo", "hi", g.alias("g"), F.when(F.col("lo") == 0, F.reverse("word")).otherwise(F.col("word")).alias("w"))


def _halved(rows: DataFrame) -> DataFrame:
    """Both halves of the windows."""
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    halves = F.array(F.struct("lo", middle.alias("hi")), F.struct(middle.alias("lo"), "hi"))
    return _dealt(rows.select("word", "n", "l", F.explode(halves).alias("h")).select("word", "n", "l", "h.*"))


def groups(words: DataFrame) -> DataFrame:
    """Every word in its groups: shorter length ``l``, window ``lo`` to ``hi`` (exclusive) of common prefixes."""
    lower = F.explode(F.array(F.length("word") - 1, F.length("word"))).alias("l")
    rows = words.select("word", "n", lower).where(F.col("l") >= LEAST_LENGTH)
    rows = _halved(rows.withColumn("lo", F.lit(0)).withColumn("hi", F.col("l") + 1))
    while True:
        large = cut(rows.where("hi - lo > 1").groupBy("g").count().where(F.col("count") > GROUP).select("g"))
        if large.isEmpty():
            return rows
        large = checked_broadcast(large)
        rows = written(rows.join(large, "g", "left_anti").select(*rows.columns).unionAll(_halved(rows.join(large, "g", "left_semi"))))


def near(words: list[str]) -> Iterator[tuple[int, int]]:
    """Places of all pairs of the sorted distinct ``words`` that are one edit apart."""
    size = len(words)
    shared = [0] * size  # LCP with the entry before
    for j in range(1, size):
        a, b = words[j - 1], words[j]
        k, most = 0, min(len(a), len(b))
        while k < most and a[k] == b[k]:
            k += 1
        shared[j] = k
    beyond = [size] * size  # the next entry with a shorter LCP
    for j in range(size - 2, 0, -1):
        k = j + 1
        while k < size and shared[k] >= shared[j]:
            k = beyond[k]
        beyond[j] = k
    longest = max(map(len, words), default=0)
    rows: list[tuple[int, int, int]] = [(2, 0, 1)] * (longest + 2)
    for i, own in enumerate(words):
        length = len(own)
        padded = f"\0{own}\0\0\0"
        for d in range(1, length + 1):  # the word itself
            rows[d] = (1, 0, 1)
        j, known = i + 1, length
        while j < size:
            entry = words[j]
            known = min(known, shared[j])
            end = len(entry)
            # cells: entry[:d] against own[:d - 1], own[:d], own[:d + 1]
            a, b, c = rows[known]
            d = known
            while d < end:
                x = entry[d]
                a = a + 1 if x != padded[d] else a
                if b < a:
                    a = b + 1
                b = b + 1 if x != padded[d + 1] else b
                if c < b:
                    b = c + 1
                if a < b:
                    b = a + 1
                c = c + 1 if x != padded[d + 2] else c
                if b < c:
                    c = b + 1
                d += 1
                rows[d] = (a, b, c)
                if a > 1 and b > 1 and c > 1:
                    break
            else:
                apart = length - end
                if (b if apart == 0 else a if apart == -1 else c if apart == 1 else 2) == 1:
                    yield i, j
                j += 1
                known = d
                continue
            while j < size:  # all entries with the dead prefix
                j = beyond[j] if shared[j] >= d and j > i + 1 else j + 1
                if j < size and shared[j] < d:
                    break
            known = d - 1
    return


def variants(rows: DataFrame) -> DataFrame:
    """``word``, ``n_near`` and ``best`` (negated count and near word) from every group that has near words of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(entries: list[dict]) -> Iterator[pa.RecordBatch]:
            short, hi, backwards = entries[0]["l"], entries[0]["hi"], entries[0]["lo"] == 0
            words, counts = [e["w"] for e in entries], [e["n"] for e in entries]
            plain = [w[::-1] for w in words] if backwards else words
            number, best = [0] * len(words), [None] * len(words)
            for i, j in near(words):
                v, w = plain[i], plain[j]
                if (len(v) > short and len(w) > short) or (hi <= short and v[:hi] == w[:hi]):
                    continue  # the pair of another group
                for one, other in ((i, j), (j, i)):
                    number[one] += 1
                    found = (-counts[other], plain[other])
                    if best[one] is None or found < best[one]:
                        best[one] = found
            some = [i for i, n in enumerate(number) if n]
            if some:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([plain[i] for i in some], pa.string()),
                        pa.array([number[i] for i in some], pa.int64()),
                        pa.array([best[i][0] for i in some], pa.int64()),
                        pa.array([best[i][1] for i in some], pa.string()),
                    ],
                    names=["word", "n_near", "less", "other"],
                )

        group, entries = None, []
        for batch in batches:
            for e in batch.to_pylist():
                if e["g"] != group:
                    if len(entries) > 1:
                        yield from done(entries)
                    group, entries = e["g"], []
                entries.append(e)
        if len(entries) > 1:
            yield from done(entries)

    dealt = rows.select("g", "w", "n", "l", "lo", "hi").repartition("g").sortWithinPartitions("g", "w")
    found = dealt.mapInArrow(run, "word string, n_near bigint, less bigint, other string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "other")).alias("best"))


def grouped(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every word with its form, the root over its forms, and counts: word, form, root, n, n_near, form_n.

    A word's form is its near word (one code point inserted, deleted or replaced) with the largest count, if that is
    TIMES its own; ties go to the smaller word in code-point order.  Null and empty texts have no words, very long ones
    are read whole; repeated rows count as often as they are there; a null key counts as an empty one.  An empty table
    gives no words.  Other columns are not read, whatever their names.
    """
    words = vocabulary(docs, key, text)
    found = words.join(variants(groups(words)), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), (-F.col("best.less")).alias("most"), "best.other"
    )
    of = F.col("most") >= TIMES * F.col("n")
    found = written(found.select("word", "n", "n_near", F.when(of, F.col("other")).alias("form"), F.when(of, F.col("most")).alias("form_n")))
    # counts at least double along the forms, so few jumps over ever longer ways reach the roots
    forms = found.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    moved = True
    while moved:
        step = forms.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = written(forms.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        moved = not new.where("moved").isEmpty()
        forms = new.select("word", "root")
    return found.join(forms, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
