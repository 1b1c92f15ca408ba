"""Helpers of the text operators: table access, null texts, shared intermediate tables."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordinalia.runtime import ensure_checkpoint_dir

#: A word: a run of code points other than space and U+0009 to U+000D.
WORD_BREAK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The whole text; a null text counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def crc32_of_id(column: str = "doc_id") -> Column:
    """crc32 of the decimal id; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    A lost executor then costs a read, not the work before.  For tables of the size of the input;
    small ones use :func:`ordinalia.runtime.cut`.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def without(docs: DataFrame, text: str, *names: str) -> DataFrame:
    """``docs`` without the columns of these names, in upper or lower case, but with its text."""
    taken = {n.lower() for n in names}
    return docs.drop(*[c for c in docs.columns if c.lower() in taken and c != text])


def shielded(docs: DataFrame, text: str, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """:func:`without` those names, and with names that no operator uses instead of those of the other columns.

    Also the users' names by those that stand for them, in order; the text stands for itself.
    """
    rest = without(docs, text, *names)
    back = {c if c == text else f"_c{i}": c for i, c in enumerate(rest.columns)}
    return rest.select(*[F.col(f"`{c}`").alias(n) for n, c in back.items()]), back


def restored(rows: DataFrame, back: dict[str, str]) -> DataFrame:
    """``rows`` with the users' names again; columns that ``back`` does not know stay behind them."""
    first = [F.col(n).alias(c) for n, c in back.items() if n in rows.columns]
    return rows.select(*first, *[c for c in rows.columns if c not in back])


def release(*tables: DataFrame) -> None:
    """Gives back the disk of :func:`written` tables that no later step reads."""
    for folder in {f.rsplit("/", 1)[0] for t in tables for f in t.inputFiles()}:
        context = tables[0].sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def kept(name: str, make: Callable[[], Any]) -> Any:
    """One object per worker process and name.

    This package travels with the functions that tasks run, so its module variables are new in each task; what
    should outlive a task (a loaded vocabulary, a memory of words) hangs on the process.
    """
    store = sys.__dict__.setdefault("_ordinalia_kept", {})
    if name not in store:
        store[name] = make()
    return store[name]


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Rows of an Arrow batch for what is run inside: rows with packed blocks are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Memory:
    """What a worker process remembers of words: a young and an old generation of at most ``limit`` entries each.

    When the young one is full it becomes the old one, and the old one goes; an entry that is asked for again moves to
    the young one.  So what is frequent stays, and the bound holds however many words there are.
    """

    def __init__(self, limit: int) -> None:
        self.limit, self.young, self.old = limit, {}, {}

    def missing(self, words: list[str]) -> list[str]:
        """Those of the distinct ``words`` (``limit`` at most) that are not remembered; the others are in ``young`` afterwards."""
        rest = [w for w in words if w not in self.young]
        if not rest:
            return rest
        if len(self.young) + len(rest) > self.limit:
            kept_ = {w: self.old[w] for w in rest if w in self.old} | {w: self.young[w] for w in words if w in self.young}
            self.old, self.young = self.young, kept_
            return [w for w in rest if w not in kept_]
        found = {w: self.old[w] for w in rest if w in self.old}
        self.young.update(found)
        return [w for w in rest if w not in found] if found else rest
