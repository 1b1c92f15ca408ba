"""Session helpers: lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table (rows) that may be sent to every executor.
BROADCAST_ROWS = 100_000
#: Largest model table with wide rows (bytes) that may be sent to every executor.
BROADCAST_BYTES = 64 << 20


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in ``spark.checkpoint.dir``; a local master without one gets a scratch folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        shared = tempfile.mkdtemp(prefix="ordinalia-checkpoint-")
    sc.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and forget how it was made.

    A lost executor then re-reads files instead of repeating earlier iterations.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    For the state of an iteration: a checkpoint keeps the *estimated* size of its plan, and a state that is joined
    with itself squares the estimate in each round, until planning handles numbers of millions of digits.  A
    file has the size that it has.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/state-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def at_most(df: DataFrame, rows: int) -> bool:
    """Does ``df`` have at most ``rows`` rows?  Reads no more than ``rows + 1`` of them."""
    return df.limit(rows + 1).count() <= rows


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting; a larger table stays an ordinary shuffled join side.

    Call it on a table that is cheap to count, such as the result of :func:`cut`.
    """
    return F.broadcast(df) if at_most(df, rows) else df


#: Copies of a model table for a join whose model side is too large to broadcast.
SALTS = 32


def attach_models(rows: DataFrame, models: DataFrame, key: str, row_bytes: int = 4096) -> DataFrame:
    """Join every row to the one model row (or few model rows) of its ``key``.

    A model table of at most ``BROADCAST_BYTES`` (counted rows times ``row_bytes``) is broadcast, so the
    rows stay where they are.  A larger one is joined on (key, salt): a key that holds a large share
    of the rows is then spread over ``SALTS`` partitions.
    """
    if at_most(models, max(1, BROADCAST_BYTES // max(row_bytes, 1))):
        return rows.join(F.broadcast(models), key)
    spread = models.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("sample_id"), F.lit(SALTS)).cast("int"))
    return salted.join(spread, [key, "_salt"]).drop("_salt")


def model_table(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Materialise a fitted model table and hint a broadcast if its counted size allows it."""
    return checked_broadcast(cut(df), rows)
