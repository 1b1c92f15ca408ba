"""Frozen assignment of a stream of samples.

A streamed row is one sample ``model_id, sample_id, features map<string,double>``.  The frozen model is
a static table, the assignment a row expression, so the query keeps no state and appends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import rules as RL
from ..operators import transfer as TR

SAMPLES = "model_id string, sample_id string, features map<string,double>"


def read_samples(spark: SparkSession, path: str, fmt: str = "json", files_per_trigger: int | None = None) -> DataFrame:
    """Stream sample files of a folder."""
    reader = spark.readStream.schema(SAMPLES).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def assign_medoids(samples: DataFrame, frozen: DataFrame) -> DataFrame:
    """Streaming form of ``transfer.assign``."""
    return TR.assign(samples, frozen)


def assign_rules(samples: DataFrame, models: DataFrame, **limits: float) -> DataFrame:
    """Streaming form of ``rules.assign``."""
    return RL.assign(samples, models, **limits)


def clean(samples: DataFrame) -> DataFrame:
    """NaN values become missing before assignment."""
    kept = F.map_filter("features", lambda _, v: v.isNotNull() & ~F.isnan(v))
    return samples.withColumn("features", kept)


def write_assignments(
    assigned: DataFrame, path: str, checkpoint: str, fmt: str = "parquet"
) -> StreamingQuery:
    """Append assignments to files; everything available is processed, then the query stops."""
    return (
        assigned.writeStream.format(fmt)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
