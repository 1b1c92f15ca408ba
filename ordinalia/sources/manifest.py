"""Manifest and file-integrity scans."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTRY = T.StructType(
    [
        T.StructField("x_path", T.StringType()),
        T.StructField("x_size_bytes", T.LongType()),
        T.StructField("x_sha256", T.StringType()),
        T.StructField("n_samples", T.IntegerType()),
        T.StructField("n_features", T.IntegerType()),
        T.StructField("platform_id", T.StringType()),
        T.StructField("first_column_is_sample_id", T.BooleanType()),
    ]
)


def read_manifest(spark: SparkSession, path: str, schema_tag: str) -> DataFrame:
    """``datasets`` map of a JSON manifest -> one row per dataset; a wrong schema tag is an error."""
    schema = T.StructType(
        [
            T.StructField("schema", T.StringType()),
            T.StructField("datasets", T.MapType(T.StringType(), ENTRY)),
        ]
    )
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    checked = F.when(F.col("schema") == schema_tag, F.col("datasets")).otherwise(
        F.raise_error(F.concat(F.lit(f"expected {schema_tag}, found "), F.coalesce("schema", F.lit("none"))))
    )
    return raw.select(F.explode(checked).alias("dataset_id", "e")).select("dataset_id", "e.*")


#: Larger files do not go through one binary cell: a task reads them in parts of PART_BYTES.
HASHED_BYTES, PART_BYTES = 1 << 28, 8 << 20


def _streamed(files: DataFrame) -> DataFrame:
    """``path, sha256`` of files that are read part by part, one file at a time in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            paths = batch.column(0).to_pylist()
            digests = []
            for path in paths:
                local = path.startswith("file:")
                store, name = (fs.LocalFileSystem(), re.sub("^file:/+", "/", path)) if local else fs.FileSystem.from_uri(path)
                digest = hashlib.sha256()
                with store.open_input_stream(name) as file:
                    while part := file.read(PART_BYTES):
                        digest.update(part)
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(digests, pa.string())], names=["path", "sha256"])

    return files.select("path").mapInArrow(run, "path string, sha256 string")


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """Size and SHA-256 of every file below ``path``: ``path, size_bytes, sha256``."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(path)
    )
    sizes = files.select("path", F.col("length").alias("size_bytes"))
    small = files.where(F.col("length") <= HASHED_BYTES).select(
        "path", F.sha2("content", 256).alias("sha256")
    )
    large = files.where(F.col("length") > HASHED_BYTES).select("path").repartition("path")
    return sizes.join(small.unionAll(_streamed(large)), "path", "left")


def file_problems(manifest: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """Manifest entries whose file is missing or differs, and files no entry lists."""
    prefix = F.lit(root.rstrip("/") + "/")
    name = F.regexp_replace("path", "^file:/*", "/")
    found = files.withColumn("_p", name).withColumn("_r", prefix).selectExpr(
        "substring(_p, length(_r) + 1) AS x_path", "size_bytes", "sha256"
    )
    status = (
        F.when(F.col("size_bytes").isNull(), "missing file")
        .when(F.col("dataset_id").isNull(), "unlisted file")
        .when(F.col("size_bytes") != F.col("x_size_bytes"), "size")
        .when(F.col("sha256") != F.col("x_sha256"), "checksum")
        .when(F.col("sha256").isNull() & F.col("x_sha256").isNotNull(), "unverified")
    )
    return (
        manifest.select("dataset_id", "x_path", "x_size_bytes", "x_sha256")
        .join(found, "x_path", "full_outer")
        .withColumn("problem", status)
        .where(F.col("problem").isNotNull())
        .select("dataset_id", "x_path", "problem")
    )
