"""Source documents: whole-file reads, checksums, content-addressed storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vintry.schemas import SOURCE_MANIFEST

# Fixed value: how a document names its issuer.
FILE_PATTERN = r"CIK(\d{10})\.json(?:\.gz)?$"


def content_sha(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per JSON document (plain or gzipped): cik, source_url, landed_at, content."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return named_documents(files)


def named_documents(files: DataFrame) -> DataFrame:
    """Issuer number and location of whole-file rows, batch or streaming."""
    location = F.col("_metadata.file_path")
    return files.select(
        F.nullif(F.regexp_extract(location, FILE_PATTERN, 1), F.lit("")).cast("bigint").alias("cik"),
        location.alias("source_url"),
        F.col("_metadata.file_modification_time").alias("landed_at"),
        F.col("value").alias("content"),
    )


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SOURCE_MANIFEST).option("multiLine", "true").json(path)


def verify_checksums(documents: DataFrame, manifest: DataFrame, key: str = "cik") -> DataFrame:
    """Every document with ``source_sha`` and a status: ok, mismatch or unlisted.

    Only digests meet the manifest; document bodies are hashed where they are read
    and do not travel.
    """
    hashed = documents.select(key, content_sha(F.col("content")).alias("source_sha"))
    expected = manifest.select(key, F.col("sha256").alias("expected_sha"))
    status = (
        F.when(F.col("expected_sha").isNull(), F.lit("unlisted"))
        .when(F.col("expected_sha") != F.col("source_sha"), F.lit("mismatch"))
        .otherwise(F.lit("ok"))
    )
    return hashed.join(expected, key, "left").withColumn("status", status).drop("expected_sha")
