"""Reading stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_parquet(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet scan under a fixed schema; partition folders add no columns.

    ``recursiveFileLookup`` turns off partition inference, so values come from the
    files themselves, never from folder names.
    """
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Typed JSON lines; a row that does not fit the schema stops the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
