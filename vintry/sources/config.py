"""Issuer configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintry.contract import CIK_RANGE
from vintry.schemas import ISSUERS


def read_issuers(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of issuers under a fixed schema."""
    return (
        spark.read.schema(ISSUERS).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    )


def issuer_config_checks(issuers: DataFrame) -> DataFrame:
    """Issuer numbers that are repeated or out of range, with what is wrong."""
    low, high = CIK_RANGE
    listed = issuers.groupBy("cik").agg(F.count("*").alias("listed"))
    valid = F.coalesce(F.col("cik").between(low, high), F.lit(False))
    problem = F.when(~valid, F.lit("out_of_range")).when(F.col("listed") > 1, F.lit("repeated"))
    return listed.withColumn("problem", problem).where(F.col("problem").isNotNull())
