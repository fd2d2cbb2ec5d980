"""Append-only fact versions: first copy wins, known versions are never rewritten."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, key: str | list[str], *order) -> DataFrame:
    """First row per key (one column, or several) in the given order.

    Only the first row per key and map task is shuffled, so many copies of one row
    cost no more than one.
    """
    ranked = df.withColumn(
        "__copy", F.row_number().over(Window.partitionBy(key).orderBy(*order)),
    )
    return ranked.where(F.col("__copy") == 1).drop("__copy")


def duplicate_count(df: DataFrame, key: str) -> DataFrame:
    """Rows beyond the first of each key, over the whole table."""
    copies = df.groupBy(key).agg((F.count("*") - 1).alias("extra"))
    return copies.agg(F.coalesce(F.sum("extra"), F.lit(0)).cast("bigint").alias("duplicates"))


def unseen(incoming: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Incoming rows whose key is not stored yet."""
    return incoming.join(existing.select(key), key, "left_anti")


def merge_facts(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert-if-absent by ``fact_id``; a version keeps its earliest observation time."""
    first = keep_first(incoming, "fact_id", F.col("first_observed").asc_nulls_last())
    return existing.unionByName(unseen(first, existing, "fact_id"))


def load_ledger(
    accepted: DataFrame, rejected: DataFrame, inserted: DataFrame, by: str = "cik"
) -> DataFrame:
    """Accepted, rejected and inserted rows per issuer or snapshot in one aggregation."""
    outcomes = (("accepted", accepted), ("rejected", rejected), ("inserted", inserted))
    tagged = [df.select(by, F.lit(name).alias("outcome")) for name, df in outcomes]
    both = tagged[0].unionByName(tagged[1]).unionByName(tagged[2])
    return both.groupBy(by).agg(*[
        F.count_if(F.col("outcome") == name).alias(name) for name, _ in outcomes
    ])


def outcome_counts(rows: DataFrame, known: DataFrame, by: str = "cik") -> DataFrame:
    """The ledger of one load in one pass over its rows and one look-up.

    ``rows`` holds ``accepted`` and ``fact_id``; accepted rows that are not ``known`` count
    as inserted.
    """
    held = known.select("fact_id", F.lit(True).alias("__held"))
    looked_up = rows.join(held, "fact_id", "left")
    accepted = F.col("accepted")
    return looked_up.groupBy(by).agg(
        F.count_if(accepted).alias("accepted"),
        F.count_if(~accepted).alias("rejected"),
        F.count_if(accepted & F.col("__held").isNull()).alias("inserted"),
    )


def load_verification(facts: DataFrame) -> DataFrame:
    """Row count and exact decimal sum, to compare with an independent closed form."""
    return facts.agg(
        F.count("*").alias("verified_rows"),
        F.sum("value").cast("decimal(38,4)").alias("verified_sum"),
    )
