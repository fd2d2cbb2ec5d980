"""Slowly changing dimension history with half-open validity intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintry.contract import OPEN_END
from vintry.functions.identity import digest, issuer_attribute_hash, issuer_key
from vintry.operators.ordered import ordered_columns, range_bounds


def scd2_build(
    changes: DataFrame,
    key: str,
    attributes: list[str],
    observed: str,
    tie: str,
) -> DataFrame:
    """Full history from a log of observed attribute states.

    A version starts where the attributes differ from the state seen before, and ends
    where the next version starts. ``tie`` orders states seen at one instant.
    """
    states = changes.select(
        key, *attributes, observed, tie,
        digest(**{c: F.col(c) for c in (key, *attributes)}).alias("attribute_hash"),
    )
    bounds = range_bounds(states, [key], [observed, tie])
    seen = ordered_columns(
        states, [key], [observed, tie], {"previous_hash": "attribute_hash"}, bounds=bounds
    )
    starts = seen.where(
        F.col("previous_hash").isNull() | (F.col("previous_hash") != F.col("attribute_hash"))
    ).drop("previous_hash")
    versions = ordered_columns(
        starts, [key], [observed, tie], following={"valid_to": observed}, bounds=bounds
    )
    return versions.withColumnRenamed(observed, "valid_from").withColumn(
        "version_key", issuer_key(F.col("attribute_hash"), F.col("valid_from"))
    )


def scd2_merge(history: DataFrame, incoming: DataFrame, observed: Column) -> DataFrame:
    """Next state of the issuer history after seeing ``incoming`` attributes once.

    ``incoming`` holds one row per issuer (cik, name, ticker, sector, headquarters).
    An unchanged issuer keeps its open version; a changed one is closed and reopened
    at the same instant. Issuers that are not in ``incoming`` are left alone.
    """
    hashed = incoming.withColumn("attribute_hash", issuer_attribute_hash())
    open_now = history.where(F.col("valid_to").isNull()).select(
        "cik", F.col("attribute_hash").alias("open_hash")
    )
    changed = (
        hashed.join(open_now, "cik", "left")
        .where(F.col("open_hash").isNull() | (F.col("open_hash") != F.col("attribute_hash")))
        .drop("open_hash")
    )
    marked = history.join(
        changed.select("cik", F.lit(True).alias("reopened")), "cik", "left"
    )
    closed = marked.withColumn(
        "valid_to",
        F.coalesce("valid_to", F.when(F.col("reopened"), observed)),
    ).select(*history.columns)
    opened = changed.select(
        issuer_key(F.col("attribute_hash"), observed).alias("issuer_key"),
        "cik", "name", "ticker", "sector", "headquarters", "attribute_hash",
        observed.alias("valid_from"),
        F.lit(None).cast(history.schema["valid_to"].dataType).alias("valid_to"),
    )
    return closed.unionByName(opened)


def dim_issuer(history: DataFrame, ticker: str | None = None) -> DataFrame:
    """Current issuer versions; a ticker is matched in upper case."""
    current = history.where(F.col("valid_to").isNull())
    if ticker is not None:
        current = current.where(F.col("ticker") == F.upper(F.lit(ticker)))
    return current.select(
        "issuer_key", "cik", "name", "ticker", "sector", "headquarters", "valid_from"
    )


def overlapping_versions(
    history: DataFrame,
    key: str = "cik",
    version: str = "issuer_key",
) -> DataFrame:
    """Versions that share an instant with another version of the same key.

    In start order a version overlaps an earlier one exactly when some earlier end lies
    after its start, and a later one exactly when the next start lies before its end.
    That needs one pass, where pairing all versions of a key would be quadratic.
    Intervals of zero length hold no instant and are left out.
    """
    end = F.coalesce(
        "valid_to", F.lit(OPEN_END).cast(history.schema["valid_to"].dataType)
    )
    spans = history.select(key, version, "valid_from", end.alias("until")).where(
        F.col("valid_from") < F.col("until")
    )
    order = ["valid_from", version]
    seen = ordered_columns(
        spans, [key], order, bounds=range_bounds(spans, [key], order),
        following={"next_from": "valid_from"},
        highest_before={"latest_until": "until"},
    )
    return seen.where(
        (F.col("latest_until") > F.col("valid_from")) | (F.col("next_from") < F.col("until"))
    ).select(key, version, "valid_from", "until")
