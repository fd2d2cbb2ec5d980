"""Changed values between successive filings of one economic period."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vintry.functions.measures import safe_ratio
from vintry.operators.ordered import ordered_columns, range_bounds
from vintry.operators.selection import annual_candidates

_SERIES = ["cik", "concept", "unit", "period_start", "period_end"]
_FILING_ORDER = ["filed", "accession", "first_observed", "fact_id"]
_OUTPUT = [
    "fact_id", "cik", "metric", "concept", "period_start", "period_end", "accession",
    "filed", "value", "previous_value", "change_amount", "relative_change",
    "source_sha", "bronze_path",
]
MAX_LIMIT = 200


def changed_versions(candidates: DataFrame) -> DataFrame:
    """Versions whose value differs from the version filed before."""
    versions = ordered_columns(
        candidates, _SERIES, _FILING_ORDER, {"previous_value": "value"},
        bounds=range_bounds(candidates, _SERIES, _FILING_ORDER),
    )
    change = F.col("value") - F.col("previous_value")
    return (
        versions.where(
            F.col("previous_value").isNotNull() & (F.col("value") != F.col("previous_value"))
        )
        .withColumn("change_amount", change)
        .withColumn("relative_change", safe_ratio(change, F.abs(F.col("previous_value"))))
        .select(*_OUTPUT)
    )


def filing_revisions(
    facts: DataFrame,
    as_of: date | None,
    limit: int | None = None,
    observed_before: datetime | None = None,
    cik: int | None = None,
) -> DataFrame:
    """All revisions at the cutoffs, or the ``limit`` latest with a stable tie order."""
    if limit is not None and not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be between 1 and {MAX_LIMIT}")
    changed = changed_versions(annual_candidates(facts, as_of, observed_before, cik))
    if limit is None:
        return changed
    return changed.orderBy(
        F.col("filed").desc(), F.col("period_end").desc(), F.col("fact_id").asc()
    ).limit(limit)


def latest_per_issuer(revisions: DataFrame, limit: int = MAX_LIMIT) -> DataFrame:
    """The ``limit`` latest revisions of every issuer, in the order of the limited report.

    A rank filter: every map task keeps its own best rows of an issuer before the exchange.
    """
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be between 1 and {MAX_LIMIT}")
    latest = Window.partitionBy("cik").orderBy(
        F.col("filed").desc(), F.col("period_end").desc(), F.col("fact_id").asc()
    )
    ranked = revisions.withColumn("__rank", F.row_number().over(latest))
    return ranked.where(F.col("__rank") <= limit).drop("__rank")
