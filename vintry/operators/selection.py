"""Point-in-time selection on two clocks: when it was filed, and when it was first seen."""

from __future__ import annotations

from datetime import date, datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vintry.functions.measures import is_annual_form, is_annual_span
from vintry.functions.text import filing_url


def seen_by(facts: DataFrame, observed_before: datetime) -> Column:
    """``first_observed <= observed_before``; the cutoff must say its time zone."""
    if observed_before.tzinfo is None:
        raise ValueError("observed_before needs a time zone")
    utc = observed_before.astimezone(timezone.utc)
    kind = facts.schema["first_observed"].dataType
    if isinstance(kind, T.TimestampNTZType):
        cutoff = F.lit(utc.replace(tzinfo=None).isoformat()).cast("timestamp_ntz")
    else:
        cutoff = F.lit(utc.isoformat()).cast("timestamp")
    return F.col("first_observed") <= cutoff


def annual_candidates(
    facts: DataFrame,
    as_of: date | None,
    observed_before: datetime | None = None,
    cik: int | None = None,
) -> DataFrame:
    """Annual evidence filed by the cutoff. ``as_of=None`` leaves the filing date open."""
    if cik is not None:
        facts = facts.where(F.col("cik") == F.lit(cik))
    eligible = facts.where(is_annual_form() & is_annual_span())
    if as_of is not None:
        eligible = eligible.where(F.col("filed") <= F.lit(as_of))
    if observed_before is not None:
        eligible = eligible.where(seen_by(facts, observed_before))
    return eligible


def best_evidence(candidates: DataFrame) -> DataFrame:
    """One fact per issuer, metric and period end: the latest filing wins.

    The rank filter lets Spark keep only the best row per group in every map task
    (WindowGroupLimit), so one crowded group never travels whole.
    """
    preference = Window.partitionBy("cik", "metric", "period_end").orderBy(
        F.col("filed").desc_nulls_last(),
        F.col("alias_priority").asc_nulls_last(),
        F.col("accession").desc_nulls_last(),
        F.col("first_observed").desc_nulls_last(),
        F.col("fact_id").asc_nulls_last(),
    )
    ranked = candidates.withColumn("version_rank", F.row_number().over(preference))
    return ranked.where(F.col("version_rank") == 1).drop("version_rank")


def canonical_facts(
    facts: DataFrame,
    as_of: date,
    observed_before: datetime | None = None,
    cik: int | None = None,
    period_end: date | None = None,
) -> DataFrame:
    """The selected fact of every issuer, metric and period, as known at the cutoffs."""
    chosen = best_evidence(annual_candidates(facts, as_of, observed_before, cik))
    if period_end is not None:
        chosen = chosen.where(F.col("period_end") == F.lit(period_end))
    return chosen


def with_filing_url(facts: DataFrame) -> DataFrame:
    return facts.withColumn("filing_url", filing_url(F.col("cik"), F.col("accession")))


def candidate_extract(facts: DataFrame) -> DataFrame:
    """Every annual candidate of every issuer with its filing link, in one relation."""
    return with_filing_url(
        annual_candidates(facts, as_of=None).select(
            "fact_id", "cik", "metric", "concept", "kind", "alias_priority",
            "period_start", "period_end", "value", "accession", "form", "filed",
            "first_observed", "source_sha",
        )
    )


def selection_parity(left: DataFrame, right: DataFrame, key: str = "fact_id") -> DataFrame:
    """Keys one route selected and the other did not; empty means the routes agree."""
    sided = left.select(key, F.lit(1).alias("side")).unionByName(
        right.select(key, F.lit(-1).alias("side"))
    )
    surplus = sided.groupBy(key).agg(F.sum("side").alias("n")).where("n <> 0")
    side = F.when(F.col("n") > 0, F.lit("left")).otherwise(F.lit("right"))
    # A key that one side has n times more often comes n times.
    return surplus.select(
        key, F.explode(F.array_repeat(side, F.abs("n").cast("int"))).alias("only_in")
    )
