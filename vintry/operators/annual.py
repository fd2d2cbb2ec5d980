"""Annual records: pivot, ratios, growth, review flags."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vintry.contract import METRICS
from vintry.functions.identity import annual_key
from vintry.functions.measures import (
    annual_ratios,
    history_ratios,
    review_flags,
    year_over_year,
)
from vintry.operators.selection import canonical_facts


def annual_pivot(canonical: DataFrame) -> DataFrame:
    """One row per issuer and period end; a metric without evidence stays NULL."""
    by_metric = [F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in METRICS]
    return canonical.groupBy("cik", "period_end").agg(
        *by_metric,
        F.max("filed").alias("latest_evidence_filed"),
        F.count("*").alias("available_metrics"),
    )


def revenue_anchored(pivoted: DataFrame) -> DataFrame:
    """Only periods with revenue are annual periods; other instants are comparatives."""
    return pivoted.where(F.col("revenue").isNotNull())


def anchored_facts(canonical: DataFrame) -> DataFrame:
    """The same anchor at fact level: facts of periods that have a revenue fact."""
    # At most one fact per metric here, so a group has no more rows than there are metrics.
    period = Window.partitionBy("cik", "period_end")
    anchored = canonical.where(F.col("cik").isNotNull() & F.col("period_end").isNotNull()).withColumn(
        "__anchor", F.max(F.col("metric") == "revenue").over(period)
    )
    return anchored.where("__anchor").drop("__anchor")


def annual_financials(canonical: DataFrame, issuers: DataFrame, as_of: date) -> DataFrame:
    """Annual record of every issuer with its ratios, on the current issuer version."""
    annual = revenue_anchored(annual_pivot(canonical))
    joined = annual.join(issuers.select("cik", "issuer_key"), "cik", "inner")
    return joined.select(
        annual_key(F.col("cik"), F.col("period_end")).alias("annual_key"),
        "issuer_key",
        *annual.columns,
        *[ratio.alias(name) for name, ratio in annual_ratios().items()],
        F.lit(as_of).cast("date").alias("filing_date_cutoff"),
    )


def with_previous_period(annual: DataFrame) -> DataFrame:
    """Previous revenue and period end per issuer.

    An issuer has at most one annual row per calendar day, so its group is bounded
    and a plain window is enough.
    """
    by_period = Window.partitionBy("cik").orderBy(F.col("period_end").asc_nulls_last())
    return annual.select(
        "*",
        F.lag("revenue").over(by_period).alias("previous_revenue"),
        F.lag("period_end").over(by_period).alias("previous_period_end"),
    )


def with_growth(annual: DataFrame) -> DataFrame:
    growth = year_over_year(
        F.col("revenue"), F.col("previous_revenue"),
        F.col("period_end"), F.col("previous_period_end"),
    )
    return with_previous_period(annual).withColumn("revenue_growth_yoy", growth)


def company_trends(annual: DataFrame, issuers: DataFrame) -> DataFrame:
    """Annual records with issuer names, growth and review flags."""
    names = issuers.select("issuer_key", "cik", "ticker", "name", "sector")
    named = annual.join(names, ["issuer_key", "cik"], "inner")
    flags = [flag.alias(name) for name, flag in review_flags().items()]
    return with_growth(named).select("*", *flags)


def annual_history(
    facts: DataFrame,
    as_of: date,
    observed_before: datetime | None = None,
    cik: int | None = None,
) -> DataFrame:
    """History of all issuers (or one) straight from fact versions, at any two cutoffs."""
    annual = revenue_anchored(
        annual_pivot(canonical_facts(facts, as_of, observed_before, cik))
    )
    ratios = [ratio.alias(name) for name, ratio in history_ratios().items()]
    return with_growth(annual).select("*", *ratios)


def latest_period(annual: DataFrame) -> DataFrame:
    """The most recent period of each issuer."""
    return annual.groupBy("cik").agg(F.max("period_end").alias("latest_period_end"))


def period_evidence(canonical: DataFrame, period_end: date) -> DataFrame:
    """Facts behind one period, numbered in contract order."""
    contract = F.array(*[F.lit(m) for m in METRICS])
    return canonical.where(F.col("period_end") == F.lit(period_end)).withColumn(
        "position", F.array_position(contract, F.col("metric")).cast("int")
    )


def metric_runs(annual: DataFrame, metrics=METRICS) -> DataFrame:
    """Unbroken runs of reported values per issuer and metric.

    Every annual period of the issuer counts as a step, so a period without the
    metric ends a run. Groups hold one row per annual period and are bounded.
    """
    long = annual.select(
        "cik", "period_end",
        F.explode(F.array(*[
            F.struct(F.lit(m).alias("metric"), F.col(m).isNotNull().alias("reported"))
            for m in metrics
        ])).alias("m"),
    ).select("cik", "period_end", "m.metric", "m.reported")
    steps = Window.partitionBy("cik", "metric").orderBy("period_end")
    gaps = F.count_if(~F.col("reported")).over(
        steps.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        long.withColumn("gaps", gaps)
        .where("reported")
        .groupBy("cik", "metric", "gaps")
        .agg(
            F.min("period_end").alias("run_start"),
            F.max("period_end").alias("run_end"),
            F.count("*").alias("points"),
        )
        .drop("gaps")
    )
