"""Coverage and balance findings over published annual records."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from vintry.contract import METRICS
from vintry.functions.measures import (
    balance_residual,
    balance_tolerance,
    missing_metrics,
)


def _complete():
    return F.col("available_metrics") == len(METRICS)


def _named(annual: DataFrame, issuers: DataFrame) -> DataFrame:
    return annual.join(issuers.select("cik", "ticker"), "cik", "inner")


def incomplete_periods(annual: DataFrame, issuers: DataFrame) -> DataFrame:
    """Periods that lack at least one contract metric."""
    short = annual.where(F.col("available_metrics") < len(METRICS))
    return _named(short, issuers).select("ticker", "period_end", "available_metrics")


def missing_metric_list(annual: DataFrame, issuers: DataFrame) -> DataFrame:
    """The same periods with the names of what is missing, in contract order."""
    short = annual.withColumn("missing_metrics", missing_metrics()).where(
        F.size("missing_metrics") > 0
    )
    return _named(short, issuers).select("ticker", "period_end", "missing_metrics")


def balance_warnings(annual: DataFrame, issuers: DataFrame) -> DataFrame:
    """Assets that differ from liabilities plus equity by more than the tolerance."""
    measured = annual.withColumn("residual", balance_residual()).withColumn(
        "tolerance", balance_tolerance()
    )
    off = measured.where(F.abs("residual") > F.col("tolerance"))
    return _named(off, issuers).select(
        "ticker", "period_end", "assets", "liabilities", "equity", "residual", "tolerance"
    )


def coverage_by_issuer(annual: DataFrame, issuers: DataFrame) -> DataFrame:
    return _named(annual, issuers).groupBy("ticker").agg(
        F.count("*").alias("annual_periods"),
        F.count_if(_complete()).alias("complete_periods"),
    )


def missing_by_metric(annual: DataFrame, issuers: DataFrame) -> DataFrame:
    """Missing periods per issuer and metric, every metric listed even at zero."""
    wide = _named(annual, issuers).groupBy("ticker").agg(
        *[F.count_if(F.col(m).isNull()).alias(m) for m in METRICS]
    )
    return wide.unpivot("ticker", list(METRICS), "metric", "missing")


def coverage_percent(annual: DataFrame, issuers: DataFrame) -> DataFrame:
    """Share of complete periods and total missing values per issuer."""
    absent = sum((F.col(m).isNull().cast("int") for m in METRICS), F.lit(0))
    totals = _named(annual, issuers).groupBy("ticker").agg(
        F.count("*").alias("annual_periods"),
        F.count_if(_complete()).alias("complete_periods"),
        F.sum(absent).cast("bigint").alias("missing_values"),
    )
    share = F.col("complete_periods").cast("double") / F.nullif("annual_periods", F.lit(0))
    return totals.withColumn("coverage", share)


def quality_summary(annual: DataFrame, issuers: DataFrame) -> DataFrame:
    """One row: issuers, periods, complete, incomplete, balance warnings; one pass."""
    off = F.abs(balance_residual()) > balance_tolerance()
    per_issuer = _named(annual, issuers).groupBy("ticker").agg(
        F.count("*").alias("periods"),
        F.count_if(_complete()).alias("complete"),
        F.count_if(off).alias("off"),
    )
    total = {
        "issuers": F.count("*"),
        "annual_periods": F.sum("periods"),
        "complete_periods": F.sum("complete"),
        "incomplete_periods": F.sum(F.col("periods") - F.col("complete")),
        "balance_warnings": F.sum("off"),
    }
    return per_issuer.agg(*[
        F.coalesce(value, F.lit(0)).cast("bigint").alias(name) for name, value in total.items()
    ])


def quality_report(annual: DataFrame, issuers: DataFrame) -> dict[str, DataFrame]:
    return {
        "summary": quality_summary(annual, issuers),
        "by_issuer": coverage_by_issuer(annual, issuers),
        "missing_by_metric": missing_by_metric(annual, issuers),
        "incomplete_periods": missing_metric_list(annual, issuers),
        "balance_warnings": balance_warnings(annual, issuers),
    }


def coverage_gate(annual: DataFrame, issuers: DataFrame) -> DataFrame:
    """Configured issuers without any annual period that has assets."""
    covered = annual.where(F.col("assets").isNotNull()).select("cik")
    return issuers.select("cik", "ticker").join(covered, "cik", "left_anti")


def release_totals(facts: DataFrame, annual: DataFrame, revisions: DataFrame) -> DataFrame:
    named = (("total_facts", facts), ("annual_periods", annual), ("revisions", revisions))
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in named]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


# Gauge names of a served release. Each stands for one count.
GAUGES = (
    ("ready", "serving_release_ready", "1 while a checked release can be read, else 0."),
    ("total_facts", "financial_fact_versions", "Fact versions the release holds."),
    ("annual_periods", "annual_periods", "Issuer periods with an annual record."),
    ("incomplete_periods", "incomplete_annual_periods", "Annual records without all contract metrics."),
    ("balance_warnings", "balance_warnings", "Annual records whose balance is off."),
    ("checks_passed", "checks_passed", "Checks that the release passed."),
    ("age_seconds", "release_age_seconds", "Time since the release was published."),
)


def _labelled(rows: DataFrame) -> DataFrame:
    """(source, value) with the gauge's name and help text."""
    named = {source: (name, text) for source, name, text in GAUGES}
    label = F.create_map(*[F.lit(x) for s, (n, _) in named.items() for x in (s, n)])
    help_text = F.create_map(*[F.lit(x) for s, (_, t) in named.items() for x in (s, t)])
    return rows.select(
        label[F.col("source")].alias("name"), help_text[F.col("source")].alias("help"), "value"
    )


def manifest_gauges(spark: SparkSession, manifest: Row | None) -> DataFrame:
    """Gauges from the counts a manifest holds; no table is read."""
    if manifest is None or manifest["status"] != "success" or not manifest["checks_passed"]:
        return _labelled(spark.createDataFrame([("ready", 0.0)], "source string, value double"))
    counts = ("total_facts", "annual_periods", "incomplete_periods", "balance_warnings", "checks_passed")
    age = (datetime.now(timezone.utc) - manifest["published_at"].astimezone(timezone.utc)).total_seconds()
    rows = [("ready", 1.0), *((c, float(manifest[c] or 0)) for c in counts), ("age_seconds", max(age, 0.0))]
    return _labelled(spark.createDataFrame(rows, "source string, value double"))


def release_gauges(
    summary: DataFrame, facts: DataFrame, checks: DataFrame, published_at: Column | None = None
) -> DataFrame:
    """(name, help, value) rows of a readable release; the age needs ``published_at``."""
    ready = summary.select(F.lit("ready").alias("source"), F.lit(1.0).alias("value"))
    found = summary.select(
        *[F.col(c).cast("double") for c in ("annual_periods", "incomplete_periods", "balance_warnings")]
    ).unpivot([], ["annual_periods", "incomplete_periods", "balance_warnings"], "source", "value")
    stored = facts.agg(F.count("*").cast("double").alias("value")).select(
        F.lit("total_facts").alias("source"), "value"
    )
    passed = checks.agg(F.count_if(F.col("status") == "pass").cast("double").alias("value")).select(
        F.lit("checks_passed").alias("source"), "value"
    )
    rows = ready.unionByName(found).unionByName(stored).unionByName(passed)
    if published_at is not None:
        micros = F.unix_micros(F.current_timestamp()) - F.unix_micros(published_at)
        age = F.greatest(F.lit(0), micros) / F.lit(1e6)
        rows = rows.unionByName(
            summary.select(F.lit("age_seconds").alias("source"), age.alias("value"))
        )
    return _labelled(rows)


def gauge_text(gauges: DataFrame, prefix: str = "") -> DataFrame:
    """Text exposition, three lines per gauge, one row each."""
    name = F.concat(F.lit(prefix), F.col("name"))
    return gauges.select(
        F.concat_ws(
            "\n",
            F.concat_ws(" ", F.lit("# HELP"), name, F.col("help")),
            F.concat_ws(" ", F.lit("# TYPE"), name, F.lit("gauge")),
            F.concat_ws(" ", name, F.col("value").cast("string")),
        ).alias("value")
    )
