"""Data checks. Each returns the failing rows; an empty result passes."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintry.contract import NONNEGATIVE_METRICS
from vintry.functions.measures import is_duration_off_annual, raised
from vintry.operators.history import overlapping_versions


def _any(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, [raised(c) for c in conditions])


def check_unique(df: DataFrame, key: str) -> DataFrame:
    return (
        df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("copies"))
        .where("copies > 1")
    )


def check_not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def check_relationship(df: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).join(parent.select(key), key, "left_anti")


def future_evidence(as_of: date) -> Column:
    return F.col("filed") > F.lit(as_of)


def negative_balance() -> Column:
    return _any(*[F.col(m) < 0 for m in NONNEGATIVE_METRICS])


def check_no_future(facts: DataFrame, as_of: date) -> DataFrame:
    return facts.where(future_evidence(as_of))


def check_no_quarterly(facts: DataFrame) -> DataFrame:
    return facts.where(is_duration_off_annual())


def check_nonnegative(annual: DataFrame) -> DataFrame:
    return annual.where(negative_balance())


def check_one_current(history: DataFrame) -> DataFrame:
    return (
        history.groupBy("cik")
        .agg(F.count_if(F.col("valid_to").isNull()).alias("open_versions"))
        .where("open_versions <> 1")
    )


def _tally(df: DataFrame, table: str, unique: str, rules: dict[str, Column]) -> DataFrame:
    """Failures of one table: its unique key and all row rules in one shuffle."""
    conditions = {f"{table}.{unique}.not_null": F.col(unique).isNull(), **rules}
    per_key = df.groupBy(unique).agg(
        F.count("*").alias("copies"),
        *[F.count_if(raised(rule)).alias(f"r{i}") for i, rule in enumerate(conditions.values())],
    )
    repeated = F.count_if(F.col(unique).isNotNull() & (F.col("copies") > 1))
    sums = [F.coalesce(F.sum(f"r{i}"), F.lit(0)) for i in range(len(conditions))]
    names = [f"{table}.{unique}.unique", *conditions]
    counts = per_key.agg(*[v.cast("bigint").alias(f"c{i}") for i, v in enumerate([repeated, *sums])])
    rows = [
        F.struct(F.lit(n).alias("check_name"), F.col(f"c{i}").alias("failing_rows"))
        for i, n in enumerate(names)
    ]
    return counts.select(F.inline(F.array(*rows)))


def _tally_keys(df: DataFrame, table: str, keys: list[str]) -> DataFrame:
    """Uniqueness and presence of several keys of a small dimension, in one read."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("name"), F.col(k).cast("string").alias("value")) for k in keys
    ])).alias("k")).select("k.*")
    copies = long.groupBy("name", "value").agg(F.count("*").alias("copies"))
    repeated = F.col("value").isNotNull() & (F.col("copies") > 1)
    absent = F.when(F.col("value").isNull(), F.col("copies"))
    counts = copies.agg(*[
        c for i, k in enumerate(keys) for c in (
            F.count_if((F.col("name") == k) & repeated).alias(f"u{i}"),
            F.coalesce(F.sum(F.when(F.col("name") == k, absent)), F.lit(0)).alias(f"n{i}"),
        )
    ])
    rows = [
        F.struct(F.lit(f"{table}.{k}.{rule}").alias("check_name"), F.col(f"{c}{i}").alias("failing_rows"))
        for i, k in enumerate(keys) for rule, c in (("unique", "u"), ("not_null", "n"))
    ]
    return counts.select(F.inline(F.array(*rows)))


def _counted(name: str, failing: DataFrame) -> DataFrame:
    return failing.agg(F.count("*").alias("failing_rows")).select(
        F.lit(name).alias("check_name"), "failing_rows"
    )


def check_summary(
    facts: DataFrame,
    history: DataFrame,
    canonical: DataFrame,
    issuers: DataFrame,
    annual: DataFrame,
    trends: DataFrame,
    revisions: DataFrame,
    as_of: date,
) -> DataFrame:
    """All 23 checks as (check_name, failing_rows, status). Meant for stored tables."""
    c = F.col
    parts = [
        _tally(facts, "facts", "fact_id", {
            "facts.cik.not_null": c("cik").isNull(),
            "facts.value.not_null": c("value").isNull(),
        }),
        _tally(canonical, "canonical_facts", "fact_id", {
            "canonical_facts.no_future_evidence": future_evidence(as_of),
            "canonical_facts.no_quarterly_duration": is_duration_off_annual(),
        }),
        _tally_keys(issuers, "dim_issuer", ["issuer_key", "cik"]),
        _tally(annual, "annual_financials", "annual_key", {
            "annual_financials.revenue.not_null": c("revenue").isNull(),
            "annual_financials.nonnegative_balance": negative_balance(),
        }),
        _counted(
            "annual_financials.issuer_key.relationship",
            check_relationship(annual, issuers, "issuer_key"),
        ),
        _tally(trends, "company_trends", "annual_key", {}),
        _tally(revisions, "filing_revisions", "fact_id", {}),
        _counted("issuer_history.one_current", check_one_current(history)),
        _counted(
            "issuer_history.no_overlap", overlapping_versions(history)
        ),
    ]
    status = F.when(F.col("failing_rows") == 0, F.lit("pass")).otherwise(F.lit("fail"))
    return reduce(DataFrame.unionByName, parts).withColumn("status", status)
