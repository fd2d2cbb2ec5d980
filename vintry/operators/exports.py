"""Flat-file forms of published tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintry.contract import METRICS
from vintry.functions.text import csv_cell, exact_text
from vintry.operators.quality import quality_report
from vintry.operators.revisions import MAX_LIMIT, filing_revisions, latest_per_issuer
from vintry.operators.selection import candidate_extract

# Column order of an exported history.
HISTORY_COLUMNS = (
    "ticker", "as_of", "period_end", *METRICS,
    "net_margin", "current_ratio", "liabilities_to_assets", "revenue_growth_yoy",
    "available_metrics", "latest_evidence_filed",
)
_RATIOS = ("net_margin", "current_ratio", "liabilities_to_assets", "revenue_growth_yoy")


def _history_text(name: str, places: int | None) -> Column:
    if name in METRICS:
        return exact_text(F.col(name))
    if name in _RATIOS:
        if places is None:
            return F.col(name).cast("string")
        return F.round(name, places).cast(f"decimal(38,{places})").cast("string")
    return F.col(name).cast("string")


def history_lines(
    history: DataFrame, issuers: DataFrame, as_of: date, places: int | None = None
) -> DataFrame:
    """One CSV line per annual period: present cells quoted, missing cells empty.

    Ratios are written with all their digits, or rounded to ``places`` decimals.
    """
    named = history.join(issuers.select("cik", "ticker"), "cik", "inner").withColumn(
        "as_of", F.lit(as_of)
    )
    cells = [csv_cell(_history_text(name, places)) for name in HISTORY_COLUMNS]
    return named.select("ticker", "period_end", F.concat_ws(",", *cells).alias("line"))


def write_history(lines: DataFrame, path: str) -> None:
    """Write the lines by issuer and period end under one header, CRLF between them.

    The header is a row that sorts first. Rows are range partitioned, so the files
    read in name order are the whole export, however large.
    """
    spark = lines.sparkSession
    header = spark.range(1).select(
        F.lit(None).cast("string").alias("ticker"),
        F.lit(None).cast("date").alias("period_end"),
        F.lit(",".join(HISTORY_COLUMNS)).alias("line"),
    )
    order = [F.col("ticker").asc_nulls_first(), F.col("period_end").asc_nulls_first()]
    (
        lines.unionByName(header)
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(F.col("line").alias("value"))
        .write.option("lineSep", "\r\n").mode("errorifexists").text(path)
    )


def candidate_bundle(
    facts: DataFrame, issuers: DataFrame, annual: DataFrame, revisions_each: int = MAX_LIMIT
) -> dict[str, DataFrame]:
    """All parts of a self-contained extract: issuers, candidates, revisions, quality.

    Revisions are the latest of each issuer, whatever the filing date; parts that belong to
    an issuer carry its ticker.
    """
    tickers = issuers.select("cik", "ticker")
    latest = latest_per_issuer(filing_revisions(facts, None), revisions_each)
    parts = {
        "companies": issuers,
        "candidates": candidate_extract(facts).join(tickers, "cik"),
        "revisions": latest.join(tickers, "cik"),
    }
    return parts | {f"quality_{name}": part for name, part in quality_report(annual, issuers).items()}


def write_bundle(parts: dict[str, DataFrame], path: str) -> None:
    """Each part as JSON lines, with amounts as exact text."""
    for name, df in parts.items():
        _with_exact_text(df).write.mode("errorifexists").json(f"{path}/{name}")


def _with_exact_text(df: DataFrame) -> DataFrame:
    return df.select(*[
        exact_text(F.col(f.name)).alias(f.name)
        if f.dataType.typeName() == "decimal" else F.col(f.name)
        for f in df.schema.fields
    ])


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as ZSTD Parquet and as headered CSV with exact decimal text."""
    for name, df in tables.items():
        df.write.mode("errorifexists").option("compression", "zstd").parquet(f"{path}/parquet/{name}")
        text = _with_exact_text(df)
        text.write.mode("errorifexists").option("header", True).csv(f"{path}/csv/{name}")
