"""Where a fact came from, where it is stored, and which models may use it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintry.functions.measures import is_annual_form, is_annual_span, raised
from vintry.functions.text import filing_url

# The models an annual candidate can reach, in order.
ANNUAL_MODEL_PATH = ("annual_candidates", "canonical_facts", "annual_financials", "company_trends")
MAX_LOOKUP = 1_000


def _wanted(facts: DataFrame, fact_ids) -> DataFrame:
    if fact_ids is None:
        return facts
    if isinstance(fact_ids, DataFrame):
        return facts.join(fact_ids.select("fact_id"), "fact_id", "left_semi")
    ids = list(fact_ids)
    if len(ids) > MAX_LOOKUP:
        raise ValueError(f"pass more than {MAX_LOOKUP} fact ids as a DataFrame")
    return facts.where(F.col("fact_id").isin(ids))


def fact_lineage(
    facts: DataFrame, snapshots: DataFrame, issuers: DataFrame, fact_ids=None
) -> DataFrame:
    """Nested trace per fact: the fact, its source, its storage and its model path.

    ``fact_ids`` may be a short list or a DataFrame; without it every fact is traced.
    """
    joined = (
        _wanted(facts, fact_ids)
        .join(snapshots.select("snapshot_id", "source_url", "silver_path"), "snapshot_id", "inner")
        .join(issuers.select("cik", "ticker", "name"), "cik", "inner")
    )
    eligible = raised(is_annual_form() & is_annual_span())
    steps = F.array(*[F.lit(step) for step in ANNUAL_MODEL_PATH])
    return joined.select(
        F.struct(*facts.columns, "ticker", "name").alias("fact"),
        F.struct(
            F.col("source_url").alias("company_facts_url"),
            filing_url(F.col("cik"), F.col("accession")).alias("filing_url"),
            F.col("source_sha").alias("sha256"),
        ).alias("source"),
        F.struct(
            F.col("bronze_path").alias("bronze"),
            F.col("silver_path").alias("silver"),
            F.col("snapshot_id").alias("snapshot_id"),
        ).alias("storage"),
        eligible.alias("annual_candidate"),
        F.when(eligible, steps).otherwise(F.array().cast("array<string>")).alias("annual_model_path"),
    )
