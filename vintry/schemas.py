"""Explicit schemas of every stored table. Nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(38, 4)
TEXT, LONG, INT = T.StringType(), T.LongType(), T.IntegerType()
DAY, INSTANT = T.DateType(), T.TimestampType()


def required(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind, nullable=False)


def optional(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind, nullable=True)


FACTS = T.StructType([
    required("fact_id", TEXT),
    required("cik", LONG),
    required("metric", TEXT),
    required("concept", TEXT),
    required("kind", TEXT),
    required("alias_priority", INT),
    required("unit", TEXT),
    optional("period_start", DAY),
    required("period_end", DAY),
    required("value", MONEY),
    required("accession", TEXT),
    required("form", TEXT),
    required("filed", DAY),
    optional("fiscal_year_hint", INT),
    optional("fiscal_period_hint", TEXT),
    required("first_observed", INSTANT),
    required("source_sha", TEXT),
    required("bronze_path", TEXT),
    required("snapshot_id", TEXT),
])

ISSUERS = T.StructType([
    required("cik", LONG),
    required("ticker", TEXT),
    required("sector", TEXT),
    required("headquarters", TEXT),
])

ISSUER_HISTORY = T.StructType([
    required("issuer_key", TEXT),
    required("cik", LONG),
    required("name", TEXT),
    required("ticker", TEXT),
    required("sector", TEXT),
    required("headquarters", TEXT),
    required("attribute_hash", TEXT),
    required("valid_from", INSTANT),
    optional("valid_to", INSTANT),
])

SNAPSHOTS = T.StructType([
    required("snapshot_id", TEXT),
    required("cik", LONG),
    required("source_sha", TEXT),
    required("source_url", TEXT),
    required("bronze_path", TEXT),
    required("silver_path", TEXT),
    required("ingested_at", INSTANT),
    required("accepted_count", LONG),
    required("rejected_count", LONG),
    required("inserted_count", LONG),
    optional("unknown_concepts", LONG),
    optional("other_units", LONG),
    optional("old_periods", LONG),
])

SOURCE_MANIFEST = T.StructType([
    required("cik", LONG),
    optional("url", TEXT),
    required("file", TEXT),
    required("sha256", TEXT),
])

BRONZE = T.StructType([
    required("cik", LONG),
    required("source_sha", TEXT),
    required("content", T.BinaryType()),
])

RELEASE_MANIFEST = T.StructType([
    required("run_id", TEXT),
    required("status", TEXT),
    required("published_at", INSTANT),
    required("filing_date_cutoff", DAY),
    required("model_version", TEXT),
    required("number", LONG),
    required("generation", TEXT),
    optional("latest_filed", DAY),
    required("total_facts", LONG),
    required("annual_periods", LONG),
    required("revisions", LONG),
    required("checks_passed", LONG),
    optional("incomplete_periods", LONG),
    optional("balance_warnings", LONG),
    optional("rebuilt_buckets", LONG),
])

# One row per block of a Bloom filter over the fact ids of one piece.
FILTERS = T.StructType([
    required("piece_run", TEXT),
    required("piece_bucket", INT),
    required("block", LONG),
    required("bits", T.BinaryType()),
])

DEAD_LETTERS = T.StructType([
    required("cik", LONG),
    required("snapshot_id", TEXT),
    required("source_sha", TEXT),
    optional("source_url", TEXT),
    required("reason", TEXT),
    optional("detail", TEXT),
])

ISSUER_REPORT = T.StructType([
    required("cik", LONG),
    required("snapshots_loaded", LONG),
    required("snapshots_skipped", LONG),
    required("snapshots_failed", LONG),
    required("accepted_count", LONG),
    required("rejected_count", LONG),
    required("inserted_count", LONG),
])

RUN_REPORT = T.StructType([
    required("run_id", TEXT),
    required("status", TEXT),
    required("mode", TEXT),
    required("started_at", INSTANT),
    optional("filing_date_cutoff", DAY),
    optional("snapshots_loaded", LONG),
    optional("snapshots_skipped", LONG),
    optional("facts_inserted", LONG),
    optional("rejected_rows", LONG),
    optional("documents_unmatched", LONG),
    optional("documents_failed", LONG),
    optional("model_version", TEXT),
    optional("published_run_id", TEXT),
    optional("elapsed_seconds", T.DoubleType()),
    optional("error", TEXT),
])

# Folder names of partitioned tables.
RUN = optional("run_id", TEXT)
BUCKET = optional("cik_bucket", INT)


def with_folders(schema: T.StructType, *folders: T.StructField) -> T.StructType:
    return T.StructType([*schema.fields, *folders])
