from __future__ import annotations

import glob
import hashlib
import json
import os
from datetime import date
from decimal import Decimal

import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from vintry.catalog import standin
from vintry.functions.identity import fact_identity, issuer_attribute_hash, issuer_key
from vintry.operators import annual as A
from vintry.operators import exports
from vintry.operators.exports import HISTORY_COLUMNS, history_lines, write_history
from vintry.operators.history import dim_issuer
from vintry.operators.lineage import fact_lineage
from vintry.operators.quality import gauge_text
from vintry.operators.revisions import filing_revisions
from vintry.operators.selection import annual_candidates, canonical_facts, selection_parity
from vintry.operators.versions import merge_facts


@pytest.fixture(scope="module")
def facts(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("facts") / "facts")
    standin.facts(spark, SF_DIR).repartition(8).write.parquet(path)
    return spark.read.parquet(path)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fact_identity_is_the_digest_of_compact_json(spark):
    row = {
        "accession": "0000417733-22-000019", "cik": 1, "concept": "Assets", "filed": "2022-09-02",
        "form": "10-K/A", "period_end": "2022-06-30", "period_start": None, "unit": "USD", "value": "377.5",
    }
    df = spark.createDataFrame(
        [(1, "Assets", "USD", None, date(2022, 6, 30), Decimal("377.5000"), row["accession"], "10-K/A", date(2022, 9, 2))],
        "cik bigint, concept string, unit string, period_start date, period_end date,"
        " value decimal(38,4), accession string, form string, filed date",
    )
    text = json.dumps(row, sort_keys=True, separators=(",", ":"))
    assert df.select(fact_identity()).first()[0] == hashlib.sha256(text.encode()).hexdigest()


def test_issuer_key_of_a_published_issuer(spark):
    df = spark.createDataFrame(
        [(97476, "TEXAS INSTRUMENTS INCORPORATED", "TXN", "Semiconductors", "Dallas, TX")],
        "cik bigint, name string, ticker string, sector string, headquarters string",
    )
    seen = F.lit("2026-09-17T16:53:53.247129+00:00").cast("timestamp")
    key = df.select(issuer_key(issuer_attribute_hash(), seen)).first()[0]
    assert key == "3d5af7f2de08ed048c0b80ed7df1151a7be1fb55242ba62e399dee3a3203e0cd"


def test_selection_agrees_with_an_aggregate_route(facts):
    """max over an ordered struct finds the same facts as the ranked window."""
    chosen = canonical_facts(facts, standin.AS_OF)
    inverted = F.translate("fact_id", "0123456789abcdef", "fedcba9876543210")
    best = F.max(F.struct(
        "filed", (-F.col("alias_priority")).alias("p"), "accession", "first_observed",
        inverted.alias("i"), "fact_id",
    ))
    other = (
        annual_candidates(facts, standin.AS_OF).groupBy("cik", "metric", "period_end")
        .agg(best.alias("b")).select("b.fact_id")
    )
    assert chosen.count() > 0 and selection_parity(chosen, other).count() == 0


def test_selection_prunes_in_map_tasks_and_reads_filtered_columns(spark, facts):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = plan_of(canonical_facts(facts, standin.AS_OF, period_end=standin.PERIOD).select("fact_id", "value"))
    final, exchange, partial = (plan.index(w) for w in (", Final", "Exchange hashpartitioning", ", Partial"))
    assert final < exchange < partial
    pushed = plan[plan.index("PushedFilters"):]
    assert "LessThanOrEqual(filed" in pushed and "EqualTo(period_end" in pushed
    read = plan[plan.index("ReadSchema"):]
    assert "source_sha" not in read and "bronze_path" not in read


def test_cutoffs_are_monotone(facts):
    early = canonical_facts(facts, standin.EARLIER)
    assert early.where(F.col("filed") > F.lit(standin.EARLIER)).count() == 0
    assert early.count() <= canonical_facts(facts, standin.AS_OF).count()


def test_one_issuer_equals_its_part_of_all(facts):
    one = A.annual_history(facts, standin.AS_OF, cik=3)
    everyone = A.annual_history(facts, standin.AS_OF).where("cik = 3")
    assert one.count() > 0 and one.exceptAll(everyone).count() == everyone.exceptAll(one).count() == 0


def test_growth_needs_adjacent_years(spark):
    rows = [(1, date(y, 12, 31), Decimal(v)) for y, v in ((2018, 100), (2019, 110), (2021, 220), (2022, 0), (2023, 5))]
    df = spark.createDataFrame(rows, "cik bigint, period_end date, revenue decimal(38,4)")
    growth = [r["revenue_growth_yoy"] for r in A.with_growth(df).orderBy("period_end").collect()]
    assert growth == [None, pytest.approx(0.1), None, -1.0, None]


def test_revision_limits(facts):
    for bad in (0, 201):
        with pytest.raises(ValueError):
            filing_revisions(facts, standin.AS_OF, limit=bad)


def test_merge_is_idempotent_and_keeps_first_observation(facts):
    later = facts.withColumn("first_observed", F.col("first_observed") + F.expr("INTERVAL 9 DAYS"))
    merged = merge_facts(facts, later.unionByName(later))
    assert merged.count() == facts.count()
    assert merged.exceptAll(facts).count() == 0
    fresh = merge_facts(facts.limit(0), later.unionByName(facts))
    assert fresh.exceptAll(facts).count() == 0


def test_lineage_of_one_fact(spark, facts):
    wanted = canonical_facts(facts, standin.AS_OF).orderBy("fact_id").first()["fact_id"]
    issuers = dim_issuer(standin.issuer_history(spark, SF_DIR))
    trace = fact_lineage(facts, standin.snapshots(facts), issuers, [wanted]).collect()
    assert len(trace) == 1
    fact, source = trace[0]["fact"], trace[0]["source"]
    assert fact["fact_id"] == wanted and trace[0]["annual_candidate"]
    assert trace[0]["annual_model_path"][-1] == "company_trends"
    assert source["filing_url"].endswith(f"/{fact['accession']}-index.html")
    assert fact_lineage(facts, standin.snapshots(facts), issuers, ["unknown"]).count() == 0
    as_table = spark.createDataFrame([(wanted,)], "fact_id string")
    assert fact_lineage(facts, standin.snapshots(facts), issuers, as_table).count() == 1


def test_history_file(spark, facts, tmp_path):
    issuers = dim_issuer(standin.issuer_history(spark, SF_DIR))
    lines = history_lines(A.annual_history(facts, standin.AS_OF), issuers, standin.AS_OF)
    path = str(tmp_path / "history")
    write_history(lines, path)
    parts = sorted(glob.glob(os.path.join(path, "part-*")))
    body = b"".join(open(p, "rb").read() for p in parts).decode()
    rows = body.split("\r\n")
    assert rows[0] == ",".join(HISTORY_COLUMNS) and rows[-1] == ""
    keys = [tuple(cell.strip('"') for cell in r.split(",")[:3]) for r in rows[1:-1]]
    assert keys == sorted(keys) and len(keys) == lines.count()
    assert all('""' not in r for r in rows[1:-1])
    assert any(",," in r for r in rows[1:-1])


def test_gauge_text(spark):
    gauges = spark.createDataFrame([("annual_periods", "Published.", 8.0)], "name string, help string, value double")
    assert gauge_text(gauges, "lake_").first()["value"] == (
        "# HELP lake_annual_periods Published.\n# TYPE lake_annual_periods gauge\nlake_annual_periods 8.0"
    )


def test_crowded_group_selection_matches_brute_force(spark):
    """A third of all rows compete for one (issuer, metric, period)."""
    n = 6000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500).cast("bigint").alias("cik"),
        F.lit("assets").alias("metric"), F.lit("instant").alias("kind"), F.lit("10-K").alias("form"),
        F.lit(None).cast("date").alias("period_start"), F.lit(date(2023, 12, 31)).alias("period_end"),
        F.date_add(F.lit(date(2024, 1, 1)), (F.col("id") % 97).cast("int")).alias("filed"),
        (F.col("id") % 2).cast("int").alias("alias_priority"),
        F.lpad((F.col("id") % 13).cast("string"), 4, "0").alias("accession"),
        F.lit("2024-06-01").cast("timestamp").alias("first_observed"),
        F.sha2(F.col("id").cast("string"), 256).alias("fact_id"),
    )
    groups = {}
    for r in df.collect():
        groups.setdefault(r["cik"], []).append(r)
    best = set()
    for rows in groups.values():
        rows = sorted(rows, key=lambda r: r["fact_id"])
        rows = sorted(rows, key=lambda r: r["accession"], reverse=True)
        rows = sorted(rows, key=lambda r: r["alias_priority"])
        rows = sorted(rows, key=lambda r: r["filed"], reverse=True)
        best.add(rows[0]["fact_id"])
    assert {r["fact_id"] for r in canonical_facts(df, date(2024, 12, 31)).collect()} == best


def test_typed_readers(spark, tmp_path):
    from vintry import schemas
    from vintry.sources.config import read_issuers
    from vintry.sources.documents import read_manifest
    from vintry.sources.tables import read_json_lines, read_parquet

    schema = "a bigint, b string"
    kind = spark.createDataFrame([], schema).schema
    spark.createDataFrame([(1, "x")], schema).write.parquet(f"{tmp_path}/t/k=1")
    assert read_parquet(spark, f"{tmp_path}/t", kind).collect() == [(1, "x")]
    (tmp_path / "lines.json").write_text('{"a": 1, "b": "x"}\n{"a": 2}\n')
    assert [tuple(r) for r in read_json_lines(spark, f"{tmp_path}/lines.json", kind).collect()] == [(1, "x"), (2, None)]
    (tmp_path / "bad.json").write_text('{"a": "text"}\n')
    with pytest.raises(Exception, match="MALFORMED"):
        read_json_lines(spark, f"{tmp_path}/bad.json", kind).collect()
    (tmp_path / "manifest.json").write_text('[\n{"cik": 1, "file": "f", "sha256": "0"}\n]')
    manifest = read_manifest(spark, f"{tmp_path}/manifest.json")
    assert manifest.columns == schemas.SOURCE_MANIFEST.names and manifest.first()["file"] == "f"
    (tmp_path / "issuers.json").write_text('[{"cik": 1, "ticker": "T", "sector": "S", "headquarters": "H"}]')
    assert read_issuers(spark, f"{tmp_path}/issuers.json").first()["ticker"] == "T"


def test_candidate_bundle_is_written_whole(spark, facts, tmp_path):
    issuers = standin.issuer_history(spark, SF_DIR)
    current = dim_issuer(issuers)
    annual = A.annual_financials(canonical_facts(facts, standin.AS_OF), current, standin.AS_OF)
    parts = exports.candidate_bundle(facts, current, annual, revisions_each=2)
    exports.write_bundle(parts, str(tmp_path / "bundle"))
    assert sorted(p.name for p in (tmp_path / "bundle").iterdir()) == sorted(parts)
    for name in ("candidates", "revisions", "quality_summary"):
        assert spark.read.json(str(tmp_path / "bundle" / name)).count() == parts[name].count() > 0
    each = parts["revisions"].groupBy("cik").count().agg(F.max("count")).first()[0]
    assert 1 <= each <= 2
    with pytest.raises(ValueError):
        exports.candidate_bundle(facts, current, annual, revisions_each=0)
