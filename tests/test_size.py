"""Work that must not grow faster than the tables: what queries read again, and what they shuffle."""

from __future__ import annotations

import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from vintry.catalog import queries
from vintry.catalog import standin as S
from vintry.functions.text import decimal_text
from vintry.operators import membership as M
from vintry.operators import validation as V


@pytest.mark.parametrize("name", ["check_summary", "release_gauges"])
def test_checks_join_the_observations_once(spark, name):
    df = queries.queries()[name](spark, SF_DIR)
    assert not [f for f in df.inputFiles() if "/lineitem" in f or "/orders" in f]


def test_packed_ids_keep_equality_and_order(spark):
    marts = queries.checked_marts(spark, SF_DIR)
    packed = {r[0] for r in marts.facts.select(F.lower(F.hex("fact_id"))).collect()}
    assert packed == {r["fact_id"] for r in S.facts(spark, SF_DIR).select("fact_id").collect()}
    chosen = {r[0] for r in marts.canonical.select(F.lower(F.hex("fact_id"))).collect()}
    assert chosen == {r["fact_id"] for r in queries.canonical(spark, SF_DIR).select("fact_id").collect()}


def test_bloom_filters_send_hashes_not_bitmaps(spark):
    """Bitmaps made before the rows are dealt by block are tasks times blocks of them."""
    keys = spark.range(0, 4000, 1, 4).select(
        F.lit(0).alias("part"), F.col("id").cast("string").alias("key"), F.lit(3).alias("blocks")
    )
    filters = M.bloom_blocks(keys.withColumn("part", (F.col("key") % 2).cast("int")), ["part"], "key", "blocks")
    plan = filters._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert plan.rindex("SortAggregate") < plan.index("Exchange")
    assert filters.count() == 6


def test_filtered_merge_joins_the_observations_once(spark):
    df = queries.queries()["filtered_merge"](spark, SF_DIR)
    assert not [f for f in df.inputFiles() if "/lineitem" in f or "/orders" in f]


def test_documents_are_grouped_once(spark):
    plan = S.documents(spark, SF_DIR, faults=True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_generated_documents_are_written_before_they_are_parsed(spark):
    """Written inside the parser, which is not compiled, a text costs half as much as its parsing."""
    plan = optimized(queries.queries()["synthetic_load"](spark, SF_DIR))
    assert "from_json" in plan
    assert not [line for line in plan.splitlines() if "from_json" in line and "lpad" in line]


def test_parser_walks_no_lambda_and_reads_no_unused_hint(spark):
    docs = spark.createDataFrame([(1, "{}")], "cik bigint, content string")
    facts = V.accepted_facts(V.normalize(docs))
    plan = optimized(facts.select("fact_id", "value", "idx"))
    assert "lambda" not in plan and "fy" not in plan and "fp" not in plan
    assert "$.fy" in optimized(facts)


def test_generated_documents_are_json_without_what_is_missing(spark):
    rows = spark.createDataFrame(
        [(7, 12), (7, 3_456_789_012), (None, 5), (8, None), (None, None), (0, 0)], "cik bigint, i bigint"
    )
    i = F.col("i")
    accession = F.concat_ws(
        "-", F.lpad(F.expr("i DIV 1000000").cast("string"), 10, "0"),
        F.lit("25"), F.lpad((i % 1_000_000).cast("string"), 6, "0"),
    )
    observation = F.struct(
        (1_000_000 + i).alias("val"), F.concat((2015 + i % 10).cast("string"), F.lit("-12-31")).alias("end"),
        F.lit("2025-02-15").alias("filed"), accession.alias("accn"),
        F.lit("10-K").alias("form"), F.lit(2024).alias("fy"), F.lit("FY").alias("fp"),
    )
    units = F.struct(F.create_map(F.lit("USD"), F.array(observation)).alias("units"))
    expected = F.to_json(F.struct(
        "cik", F.lit("Synthetic").alias("entityName"),
        F.create_map(F.lit("us-gaap"), F.create_map(F.lit("Assets"), units)).alias("facts"),
    ))
    for written, wanted in rows.select(queries.synthetic_text(), expected).collect():
        assert written == wanted


def test_shorter_steps_keep_the_contract(spark):
    """Amounts, hints and broken units come out as by the longer steps."""
    def document(units):
        return '{"cik":1,"entityName":"A","facts":{"us-gaap":{"Assets":{"units":%s}}}}' % units

    def observation(value, hints=""):
        return ('{"USD":[{"val":%s,"end":"2020-12-31","filed":"2021-02-01",'
                '"accn":"0000000001-21-000001","form":"10-K"%s}]}' % (value, hints))

    cases = {  # (status, reason or error, value, fy, fp)
        observation("9223372036854775807"): ("accepted", None, "9223372036854775807.0000", None, None),
        observation("0", ',"fy":2020,"fp":"FY"'): ("accepted", None, "0.0000", 2020, "FY"),
        observation("1.25", ',"fy":"x","fp":4'): ("accepted", None, "1.2500", None, "4"),
        observation("2e3", ',"fy":null,"fp":null'): ("accepted", None, "2000.0000", None, None),
        observation("1.00001"): ("rejected", "too_many_decimals", None, None, None),
        observation("1e-5"): ("rejected", "too_many_decimals", None, None, None),
        observation('"5"'): ("rejected", "value_not_numeric", None, None, None),
        observation("true"): ("rejected", "value_not_numeric", None, None, None),
        '{"USD":5,"EUR":[]}': ("document_error", "units_not_arrays", None, None, None),
        '{"EUR":[],"USD":null}': ("document_error", "units_not_arrays", None, None, None),
        "5": ("document_error", "units_not_arrays", None, None, None),
        "{}": ("empty", None, None, None, None),
        '{"USD":[]}': ("empty", None, None, None, None),
        '{"USD":[7]}': ("rejected", "not_an_object", None, None, None),
    }
    docs = spark.createDataFrame(
        [(1, n, document(units)) for n, units in enumerate(cases)], "cik bigint, n int, content string"
    )
    rows = V.normalize(docs).select(
        "n", "status", F.coalesce("reason", "document_error"), F.col("value").cast("string"),
        "fiscal_year_hint", "fiscal_period_hint",
    ).orderBy("n").collect()
    assert {r[0]: tuple(r[1:]) for r in rows} == dict(enumerate(cases.values()))
    assert len(rows) == len(cases)


def test_amount_texts_lose_trailing_zeros_only(spark):
    amounts = ["0", "100", "-100", "0.5", "-0.0500", "0.0001", "10.01", "99999999999999999999999999999999.9999", None]
    rows = spark.createDataFrame([(a,) for a in amounts], "a string").select(F.col("a").cast("decimal(38,4)").alias("a"))
    by_pattern = F.regexp_replace(F.col("a").cast("string"), r"\.?0+$", "")
    for text, wanted in rows.select(decimal_text(F.col("a")), by_pattern).collect():
        assert text == wanted
