"""The source contract, case by case, each case as its own document in one job."""

from __future__ import annotations

import copy
import json
from decimal import Decimal

import pytest
from conftest import REPORT, REVENUE, YEAR, held, kiln_report, observed
from pyspark.sql import functions as F

from vintry.operators import validation as V
from vintry.operators.versions import duplicate_count, keep_first


def run(spark, payloads, min_year=2015):
    rows = [
        (cik, p if isinstance(p, str) else json.dumps({**p, "cik": p.get("cik_in", cik)}))
        for cik, p in payloads.items()
    ]
    docs = spark.createDataFrame(rows, "cik bigint, content string")
    return V.normalize(docs, min_year=min_year)


# (what is put in the place of the assets observation, expected reason or None)
CASES = {
    1: (observed(True), "value_not_numeric"),
    2: (observed("100"), "value_not_numeric"),
    3: (observed(-1), "negative_value"),
    4: (observed(2000, filed="2022-01-01"), "filed_before_end"),
    5: (observed(2000, accn="bad-id"), "bad_accession"),
    6: (observed(2000, end="2023-02-31"), "end_not_a_date"),
    7: (observed(2000, end="2023-2-3"), "end_not_a_date"),
    8: (observed(2000, end=20231231), "end_not_a_date"),
    9: (observed(2000, filed=None), "filed_not_a_date"),
    10: (observed(2000, form=10), "missing_form"),
    11: (observed(None), "value_not_numeric"),
    12: (observed(10**30), "value_out_of_range"),
    13: (observed(1e300), "value_out_of_range"),
    14: (observed(2000.12345), "too_many_decimals"),
    15: (observed(1e-9), "too_many_decimals"),
    16: ("text", "not_an_object"),
    17: (7, "not_an_object"),
    18: ({}, "end_not_a_date"),
    19: (observed(2000, accn=None), "bad_accession"),
    20: (observed(2000, accn=REPORT["accn"] + "\n"), "bad_accession"),
    # The first broken rule is reported.
    21: (observed(True, filed="2022-01-01", accn="bad-id"), "filed_before_end"),
    22: (observed(2000, fy="unknown", note="x"), None),
    23: (observed(0), None),
    24: (observed(999999999999999999999999999999), None),
    25: (observed(2000.1234), None),
}


@pytest.fixture(scope="module")
def judged(spark):
    payloads = {}
    for cik, (row, _) in CASES.items():
        payloads[cik] = kiln_report(cik)
        payloads[cik]["facts"]["us-gaap"]["Assets"]["units"]["USD"] = [row]
    rows = run(spark, payloads).where(F.col("concept") == "Assets").collect()
    return {r["cik"]: r for r in rows}


@pytest.mark.parametrize("case", sorted(CASES))
def test_observation_rules(judged, case):
    expected = CASES[case][1]
    row = judged[case]
    assert row["reason"] == expected
    assert row["status"] == ("accepted" if expected is None else "rejected")
    assert (row["fact_id"] is None) == (expected is not None)
    assert (row["source_fact"] is None) == (expected is None)


def test_accepted_values_and_hints(judged):
    assert judged[22]["fiscal_year_hint"] is None and judged[22]["extra_keys"] == ["note"]
    assert judged[23]["value"] == 0
    assert judged[24]["value"] == Decimal("999999999999999999999999999999")
    assert judged[25]["value"] == Decimal("2000.1234")
    assert judged[23]["period_start"] is None


def test_durations(spark, payload):
    def with_start(**change):
        p = copy.deepcopy(payload)
        row = held(p, REVENUE)[0]
        row.update(change)
        if change.get("start") == "":
            del row["start"]
        return p

    rows = run(spark, {
        1: with_start(start="2024-06-30"), 2: with_start(start=""), 3: with_start(start=YEAR[0]),
        4: with_start(val=-5),
    }).where(F.col("concept") == REVENUE).collect()
    assert {r["cik"]: r["reason"] for r in rows} == {
        1: "start_after_end", 2: "start_not_a_date", 3: None, 4: "negative_value",
    }


def test_negative_income_is_valid(spark, payload):
    held(payload, "NetIncomeLoss")[0]["val"] = -50
    assert V.rejected_rows(run(spark, {1: payload})).count() == 0


def test_equal_numbers_are_one_fact(spark, payload):
    """5130, 5130.0, 513e1 and 5130.0000 share an identity; a changed value does not."""
    text = json.dumps({**payload, "cik": 1})
    row = json.dumps(observed(5130))
    spelled = [row.replace('"val": 5130', f'"val": {v}') for v in ("5130", "5130.0", "513e1", "5130.0000", "5131")]
    assert row in text
    accepted = V.accepted_facts(run(spark, {1: text.replace(row, ", ".join(spelled))}))
    assets = accepted.where(F.col("concept") == "Assets")
    kept = keep_first(assets, "fact_id", "idx").orderBy("idx").collect()
    assert [(r["idx"], r["value"]) for r in kept] == [(0, 5130), (4, 5131)]
    assert duplicate_count(assets, "fact_id").first()["duplicates"] == 3


def test_exact_decimals_survive_parquet(spark, payload, tmp_path):
    text = json.dumps({**payload, "cik": 1}).replace('"val": 5130', '"val": 12345678901234567890123.125')
    path = str(tmp_path / "facts")
    V.accepted_facts(run(spark, {1: text})).write.parquet(path)
    value = spark.read.parquet(path).where("concept = 'Assets'").first()["value"]
    assert value == Decimal("12345678901234567890123.125")


def test_drift_is_telemetry_only(spark, payload):
    row = held(payload, "Assets")[0]
    row["note"] = "x"
    held(payload, "Assets").append(dict(row))
    held(payload, "Assets").append(observed(1, end="2014-12-31", filed="2015-03-01"))
    payload["facts"]["us-gaap"]["Assets"]["units"]["EUR"] = [observed(1), observed(2)]
    payload["facts"]["us-gaap"]["Brand"] = {"units": {"USD": [observed(1)]}}
    normalized = run(spark, {1: payload})
    found = {(r["signal"], r["name"]): r["n"] for r in V.drift_telemetry(normalized).collect()}
    assert found == {
        ("extra_key", "note"): 2, ("duplicate_row", ""): 1, ("old_period", ""): 1,
        ("other_unit", ""): 2, ("unknown_concept", "Brand"): 1,
    }
    assert V.rejected_rows(normalized).count() == 0


def test_broken_envelopes(spark, payload):
    def broken(change):
        p = copy.deepcopy(payload)
        change(p)
        return p

    cases = {
        1: ("{}", "cik_mismatch"),
        2: ("not-json", "unreadable_json"),
        3: ('{"cik": 4}', "cik_mismatch"),
        4: ({**payload, "cik_in": "4"}, "cik_mismatch"),
        5: ({**payload, "entityName": "  "}, "missing_entity_name"),
        6: ({**payload, "entityName": 5}, "missing_entity_name"),
        7: ({**payload, "facts": {"us-gaap": []}}, "concepts_not_a_map"),
        8: ({**payload, "facts": {}}, "concepts_not_a_map"),
        9: (broken(lambda p: p["facts"]["us-gaap"].update(Assets={})), "units_not_arrays"),
        10: (broken(lambda p: p["facts"]["us-gaap"].update(Assets={"units": []})), "units_not_arrays"),
        11: (broken(lambda p: p["facts"]["us-gaap"].update(Assets={"units": {"USD": 5}})), "units_not_arrays"),
        12: (payload, None),
        18: (broken(lambda p: p["facts"]["us-gaap"].update(Weird=5, Odd=[1], Void=None)), None),
        19: (broken(lambda p: p["facts"]["us-gaap"].update(Assets=[1])), "units_not_arrays"),
        13: (json.dumps({**payload, "cik": 13}) + " trailing", "unreadable_json"),
        14: (json.dumps({**payload, "cik": 14}) + ',{"cik": 14}', "unreadable_json"),
        15: (json.dumps([{**payload, "cik": 15}]), "unreadable_json"),
        16: ("", "unreadable_json"),
        17: (json.dumps({**payload, "cik": 17})[:-1], "unreadable_json"),
    }
    normalized = run(spark, {cik: p for cik, (p, _) in cases.items()})
    errors = {r["cik"]: r["document_error"] for r in V.document_errors(normalized).collect()}
    assert errors == {cik: e for cik, (_, e) in cases.items() if e}
