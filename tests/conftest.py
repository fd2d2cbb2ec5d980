from __future__ import annotations

import gzip
import json
import os
import sys
from datetime import date, datetime, timezone

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

from vintry.session import build_session

AS_OF = date(2026, 9, 1)
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

# An invented pottery with a year that ends in June. Its annual report states eight amounts;
# the amendment two weeks later states the other two.
YEAR = ("2021-07-01", "2022-06-30")
REPORT = {"form": "10-K", "filed": "2022-08-19", "accn": "0000417733-22-000012"}
AMENDMENT = {"form": "10-K/A", "filed": "2022-09-02", "accn": "0000417733-22-000019"}
REVENUE = "RevenueFromContractWithCustomerExcludingAssessedTax"
DURING = {  # over the year
    REVENUE: 8400, "OperatingIncomeLoss": 966, "NetIncomeLoss": 630,
    "NetCashProvidedByUsedInOperatingActivities": 1050,
}
AT_END = {  # on its last day
    "Assets": 5130, "AssetsCurrent": 1911, "CashAndCashEquivalentsAtCarryingValue": 377,
    "Liabilities": 3078, "LiabilitiesCurrent": 1274, "StockholdersEquity": 2052,
}
AMENDED = ("LiabilitiesCurrent", "NetCashProvidedByUsedInOperatingActivities")


def observed(value, **changes):
    return {"val": value, "end": YEAR[1], "fy": 2022, "fp": "FY", **REPORT, **changes}


def stated(concept):
    """The concept's one observation of the year."""
    source = AMENDMENT if concept in AMENDED else REPORT
    if concept in DURING:
        return observed(DURING[concept], start=YEAR[0], **source)
    return observed(AT_END[concept], **source)


def kiln_report(cik=1):
    concepts = {c: {"units": {"USD": [stated(c)]}} for c in (*DURING, *AT_END)}
    return {"cik": cik, "entityName": "Lantern Hill Pottery", "facts": {"us-gaap": concepts}}


def held(payload, concept):
    return payload["facts"]["us-gaap"][concept]["units"]["USD"]


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "4g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def payload():
    return kiln_report()


@pytest.fixture
def documents(spark):
    def build(*payloads, cik=1):
        rows = [
            (cik, f"memory://{i}", p if isinstance(p, str) else json.dumps(p))
            for i, p in enumerate(payloads)
        ]
        return spark.createDataFrame(rows, "cik bigint, source_url string, content string")

    return build


@pytest.fixture
def issuers(spark):
    def build(sector="Testing", ciks=(1,)):
        rows = [(cik, f"T{cik}", sector, "Somewhere") for cik in ciks]
        return spark.createDataFrame(rows, "cik bigint, ticker string, sector string, headquarters string")

    return build


@pytest.fixture
def moment():
    return lambda day: datetime(2026, 1, day, 12, tzinfo=timezone.utc)


def write_document(folder, payload, cik=1, version=""):
    folder = os.path.join(folder, version)
    os.makedirs(folder, exist_ok=True)
    body = json.dumps(payload).encode()
    with open(os.path.join(folder, f"CIK{cik:010d}.json.gz"), "wb") as out:
        out.write(gzip.compress(body, mtime=0))
    return body
