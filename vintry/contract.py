"""What the source contract accepts: metrics, concepts, thresholds."""

from __future__ import annotations

import dataclasses
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DURATION = "duration"
INSTANT = "instant"

# Metrics in contract order, each with its kind and its accepted
# taxonomy concepts, preferred concept first.
METRIC_CONCEPTS = {
    "revenue": (
        DURATION,
        "RevenueFromContractWithCustomerExcludingAssessedTax",
        "Revenues",
        "SalesRevenueNet",
        "RevenueFromContractWithCustomerIncludingAssessedTax",
    ),
    "net_income": (DURATION, "NetIncomeLoss", "ProfitLoss"),
    "operating_income": (DURATION, "OperatingIncomeLoss"),
    "operating_cash_flow": (DURATION, "NetCashProvidedByUsedInOperatingActivities"),
    "assets": (INSTANT, "Assets"),
    "liabilities": (INSTANT, "Liabilities"),
    "equity": (
        INSTANT,
        "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest",
        "StockholdersEquity",
    ),
    "current_assets": (INSTANT, "AssetsCurrent"),
    "current_liabilities": (INSTANT, "LiabilitiesCurrent"),
    "cash": (INSTANT, "CashAndCashEquivalentsAtCarryingValue"),
}
METRICS = tuple(METRIC_CONCEPTS)

# Metrics that may not be negative.
NONNEGATIVE_METRICS = (
    "assets",
    "liabilities",
    "current_assets",
    "current_liabilities",
    "cash",
    "revenue",
)

# Keys an observation may carry without being reported as drift.
OBSERVATION_KEYS = ("start", "end", "val", "accn", "fy", "fp", "form", "filed", "frame")

# Annual evidence, thresholds and identifiers.
ANNUAL_FORMS = ("10-K", "10-K/A")
ANNUAL_DURATION_DAYS = (329, 399)
YEAR_OVER_YEAR_DAYS = (330, 400)
ACCESSION_PATTERN = r"\A\d{10}-\d{2}-\d{6}\z"
DATE_PATTERN = r"\A\d{4}-\d{2}-\d{2}\z"
REPORTING_UNIT = "USD"
DEFAULT_MIN_YEAR = 2015
MIN_YEAR_RANGE = (2009, 2099)
CIK_RANGE = (1, 10**10 - 1)
MAX_REJECT_RATE = 0.005
BALANCE_FLOOR = Decimal("1000")
BALANCE_SHARE = Decimal("0.005")
NORMALIZER_VERSION = "1"
FILING_ARCHIVE = "https://www.sec.gov/Archives/edgar/data/"
OPEN_END = "9999-12-31"

# A concept map is code-sized; anything bigger must arrive as a joined table.
MAX_CONCEPTS = 10_000


@dataclasses.dataclass(frozen=True)
class Concept:
    concept: str
    metric: str
    kind: str
    alias_priority: int


CONCEPTS = tuple(
    Concept(name, metric, spec[0], rank)
    for metric, spec in METRIC_CONCEPTS.items()
    for rank, name in enumerate(spec[1:])
)


def concept_table(spark: SparkSession, concepts=CONCEPTS) -> DataFrame:
    """The concept map as a literal relation, small enough to broadcast by construction."""
    if not 0 < len(concepts) <= MAX_CONCEPTS:
        raise ValueError(f"a concept map holds 1 to {MAX_CONCEPTS} concepts")
    entries = [
        F.struct(
            F.lit(c.concept).alias("concept"),
            F.lit(c.metric).alias("metric"),
            F.lit(c.kind).alias("kind"),
            F.lit(c.alias_priority).alias("alias_priority"),
        )
        for c in concepts
    ]
    return spark.range(1).select(F.inline(F.array(*entries)))


def check_min_year(min_year: int) -> int:
    low, high = MIN_YEAR_RANGE
    if not low <= min_year <= high:
        raise ValueError(f"min_year must be between {low} and {high}")
    return min_year
