"""Text forms of money and filings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vintry.contract import FILING_ARCHIVE
from vintry.schemas import MONEY


def decimal_text(value: Column) -> Column:
    """Plain notation without trailing zeros, so equal amounts share one text.

    The cast to four decimals guarantees a fraction part, hence "100" never loses
    its own zeros.
    """
    return F.rtrim(F.rtrim(value.cast(MONEY).cast("string"), F.lit("0")), F.lit("."))


def exact_text(value: Column) -> Column:
    """The stored decimal with its full scale, safe for any consumer."""
    return value.cast(MONEY).cast("string")


def filing_url(cik: Column, accession: Column) -> Column:
    return F.concat(
        F.lit(FILING_ARCHIVE),
        cik.cast("string"),
        F.lit("/"),
        F.replace(accession, F.lit("-"), F.lit("")),
        F.lit("/"),
        accession,
        F.lit("-index.html"),
    )


def csv_cell(value: Column) -> Column:
    """A quoted cell with doubled quotes; a missing value stays an empty cell."""
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(quoted, F.lit(""))


def instant_text(instant: Column) -> Column:
    """ISO-8601 in UTC, microseconds only where they are not zero."""
    fraction = F.date_format(instant, ".SSSSSS")
    return F.concat(
        F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(fraction != ".000000", fraction).otherwise(F.lit("")),
        F.lit("+00:00"),
    )
