"""Content-derived identities.

Each identity is the SHA-256 of compact JSON with its keys in alphabetical order,
so a row keeps its identity whatever route it took into the lake.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vintry.contract import NORMALIZER_VERSION
from vintry.functions.text import decimal_text, instant_text

_WITH_NULLS = {"ignoreNullFields": "false"}


def digest(**fields: Column) -> Column:
    members = [fields[name].alias(name) for name in sorted(fields)]
    return F.sha2(F.to_json(F.struct(*members), _WITH_NULLS), 256)


def fact_identity(
    cik="cik",
    concept="concept",
    unit="unit",
    period_start="period_start",
    period_end="period_end",
    value="value",
    accession="accession",
    form="form",
    filed="filed",
) -> Column:
    """Nine natural-key fields: two filings of one amount are two facts, two spellings are not."""
    return digest(
        cik=F.col(cik).cast("bigint"),
        concept=F.col(concept),
        unit=F.col(unit),
        period_start=F.col(period_start).cast("string"),
        period_end=F.col(period_end).cast("string"),
        value=decimal_text(F.col(value)),
        accession=F.col(accession),
        form=F.col(form),
        filed=F.col(filed).cast("string"),
    )


def issuer_attribute_hash() -> Column:
    names = ("cik", "name", "ticker", "sector", "headquarters")
    return digest(**{name: F.col(name) for name in names})


def issuer_key(attribute_hash: Column, observed: Column) -> Column:
    """Surrogate key of one issuer version: its attributes and the moment it was seen."""
    return F.sha2(F.to_json(F.array(attribute_hash, instant_text(observed))), 256)


def snapshot_identity(source_sha: Column, min_year: int) -> Column:
    """One source content read under one issuer configuration and one contract."""
    config = F.to_json(
        F.struct("cik", "headquarters", "sector", "ticker"), _WITH_NULLS
    )
    body = F.concat(
        F.lit("["),
        config,
        F.lit(',"'),
        source_sha,
        F.lit(f'","{NORMALIZER_VERSION}",{int(min_year)}]'),
    )
    return F.sha2(body, 256)


def annual_key(cik: Column, period_end: Column) -> Column:
    return F.md5(F.concat_ws(":", cik.cast("string"), period_end.cast("string")))
