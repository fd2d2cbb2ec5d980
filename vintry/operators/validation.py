"""Source documents to validated observations.

Parsing keeps numbers exact by going through VARIANT. Each stage is a projection or
an explode; the only join is with the concept map, which is code-sized.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintry.contract import (
    ACCESSION_PATTERN,
    CONCEPTS,
    DATE_PATTERN,
    DEFAULT_MIN_YEAR,
    DURATION,
    NONNEGATIVE_METRICS,
    OBSERVATION_KEYS,
    REPORTING_UNIT,
    concept_table,
)
from vintry.functions.identity import fact_identity

ACCEPTED = "accepted"
REJECTED = "rejected"
OLD_PERIOD = "old_period"
OTHER_UNIT = "other_unit"
UNKNOWN_CONCEPT = "unknown_concept"
DOCUMENT_ERROR = "document_error"
EMPTY = "empty"

FACT_COLUMNS = [
    "fact_id", "cik", "metric", "concept", "kind", "alias_priority", "unit",
    "period_start", "period_end", "value", "accession", "form", "filed",
    "fiscal_year_hint", "fiscal_period_hint",
]

# A document as far as it is read. Observations stay VARIANT, each with only its own
# keys: numbers keep all their digits, and rows do not carry the document's dictionary.
_DOCUMENT = """
    array<struct<cik: variant, entityName: variant,
      facts: struct<`us-gaap`: map<string, variant>>>>
"""
# Read for known concepts only: what an unknown one looks like is nobody's business.
_UNITS = "map<string, array<variant>>"
# One cast reads all fields that a rule asks for; types it asks for stay VARIANT. The hints are
# read by themselves, so that only those who use them pay for them.
_OBSERVATION = """
    struct<val: variant, `end`: string, start: string, filed: string, accn: string, form: variant>
"""


def _scalar(source: Column, kind: str) -> Column:
    return F.try_variant_get(source, "$", kind)


def _first_failure(*rules: tuple[str, Column]) -> Column:
    """Name of the first rule that fails; a rule that cannot be decided fails."""
    return F.coalesce(*[
        F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in rules
    ])


def parse_documents(documents: DataFrame) -> DataFrame:
    """Add ``entity_name``, ``concepts`` and ``document_error`` to (cik, content, ...).

    The text is read as the only element of an array, so anything after the document
    makes it unreadable instead of being ignored.
    """
    listed = F.from_json(F.concat(F.lit("["), "content", F.lit("]")), _DOCUMENT)
    parsed = documents.withColumn("listed", listed).withColumn(
        "doc", F.when(F.size("listed") == 1, F.get("listed", F.lit(0)))
    )
    cik, entity = F.col("doc.cik"), F.col("doc.entityName")
    concepts = F.col("doc.facts.us-gaap")
    name = _scalar(entity, "string")
    error = _first_failure(
        ("unreadable_json", F.col("doc").isNotNull()),
        (
            "cik_mismatch",
            (F.schema_of_variant(cik) == "BIGINT") & (_scalar(cik, "bigint") == F.col("cik")),
        ),
        (
            "missing_entity_name",
            (F.schema_of_variant(entity) == "STRING") & name.rlike(r"(?U)\S"),
        ),
        ("concepts_not_a_map", concepts.isNotNull()),
    )
    return parsed.select(
        *[c for c in documents.columns if c != "content"],
        name.alias("entity_name"),
        concepts.alias("concepts"),
        error.alias("document_error"),
    )


# Documents of more bytes are read in slices by several tasks.
LARGE_DOCUMENT = 8_000_000
SLICE = 4096  # observations


def flatten_documents(documents: DataFrame, concepts=CONCEPTS, split_large: bool = False) -> DataFrame:
    """One row per observation in the reporting unit.

    What is not read further (an unknown concept, another unit, a broken shape) stays
    as one row with the number of observations it stands for in ``weight``.

    With ``split_large`` the observations of large documents are dealt out in slices before
    they are read one by one; the others stay where they are. The documents are then read
    twice, so it is for loads that hold a large one.
    """
    if not split_large:
        return _observations(_by_unit(documents, concepts))
    size = F.octet_length("content")
    small = documents.where(size.isNull() | (size <= LARGE_DOCUMENT))
    large = _by_unit(documents.where(size > LARGE_DOCUMENT), concepts)
    return _observations(_by_unit(small, concepts)).unionByName(_observations(_dealt_out(large)))


def _by_unit(documents: DataFrame, concepts) -> DataFrame:
    """One row per document, concept and unit, with all its observations in ``values``."""
    parsed = parse_documents(documents)
    carried = [c for c in parsed.columns if c != "concepts"]
    readable = F.when(F.col("document_error").isNull(), F.col("concepts"))
    by_concept = parsed.select(*carried, F.explode_outer(readable).alias("concept", "definition"))

    known = F.broadcast(concept_table(documents.sparkSession, concepts))
    mapped = by_concept.join(known, "concept", "left")
    is_known = F.col("metric").isNotNull()
    carried = [*[c for c in carried if c != "document_error"],
               "concept", "metric", "kind", "alias_priority"]
    # Through a one-row generator, so that the concept is walked once, not once per use.
    walked = mapped.select(
        *carried, "document_error",
        F.explode(F.array(F.when(is_known, F.try_variant_get("definition", "$.units", _UNITS)))).alias("read"),
    )
    # A unit that holds no array comes out as NULL, and makes the flattened whole NULL. Without a
    # lambda function all steps from here to the verdict are compiled as one.
    units = F.when(F.flatten(F.map_values("read")).isNotNull(), F.col("read"))
    broken = F.when(is_known & units.isNull(), F.lit("units_not_arrays"))
    return walked.select(
        *carried, F.coalesce("document_error", broken).alias("document_error"),
        F.explode_outer(units).alias("unit", "values"), F.lit(0).alias("first"),
    )


def _dealt_out(by_unit: DataFrame) -> DataFrame:
    """Slices of the observations, over as many tasks as the cluster runs at once."""
    starts = F.when(
        F.col("unit") == REPORTING_UNIT,
        F.sequence(F.lit(0), F.greatest(F.size("values") - 1, F.lit(0)), F.lit(SLICE)),
    )
    cut = F.transform(
        F.coalesce(starts, F.array(F.lit(0))),
        lambda at: F.struct(
            F.when(starts.isNull(), F.col("values")).otherwise(F.slice("values", at + 1, F.lit(SLICE))).alias("values"),
            at.alias("first"),
        ),
    )
    others = [c for c in by_unit.columns if c not in ("values", "first")]
    slices = by_unit.select(*others, F.inline(cut))
    context = by_unit.sparkSession.sparkContext
    return slices.repartition(4 * context.defaultParallelism, "concept", "unit", "first")


def _observations(by_unit: DataFrame) -> DataFrame:
    reported = F.when(F.col("unit") == REPORTING_UNIT, F.col("values"))
    others = [c for c in by_unit.columns if c not in ("values", "first")]
    rows = by_unit.select(
        *others, "first",
        F.when(F.col("unit") != REPORTING_UNIT, F.size("values")).alias("unread"),
        F.posexplode_outer(reported).alias("at", "observation"),
    )
    weight = F.coalesce(
        "unread", F.when(F.col("at").isNotNull(), F.lit(1)),
        F.when(F.col("concept").isNotNull() & F.col("metric").isNull(), F.lit(1)),
        F.lit(0),
    )
    return rows.select(
        *others, (F.col("at") + F.col("first")).alias("idx"), "observation",
        weight.cast("bigint").alias("weight"),
    )


def _iso_date(text: Column) -> Column:
    """A strict ISO date, else NULL. The cast alone would also take 2023-2-3."""
    day = text.try_cast("date")
    return F.when(text.rlike(DATE_PATTERN) & (F.year(day) >= 1), day)


def _typed(rows: DataFrame) -> DataFrame:
    """Read the fields of each observation; a bad field becomes NULL, never an error."""
    read = rows.withColumn("o", _scalar(F.col("observation"), _OBSERVATION))
    o = {name: F.col(f"o.{name}") for name in ("val", "end", "start", "filed", "accn", "form")}
    number = _scalar(o["val"], "string")
    return read.withColumns({
        "is_object": F.col("o").isNotNull(),
        "period_end": _iso_date(o["end"]),
        "filed": _iso_date(o["filed"]),
        "period_start": F.when(F.col("kind") == DURATION, _iso_date(o["start"])),
        "accession": o["accn"],
        "form": F.when(F.schema_of_variant(o["form"]) == "STRING", _scalar(o["form"], "string")),
        "number_type": F.schema_of_variant(o["val"]),
        "number_text": number,
        # 30 integer digits and 8 decimals: NULL exactly where the amount is out of range.
        "amount": number.try_cast("decimal(38,8)"),
        "fiscal_year_hint": F.try_variant_get("observation", "$.fy", "int"),
        "fiscal_period_hint": F.try_variant_get("observation", "$.fp", "string"),
    }).drop("o")


def _fits_four_decimals() -> Column:
    """No digit beyond the fourth decimal, whether written plainly or with an exponent."""
    amount, text = F.col("amount"), F.col("number_text")
    # A remainder, as comparing two decimal types would round the finer one first.
    whole = amount % F.lit(Decimal("0.0001")) == 0
    plain = ~text.rlike(r"\.\d{5,}\z")
    exact_double = amount.cast("double") == text.try_cast("double")
    fits = whole & F.when(F.col("number_type") == "DOUBLE", exact_double).otherwise(plain)
    # An integer has no decimals, and a remainder of big decimals is dear.
    return F.when(F.col("number_type") == "BIGINT", F.lit(True)).otherwise(fits)


def _reject_reason() -> Column:
    end, filed, start = F.col("period_end"), F.col("filed"), F.col("period_start")
    duration = F.col("kind") == DURATION
    kind_of_number = F.col("number_type")
    numeric = kind_of_number.isin("BIGINT", "DOUBLE", "FLOAT") | kind_of_number.startswith("DECIMAL")
    signed = ~F.col("metric").isin(*NONNEGATIVE_METRICS)
    return _first_failure(
        ("not_an_object", F.col("is_object")),
        ("end_not_a_date", end.isNotNull()),
        ("filed_not_a_date", filed.isNotNull()),
        ("start_not_a_date", ~duration | start.isNotNull()),
        ("start_after_end", ~duration | (start <= end)),
        ("filed_before_end", filed >= end),
        ("bad_accession", F.col("accession").rlike(ACCESSION_PATTERN)),
        ("missing_form", F.col("form").isNotNull()),
        ("value_not_numeric", numeric),
        ("value_out_of_range", F.col("amount").isNotNull()),
        ("too_many_decimals", _fits_four_decimals()),
        ("negative_value", signed | (F.col("amount") >= 0)),
    )


def validate(rows: DataFrame, min_year: int = DEFAULT_MIN_YEAR) -> DataFrame:
    """Give every flattened row a ``status`` and, where rejected, the first ``reason``.

    A period before ``min_year`` is set aside before any later rule is asked, so it is
    never counted as a rejection.
    """
    typed = _typed(rows)
    old = F.col("is_object") & (F.year("period_end") < min_year)
    status = (
        F.when(F.col("document_error").isNotNull(), F.lit(DOCUMENT_ERROR))
        .when(F.col("metric").isNull(), F.lit(UNKNOWN_CONCEPT))
        .when(F.col("unit") != REPORTING_UNIT, F.lit(OTHER_UNIT))
        .when(F.col("idx").isNull(), F.lit(EMPTY))
        .when(old, F.lit(OLD_PERIOD))
        .when(F.col("reason").isNotNull(), F.lit(REJECTED))
        .otherwise(F.lit(ACCEPTED))
    )
    outcome = F.struct(F.col("reason"), status.alias("status"))
    # Through a one-row generator: a later filter on the status stays above it. Pushed
    # into the projections it would parse every field again for each rule.
    judged = (
        typed.withColumn("reason", _reject_reason())
        .withColumn("outcome", outcome).drop("reason")
        .select("*", F.inline(F.array("outcome"))).drop("outcome")
    )
    keys = F.map_keys(_scalar(F.col("observation"), "map<string,variant>"))
    extra = F.array_except(keys, F.array(*[F.lit(k) for k in OBSERVATION_KEYS]))
    accepted, rejected = F.col("status") == ACCEPTED, F.col("status") == REJECTED
    return (
        judged.withColumn("extra_keys", F.when(F.size(extra) > 0, extra))
        .withColumn("reason", F.when(rejected, F.col("reason")))
        .withColumn("value", F.when(accepted, F.col("amount").cast("decimal(38,4)")))
        .withColumn("source_fact", F.when(rejected, F.to_json("observation")))
        .withColumn("fact_id", F.when(accepted, fact_identity()))
        .drop("is_object", "number_type", "number_text", "amount", "observation")
    )


def normalize(
    documents: DataFrame, concepts=CONCEPTS, min_year: int = DEFAULT_MIN_YEAR, split_large: bool = False
) -> DataFrame:
    """Documents (cik, content, ...) to rows with a status: one narrow pass.

    Nothing is shuffled but, with ``split_large``, the observations of large documents.
    """
    return validate(flatten_documents(documents, concepts, split_large), min_year)


def accepted_facts(normalized: DataFrame, *carried: str) -> DataFrame:
    return normalized.where(F.col("status") == ACCEPTED).select(*FACT_COLUMNS, *carried, "idx")


def rejected_rows(normalized: DataFrame, *carried: str) -> DataFrame:
    return normalized.where(F.col("status") == REJECTED).select(
        "cik", "concept", "idx", "reason", "source_fact", *carried
    )


def document_errors(normalized: DataFrame, *by: str) -> DataFrame:
    """Documents that break the envelope contract, each with its first error.

    ``by`` names what makes a document, the issuer by default.
    """
    return (
        normalized.where(F.col("status") == DOCUMENT_ERROR)
        .groupBy(*(by or ("cik",)))
        .agg(F.min("document_error").alias("document_error"))
    )


def accepted_nothing(normalized: DataFrame, *by: str) -> DataFrame:
    """Documents (issuers by default) that gave no accepted fact at all."""
    return (
        normalized.groupBy(*(by or ("cik",)))
        .agg(
            F.count_if(F.col("status") == ACCEPTED).alias("accepted"),
            F.count_if(F.col("status") == REJECTED).alias("rejected"),
        )
        .where("accepted = 0")
    )


def reject_rates(normalized: DataFrame, *by: str) -> DataFrame:
    """Rejected share of the supported facts of each document (issuer by default).

    Copies of one fact count once.
    """
    by = by or ("cik",)
    distinct = (
        normalized.where(F.col("status").isin(ACCEPTED, REJECTED))
        .groupBy(*by, "status", "fact_id").agg(F.count("*").alias("n"))
    )
    tallies = distinct.groupBy(*by).agg(
        F.count_if(F.col("status") == ACCEPTED).alias("accepted"),
        F.coalesce(F.sum(F.when(F.col("status") == REJECTED, F.col("n"))), F.lit(0)).alias("rejected"),
    )
    rate = F.col("rejected").cast("double") / (F.col("accepted") + F.col("rejected"))
    return tallies.withColumn("reject_rate", rate)


def drift_telemetry(normalized: DataFrame) -> DataFrame:
    """What the contract did not expect, as (cik, signal, name, n) rows; one pass.

    Long rows rather than one array per issuer: an issuer with very many unknown
    names is then still many small groups. Copies of a fact are first counted per
    fact, where map tasks combine them, then added up.
    """

    def signal(kind: Column, name: Column, n: Column) -> Column:
        return F.struct(kind.alias("signal"), name.alias("name"), n.cast("bigint").alias("n"))

    status, none = F.col("status"), F.lit("")
    unread = F.when(
        status.isin(UNKNOWN_CONCEPT, OTHER_UNIT, OLD_PERIOD),
        signal(
            status, F.when(status == UNKNOWN_CONCEPT, F.col("concept")).otherwise(none),
            F.col("weight"),
        ),
    )
    copy = F.when(status == ACCEPTED, signal(F.lit("copy"), F.col("fact_id"), F.lit(1)))
    extra = F.transform(
        F.coalesce("extra_keys", F.array().cast("array<string>")),
        lambda key: signal(F.lit("extra_key"), key, F.lit(1)),
    )
    seen = normalized.select(
        "cik", F.inline(F.concat(F.array_compact(F.array(unread, copy)), extra))
    )
    counted = seen.groupBy("cik", "signal", "name").agg(F.sum("n").alias("n"))
    is_copy = F.col("signal") == "copy"
    named = counted.select(
        "cik",
        F.when(is_copy, F.lit("duplicate_row")).otherwise(F.col("signal")).alias("signal"),
        F.when(is_copy, none).otherwise(F.col("name")).alias("name"),
        F.when(is_copy, F.col("n") - 1).otherwise(F.col("n")).alias("n"),
    )
    return named.where("n > 0").groupBy("cik", "signal", "name").agg(F.sum("n").alias("n"))
