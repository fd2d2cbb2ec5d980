"""Registered queries: each operator over the given tables, whole."""

from __future__ import annotations

from datetime import timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintry.catalog import standin as S
from vintry.contract import MAX_REJECT_RATE, OBSERVATION_KEYS, concept_table
from vintry.functions.identity import fact_identity, snapshot_identity
from vintry.functions.text import decimal_text, exact_text
from vintry.operators import affected as D
from vintry.operators import annual as A
from vintry.operators import checks as C
from vintry.operators import exports, quality as Q
from vintry.operators import membership as M
from vintry.operators import validation as V
from vintry.operators import versions as R
from vintry.operators.history import dim_issuer, overlapping_versions, scd2_build
from vintry.operators.lineage import fact_lineage
from vintry.operators.revisions import filing_revisions
from vintry.operators.selection import (
    annual_candidates,
    candidate_extract,
    canonical_facts,
    seen_by,
    selection_parity,
    with_filing_url,
)
from vintry.session import stored
from vintry.sources.config import issuer_config_checks
from vintry.sources.documents import content_sha, verify_checksums

SEEN = S.SEEN.replace(tzinfo=timezone.utc)
MIN_YEAR = 1994
TOP_K = 100
CANONICAL_COLUMNS = ["fact_id", "cik", "metric", "period_end", "value", "accession", "filed"]
RATIOS = ["net_margin", "operating_margin", "current_ratio", "liabilities_to_assets", "cash_flow_margin"]

REGISTRY: dict = {}


def query(function):
    REGISTRY[function.__name__] = function
    return function


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """Doubles at six decimals, as two engines may differ in the last bit."""
    return df.withColumns({n: F.round(n, 6) for n in names})


def canonical(spark, d, **cutoffs) -> DataFrame:
    return canonical_facts(S.facts(spark, d), S.AS_OF, **cutoffs)


class Marts:
    """The tables of one release, each derived once and shared by its readers."""

    def __init__(self, spark, d, facts=None, keep=lambda df: df):
        self.facts = S.facts(spark, d) if facts is None else facts
        self.history = S.issuer_history(spark, d)
        self.issuers = dim_issuer(self.history)
        self.canonical = keep(canonical_facts(self.facts, S.AS_OF))
        self.annual = A.annual_financials(self.canonical, self.issuers, S.AS_OF)

    def trends(self) -> DataFrame:
        return A.company_trends(self.annual, self.issuers)

    def revisions(self) -> DataFrame:
        return filing_revisions(self.facts, S.AS_OF)

    def checks(self) -> DataFrame:
        return C.check_summary(
            self.facts, self.history, self.canonical, self.issuers, self.annual,
            self.trends(), self.revisions(), S.AS_OF,
        )


def checked_marts(spark, d) -> Marts:
    """Marts for the checks, which read facts many times and return counts only.

    Observations are joined and stored once, without their identity: its digest is half of a
    row and is made again where it is read. It travels as 32 bytes, not as 64 digits; equality
    and order stay the same.
    """
    facts = S.identified(stored(S.accepted_observations(spark, d)))
    provenance = ("source_sha", "bronze_path", "snapshot_id")
    return Marts(
        spark, d, facts.withColumn("fact_id", F.unhex("fact_id")),
        lambda canonical: stored(canonical.drop(*provenance)),
    )


def current_issuers(spark, d) -> DataFrame:
    return dim_issuer(S.issuer_history(spark, d))


def annual(spark, d) -> DataFrame:
    return Marts(spark, d).annual


def normalized(spark, d) -> DataFrame:
    docs = S.documents(spark, d, faults=True)
    return V.normalize(docs, S.STANDIN_CONCEPTS, MIN_YEAR)


def copies(number) -> Column:
    """Copy numbers of a row: every fiftieth row comes twice."""
    return F.when(number % 50 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))


# Sources and sinks


@query
def scan_facts(spark, d):
    return S.facts(spark, d)


@query
def source_checksum(spark, d):
    docs = S.columns(spark, d, "documents", "doc_id", "text").withColumnRenamed("text", "content")
    listed = docs.where(F.col("doc_id") % 77 != 0)
    recorded = F.when(
        F.col("doc_id") % 50 == 0, content_sha(F.concat("content", F.lit("x")))
    ).otherwise(content_sha(F.col("content")))
    manifest = listed.select("doc_id", recorded.alias("sha256"))
    return verify_checksums(docs, manifest, key="doc_id")


@query
def issuer_config_checks_query(spark, d):
    config = S.issuers(spark, d)
    return issuer_config_checks(config.unionByName(config.where(F.col("cik") % 25 == 0)))


@query
def history_export(spark, d):
    history = A.annual_history(S.facts(spark, d), S.AS_OF)
    # Six decimals, as two engines may differ in the last bit.
    return exports.history_lines(history, current_issuers(spark, d), S.AS_OF, places=6)


@query
def candidate_extract_query(spark, d):
    return candidate_extract(S.facts(spark, d))


def synthetic_text() -> Column:
    """The document of one generated amount of (cik, i); what is missing is left out."""
    i = F.col("i")
    accession = F.concat_ws(
        "-", F.lpad(F.expr("i DIV 1000000").cast("string"), 10, "0"),
        F.lit("25"), F.lpad((i % 1_000_000).cast("string"), 6, "0"),
    )
    cik = F.concat(F.lit('"cik":'), F.col("cik").cast("string"), F.lit(","))
    amount = F.concat(
        F.lit('"val":'), (1_000_000 + i).cast("string"),
        F.lit(',"end":"'), (2015 + i % 10).cast("string"), F.lit('-12-31",'),
    )
    return F.concat(
        F.lit("{"), F.coalesce(cik, F.lit("")),
        F.lit('"entityName":"Synthetic","facts":{"us-gaap":{"Assets":{"units":{"USD":[{'),
        F.coalesce(amount, F.lit("")), F.lit('"filed":"2025-02-15","accn":"'), accession,
        F.lit('","form":"10-K","fy":2024,"fp":"FY"}]}}}}}'),
    )


@query
def synthetic_load(spark, d):
    """Generated amounts through JSON, contract and de-duplication, checked in closed form."""
    lines = S.observations(spark, d).select("cik", S.row_number_column().alias("i"))
    # Two numbers a row are dealt out before each becomes a document: the parser is the work.
    # Through a one-row generator, so that the text is not written inside the parser, uncompiled.
    tasks = 4 * spark.sparkContext.defaultParallelism
    dealt = lines.repartition(tasks, "i").select("cik", F.explode(F.array(synthetic_text())).alias("content"))
    # Identities travel as 32 bytes, not as 64 digits.
    loaded = V.accepted_facts(V.normalize(dealt)).withColumn("fact_id", F.unhex("fact_id"))
    verified = R.load_verification(R.keep_first(loaded, "fact_id", "idx"))
    expected = lines.agg(
        F.count("*").alias("input_rows"),
        (F.count("*") * 1_000_000 + F.sum(F.col("i").cast("decimal(28,0)")))
        .cast("decimal(38,4)").alias("expected_sum"),
    )
    facts = [df.unpivot([], df.columns, "measure", "amount") for df in (
        verified.select(F.col("verified_rows").cast("decimal(38,4)"), "verified_sum"),
        expected.select(F.col("input_rows").cast("decimal(38,4)"), "expected_sum"),
    )]
    return facts[0].unionByName(facts[1])


# Projections


@query
def json_flatten(spark, d):
    rows = V.flatten_documents(S.documents(spark, d, faults=True), S.STANDIN_CONCEPTS)

    def field(name):
        return F.try_variant_get("observation", f"$.{name}", "string")

    return rows.select(
        "cik", "r", "concept", "unit", "idx", "weight",
        field("accn").alias("accn"), field("end").alias("end_text"), field("filed").alias("filed_text"),
    )


@query
def normalize_facts(spark, d):
    return V.accepted_facts(normalized(spark, d), "r")


@query
def filing_url_query(spark, d):
    return with_filing_url(S.facts(spark, d)).select("fact_id", "filing_url")


@query
def value_text(spark, d):
    return S.facts(spark, d).select("fact_id", decimal_text(F.col("value")).alias("value_text"))


@query
def decimal_text_output(spark, d):
    return S.facts(spark, d).select("fact_id", exact_text(F.col("value")).alias("value"))


@query
def fact_identity_query(spark, d):
    obs = S.observations(spark, d)
    return obs.select("l_orderkey", "idx", fact_identity().alias("fact_id"))


@query
def snapshot_identity_query(spark, d):
    sources = S.with_provenance(S.observations(spark, d)).select("cik", "source_sha").distinct()
    configured = sources.join(S.issuers(spark, d), "cik", "inner")
    return configured.select(
        "cik", "source_sha", snapshot_identity(F.col("source_sha"), 2015).alias("snapshot_id")
    )


@query
def extra_keys(spark, d):
    contract = F.array(*[F.lit(k) for k in OBSERVATION_KEYS])
    extra = F.array_except(F.json_object_keys("props"), contract)
    events = S.columns(spark, d, "events", "event_id", "props")
    return events.select("event_id", F.array_join(F.array_sort(extra), ",").alias("extra_keys"))


# Contract


@query
def concept_map_join(spark, d):
    obs = S.observations(spark, d).withColumn("r", S.row_number_column())
    renamed = F.when(F.col("r") % 101 == 15, F.concat(F.lit("Other"), "concept")).otherwise(F.col("concept"))
    known = F.broadcast(concept_table(spark, S.STANDIN_CONCEPTS))
    return obs.select("r", renamed.alias("concept")).join(known, "concept", "inner")


@query
def contract_rejects(spark, d):
    return normalized(spark, d).where(F.col("status") == V.REJECTED).select("cik", "r", "concept", "idx", "reason")


@query
def contract_reject_counts(spark, d):
    rejected = normalized(spark, d).where(F.col("status") == V.REJECTED)
    return rejected.groupBy("reason").agg(F.count("*").alias("n"))


@query
def telemetry(spark, d):
    docs = S.documents(spark, d, faults=True)
    repeated = docs.withColumn("copy", F.explode(copies(F.col("r")))).drop("copy")
    return V.drift_telemetry(V.normalize(repeated, S.STANDIN_CONCEPTS, MIN_YEAR))


@query
def envelope_errors(spark, d):
    """Documents whose order number makes their envelope break the contract in one way."""
    kind, content = F.col("r") % 11, F.col("content")
    broken = (
        F.when(kind == 0, F.expr("left(content, length(content) - 1)"))
        .when(kind == 1, F.replace("content", F.lit('{"cik":'), F.lit('{"cik":9')))
        .when(kind == 2, F.regexp_replace("content", '"entityName":"[^"]*"', '"entityName":"  "'))
        .when(kind == 3, F.replace("content", F.lit('"us-gaap"'), F.lit('"other"')))
        .when(kind == 4, F.concat("content", F.lit(" x")))
        .otherwise(content)
    )
    docs = S.documents(spark, d, faults=True).withColumn("content", broken)
    return V.document_errors(V.normalize(docs, S.STANDIN_CONCEPTS, MIN_YEAR), "cik", "r")


@query
def empty_accept_gate(spark, d):
    """Every fourth issuer names its amounts differently, so none of them is accepted."""
    docs = S.documents(spark, d, faults=True)
    renamed = F.replace("content", F.lit('"val":'), F.lit('"amount":'))
    content = F.when(F.col("cik") % 4 == 1, renamed).otherwise(F.col("content"))
    return V.accepted_nothing(
        V.normalize(docs.withColumn("content", content), S.STANDIN_CONCEPTS, MIN_YEAR)
    )


@query
def reject_rate(spark, d):
    rates = V.reject_rates(normalized(spark, d))
    over = F.col("reject_rate") > MAX_REJECT_RATE
    return rounded(rates.withColumn("over_limit", over), "reject_rate")


@query
def dedupe_facts(spark, d):
    obs = S.observations(spark, d).withColumn("fact_id", fact_identity())
    repeated = obs.withColumn("copy", F.explode(copies(F.col("l_orderkey"))))
    later = repeated.withColumn("idx", F.col("idx") + 100 * F.col("copy"))
    kept = R.keep_first(later, "fact_id", "idx")
    return kept.select("fact_id", "cik", "idx", "value")


# Selection


@query
def annual_candidates_query(spark, d):
    return annual_candidates(S.facts(spark, d), S.AS_OF).select(*CANONICAL_COLUMNS)


@query
def canonical_facts_query(spark, d):
    return canonical(spark, d).select(*CANONICAL_COLUMNS, "concept", "alias_priority", "form")


@query
def observed_before_cutoff(spark, d):
    return canonical(spark, d, observed_before=SEEN).select(*CANONICAL_COLUMNS)


@query
def canonical_period(spark, d):
    return canonical(spark, d, period_end=S.PERIOD).select(*CANONICAL_COLUMNS)


@query
def period_evidence(spark, d):
    rows = A.period_evidence(canonical(spark, d), S.PERIOD)
    return rows.select("cik", "position", "metric", "value", "fact_id")


@query
def selection_parity_query(spark, d):
    facts = S.facts(spark, d)
    seen = canonical_facts(facts, S.AS_OF, observed_before=SEEN)
    return selection_parity(canonical_facts(facts, S.AS_OF), seen)


@query
def anchor_semi_join(spark, d):
    return A.anchored_facts(canonical(spark, d)).select(*CANONICAL_COLUMNS)


# Annual records


@query
def annual_pivot(spark, d):
    return A.annual_pivot(canonical(spark, d))


@query
def annual_financials(spark, d):
    return rounded(annual(spark, d), *RATIOS)


@query
def annual_ratios(spark, d):
    return rounded(annual(spark, d).select("cik", "period_end", *RATIOS), *RATIOS)


@query
def annual_history(spark, d):
    history = A.annual_history(S.facts(spark, d), S.AS_OF)
    return rounded(
        history, "net_margin", "current_ratio", "liabilities_to_assets", "revenue_growth_yoy"
    )


@query
def company_trends(spark, d):
    trends = Marts(spark, d).trends()
    return rounded(trends, *RATIOS, "revenue_growth_yoy")


@query
def revenue_growth_yoy(spark, d):
    grown = A.with_growth(A.revenue_anchored(A.annual_pivot(canonical(spark, d))))
    return rounded(
        grown.select("cik", "period_end", "revenue", "previous_revenue", "previous_period_end", "revenue_growth_yoy"),
        "revenue_growth_yoy",
    )


@query
def review_flags(spark, d):
    trends = Marts(spark, d).trends()
    return trends.select(
        "annual_key", "liquidity_review", "loss_review", "cash_flow_review", "incomplete_metrics"
    )


@query
def latest_period(spark, d):
    return A.latest_period(annual(spark, d))


@query
def metric_runs(spark, d):
    return A.metric_runs(annual(spark, d))


@query
def filing_revisions_query(spark, d):
    return rounded(filing_revisions(S.facts(spark, d), S.AS_OF), "relative_change")


@query
def revisions_top_k(spark, d):
    top = filing_revisions(S.facts(spark, d), S.AS_OF, limit=TOP_K)
    return rounded(top, "relative_change")


@query
def latest_revisions(spark, d):
    marts = Marts(spark, d)
    parts = exports.candidate_bundle(marts.facts, marts.issuers, marts.annual, revisions_each=5)
    return parts["revisions"].select(
        "ticker", "cik", "fact_id", "filed", "period_end", "value", "previous_value"
    )


# Issuers and history


@query
def dim_issuer_query(spark, d):
    return current_issuers(spark, d)


@query
def issuer_lookup(spark, d):
    return dim_issuer(S.issuer_history(spark, d), ticker="s7")


def event_versions(spark, d) -> DataFrame:
    events = S.columns(spark, d, "events", "event_id", "ts", "user_id", "event_type")
    return scd2_build(events, "user_id", ["event_type"], "ts", "event_id")


@query
def scd2_build_query(spark, d):
    return event_versions(spark, d)


@query
def scd_overlaps(spark, d):
    stretched = F.when(
        F.col("event_id") % 7 == 0, F.col("valid_to") + F.expr("INTERVAL 6 HOURS")
    ).otherwise(F.col("valid_to"))
    versions = event_versions(spark, d).withColumn("valid_to", stretched)
    found = overlapping_versions(versions, key="user_id", version="event_id")
    return found.select("user_id", "event_id")


# Incremental loading


@query
def incremental_merge(spark, d):
    facts = S.facts(spark, d).select("fact_id", "filed", "value", "first_observed")
    existing = facts.where(F.col("filed") < F.lit("1997-01-01").cast("date"))
    late = facts.where(F.col("filed") >= F.lit("1996-01-01").cast("date"))
    incoming = late.withColumn("first_observed", F.col("first_observed") + F.expr("INTERVAL 400 DAYS"))
    return R.merge_facts(existing, incoming)


@query
def filtered_merge(spark, d):
    """New facts, told by Bloom filters of the stored ids; only what these pass is looked up."""
    # Read five times below, so joined and identified once.
    facts = stored(S.facts(spark, d).select("fact_id", "cik", (F.col("cik") % 4).cast("int").alias("part")))
    known = facts.where(F.substring("fact_id", 1, 1) < "8")
    # Four parts: their sizes are four numbers.
    sizes = known.groupBy("part").agg(F.count("*").alias("n")).collect()
    parts = spark.createDataFrame([(r["part"], M.blocks_for(r["n"])) for r in sizes], "part int, blocks int")
    filters = M.bloom_blocks(known.join(F.broadcast(parts), "part"), ["part"], "fact_id", "blocks")
    maybe = M.maybe_held(facts, parts, filters, ["part"], ["part"], "fact_id").select("fact_id")
    held = known.join(maybe, "fact_id", "left_semi")
    return R.unseen(facts.drop("part"), held, "fact_id")


def _touched(spark, d):
    """Facts seen after the cutoff, and canonical and annual records from those seen before."""
    facts = S.facts(spark, d)
    before = facts.where(seen_by(facts, SEEN))
    late = facts.where(~seen_by(facts, SEEN))
    issuers = current_issuers(spark, d)
    held = canonical_facts(before, S.AS_OF)
    nobody = issuers.select("cik").limit(0)
    return facts, issuers, held, D.touched_periods(late, held, nobody)


@query
def affected_periods(spark, d):
    """What late facts reach: their periods, and the next annual period after each."""
    facts, issuers, held, touched = _touched(spark, d)
    before = A.annual_financials(held, issuers, S.AS_OF)
    return D.with_following(touched, before, annual(spark, d))


@query
def affected_trends(spark, d):
    """Trends of early facts, brought up to date for late ones: the result of a full build."""
    facts, issuers, held, touched = _touched(spark, d)
    before = A.annual_financials(held, issuers, S.AS_OF)
    rebuilt = canonical_facts(facts.join(touched, D.PERIOD, "left_semi"), S.AS_OF)
    now = D.swapped(before, A.annual_financials(rebuilt, issuers, S.AS_OF), touched)
    reach = D.with_following(touched, before, now)
    near = now.join(touched.select("cik").distinct(), "cik", "left_semi")
    fresh = A.company_trends(near, issuers).join(reach, D.PERIOD, "left_semi")
    return rounded(D.swapped(A.company_trends(before, issuers), fresh, reach), *RATIOS, "revenue_growth_yoy")


@query
def snapshot_skip(spark, d):
    taken = S.with_provenance(S.observations(spark, d)).select("snapshot_id", "cik", "y").distinct()
    return R.unseen(taken, taken.where(F.col("y") < 1996), "snapshot_id")


@query
def load_ledger(spark, d):
    obs = S.observations(spark, d)
    rows = obs.withColumns({
        "accepted": F.coalesce(F.col("filed") >= F.col("period_end"), F.lit(False)),
        "fact_id": fact_identity(),
    })
    return R.outcome_counts(rows, rows.where("accepted and y < 1996"))


@query
def fact_lineage_query(spark, d):
    facts = S.facts(spark, d)
    traced = fact_lineage(facts, S.snapshots(facts), current_issuers(spark, d))
    return traced.select(
        F.col("fact.fact_id").alias("fact_id"), F.col("fact.ticker").alias("ticker"),
        F.col("fact.value").alias("value"), F.col("source.company_facts_url").alias("source_url"),
        F.col("source.filing_url").alias("filing_url"), F.col("source.sha256").alias("source_sha"),
        F.col("storage.bronze").alias("bronze_path"), F.col("storage.silver").alias("silver_path"),
        F.col("storage.snapshot_id").alias("snapshot_id"), "annual_candidate",
        F.array_join("annual_model_path", ">").alias("model_path"),
    )


# Quality


def _on_annual(report, spark, d) -> DataFrame:
    marts = Marts(spark, d)
    return report(marts.annual, marts.issuers)


@query
def coverage_by_issuer(spark, d):
    return _on_annual(Q.coverage_by_issuer, spark, d)


@query
def missing_by_metric(spark, d):
    return _on_annual(Q.missing_by_metric, spark, d)


@query
def missing_metrics(spark, d):
    rows = _on_annual(Q.missing_metric_list, spark, d)
    return rows.withColumn("missing_metrics", F.array_join("missing_metrics", ","))


@query
def incomplete_periods(spark, d):
    return _on_annual(Q.incomplete_periods, spark, d)


@query
def balance_warnings(spark, d):
    return _on_annual(Q.balance_warnings, spark, d)


@query
def quality_summary(spark, d):
    return _on_annual(Q.quality_summary, spark, d)


@query
def coverage_pct(spark, d):
    return rounded(_on_annual(Q.coverage_percent, spark, d), "coverage")


@query
def coverage_gate(spark, d):
    early = canonical_facts(S.facts(spark, d), S.EARLIER)
    issuers = current_issuers(spark, d)
    return Q.coverage_gate(A.annual_financials(early, issuers, S.EARLIER), issuers)


@query
def release_totals(spark, d):
    marts = Marts(spark, d)
    return Q.release_totals(marts.facts, marts.annual, marts.revisions())


@query
def check_summary(spark, d):
    return checked_marts(spark, d).checks()


@query
def release_gauges(spark, d):
    marts = checked_marts(spark, d)
    summary = Q.quality_summary(marts.annual, marts.issuers)
    return Q.release_gauges(summary, marts.facts, marts.checks())


@query
def check_unique(spark, d):
    return C.check_unique(S.facts(spark, d), "accession")


@query
def check_not_null(spark, d):
    return C.check_not_null(A.annual_pivot(canonical(spark, d)), "revenue").select("cik", "period_end")


@query
def check_relationships(spark, d):
    marts = Marts(spark, d)
    kept = marts.issuers.where(F.col("cik") % 5 != 0)
    return C.check_relationship(marts.annual, kept, "issuer_key").select("annual_key", "cik")


@query
def check_no_future(spark, d):
    return C.check_no_future(S.facts(spark, d), S.EARLIER).select("fact_id", "filed")


@query
def check_no_quarterly(spark, d):
    return C.check_no_quarterly(S.facts(spark, d)).select("fact_id", "period_start", "period_end")


@query
def check_nonnegative(spark, d):
    net = annual(spark, d).withColumn("cash", F.col("cash") - F.col("current_liabilities"))
    return C.check_nonnegative(net).select("annual_key", "cash")


@query
def check_one_current(spark, d):
    history = S.issuer_history(spark, d)
    still_open = F.col("valid_to").isNull()
    lost = history.where(~(still_open & (F.col("cik") % 7 == 0)))
    return C.check_one_current(lost.unionByName(history.where(still_open & (F.col("cik") % 10 == 4))))


def queries() -> dict:
    return {name.removesuffix("_query"): function for name, function in REGISTRY.items()}
