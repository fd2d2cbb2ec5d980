"""Build, check and publish a release. The manifest row is the only commit."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import time
import uuid
from collections.abc import Callable
from datetime import date, datetime, timezone
from functools import cache
from importlib import resources

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from vintry import schemas
from vintry.operators import quality as Q
from vintry.operators.affected import PERIOD, swapped, touched_periods, with_following
from vintry.operators.annual import annual_financials, company_trends
from vintry.operators.checks import check_summary
from vintry.operators.exports import write_tables
from vintry.operators.history import dim_issuer
from vintry.operators.revisions import filing_revisions
from vintry.operators.selection import canonical_facts
from vintry.plans.ingest import ContractError, Load, ingest, instant
from vintry.sources.commit import create_if_absent
from vintry.sources.store import Generation, Store, dated

PERIODS = "cik bigint, period_end date"
KEYED = "cik bigint"  # what every counted table has

EXPORTED = ("dim_issuer", "annual_financials", "company_trends", "filing_revisions")


@cache
def model_version() -> str:
    """A digest of the code that gives the marts their meaning.

    An unchanged source is built again when it changes. The code is read as package data, so
    the library may be shipped as a zip file.
    """
    top = resources.files("vintry")
    folders = [top.joinpath("functions"), top.joinpath("operators")]
    sources = [top.joinpath("contract.py"), *(p for d in folders for p in d.iterdir() if p.name.endswith(".py"))]
    named = sorted((p.name, p.read_bytes()) for p in sources)
    return hashlib.sha256(b"\0".join(body for _, body in named)).hexdigest()[:12]


@dataclasses.dataclass(frozen=True)
class Build:
    """What one publication builds: all of every mart, or only what a load can have changed."""

    buckets: list[int] | None  # None: all
    touched: DataFrame | None = None  # (cik, period_end); None: every row of those buckets

    @property
    def whole(self) -> bool:
        return self.touched is None


def _moved_cutoff(served: Row, load: Load, as_of: date) -> bool:
    """Whether some fact is filed after either cutoff, so that moving it changes marts."""
    before, latest = served["filing_date_cutoff"], served["latest_filed"]
    return before != as_of and (latest is None or latest > min(before, as_of))


def plan_build(
    spark: SparkSession, store: Store, load: Load, served: Row | None, as_of: date, force: bool = False
) -> Build:
    """Decide what has to be built again. Reads only buckets that the load touched."""
    if (
        force or served is None or served["model_version"] != model_version()
        or _moved_cutoff(served, load, as_of)
    ):
        return Build(None)
    buckets = list(load.touched)
    own = [p for p in load.generation.of("facts", buckets) if p.run_id == load.run_id]
    schemas_held = store.mart_schemas(spark, served["model_version"])
    changed = store.read_pieces(spark, own, schemas.FACTS)
    held = store.mart(spark, load.generation, "canonical_facts", schemas_held["canonical_facts"], buckets)
    reopened = store.history(spark, load.generation, buckets).where(
        F.col("valid_from") == instant(load.observed)
    )
    path = store.path("runs", load.run_id, "touched_periods")
    touched_periods(changed, held, reopened).write.mode("overwrite").parquet(path)
    return Build(buckets, spark.read.schema(PERIODS).parquet(path))


def build_marts(
    spark: SparkSession, store: Store, load: Load, served: Row | None, as_of: date, build: Build
) -> tuple[Generation, dict[str, DataFrame]]:
    """Write each mart's rebuilt buckets and build the next mart on what was written.

    Returns the generation that names them, and the marts' rows in the built buckets. An
    incremental build reads facts of touched periods and marts of touched buckets, and its
    result is that of building everything.
    """
    generation, buckets, touched = load.generation, build.buckets, build.touched
    held_schemas = {} if build.whole else store.mart_schemas(spark, served["model_version"])
    written = {}

    def stored(name: str, df: DataFrame, periods: DataFrame | None = None) -> DataFrame:
        """``periods`` (None: all) of the mart come from ``df``, the others from the store."""
        nonlocal generation
        df = df.drop("filing_date_cutoff")
        if not build.whole and periods is not None:
            held = store.mart(spark, generation, name, held_schemas[name], buckets)
            df = swapped(held, df, periods)
        pieces = store.write_pieces(df, f"marts/{name}", load.run_id)
        generation = generation.replaced(f"marts/{name}", buckets, pieces)
        written[name] = store.read_pieces(spark, pieces, df.schema)
        return dated(name, written[name], as_of)

    facts = store.facts(spark, load.generation, buckets)
    if not build.whole:
        facts = facts.join(touched, PERIOD, "left_semi")
        annual_before = store.mart(
            spark, load.generation, "annual_financials", held_schemas["annual_financials"], buckets
        )
    issuers = stored("dim_issuer", dim_issuer(store.history(spark, load.generation, buckets)))
    rebuilt = canonical_facts(facts, as_of)
    canonical = stored("canonical_facts", rebuilt, touched)
    if not build.whole:
        rebuilt = canonical.join(touched, PERIOD, "left_semi")
    annual = stored(
        "annual_financials",
        annual_financials(canonical if build.whole else rebuilt, issuers, as_of), touched,
    )
    if build.whole:
        stored("company_trends", company_trends(annual, issuers))
    else:
        reach = with_following(touched, annual_before, annual)
        # Growth looks back, so the issuers' other periods are at hand.
        near = annual.join(touched.select("cik").distinct(), "cik", "left_semi")
        stored("company_trends", company_trends(near, issuers).join(reach, PERIOD, "left_semi"), reach)
    stored("filing_revisions", filing_revisions(facts, as_of), touched)
    store.keep_mart_schemas(spark, model_version(), {n: df.schema for n, df in written.items()})
    return generation, {name: dated(name, df, as_of) for name, df in written.items()}


def run_checks(
    spark: SparkSession, store: Store, load: Load, marts: dict[str, DataFrame], as_of: date, build: Build
) -> int:
    """All checks must pass and every issuer must be covered; returns the passes.

    Every check compares rows of one issuer only, so buckets that were not built again keep
    the result they were published with.
    """
    summary = check_summary(
        store.facts(spark, load.generation, build.buckets),
        store.history(spark, load.generation, build.buckets),
        marts["canonical_facts"], marts["dim_issuer"], marts["annual_financials"],
        marts["company_trends"], marts["filing_revisions"], as_of,
    )
    path = store.path("releases", load.run_id, "checks")
    summary.write.mode("overwrite").json(path)
    outcome = spark.read.schema(summary.schema).json(path).collect()
    failed = [r["check_name"] for r in outcome if r["status"] != "pass"]
    if failed or not outcome:
        raise ContractError("failed checks: " + ", ".join(failed))
    gap = Q.coverage_gate(marts["annual_financials"], marts["dim_issuer"]).limit(20).collect()
    if gap:
        raise ContractError(
            "issuers without an annual revenue and assets period: "
            + ", ".join(r["ticker"] for r in gap)
        )
    return len(outcome)


def _append(spark: SparkSession, store: Store, folder: str, row: dict, schema) -> None:
    """Append one row as a small file of its own."""
    body = {
        name: v.isoformat() if isinstance(v := row.get(name), (date, datetime)) else v
        for name in schema.names
    }
    create_if_absent(
        spark, store.path(folder, f"{uuid.uuid4().hex}.json"), json.dumps(body) + "\n"
    )


def publish(
    spark: SparkSession, store: Store, load: Load, as_of: date, exports: bool = True, force: bool = False
) -> dict:
    """Build and verify the release of ``load``, then commit its manifest.

    The commit creates the manifest after the one that ``load`` was compared with. It fails
    where another run has published in between: its facts would be missing here.
    """
    served = store.current_release(spark)
    if (served["number"] if served else 0) != load.base:
        raise ContractError(f"another run has published since run {load.run_id} began")
    build = plan_build(spark, store, load, served, as_of, force)
    generation, marts = build_marts(spark, store, load, served, as_of, build)
    passed = run_checks(spark, store, load, marts, as_of, build)
    totals = {name: generation.rows(table) for name, table in COUNTED.items()}
    kinds = store.mart_schemas(spark, model_version())

    def whole(name: str) -> DataFrame:
        return dated(name, store.mart(spark, generation, name, kinds[name]), as_of)

    # Reports are per issuer over annual records, a small part of the facts.
    for name, report in Q.quality_report(whole("annual_financials"), whole("dim_issuer")).items():
        path = store.path("releases", load.run_id, "quality", name)
        report.write.mode("overwrite").parquet(path)
    summary = store.quality(spark, load.run_id, "summary").first()
    if exports:
        folder = store.path("releases", load.run_id, "exports", uuid.uuid4().hex)
        write_tables({name: whole(name) for name in EXPORTED}, folder)
    own = [p for p in generation.of("facts") if p.run_id == load.run_id]
    filed = [store.read_pieces(spark, own, schemas.FACTS).agg(F.max("filed")).first()[0]] if own else []
    filed = [d for d in (*filed, served["latest_filed"] if served else None) if d is not None]
    manifest = {
        "run_id": load.run_id, "status": "success",
        "published_at": datetime.now(timezone.utc), "filing_date_cutoff": as_of,
        "model_version": model_version(), "latest_filed": max(filed, default=None),
        "checks_passed": passed, **totals,
        "incomplete_periods": summary["incomplete_periods"],
        "balance_warnings": summary["balance_warnings"],
        "rebuilt_buckets": store.buckets if build.buckets is None else len(build.buckets),
    }
    _verify(spark, store, generation, build.buckets)
    if not store.commit_manifest(spark, load.base, generation, manifest):
        raise ContractError(f"another run has published since run {load.run_id} began")
    return manifest


# Counts of a manifest, and the table whose rows each is.
COUNTED = {
    "total_facts": "facts", "annual_periods": "marts/annual_financials",
    "revisions": "marts/filing_revisions",
}


def _verify(spark: SparkSession, store: Store, generation: Generation, buckets: list[int] | None) -> None:
    """Count the tables again in storage (from footers) and compare with the generation."""
    wrong = {}
    for table in COUNTED.values():
        pieces = generation.of(table, buckets)
        found = store.read_pieces(spark, pieces, KEYED).count()
        if found != sum(p.rows for p in pieces):
            wrong[table] = found
    if wrong:
        raise ContractError(f"tables differ from their generation: {wrong}")


def verify_release(spark: SparkSession, store: Store) -> Row:
    """Check the served release independently of the run that wrote it."""
    manifest = store.current_release(spark)
    if manifest is None or manifest["status"] != "success" or not manifest["checks_passed"]:
        raise ContractError("no successful, checked release")
    generation = store.generation(spark, manifest)
    wrong = {n: generation.rows(t) for n, t in COUNTED.items() if generation.rows(t) != manifest[n]}
    if wrong:
        raise ContractError(f"release {manifest['run_id']} differs from its manifest: {wrong}")
    _verify(spark, store, generation, None)
    return manifest


def serving_gauges(spark: SparkSession, store: Store) -> DataFrame:
    """Gauges of the served release, from its manifest; without one, only that none is ready."""
    return Q.manifest_gauges(spark, store.current_release(spark))


def run(
    spark: SparkSession,
    store: Store,
    documents: DataFrame,
    issuers: DataFrame,
    as_of: date | None = None,
    mode: str = "batch",
    force: bool = False,
    run_id: str | None = None,
    observed: datetime | None = None,
    publisher: Callable = publish,
    **contract,
) -> dict:
    """Ingest what changed and publish a validated release; return the run report.

    If nothing was loaded and neither models nor cutoff changed, the served release
    stays. On any failure it stays too, and the report says why.
    """
    observed = observed or datetime.now(timezone.utc)
    as_of = as_of or observed.date()
    started = time.monotonic()
    report = {
        "run_id": run_id or uuid.uuid4().hex, "status": "running", "mode": mode,
        "started_at": observed, "filing_date_cutoff": as_of, "model_version": model_version(),
    }
    _append(spark, store, "reports", report, schemas.RUN_REPORT)
    try:
        load = ingest(
            spark, store, documents, issuers, report["run_id"], observed, **contract
        )
        report.update(
            snapshots_loaded=load.loaded, snapshots_skipped=load.skipped,
            facts_inserted=load.inserted, rejected_rows=load.rejected,
            documents_unmatched=load.unmatched, documents_failed=load.failed,
        )
        served = store.current_release(spark)
        same = (
            served is not None and load.loaded == 0 and not force
            and served["model_version"] == model_version() and served["filing_date_cutoff"] == as_of
        )
        if same:
            report.update(status="unchanged", published_run_id=served["run_id"])
        else:
            publisher(spark, store, load, as_of, **({"force": True} if force else {}))
            report.update(status="success", published_run_id=load.run_id)
    except Exception as error:
        report.update(status="failed", error=str(error), **getattr(error, "counts", {}))
        raise
    finally:
        report["elapsed_seconds"] = round(time.monotonic() - started, 3)
        _append(spark, store, "reports", report, schemas.RUN_REPORT)
    return report
