"""Load changed source documents into the fact store: one distributed pass, all issuers."""

from __future__ import annotations

import dataclasses
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vintry import schemas
from vintry.contract import CONCEPTS, DEFAULT_MIN_YEAR, MAX_REJECT_RATE, check_min_year
from vintry.functions.identity import snapshot_identity
from vintry.operators import validation as V
from vintry.operators.history import scd2_merge
from vintry.operators.membership import blocks_for, bloom_blocks, maybe_held
from vintry.operators.versions import keep_first, load_ledger, unseen
from vintry.plans.integrity import record_leaves
from vintry.sources.config import issuer_config_checks
from vintry.sources.documents import content_sha
from vintry.sources.store import Generation, Piece, Store

SHOWN = 20


class ContractError(ValueError):
    """A source breaks the contract; nothing of the run may be published.

    ``counts`` holds what the run had found by then.
    """

    def __init__(self, message: str, **counts):
        super().__init__(message)
        self.counts = counts


@dataclasses.dataclass(frozen=True)
class Load:
    """What one ingest added, and the generation that names it."""

    run_id: str
    observed: datetime
    loaded: int
    skipped: int
    inserted: int
    rejected: int
    generation: Generation
    base: int  # number of the release it was compared with; 0 before the first
    unmatched: int = 0
    failed: int = 0
    touched: tuple[int, ...] = ()  # issuer buckets with anything new


def instant(moment: datetime) -> Column:
    if moment.tzinfo is None:
        raise ValueError("an observation time needs a time zone")
    return F.lit(moment.astimezone(timezone.utc).isoformat()).cast("timestamp")


def _stop_if_any(failing: DataFrame, message: str, **counts) -> None:
    """Raise with a few examples; only those come to the driver."""
    rows = failing.limit(SHOWN).collect()
    if rows:
        shown = "; ".join(str(r.asDict()) for r in rows)
        raise ContractError(f"{message}: {shown}", **counts)


def _described(documents: DataFrame, issuers: DataFrame, min_year: int) -> DataFrame:
    """One row per document, without its body; ``unmatched`` says why one cannot be used."""
    landed = F.col("landed_at") if "landed_at" in documents.columns else F.lit(None)
    known = issuers.withColumn("configured", F.lit(True))
    unmatched = F.when(F.col("cik").isNull(), F.lit("file_name_without_issuer")).when(
        F.col("configured").isNull(), F.lit("issuer_not_configured")
    )
    return (
        documents.select(
            "cik", "source_url", landed.cast("timestamp").alias("landed_at"),
            content_sha(F.col("content")).alias("source_sha"),
            F.octet_length("content").alias("n_bytes"),
        )
        .join(known, "cik", "left")
        .withColumn("unmatched", unmatched)
        .withColumn("snapshot_id", snapshot_identity(F.col("source_sha"), min_year))
        .drop("configured")
    )


def pending_bodies(documents: DataFrame, pending: DataFrame) -> DataFrame:
    """The documents that ``pending`` names, with their bodies, as they were when hashed.

    Bodies come from this run's documents, never from the archive of all runs.
    """
    hashed = documents.select(
        "cik", "source_url", content_sha(F.col("content")).alias("source_sha"), "content"
    )
    chosen = pending.select("cik", "source_url", "source_sha")
    bodies = hashed.join(chosen, ["cik", "source_url", "source_sha"], "left_semi")
    return bodies.select("cik", "source_sha", F.col("content").cast("binary").alias("content"))


def _archive(
    store: Store, documents: DataFrame, sources: DataFrame, pending: DataFrame, buckets: list[int], run_id: str
) -> DataFrame:
    """Archive new bodies; return (cik, source_sha, content) of all pending documents.

    Which bodies are new is told from digests alone, and the documents are read once more to
    write those. The others, read again under another contract, are not archived twice.
    """
    spark, key = pending.sparkSession, ["cik", "source_sha"]
    archived = store.bronze(spark, buckets).select(*key).distinct()
    fresh = pending.join(archived, key, "left_anti")
    folders = fresh.groupBy(store.bucket(F.col("cik")).alias("b")).agg(F.count("*").alias("n")).collect()
    expected = sum(r["n"] for r in folders)
    repeated = sources.groupBy(*key, "source_url").count().where("count > 1").limit(1).count()

    def bodies(rows: DataFrame) -> DataFrame:
        found = pending_bodies(documents, rows)
        # Rows that repeat both name and body are one document.
        return found.dropDuplicates(key) if repeated else found

    parts = []
    if expected:
        store.archive(bodies(fresh), run_id)
        own = store.archived_by(spark, run_id, [r["b"] for r in folders])
        if own.count() != expected:
            raise ContractError("documents changed while they were read")
        record_leaves(store, own, run_id)
        parts.append(own)
    if pending.count() > expected:
        parts.append(bodies(pending.join(archived, key, "left_semi")))
    return reduce(DataFrame.unionByName, parts)


def failed_documents(staged: DataFrame, max_reject_rate: float) -> DataFrame:
    """(cik, snapshot_id, reason, detail) of documents that a gate turns away.

    A document that fails several gates is listed once, with the first of them.
    """
    document = ("cik", "snapshot_id")
    errors = V.document_errors(staged, *document).select(
        *document, F.lit(1).alias("gate"), F.lit(ENVELOPE).alias("reason"), F.col("document_error").alias("detail")
    )
    nothing = V.accepted_nothing(staged, *document).select(
        *document, F.lit(2).alias("gate"), F.lit(NOTHING).alias("reason"), F.col("rejected").cast("string").alias("detail")
    )
    rates = V.reject_rates(staged, *document).where(F.col("reject_rate") > max_reject_rate).select(
        *document, F.lit(3).alias("gate"), F.lit(TOO_MANY).alias("reason"), F.col("reject_rate").cast("string").alias("detail")
    )
    every = errors.unionByName(nothing).unionByName(rates)
    first = F.min(F.struct("gate", "reason", "detail")).alias("first")
    return every.groupBy(*document).agg(first).select(*document, "first.reason", "first.detail")


ENVELOPE, NOTHING, TOO_MANY = "envelope", "nothing_accepted", "too_many_rejected"
# What a stopped run says.
_SAYS = {
    ENVELOPE: "source envelope violates the contract",
    NOTHING: "no supported fact survived the contract",
    TOO_MANY: "too many rejected rows",
}


def fact_filters(store: Store, spark: SparkSession, pieces: list[Piece]) -> list[Piece]:
    """Write a Bloom filter of the ids of each piece, beside it."""
    if not pieces:
        return []
    run_id = pieces[0].run_id
    sizes = spark.createDataFrame(
        [(p.bucket, blocks_for(p.rows)) for p in pieces], "cik_bucket int, blocks int"
    )
    ids = store.written(spark, schemas.FACTS, "facts", f"run_id={run_id}").select("cik_bucket", "fact_id")
    keys = ids.join(F.broadcast(sizes), "cik_bucket").withColumn("piece_run", F.lit(run_id))
    blocks = bloom_blocks(keys, ["piece_run", "cik_bucket"], "fact_id", "blocks")
    # A bucket's filter is a few rows: one file each.
    (
        blocks.withColumn("piece_bucket", F.col("cik_bucket")).select(*schemas.FILTERS.names, "cik_bucket")
        .repartition("cik_bucket").write.mode("overwrite").partitionBy("cik_bucket")
        .parquet(store.path("filters", f"run_id={run_id}"))
    )
    return [Piece("filters", p.bucket, run_id, blocks_for(p.rows)) for p in pieces]


def suspected_pieces(
    store: Store, spark: SparkSession, generation: Generation, incoming: DataFrame, buckets: list[int]
) -> list[Piece]:
    """Fact pieces that may hold some of the incoming ids, told from their filters.

    ``incoming`` has ``cik_bucket`` and ``fact_id``.
    """
    pieces = generation.of("facts", buckets)
    if not pieces:
        return []
    # One row per piece: bounded by buckets and compaction.
    parts = spark.createDataFrame(
        [(p.bucket, p.bucket, p.run_id, blocks_for(p.rows)) for p in pieces],
        "cik_bucket int, piece_bucket int, piece_run string, blocks int",
    )
    filters = store.read_pieces(spark, generation.of("filters", buckets), schemas.FILTERS)
    part = ["piece_run", "piece_bucket"]
    maybe = maybe_held(incoming, parts, filters, ["cik_bucket"], part, "fact_id")
    met = {(r["piece_run"], r["piece_bucket"]) for r in maybe.select(*part).distinct().collect()}
    return [p for p in pieces if (p.run_id, p.bucket) in met]


def ingest(
    spark: SparkSession,
    store: Store,
    documents: DataFrame,
    issuers: DataFrame,
    run_id: str,
    observed: datetime,
    concepts=CONCEPTS,
    min_year: int = DEFAULT_MIN_YEAR,
    max_reject_rate: float = MAX_REJECT_RATE,
    complete: bool = True,
    stop_on_failure: bool = True,
) -> Load:
    """Validate and load every unseen (issuer, source, contract) snapshot.

    ``documents`` is (cik, source_url, content) and, where known, ``landed_at``, by which
    documents of one issuer are ordered. With ``complete`` every configured issuer must
    have a document; a stream of newly landed files passes False. Documents without a
    configured issuer, rejected rows and drift are written to quarantine, even where a
    gate then stops the run. Gates look at each document by itself: one that fails stops the
    run, or, without ``stop_on_failure``, becomes a dead letter while the others are loaded.
    """
    check_min_year(min_year)
    if not 0 <= max_reject_rate <= 1:
        raise ValueError("max_reject_rate must be between 0 and 1")
    _stop_if_any(issuer_config_checks(issuers), "invalid issuer configuration")

    def kept(df: DataFrame, name: str) -> DataFrame:
        """Written once and read back, so that bodies are read for it only once."""
        path = store.path("runs", run_id, name)
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return spark.read.parquet(path)

    described = kept(_described(documents, issuers, min_year), "sources")
    strays = described.where("unmatched is not null")
    unmatched = strays.count()
    if unmatched:
        strays.select("source_url", "cik", "source_sha", F.col("unmatched").alias("reason")).write.mode(
            "overwrite"
        ).json(store.path("unmatched", f"run_id={run_id}"))
    sources = described.where("unmatched is null").drop("unmatched")
    if complete:
        absent = issuers.select("cik").join(sources, "cik", "left_anti")
        _stop_if_any(absent, "issuers without a source document")

    release = store.current_release(spark)
    generation = store.generation(spark, release)
    base = release["number"] if release else 0

    # At most store.buckets numbers: they prune the stored side to the touched folders.
    folders = sources.groupBy(store.bucket(F.col("cik")).alias("b")).agg(
        F.count("*").alias("n"), F.max("n_bytes").alias("longest")
    ).collect()
    seen, touched = sum(r["n"] for r in folders), [r["b"] for r in folders]
    large = max((r["longest"] or 0 for r in folders), default=0) > V.LARGE_DOCUMENT
    landing = [F.col("landed_at").asc_nulls_first(), F.col("source_url")]
    known = store.snapshots(spark, generation, touched)
    pending = kept(
        keep_first(unseen(sources, known, "snapshot_id"), "snapshot_id", *landing), "pending"
    )
    loaded = pending.count()
    skipped = seen - loaded
    if loaded == 0:
        return Load(run_id, observed, 0, skipped, 0, 0, generation, base, unmatched)

    bodies = _archive(store, documents, sources, pending, touched, run_id)
    carried = pending.select("cik", "source_sha", "snapshot_id", "landed_at")
    # Every gate, count and table below reads this one table, and a lost executor
    # never sends the job back to parsing.
    readable = bodies.join(carried, ["cik", "source_sha"])
    staged = kept(V.normalize(readable, concepts, min_year, split_large=large), "observations")

    rejected = V.rejected_rows(staged, "snapshot_id")
    rejected.write.mode("overwrite").json(store.path("quarantine", f"run_id={run_id}"))
    V.drift_telemetry(staged).write.mode("overwrite").json(
        store.path("telemetry", f"run_id={run_id}")
    )
    found = {
        "snapshots_loaded": loaded, "snapshots_skipped": skipped,
        "documents_unmatched": unmatched, "rejected_rows": rejected.count(),
    }
    failing = kept(failed_documents(staged, max_reject_rate), "failed")
    failed = failing.count()
    if failed and stop_on_failure:
        shown = failing.orderBy("reason", "cik", "snapshot_id").limit(SHOWN).collect()
        says = "; ".join(f"{_SAYS[r['reason']]}: {r.asDict()}" for r in shown)
        raise ContractError(says, **found)
    if failed:
        letters = failing.join(pending, ["cik", "snapshot_id"]).select(*schemas.DEAD_LETTERS.names)
        letters.write.mode("overwrite").parquet(store.path("dead_letters", f"run_id={run_id}"))
        bad = failing.select("snapshot_id")
        staged = staged.join(bad, "snapshot_id", "left_anti")
        rejected = rejected.join(bad, "snapshot_id", "left_anti")
        pending = pending.join(bad, "snapshot_id", "left_anti")
        loaded -= failed
        if not loaded:
            return Load(
                run_id, observed, 0, skipped, 0, found["rejected_rows"], generation, base, unmatched, failed
            )

    accepted = V.accepted_facts(staged, "source_sha", "snapshot_id", "landed_at")
    # A fact that several documents state belongs to the one that landed first.
    unique = keep_first(
        accepted, "fact_id", F.col("landed_at").asc_nulls_first(), "source_sha", "idx"
    )
    moment = instant(observed)
    location = store.bronze_folder(F.col("cik"))
    versions = unique.withColumn("first_observed", moment).withColumn("bronze_path", location)
    store.write_bucketed(versions.select(*schemas.FACTS.names), "silver", f"run_id={run_id}")
    silver = store.written(spark, schemas.FACTS, "silver", f"run_id={run_id}")
    # Stored ids are read only where a filter does not rule them out.
    suspected = suspected_pieces(store, spark, generation, silver, touched)
    fresh = silver.drop("cik_bucket")
    if suspected:
        fresh = unseen(fresh, store.read_pieces(spark, suspected, schemas.FACTS), "fact_id")
    pieces = store.write_pieces(fresh.select(*schemas.FACTS.names), "facts", run_id)
    grown = generation.added(pieces).added(fact_filters(store, spark, pieces))
    inserted = store.read_pieces(spark, pieces, schemas.FACTS)

    # Distinct first: it hashes, where a maximum of text would sort every observation.
    # The document that landed last names the issuer.
    stated = staged.select("cik", "entity_name", "landed_at", "source_sha").distinct()
    last = F.struct(F.col("landed_at").isNotNull(), "landed_at", "source_sha")
    names = stated.groupBy("cik").agg(F.max_by("entity_name", last).alias("name"))
    incoming = pending.join(names, "cik", "inner").select(
        "cik", "name", "ticker", "sector", "headquarters"
    ).distinct()
    # Copy on write: only the touched buckets of the history are read and written again.
    merged = scd2_merge(store.history(spark, generation, touched), incoming, moment)
    grown = grown.replaced("history", touched, store.write_pieces(merged, "history", run_id))

    # Each document's own facts, also those that another one stated before.
    stated_facts = accepted.select("snapshot_id", "fact_id").distinct()
    counts = load_ledger(stated_facts, rejected, inserted, by="snapshot_id")
    unread = staged.groupBy("snapshot_id").agg(*[
        F.coalesce(F.sum(F.when(F.col("status") == status, F.col("weight"))), F.lit(0)).alias(name)
        for name, status in (
            ("unknown_concepts", V.UNKNOWN_CONCEPT), ("other_units", V.OTHER_UNIT),
            ("old_periods", V.OLD_PERIOD),
        )
    ])
    known_counts = pending.join(counts, "snapshot_id", "left").join(unread, "snapshot_id", "left")
    entries = known_counts.na.fill(0).select(
        "snapshot_id", "cik", "source_sha", "source_url",
        location.alias("bronze_path"),
        F.lit(f"silver/run_id={run_id}").alias("silver_path"),
        moment.alias("ingested_at"),
        F.col("accepted").alias("accepted_count"),
        F.col("rejected").alias("rejected_count"),
        F.col("inserted").alias("inserted_count"),
        "unknown_concepts", "other_units", "old_periods",
    )
    ledger = store.write_pieces(entries, "snapshots", run_id)
    grown = grown.added(ledger)
    issuer_report(
        sources, store.read_pieces(spark, ledger, schemas.SNAPSHOTS), failing
    ).write.mode("overwrite").json(store.path("issuer_reports", f"run_id={run_id}"))
    return Load(
        run_id, observed, loaded, skipped, sum(p.rows for p in pieces), found["rejected_rows"],
        grown, base, unmatched, failed, tuple(sorted({p.bucket for p in ledger})),
    )


def issuer_report(sources: DataFrame, entries: DataFrame, failed: DataFrame) -> DataFrame:
    """One row per issuer of a run: documents by outcome, and rows of the loaded ones."""
    seen = sources.groupBy("cik").agg(F.count("*").alias("seen"))
    rows = entries.groupBy("cik").agg(
        F.count("*").alias("snapshots_loaded"),
        *[F.sum(c).alias(c) for c in ("accepted_count", "rejected_count", "inserted_count")],
    )
    bad = failed.groupBy("cik").agg(F.count("*").alias("snapshots_failed"))
    joined = seen.join(rows, "cik", "left").join(bad, "cik", "left").na.fill(0)
    skipped = F.col("seen") - F.col("snapshots_loaded") - F.col("snapshots_failed")
    return joined.withColumn("snapshots_skipped", skipped).select(*schemas.ISSUER_REPORT.names)
