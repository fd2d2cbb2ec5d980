"""Keep the store bounded: merge small pieces, and let go of what no release names.

Facts and the ledger grow by one piece per run and touched bucket. Pieces of similar size are
merged when ``fan_in`` of them have come together, so a bucket holds at most about
``fan_in`` pieces per power of ``fan_in`` in its rows, and a row is rewritten once per power.
Merging changes no release: it commits the served one again under a new generation.
"""

from __future__ import annotations

import math
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from vintry import schemas
from vintry.plans.ingest import fact_filters
from vintry.sources import commit
from vintry.sources.store import MARTS, Generation, Piece, Store

FAN_IN = 8
COMPACTED = {"facts": schemas.FACTS, "snapshots": schemas.SNAPSHOTS}
_TABLES = ("facts", "filters", "snapshots", "history", *(f"marts/{m}" for m in MARTS))


def crowded(pieces: list[Piece], fan_in: int) -> list[Piece]:
    """Pieces to be merged: of each bucket the smaller tiers, up to the highest full one."""
    tiers: dict[int, dict[int, list[Piece]]] = {}
    for piece in pieces:
        tier = int(math.log(max(piece.rows, 1), fan_in))
        tiers.setdefault(piece.bucket, {}).setdefault(tier, []).append(piece)
    chosen = []
    for by_tier in tiers.values():
        full = [tier for tier, held in by_tier.items() if len(held) >= fan_in]
        if full:
            chosen += [p for tier, held in by_tier.items() if tier <= max(full) for p in held]
    return chosen


def _merged(store: Store, spark: SparkSession, table: str, chosen: list[Piece], run_id: str) -> list[Piece]:
    rows: DataFrame = store.read_pieces(spark, chosen, COMPACTED[table])
    return store.write_pieces(rows, table, run_id)


def compact(spark: SparkSession, store: Store, fan_in: int = FAN_IN) -> Generation | None:
    """Merge crowded pieces of the served release in one job per table.

    Returns the new generation, or None where nothing is crowded or another writer has
    published meanwhile; then the next call finds the pieces again. Readers of the earlier
    generation keep its folders.
    """
    served = store.current_release(spark)
    if served is None:
        return None
    generation, run_id = store.generation(spark, served), f"compact-{uuid.uuid4().hex}"
    before = generation
    for table in COMPACTED:
        chosen = crowded(generation.of(table), fan_in)
        if not chosen:
            continue
        made = _merged(store, spark, table, chosen, run_id)
        if sum(p.rows for p in made) != sum(p.rows for p in chosen):
            raise RuntimeError(f"merging {table} changed its number of rows")
        generation = generation.without(chosen).added(made)
        if table == "facts":
            old = {(p.run_id, p.bucket) for p in chosen}
            filters = [p for p in generation.of("filters") if (p.run_id, p.bucket) in old]
            generation = generation.without(filters).added(fact_filters(store, spark, made))
    if generation is before:
        return None
    manifest = served.asDict()
    return generation if store.commit_manifest(spark, served["number"], generation, manifest) else None


def expire(spark: SparkSession, store: Store, keep: int, written_before: datetime) -> list[str]:
    """Delete all but the ``keep`` newest manifests, and pieces that only those named.

    A piece of a run still at work is named by no manifest, so only pieces that a deleted
    manifest named are deleted; ``written_before`` spares releases that may still be read.
    """
    if keep < 1:
        raise ValueError("keep at least the served release")
    found = [n for n in commit.names(spark, store.path("manifests")) if n.endswith(".json")]
    manifests = {name: store.manifest(spark, name) for name in found}
    old = [
        name for name in found[:-keep]
        if manifests[name]["published_at"].astimezone(timezone.utc) < written_before
    ]
    generations = {name: store.generation(spark, manifests[name]) for name in found}
    named = {p.path for name in found if name not in old for p in generations[name].pieces}
    gone = sorted({p.path for name in old for p in generations[name].pieces if p.table in _TABLES} - named)
    for path in gone:
        commit.delete(spark, store.path(path))
    for name in old:
        commit.delete(spark, store.path("manifests", name))
        commit.delete(spark, store.path("generations", manifests[name]["generation"]))
    return gone
