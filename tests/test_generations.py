"""Store generations: incremental marts equal full ones, commits race, pieces are merged."""

from __future__ import annotations

import glob
import json
import os
import random
from datetime import date, datetime, timedelta, timezone
from functools import partial

import pytest
from conftest import AS_OF, held, observed
from pyspark.sql import functions as F

from vintry.operators import membership as M
from vintry.operators.affected import touched_periods, with_following
from vintry.plans import publish as P
from vintry.plans.compact import compact, crowded, expire
from vintry.plans.ingest import ContractError, ingest, suspected_pieces
from vintry.plans.integrity import suspect_buckets, verify_archive
from vintry.sources import commit
from vintry.sources.store import MARTS, Generation, Piece, Store

START = datetime(2026, 1, 1, 12, tzinfo=timezone.utc)
YEARS = range(2018, 2025)
CONCEPTS = {"Revenues": True, "Assets": False, "Liabilities": False, "NetIncomeLoss": True}


@pytest.fixture(autouse=True)
def small_jobs(spark):
    small = {
        "spark.sql.shuffle.partitions": "2", "spark.sql.adaptive.enabled": "false",
        "spark.sql.codegen.wholeStage": "false",
    }
    before = {key: spark.conf.get(key) for key in small}
    for key, value in small.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def filing(draw, cik, amendments, name="Maker"):
    """A document whose observations only ever grow: base years, then amended values."""
    concepts = {}
    for concept, flow in CONCEPTS.items():
        rows = []
        for year in YEARS:
            start = {"start": f"{year}-01-01"} if flow else {}
            value = 1000 * cik + year + len(concept)
            rows.append(observed(
                value, end=f"{year}-12-31", filed=f"{year + 1}-03-01",
                accn=f"{cik:010d}-{(year + 1) % 100:02d}-000001", fy=year, **start,
            ))
        concepts[concept] = {"units": {"USD": rows}}
    for n, (concept, year, value) in enumerate(amendments):
        start = {"start": f"{year}-01-01"} if CONCEPTS[concept] else {}
        concepts[concept]["units"]["USD"].append(observed(
            value, end=f"{year}-12-31", filed="2025-09-01", form="10-K/A",
            accn=f"{cik:010d}-25-{n + 100:06d}", fy=year, **start,
        ))
    return {"cik": cik, "entityName": f"{name} {cik}", "facts": {"us-gaap": concepts}}


def documents(spark, payloads, day):
    return spark.createDataFrame(
        [(p["cik"], f"memory://{p['cik']}", START + timedelta(days=day), json.dumps(p)) for p in payloads],
        "cik bigint, source_url string, landed_at timestamp, content string",
    )


def load(spark, store, payloads, issuers, day, **options):
    options = {"as_of": AS_OF, "publisher": partial(P.publish, exports=False), **options}
    return P.run(
        spark, store, documents(spark, payloads, day), issuers, complete=False,
        observed=START + timedelta(days=day), **options,
    )


def contents(release):
    return {
        name: sorted((tuple(r) for r in release.mart(name).select(*sorted(release.mart(name).columns)).collect()), key=str)
        for name in MARTS
    }


def test_incremental_marts_are_those_of_a_full_build(spark, tmp_path, issuers, monkeypatch):
    """Random amendments and a renamed issuer, batch by batch, against forced rebuilds."""
    draw, store = random.Random(5), Store(str(tmp_path / "lake"), buckets=4)
    ciks = (1, 2, 3, 4, 5)
    amended = {cik: [] for cik in ciks}
    load(spark, store, [filing(draw, cik, []) for cik in ciks], issuers(ciks=ciks), 0)
    assert store.current_release(spark)["rebuilt_buckets"] == 4
    for day in (1, 2):
        changed = draw.sample(ciks, 2)
        for cik in changed:
            amended[cik].append((draw.choice(list(CONCEPTS)), draw.choice(YEARS), draw.randrange(10**6)))
        name = "Renamed" if day == 2 else "Maker"
        payloads = [filing(draw, cik, amended[cik], name) for cik in changed]
        read = []
        facts_of = Store.facts

        def watched(self, session, generation, buckets=None):
            read.append(buckets)
            return facts_of(self, session, generation, buckets)

        with monkeypatch.context() as patched:
            patched.setattr(Store, "facts", watched)
            report = load(spark, store, payloads, issuers(ciks=ciks), day)
        touched = {r["b"] for r in spark.createDataFrame([(c,) for c in changed], "c bigint").select(
            store.bucket(F.col("c")).alias("b")).collect()}
        assert report["status"] == "success" and all(set(b) <= touched for b in read)
        release = store.release(spark)
        assert release.manifest["rebuilt_buckets"] == len(touched)
        kept = [p for p in release.generation.of("marts/annual_financials") if p.bucket not in touched]
        assert kept and all(p.run_id != report["run_id"] for p in kept)
    incremental, before = contents(release), release.manifest
    load(spark, store, [], issuers(ciks=ciks), 4, force=True)
    forced = store.release(spark)
    assert forced.manifest["rebuilt_buckets"] == 4
    assert contents(forced) == incremental
    assert all(forced.manifest[c] == before[c] for c in ("total_facts", "annual_periods", "revisions"))
    # The cutoff moves back before the amendments: some fact is filed later, so all is built.
    moved = load(spark, store, [], issuers(ciks=ciks), 5, as_of=date(2025, 6, 1))
    assert moved["status"] == "success"
    release = store.release(spark)
    assert release.manifest["rebuilt_buckets"] == 4 and release.mart("filing_revisions").count() == 0
    assert {r[0] for r in release.mart("company_trends").select("filing_date_cutoff").distinct().collect()} == {date(2025, 6, 1)}


def test_closure_of_touched_periods(spark):
    def periods(*rows):
        return spark.createDataFrame(
            [(c, date(y, 12, 31)) for c, y in rows], "cik bigint, period_end date"
        )

    def years(df):
        return sorted((r["cik"], r["period_end"].year) for r in df.collect())

    annual = periods((1, 2019), (1, 2020), (1, 2022), (2, 2020), (2, 2021))
    touched = touched_periods(periods((1, 2020), (1, 2020)), annual, periods((2, 1)).select("cik"))
    assert years(touched) == [(1, 2020), (2, 2020), (2, 2021)]
    assert years(with_following(periods((1, 2019), (1, 2020), (1, 2023), (3, 2020)), annual, periods((1, 2021)))) == [
        (1, 2019), (1, 2020), (1, 2021), (1, 2023), (3, 2020)
    ]


def test_two_publishers_race_and_one_wins(spark, tmp_path, issuers):
    draw, store = random.Random(1), Store(str(tmp_path / "lake"), buckets=4)
    one = issuers(ciks=(1, 2))
    loads = [
        ingest(spark, store, documents(spark, [filing(draw, cik, [])], 0), one, f"run{cik}", START, complete=False)
        for cik in (1, 2)
    ]
    assert [load.base for load in loads] == [0, 0]
    # The second one passes its first look and then finds the number taken.
    first = P.publish(spark, store, loads[0], AS_OF, exports=False)
    with pytest.raises(ContractError, match="another run"):
        P.publish(spark, store, loads[1], AS_OF, exports=False)
    assert not store.commit_manifest(spark, 0, loads[1].generation, {**first, "run_id": "run2"})
    assert store.current_release(spark)["run_id"] == "run1"
    path = store.path("once.txt")
    assert commit.create_if_absent(spark, path, "a") and not commit.create_if_absent(spark, path, "b")
    assert commit.read_text(spark, path) == "a" and commit.names(spark, store.path("nowhere")) == []


def test_compaction_bounds_pieces_and_spares_readers(spark, tmp_path, issuers):
    draw, store = random.Random(2), Store(str(tmp_path / "lake"), buckets=2)
    one, amendments, sizes = issuers(ciks=(1,)), [], []
    for day in range(3):
        load(spark, store, [filing(draw, 1, amendments)], one, day)
        amendments = [*amendments, ("Assets", 2018 + day, 77 + day)]
        sizes.append(os.path.getsize(glob.glob(f"{store.root}/manifests/{day + 1:012d}.json")[0]))
    assert max(sizes) - min(sizes) < 20
    before = store.release(spark)
    facts = sorted(r["fact_id"] for r in before.facts.collect())
    assert len(before.generation.of("facts")) == 3
    assert compact(spark, store, fan_in=2) is not None
    after = store.release(spark)
    # The first load is of a higher tier; the two amendments became one piece.
    assert len(after.generation.of("facts")) == len(after.generation.of("filters")) == 2
    assert len(after.generation.of("snapshots")) == 1
    assert sorted(r["fact_id"] for r in after.facts.collect()) == facts
    assert contents(after) == contents(before) and after.manifest["run_id"] == before.manifest["run_id"]
    assert sorted(r["fact_id"] for r in before.facts.collect()) == facts
    assert compact(spark, store, fan_in=2) is None
    assert load(spark, store, [filing(draw, 1, amendments)], one, 8)["facts_inserted"] == 1
    gone = expire(spark, store, 1, datetime.now(timezone.utc) + timedelta(hours=1))
    assert gone and all(not os.path.exists(store.path(p)) for p in gone)
    assert store.release(spark).facts.count() == len(facts) + 1
    assert len(commit.names(spark, store.path("manifests"))) == 1
    P.verify_release(spark, store)


def test_tiers_of_crowded_pieces():
    def pieces(*rows):
        return [Piece("facts", 0, str(i), n) for i, n in enumerate(rows)]

    assert crowded(pieces(1, 2, 3), 4) == []
    assert len(crowded(pieces(1, 2, 3, 1, 900), 4)) == 4
    assert len(crowded(pieces(70, 80, 90, 99, 1, 900), 4)) == 5
    text = Generation(tuple(pieces(4, 5))).text()
    assert Generation.parsed(text) == Generation(tuple(pieces(4, 5)))


def test_bloom_filters_deny_no_key_they_hold(spark):
    n = 30_000
    keys = spark.range(n).select(
        F.sha2(F.col("id").cast("string"), 256).alias("key"), (F.col("id") % 2).cast("int").alias("part"),
        F.lit(M.blocks_for(n // 2)).alias("blocks"),
    )
    filters = M.bloom_blocks(keys, ["part"], "key", "blocks")
    assert all(len(r["bits"]) == M.BLOCK_BITS // 8 for r in filters.collect())
    parts = spark.createDataFrame([(p, M.blocks_for(n // 2)) for p in (0, 1)], "part int, blocks int")
    asked = lambda df: M.maybe_held(df, parts, filters, ["part"], ["part"], "key")
    assert asked(keys.select("part", "key")).count() == n
    others = spark.range(n, 3 * n).select(F.lit(1).alias("part"), F.sha2(F.col("id").cast("string"), 256).alias("key"))
    assert asked(others).count() < 30


def test_new_facts_read_no_stored_ids(spark, tmp_path, issuers):
    draw, store = random.Random(3), Store(str(tmp_path / "lake"), buckets=1)
    load(spark, store, [filing(draw, 1, [])], issuers(ciks=(1, 2)), 0)
    release = store.release(spark)
    stored = release.facts.select(F.lit(0).alias("cik_bucket"), "fact_id")
    strange = stored.withColumn("fact_id", F.sha2("fact_id", 256))
    assert suspected_pieces(store, spark, release.generation, strange, [0]) == []
    assert suspected_pieces(store, spark, release.generation, stored.limit(1), [0]) == release.generation.of("facts")


def test_a_bad_document_is_a_dead_letter(spark, tmp_path, issuers):
    draw, store = random.Random(4), Store(str(tmp_path / "lake"), buckets=4)
    known = issuers(ciks=(1, 2, 3, 4))
    good, empty, worst = filing(draw, 1, []), filing(draw, 2, []), filing(draw, 3, [])
    for concept in empty["facts"]["us-gaap"]:
        for row in held(empty, concept):
            row["val"] = "none"
    for row in held(worst, "Assets"):
        row["val"] = -5
    broken = {"cik": 4, "entityName": "", "facts": {"us-gaap": {}}}
    batch = [good, empty, worst, broken]
    report = load(spark, store, batch, known, 1, stop_on_failure=False)
    assert report["status"] == "success" and report["snapshots_loaded"] == 1 and report["documents_failed"] == 3
    letters = spark.read.parquet(store.path("dead_letters"))
    assert {(r["cik"], r["reason"]) for r in letters.collect()} == {
        (2, "nothing_accepted"), (3, "too_many_rejected"), (4, "envelope"),
    }
    rows = {r["cik"]: r for r in spark.read.json(store.path("issuer_reports", f"run_id={report['run_id']}")).collect()}
    assert rows[1]["inserted_count"] == 28 and rows[1]["snapshots_loaded"] == 1
    assert [rows[c]["snapshots_failed"] for c in (1, 2, 3, 4)] == [0, 1, 1, 1]
    before = store.current_release(spark)
    again = load(spark, store, batch, known, 2, stop_on_failure=False)
    assert again["status"] == "unchanged" and again["documents_failed"] == 3
    assert store.current_release(spark) == before and store.release(spark).facts.count() == 28
    with pytest.raises(ContractError, match="envelope"):
        load(spark, store, batch, known, 3)


def test_a_flipped_byte_in_the_archive_is_found(spark, tmp_path, issuers):
    draw, store = random.Random(6), Store(str(tmp_path / "lake"), buckets=4)
    ciks = (1, 2, 3, 4, 5)
    load(spark, store, [filing(draw, cik, []) for cik in ciks], issuers(ciks=ciks), 0)
    assert suspect_buckets(store, spark) == []
    assert verify_archive(store, spark).count() == 0
    file = sorted(glob.glob(f"{store.root}/bronze/cik_bucket=*/run_id=*/*.parquet"))[0]
    bucket = int(file.split("cik_bucket=")[1].split("/")[0])
    rows = spark.read.parquet(file).collect()
    changed = [(r["cik"], r["source_sha"], bytes(r["content"][:-1]) + b"!") for r in rows]
    spark.createDataFrame(changed, "cik bigint, source_sha string, content binary").coalesce(1).write.parquet(str(tmp_path / "other"))
    content = open(glob.glob(str(tmp_path / "other" / "*.parquet"))[0], "rb").read()
    times = os.stat(file)
    os.unlink(os.path.join(os.path.dirname(file), f".{os.path.basename(file)}.crc"))
    with open(file, "wb") as out:
        out.write(content)
    assert suspect_buckets(store, spark) == [bucket]
    problems = verify_archive(store, spark, turns=0)
    assert {f.split("cik_bucket=")[1].split("/")[0] for f in store.bronze(spark, [bucket]).inputFiles()} == {str(bucket)}
    assert {(r["cik_bucket"], r["problem"]) for r in problems.collect()} == {(bucket, "body_changed")}
    assert problems.count() == len(rows)
    os.unlink(file)
    os.utime(os.path.dirname(file), (times.st_atime, times.st_mtime))
    assert {r["problem"] for r in verify_archive(store, spark, turns=0).collect()} == {"file_missing"}
    with pytest.raises(ValueError):
        verify_archive(store, spark, turn=3, turns=2)


def test_model_version_is_read_from_a_zip(tmp_path):
    import subprocess
    import sys
    import zipfile

    top = os.path.dirname(os.path.dirname(os.path.abspath(P.__file__)))
    archive = str(tmp_path / "code.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for source in glob.glob(f"{top}/**/*.py", recursive=True):
            out.write(source, os.path.relpath(source, os.path.dirname(top)))
    script = "from vintry.plans.publish import model_version; print(model_version())"
    found = subprocess.run(
        [sys.executable, "-c", script], env={**os.environ, "PYTHONPATH": archive}, cwd=str(tmp_path),
        capture_output=True, text=True, timeout=120,
    )
    assert found.stdout.strip() == P.model_version(), found.stderr
