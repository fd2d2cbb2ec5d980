"""Groups worked off in ranges give what one window gives."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from vintry.operators.history import overlapping_versions, scd2_build
from vintry.operators.ordered import ordered_columns, range_bounds


def rows_with_hot_group(seed, n=3000):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        group = None if i % 3 == 0 else rng.randrange(40)  # NULL holds a third of all rows
        value = None if rng.random() < 0.1 else rng.randrange(50)
        rows.append((group, rng.randrange(30), i, value))
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(
        rows_with_hot_group(1), "g int, day int, id int, v int"
    ).repartition(7)


def brute(rows):
    groups = {}
    for g, day, i, v in rows:
        groups.setdefault(g, []).append((day, i, v))
    out = set()
    for g, members in groups.items():
        members.sort()
        top = None
        for k, (day, i, v) in enumerate(members):
            before = members[k - 1][2] if k else None
            after = members[k + 1][2] if k + 1 < len(members) else None
            out.add((g, day, i, v, before, after, top))
            if v is not None:
                top = v if top is None else max(top, v)
    return out


@pytest.mark.parametrize("sample_of", [1, 7, 1 << 14])
def test_neighbours(table, sample_of):
    got = ordered_columns(
        table, ["g"], ["day", "id"], {"before": "v"}, {"after": "v"}, {"top": "v"},
        range_bounds(table, ["g"], ["day", "id"], sample_of),
    )
    assert got.columns == ["g", "day", "id", "v", "before", "after", "top"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == 3000 and set(found) == brute(rows_with_hot_group(1))


def test_a_crowded_instant_is_spread(spark):
    """One key with all rows on one day: ranges of about the wanted size, in order."""
    rows = spark.range(40_000).select(
        F.lit("k").alias("k"), F.lit(1).alias("day"), F.sha2(F.col("id").cast("string"), 256).alias("id"),
        F.col("id").alias("v"),
    )
    found = range_bounds(rows, ["k"], ["day", "id"], 64)
    bounds = found.first()["bounds"]
    assert 30 <= len(bounds) <= 50 and bounds == sorted(bounds)
    got = ordered_columns(rows, ["k"], ["day", "id"], {"before": "id"}, {}, {"top": "v"}, found)
    assert range_bounds(rows, ["k"], ["day", "id"]) is None
    window = Window.partitionBy("k").orderBy("day", "id")
    wanted = rows.select(
        "*", F.lag("id").over(window).alias("before"),
        F.max("v").over(window.rowsBetween(Window.unboundedPreceding, -1)).alias("top"),
    )
    assert got.exceptAll(wanted).count() == 0 and got.count() == 40_000


def events(seed):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    return [
        (i, start + timedelta(hours=rng.randrange(200)), 0 if i % 3 == 0 else rng.randrange(9), rng.choice("abc"))
        for i in range(600)
    ]


def test_history_and_overlaps_match_brute_force(spark):
    rows = events(3)
    log = spark.createDataFrame(rows, "id int, ts timestamp, who int, state string")
    built = scd2_build(log, "who", ["state"], "ts", "id")
    expected = set()
    for who in {r[2] for r in rows}:
        seen = sorted((r[1], r[0], r[3]) for r in rows if r[2] == who)
        starts = [s for k, s in enumerate(seen) if k == 0 or s[2] != seen[k - 1][2]]
        for k, (ts, i, state) in enumerate(starts):
            end = starts[k + 1][0] if k + 1 < len(starts) else None
            expected.add((who, state, ts, i, end))
    got = {(r["who"], r["state"], r["valid_from"], r["id"], r["valid_to"]) for r in built.collect()}
    assert got == expected

    stretched = built.select(
        "who", "id", "valid_from",
        F.when(F.col("id") % 4 == 0, F.col("valid_to") + F.expr("INTERVAL 5 HOURS"))
        .otherwise(F.col("valid_to")).alias("valid_to"),
    )
    spans = [
        (r["who"], r["id"], r["valid_from"], r["valid_to"] or datetime(9999, 12, 31))
        for r in stretched.collect()
    ]
    spans = [s for s in spans if s[2] < s[3]]
    pairs = {
        (a[0], a[1]) for a in spans for b in spans
        if a[0] == b[0] and a[1] != b[1] and a[2] < b[3] and b[2] < a[3]
    }
    found = overlapping_versions(stretched, "who", "id").collect()
    assert len(found) == len(pairs) and {(r["who"], r["id"]) for r in found} == pairs
