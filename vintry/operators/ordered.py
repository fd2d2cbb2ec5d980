"""Neighbours and running maxima inside ordered groups, without one huge task.

A window function sorts each group in one task, which is ruinous for a group that holds a
large share of a table. Here a crowded group is cut into ranges of its own order, whatever
that is: a small sample, taken by a hash of the rows, gives each crowded group its bounds, a
binary search in these gives each row its range, and windows run inside (group, range). One
edge row per range then carries on what lies beyond, as in a prefix scan. A task sorts about
``RANGE_ROWS`` rows of one group, also where all of them share a day or an instant.

The sample is one narrow read. Where no group is crowded it comes out empty, and plain
windows are all there is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintry.session import ensure_checkpoint_dir

# One row in so many is sampled; every PER_BOUND-th sample of a group bounds a range.
SAMPLE_OF = 1 << 14
PER_BOUND = 16
RANGE_ROWS = SAMPLE_OF * PER_BOUND
# Bounds joined by broadcast; more of them meet the rows in an ordinary join.
BROADCAST_BOUNDS = 50_000

_GROUP, _RANGE, _FIRST, _LAST = "__group", "__range", "__first", "__last"


def _place(order: list[str]) -> Column:
    """The row's place in its group, comparable as a whole; nulls come first."""
    return F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])


def range_bounds(
    df: DataFrame, keys: list[str], order: list[str], sample_of: int = SAMPLE_OF, per_bound: int = PER_BOUND
) -> DataFrame | None:
    """(group, keys, bounds) of crowded groups, written once so that all readers agree.

    None where no group is crowded. What is gathered per group is its sample: its rows
    divided by ``sample_of``. Bounds also serve any selection of the same rows.
    """
    drawn = df.where(F.pmod(F.xxhash64(*keys, *order), F.lit(sample_of)) == 0)
    samples = drawn.groupBy(F.xxhash64(*keys).alias(_GROUP), *keys).agg(
        F.array_sort(F.collect_list(_place(order))).alias("samples")
    ).where(F.size("samples") >= per_bound)
    if samples.select(_GROUP).first() is None:
        return None
    every = F.filter("samples", lambda _, i: i % per_bound == per_bound // 2)
    ensure_checkpoint_dir(df.sparkSession)
    return samples.select(_GROUP, *keys, every.alias("bounds")).checkpoint()


def _range_of(place: Column, bounds: Column) -> Column:
    """How many bounds lie at or below the place, by binary search; 0 without bounds."""
    steps = F.sequence(F.lit(1), F.length(F.bin(F.size(bounds))))

    def halve(s: Column, _) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        below = F.get(bounds, middle) <= place
        return F.when(s["low"] >= s["high"], s).when(
            below, F.struct((middle + 1).alias("low"), s["high"].alias("high"))
        ).otherwise(F.struct(s["low"].alias("low"), middle.alias("high")))

    start = F.struct(F.lit(0).alias("low"), F.size(bounds).alias("high"))
    found = F.aggregate(steps, start, halve, lambda s: s["low"])
    return F.when(bounds.isNull(), F.lit(0)).otherwise(found).cast("int")


def ordered_columns(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    previous: dict[str, str] | None = None,
    following: dict[str, str] | None = None,
    highest_before: dict[str, str] | None = None,
    bounds: DataFrame | None = None,
) -> DataFrame:
    """Add columns read from neighbouring rows of the same group.

    ``previous``/``following`` map a new column to the column read from the row just
    before/after; ``highest_before`` maps one to the maximum over all earlier rows.
    ``order`` ascends, nulls first, and must be unique within a group. ``bounds`` are the
    ``range_bounds`` of these rows; None says that no group is crowded.
    """
    previous, following, highest = previous or {}, following or {}, highest_before or {}
    if bounds is None:
        up = Window.partitionBy(*keys).orderBy(*order)
        earlier = up.rowsBetween(Window.unboundedPreceding, -1)
        return df.select(
            "*",
            *[F.lag(s).over(up).alias(n) for n, s in previous.items()],
            *[F.lead(s).over(up).alias(n) for n, s in following.items()],
            *[F.max(s).over(earlier).alias(n) for n, s in highest.items()],
        )

    named = bounds.select(_GROUP, *[F.col(c).alias(f"__k_{c}") for c in keys], "bounds")
    if bounds.agg(F.sum(F.size("bounds"))).first()[0] <= BROADCAST_BOUNDS:
        named = F.broadcast(named)
    grouped = df.withColumn(_GROUP, F.xxhash64(*keys))
    same_keys = [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in keys]
    met = grouped.join(named.withColumnRenamed(_GROUP, "__k"), [F.col(_GROUP) == F.col("__k"), *same_keys], "left")
    ranged = met.withColumn(_RANGE, _range_of(_place(order), F.col("bounds"))).select(*df.columns, _GROUP, _RANGE)
    # One exchange serves the windows, the edges and the join below.
    dealt = ranged.repartition(_GROUP, _RANGE)
    group = [_GROUP, *keys, _RANGE]
    up = Window.partitionBy(*group).orderBy(*order)
    earlier = up.rowsBetween(Window.unboundedPreceding, -1)
    anyone = F.lit(1)
    inside = dealt.select(
        "*",
        *[F.lag(s).over(up).alias(n) for n, s in previous.items()],
        *[F.lead(s).over(up).alias(n) for n, s in following.items()],
        *[F.max(s).over(earlier).alias(n) for n, s in highest.items()],
        F.lag(anyone).over(up).isNull().alias(_FIRST),
        F.lead(anyone).over(up).isNull().alias(_LAST),
    )
    edges = inside.groupBy(*group).agg(
        *[F.max(F.when(F.col(_LAST), F.col(s))).alias(f"__p_{n}") for n, s in previous.items()],
        *[F.max(F.when(F.col(_FIRST), F.col(s))).alias(f"__f_{n}") for n, s in following.items()],
        *[F.max(s).alias(f"__h_{n}") for n, s in highest.items()],
    )
    across = Window.partitionBy(_GROUP, *keys).orderBy(_RANGE)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select(
        *[F.col(c).alias(f"__k_{c}") for c in group],
        *[F.lag(f"__p_{n}").over(across).alias(f"__p_{n}") for n in previous],
        *[F.lead(f"__f_{n}").over(across).alias(f"__f_{n}") for n in following],
        *[F.max(f"__h_{n}").over(before).alias(f"__h_{n}") for n in highest],
    )
    # The hash and the range are never null here, so rows stay where they are.
    same = [F.col(c) == F.col(f"__k_{c}") for c in (_GROUP, _RANGE)]
    same += [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in keys]
    joined = inside.join(carried, on=same, how="left")
    first, last = F.col(_FIRST), F.col(_LAST)
    return joined.select(
        *df.columns,
        *[F.when(first, F.col(f"__p_{n}")).otherwise(F.col(n)).alias(n) for n in previous],
        *[F.when(last, F.col(f"__f_{n}")).otherwise(F.col(n)).alias(n) for n in following],
        *[F.greatest(F.col(n), F.col(f"__h_{n}")).alias(n) for n in highest],
    )
