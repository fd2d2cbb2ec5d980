"""Which periods a change can reach, and how a mart takes in what was built again for them.

Every mart row belongs to one (cik, period_end) and is derived from facts of that period
only, but for growth, which also looks at the period before. So a change of facts reaches its
own periods and, for growth, the next annual period of the issuer. A changed issuer version
reaches all periods of the issuer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PERIOD = ["cik", "period_end"]


def touched_periods(changed: DataFrame, held: DataFrame, reopened: DataFrame) -> DataFrame:
    """(cik, period_end) of changed facts, and of all held rows of reopened issuers."""
    renamed = held.select(*PERIOD).join(reopened.select("cik").distinct(), "cik", "left_semi")
    return changed.select(*PERIOD).unionByName(renamed).distinct()


def with_following(touched: DataFrame, *annual: DataFrame) -> DataFrame:
    """Touched periods and the next annual period after each, by any of the given records.

    Records before and after the change both count: a period that goes away changes the
    growth of the one after it as much as one that appears.
    """
    periods = annual[0].select(*PERIOD)
    for other in annual[1:]:
        periods = periods.unionByName(other.select(*PERIOD))
    later = touched.withColumnRenamed("period_end", "touched_end").join(periods.distinct(), "cik")
    following = later.where("period_end > touched_end").groupBy("cik", "touched_end").agg(
        F.min("period_end").alias("period_end")
    )
    return touched.unionByName(following.select(*PERIOD)).distinct()


def swapped(held: DataFrame, rebuilt: DataFrame, periods: DataFrame) -> DataFrame:
    """``held`` with its rows of ``periods`` replaced by ``rebuilt``."""
    return held.join(periods, PERIOD, "left_anti").unionByName(rebuilt)
