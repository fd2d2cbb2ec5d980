"""Ratios, review flags and tolerances. Missing inputs give missing ratios, never zeros."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vintry.contract import (
    ANNUAL_DURATION_DAYS,
    ANNUAL_FORMS,
    BALANCE_FLOOR,
    BALANCE_SHARE,
    DURATION,
    INSTANT,
    METRICS,
    YEAR_OVER_YEAR_DAYS,
)


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """A double ratio; a zero or missing denominator gives NULL.

    Both sides are cast first: decimal division would round to a fixed scale.
    """
    return numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))


def annual_ratios() -> dict[str, Column]:
    c = F.col
    return {
        "net_margin": safe_ratio(c("net_income"), c("revenue")),
        "operating_margin": safe_ratio(c("operating_income"), c("revenue")),
        "current_ratio": safe_ratio(c("current_assets"), c("current_liabilities")),
        "liabilities_to_assets": safe_ratio(c("liabilities"), c("assets")),
        "cash_flow_margin": safe_ratio(c("operating_cash_flow"), c("revenue")),
    }


def history_ratios() -> dict[str, Column]:
    ratios = annual_ratios()
    return {k: ratios[k] for k in ("net_margin", "current_ratio", "liabilities_to_assets")}


def year_over_year(value: Column, previous: Column, end: Column, previous_end: Column) -> Column:
    """Growth only where the two period ends are about a year apart."""
    gap = F.datediff(end, previous_end)
    return F.when(gap.between(*YEAR_OVER_YEAR_DAYS), safe_ratio(value, previous) - F.lit(1.0))


def raised(condition: Column) -> Column:
    """A review flag: an unknown condition is not raised."""
    return F.coalesce(condition, F.lit(False))


def review_flags() -> dict[str, Column]:
    return {
        "liquidity_review": raised(F.col("current_ratio") < 1),
        "loss_review": raised(F.col("net_income") < 0),
        "cash_flow_review": raised(F.col("operating_cash_flow") < 0),
        "incomplete_metrics": F.col("available_metrics") < len(METRICS),
    }


def is_annual_span() -> Column:
    """An instant, or a duration of about a year (52/53-week years included)."""
    days = F.datediff(F.col("period_end"), F.col("period_start"))
    return (F.col("kind") == INSTANT) | days.between(*ANNUAL_DURATION_DAYS)


def is_annual_form() -> Column:
    return F.col("form").isin(*ANNUAL_FORMS)


def is_duration_off_annual() -> Column:
    days = F.datediff(F.col("period_end"), F.col("period_start"))
    return (F.col("kind") == DURATION) & ~days.between(*ANNUAL_DURATION_DAYS)


def balance_residual() -> Column:
    return F.col("assets") - F.col("liabilities") - F.col("equity")


def balance_tolerance() -> Column:
    """The larger of the floor and a share of assets, exact to seven decimals.

    Assets stay below 1e30 by contract, so DECIMAL(34,4) loses nothing and leaves
    room for the product's three further digits.
    """
    share = F.abs(F.col("assets").cast("decimal(34,4)")) * F.lit(BALANCE_SHARE)
    return F.greatest(F.lit(BALANCE_FLOOR).cast("decimal(38,7)"), share.cast("decimal(38,7)"))


def missing_metrics() -> Column:
    """Names of the absent metrics of a wide annual row, in contract order."""
    return F.array_compact(
        F.array(*[F.when(F.col(m).isNull(), F.lit(m)) for m in METRICS])
    )
