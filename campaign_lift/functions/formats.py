"""Numbers as text. Rounding is half-even on the binary value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Which KPIs are rates, and which discount metrics are percentages.
RATE_WORDS = ("margin", "rate", "share")
DISCOUNT_PERCENT_KPIS = (
    "Total Full Price PC1 Margin, %%",
    "PC1 Margin after RP discounts, %%",
    "Final PC1 Margin, %%",
)
MISSING = "-"
NOT_AVAILABLE = "N/A"


def percent(value: Column) -> Column:
    """Two decimals, no thousands separator."""
    return F.concat(F.translate(F.format_number(value * 100, 2), ",", ""), F.lit("%"))


def thousands(value: Column) -> Column:
    return F.format_number(value, 0)


def is_rate(kpi: Column) -> Column:
    name = F.lower(F.trim(kpi))
    found = [name.contains(word) for word in RATE_WORDS]
    return found[0] | found[1] | found[2]


def kpi_text(kpi: Column, value: Column) -> Column:
    """Percent for rate-like KPIs, else whole numbers with thousands separators."""
    text = F.when(is_rate(kpi), percent(value)).otherwise(thousands(value))
    return F.coalesce(text, F.lit(MISSING))


def percent_text(value: Column) -> Column:
    return F.coalesce(percent(value), F.lit(MISSING))


def abs_percent_or_na(value: Column) -> Column:
    return F.coalesce(percent(F.abs(value)), F.lit(NOT_AVAILABLE))


def number_or_na(value: Column) -> Column:
    return F.coalesce(thousands(value), F.lit(NOT_AVAILABLE))


def format_funnel(funnel: DataFrame) -> DataFrame:
    """Funnel rows with all four numbers as text."""
    kpi = F.col("kpi")
    texts = {c: kpi_text(kpi, F.col(c)) for c in ("baseline_value", "promo_value", "abs_diff")}
    return funnel.withColumns({**texts, "pct_diff": percent_text(F.col("pct_diff"))})


def format_impact(impact: DataFrame) -> DataFrame:
    kpi = F.col("kpi")
    sides = ("testing", "control", "testing_minus_control")
    texts = {f"{side}_pct_diff": percent_text(F.col(f"{side}_pct_diff")) for side in sides}
    texts |= {f"{side}_abs_diff": kpi_text(kpi, F.col(f"{side}_abs_diff")) for side in sides}
    return impact.withColumns(texts)


def format_discount_breakdown(breakdown: DataFrame) -> DataFrame:
    """Discount rows as text: a fixed set of metrics in percent, the rest as whole numbers."""
    as_percent = F.col("kpi").isin(*DISCOUNT_PERCENT_KPIS)
    texts = {
        c: F.when(as_percent, percent(F.col(c))).otherwise(thousands(F.col(c)))
        for c in ("baseline_value", "promo_value", "abs_diff")
    }
    return breakdown.withColumns({**texts, "pct_diff": percent(F.col("pct_diff"))})
