"""Weekday and daily KPIs and the series that charts are drawn from."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campaign_lift.config import CampaignConfig, local_table
from campaign_lift.functions.columns import day_name, monday_first, pct_diff
from campaign_lift.operators.metrics import SERIES_KPIS, periods_side_by_side, store_ratios, store_sums
from campaign_lift.operators.subsets import group_period_subset

# Chart titles per KPI (fixed values).
WEEKDAY_TITLES = {
    "avg_store_absorption_rate": "Store Absorption Rate % Diff by Weekday",
    "cal_store_conversion_rate": "Store Conversion Rate % Diff by Weekday",
    "total_orders": "Total Orders % Diff by Weekday",
    "AOV": "AOV % Diff by Weekday",
    "total_quantity": "Total Quantity % Diff by Weekday",
    "price_per_item": "Price per Item % Diff by Weekday",
    "total_revenue": "Total Revenue % Diff by Weekday",
    "total_PC1": "Total PC1 % Diff by Weekday",
    "margin": "Margin % Diff by Weekday",
    "RP_revenue_share": "RP Revenue Share % Diff by Weekday",
    "promo_revenue_share": "Promo Revenue Share % Diff by Weekday",
}


def _series(facts: DataFrame, cfg: CampaignConfig, day: str) -> DataFrame:
    subset = group_period_subset(facts, cfg)
    if day == "weekday":
        subset = subset.withColumn("weekday", day_name(F.col("ordered_date")))
    sums = store_sums(subset, ["grp", "period", day])
    ratios = store_ratios({c: F.col(c) for c in sums.columns}, cfg.vat)
    return sums.select("grp", "period", day, *[ratios[kpi].alias(kpi) for kpi in SERIES_KPIS])


def weekday_kpis(facts: DataFrame, cfg: CampaignConfig) -> DataFrame:
    """KPIs per group, period and weekday, Sundays included. ``weekday_seq`` is 0 on Monday."""
    return _series(facts, cfg, "weekday").withColumn("weekday_seq", monday_first(F.col("weekday")))


def daily_kpis(facts: DataFrame, cfg: CampaignConfig) -> DataFrame:
    """KPIs per group, period and date."""
    return _series(facts, cfg, "ordered_date")


def weekday_pct_diff(facts: DataFrame, cfg: CampaignConfig) -> DataFrame:
    """Relative change per weekday of the promo period.

    A weekday that the baseline lacks gives NULL, a baseline of 0 gives 0.
    """
    rows = periods_side_by_side(_series(facts, cfg, "weekday"), ["grp", "weekday"], SERIES_KPIS)
    changes = [
        pct_diff(F.col("promo")[kpi], F.col("baseline")[kpi], zero_base=0.0).alias(f"{kpi}_pct_diff") for kpi in SERIES_KPIS
    ]
    return rows.where(F.col("promo").isNotNull()).select(
        "grp", "weekday", monday_first(F.col("weekday")).alias("weekday_seq"), *changes
    )


def _labelled(rows: DataFrame, cfg: CampaignConfig, groups: Sequence[str] | None) -> DataFrame:
    spark = rows.sparkSession
    labels = cfg.group_frame(spark)
    if groups is not None:
        chosen = local_table(spark, {"grp": (pa.string(), sorted(set(groups)))})
        labels = labels.join(chosen, "grp", "left_semi")
    return rows.join(labels, "grp")


def daily_trend(daily: DataFrame, cfg: CampaignConfig, groups: Sequence[str] | None = None) -> DataFrame:
    """Daily KPIs of the chosen groups with axis and series labels."""
    day = F.col("ordered_date")
    rows = _labelled(daily, cfg, groups).where(day.isNotNull())
    return rows.select(
        "grp",
        "period",
        "ordered_date",
        F.concat_ws("\n", F.date_format(day, "yyyy-MM-dd"), day_name(day)).alias("date_weekday_label"),
        F.concat_ws(" - ", "grp_label", "period").alias("series"),
        *SERIES_KPIS,
    )


def weekday_chart(changes: DataFrame, cfg: CampaignConfig, groups: Sequence[str] | None = None) -> DataFrame:
    """One row per chart, weekday and group from the weekday changes."""
    bars = [
        F.struct(F.lit(seq).alias("chart_seq"), F.lit(title).alias("title"), F.col(f"{kpi}_pct_diff").alias("value"))
        for seq, (kpi, title) in enumerate(WEEKDAY_TITLES.items(), start=1)
    ]
    return _labelled(changes, cfg, groups).select(
        "grp", "grp_label", "weekday", "weekday_seq", F.inline(F.array(*bars))
    )
