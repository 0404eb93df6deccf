"""Fact rows per store group and period."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campaign_lift.config import CampaignConfig
from campaign_lift.functions.columns import day_name, in_dates


def group_period_subset(facts: DataFrame, cfg: CampaignConfig) -> DataFrame:
    """Fact rows joined to the groups of their store and the periods of their date.

    A store may be in several groups and a date in both periods, so this is a join and not a
    label. The plain filter in front lets the optimizer drop other stores below the
    aggregation that made the facts.
    """
    spark = facts.sparkSession
    wanted = in_dates(F.col("ordered_date"), cfg.selected_dates)
    if cfg.known_store_codes is not None:
        wanted = F.col("store_code").isin(list(cfg.known_store_codes)) & wanted
    return (
        facts.where(wanted)
        .join(cfg.member_frame(spark), "store_code")
        .join(cfg.period_frame(spark), "ordered_date")
        .select("grp", "period", *facts.columns)
    )


def group_period_rows(facts: DataFrame, cfg: CampaignConfig) -> DataFrame:
    """``group_period_subset`` that keeps the rows of stores outside all groups, without a group."""
    spark = facts.sparkSession
    return (
        facts.join(cfg.period_frame(spark), "ordered_date")
        .join(cfg.member_frame(spark), "store_code", "left")
        .select("grp", "period", *facts.columns)
    )


EXPORT_ORDER = ("group", "period", "ordered_date", "store_code", "store_name")


def store_subset_rows(facts: DataFrame, cfg: CampaignConfig) -> DataFrame:
    """Store-day rows of every group and period, as exported."""
    rows = group_period_subset(facts, cfg).withColumn("weekday", day_name(F.col("ordered_date")))
    return rows.select(*facts.columns, "weekday", F.col("grp").alias("group"), "period")


def store_subset_export(facts: DataFrame, cfg: CampaignConfig) -> DataFrame:
    """``store_subset_rows`` in export order."""
    return store_subset_rows(facts, cfg).orderBy(*EXPORT_ORDER)
