"""Store traffic: the counter feed of visitors and till orders per store and day."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from campaign_lift.config import CampaignConfig
from campaign_lift.functions.columns import days_between, in_dates
from campaign_lift.sources.schemas import TRAFFIC, require_columns, require_types


def read_traffic(spark: SparkSession, path: str) -> DataFrame:
    traffic = spark.read.parquet(path)
    require_columns(traffic, TRAFFIC.fieldNames(), "traffic")
    require_types(traffic, TRAFFIC, "traffic")
    return traffic


def campaign_traffic(traffic: DataFrame, cfg: CampaignConfig) -> DataFrame:
    """Rows of the configured business unit and country on the selected days."""
    return traffic.where(
        (F.col("business_unit") == cfg.traffic_business_unit)
        & (F.col("country") == cfg.traffic_country)
        & in_dates(F.col("visited_on").cast("date"), cfg.selected_dates)
    )


def traffic_of_days(traffic: DataFrame, seller: CampaignConfig, days: DataFrame, first: date, last: date) -> DataFrame:
    """Rows of the business unit and country on the days that a table ``ordered_date`` lists. The bounds of the table, which
    the caller knows, reach the scan; its days are a semi join."""
    day = F.col("visited_on").cast("date")
    bounded = traffic.where(
        (F.col("business_unit") == seller.traffic_business_unit)
        & (F.col("country") == seller.traffic_country)
        & (day >= F.lit(first))
        & (day <= F.lit(last))
    )
    return bounded.join(days_between(days, first, last), day == F.col("ordered_date"), "left_semi")
