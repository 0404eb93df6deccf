"""Summary of one promotion by day, promotion flag and price colour."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campaign_lift.config import CampaignConfig
from campaign_lift.functions.columns import day_name, price_type
from campaign_lift.sources.orders import OrderTables, utc_moment, utc_wall_time
from campaign_lift.sources.schemas import PC1, QUANTITY, REVENUE

ZONE = "Europe/Berlin"
SUMMARY_VAT = 1.19  # fixed value of this summary, not the configured VAT


def promotion_summary(
    tables: OrderTables,
    cfg: CampaignConfig,
    promotion_id: str,
    start: date,
    end: date,
    end_inclusive: bool = False,
) -> DataFrame:
    """Orders, revenue, PC1 and discounts by Berlin day for items with and without a promotion.

    The bounds are UTC midnights, both included: of the end day only midnight itself is in,
    unless ``end_inclusive`` asks for the whole day.
    """
    kind = tables.time_type
    stamp = F.col("ordered_at")
    first = utc_moment(datetime.combine(start, time.min), kind)
    if end_inclusive:
        in_range = (stamp >= first) & (stamp < utc_moment(datetime.combine(end + timedelta(days=1), time.min), kind))
    else:
        in_range = (stamp >= first) & (stamp <= utc_moment(datetime.combine(end, time.min), kind))

    local = F.convert_timezone(F.lit("UTC"), F.lit(ZONE), utc_wall_time(stamp, kind))
    day = F.to_date("local_time")
    red, green = F.col("article_price_red_eur"), F.col("article_price_green_eur")
    has_promotion_id = F.array_contains(F.col("promotions")["promotion_id"], promotion_id)
    fields = (
        REVENUE,
        PC1,
        QUANTITY,
        "promotion_discount_eur",
        "article_price_red_eur",
        "article_price_green_eur",
        "promotions",
    )
    rows = (
        tables.for_seller(cfg)
        .where(in_range)
        .item_rows(fields)
        .withColumn("local_time", local)
        .select(
            F.date_format(F.date_trunc("week", day), "yyyy-MM-dd").alias("order_week"),
            day.alias("order_date"),
            day_name(day).alias("day_of_week"),
            F.when(has_promotion_id, "Yes").otherwise("No").alias("item_has_specific_promotion_id"),
            price_type(red, "red-price", "black-price").alias("price"),
            "order_id",
            F.col(REVENUE).alias("item_revenue"),
            F.col(PC1).alias("item_pc1"),
            F.col(QUANTITY).alias("item_quantity"),
            F.col("promotion_discount_eur").alias("item_discount"),
            F.when(red.isNotNull() & green.isNull(), F.col(REVENUE)).alias("item_red_revenue"),
        )
    )
    keys = ["order_week", "order_date", "day_of_week", "item_has_specific_promotion_id", "price"]
    sums = rows.groupBy(*keys).agg(
        F.countDistinct("order_id").alias("count_orders"),
        F.sum("item_revenue").alias("revenue"),
        F.sum("item_pc1").alias("pc1"),
        F.sum("item_quantity").alias("items"),
        F.sum("item_discount").alias("promotion_discount_eur"),
        F.sum("item_red_revenue").alias("revenue_red_price"),
    )
    ratios = sums.withColumns(
        {
            "AOR": F.round(F.try_divide("revenue", "count_orders"), 2),
            "PC1_margin": F.round(F.try_divide(F.col("pc1"), F.col("revenue") / SUMMARY_VAT), 2),
        }
    )
    return ratios.orderBy(
        F.desc("order_week"), F.desc("order_date"), "day_of_week", F.desc("item_has_specific_promotion_id"), "price"
    )
