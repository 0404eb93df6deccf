"""The store-day fact: traffic and order measures per store and day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campaign_lift.config import CampaignConfig
from campaign_lift.functions.columns import cents, in_dates, micros, pad_store_code, sum_where, to_number
from campaign_lift.sources.orders import OrderTables, seller_values
from campaign_lift.sources.schemas import PC1, QUANTITY, REVENUE
from campaign_lift.sources.traffic import campaign_traffic

# Measure and column names of the fact (fixed values).
TRAFFIC_MEASURES = ("pedestrian_footfall", "incoming_visitors", "orders")
ORDER_MEASURES = (
    "total_revenue",
    "total_RP_revenue",
    "total_promo_revenue",
    "total_existing_revenue",
    "total_quantity",
    "total_RP_quantity",
    "total_promo_quantity",
    "total_existing_quantity",
    "total_PC1",
    "total_RP_PC1",
    "total_promo_PC1",
    "total_existing_PC1",
    "total_full_price_revenue",
    "total_cost",
    "total_RP_discount_euro",
    "total_promo_discount_euro",
)
STORE_DAY_COLUMNS = (
    "ordered_date",
    "country",
    "business_unit",
    "store_code",
    "store_name",
    "pedestrian_footfall",
    "store_absorption_rate",
    "store_conversion_rate",
    "incoming_visitors",
    "orders",
    "channel",
    *ORDER_MEASURES,
)


def traffic_store_day(traffic: DataFrame, cfg: CampaignConfig, stores: Sequence[str] | None = None) -> DataFrame:
    """Traffic per store and day with its two rates. Footfall stays NULL where nothing was counted.

    With ``stores`` given, the rows of all others become one row per day without a store: few rows are shuffled, and it
    can still be seen whether there was any traffic.
    """
    return traffic_sums(campaign_traffic(traffic, cfg), cfg, stores)


def traffic_sums(visits: DataFrame, cfg: CampaignConfig, stores: Sequence[str] | None = None) -> DataFrame:
    """``traffic_store_day`` of traffic rows that are chosen already."""
    counted = F.col("pedestrian_footfall") > 0
    zero = F.lit(0)
    code, name = pad_store_code(F.col("store_code")), F.col("store_name")
    if stores is not None:
        wanted = code.isin(list(stores))
        code, name = F.when(wanted, code), F.when(wanted, name)
    grouped = (
        visits
        .groupBy(F.col("visited_on").cast("date").alias("ordered_date"), code.alias("store_code"), name.alias("store_name"))
        .agg(
            F.sum("pedestrian_footfall").alias("pedestrian_footfall"),
            F.coalesce(sum_where(counted, F.col("incoming_visitors")), zero).alias("counted_visitors"),
            sum_where(counted, F.col("pedestrian_footfall")).alias("counted_footfall"),
            F.coalesce(F.sum("incoming_visitors"), zero).alias("incoming_visitors"),
            F.coalesce(F.sum("orders"), zero).alias("orders"),
        )
    )
    return grouped.select(
        "ordered_date",
        F.lit(cfg.traffic_country).alias("country"),
        F.lit(cfg.traffic_business_unit).alias("business_unit"),
        "store_code",
        "store_name",
        "pedestrian_footfall",
        F.try_divide("counted_visitors", "counted_footfall").alias("store_absorption_rate"),
        F.try_divide("orders", "incoming_visitors").alias("store_conversion_rate"),
        "incoming_visitors",
        "orders",
    )


# Item fields that the order measures are made of.
MEASURE_FIELDS = (
    REVENUE,
    QUANTITY,
    PC1,
    "article_price_black_eur",
    "article_price_red_eur",
    "article_cost_eur",
    "promotion_discount_eur",
    "has_promotion",
)


def order_store_day(tables: OrderTables, cfg: CampaignConfig, stores: Sequence[str] | None = None) -> DataFrame:
    """Sixteen order measures per store and day, rounded to cents at this grain; of the given stores only, if any are given."""
    chosen = tables.for_seller(cfg).on_dates(cfg.selected_dates)
    if stores is not None:
        chosen = chosen.where(pad_store_code(F.col("tenant")).isin(list(stores)))
    sums = order_sums(chosen.item_rows(MEASURE_FIELDS)).withColumns(seller_values(cfg))
    keys = ("ordered_date", "country", "company_name_short", "channel", "store_code", "store_name")
    return sums.select(*keys, *ORDER_MEASURES)


def order_sums(items: DataFrame) -> DataFrame:
    """The sixteen measures of item rows per day and store. Amounts are added up as whole millionths and rounded after."""
    quantity = F.col(QUANTITY)
    black, red = F.col("article_price_black_eur"), F.col("article_price_red_eur")
    sold = {"revenue": F.col(REVENUE), "quantity": quantity, "PC1": F.col(PC1)}
    discounts = {
        "total_full_price_revenue": black * quantity,
        "total_cost": F.col("article_cost_eur") * quantity,
        "total_RP_discount_euro": (black - red) * quantity,
        "total_promo_discount_euro": F.col("promotion_discount_eur") * quantity,
    }
    splits = {
        "": F.lit(True),
        "RP_": F.col("article_price_red_eur").isNotNull(),
        "promo_": F.col("has_promotion"),
        "existing_": F.col("insider_customer_type") == "EXISTING",
    }
    measures = [
        cents(F.coalesce(sum_where(rule, F.col(f"micros_{name}")), F.lit(0))).alias(f"total_{prefix}{name}")
        for name in sold
        for prefix, rule in splits.items()
    ]
    whole = items.withColumns({f"micros_{name}": micros(value) for name, value in (sold | discounts).items()})
    return whole.groupBy("ordered_date", pad_store_code(F.col("tenant")).alias("store_code"), "store_name").agg(
        *measures, *[cents(F.sum(f"micros_{name}")).alias(name) for name in discounts]
    )


def store_day_raw(
    traffic: DataFrame, tables: OrderTables, cfg: CampaignConfig, stores: Sequence[str] | None = None
) -> DataFrame:
    """Traffic store-days with the order measures of the same store and day.

    Both sides are aggregated before the join, so it sees store-days and not items. Traffic
    without orders keeps NULL order measures; orders without traffic drop out.
    """
    return visits_with_sales(traffic_store_day(traffic, cfg, stores), order_store_day(tables, cfg, stores))


def visits_with_sales(visits: DataFrame, sales: DataFrame) -> DataFrame:
    visits = visits.withColumn("company_name_short", F.split_part("business_unit", F.lit(" "), F.lit(1)))
    keys = ["ordered_date", "country", "company_name_short", "store_code", "store_name"]
    return visits.join(sales, keys, "left").select(*STORE_DAY_COLUMNS)


def scale_baseline(facts: DataFrame, cfg: CampaignConfig, measures: Sequence[str]) -> DataFrame:
    """Multiply the measures on baseline dates by the coefficient.

    The rule goes by date: a date that is in both periods is scaled for both.
    """
    if cfg.baseline_coefficient == 1.0 or not cfg.baseline_dates:
        return facts
    on_baseline = in_dates(F.col("ordered_date"), cfg.baseline_dates)
    factor = F.when(on_baseline, F.lit(float(cfg.baseline_coefficient))).otherwise(1.0)
    return facts.withColumns({c: to_number(F.col(c)) * factor for c in measures})


def store_day(
    traffic: DataFrame, tables: OrderTables, cfg: CampaignConfig, stores: Sequence[str] | None = None
) -> DataFrame:
    """The store-day fact with the baseline coefficient applied."""
    return scale_baseline(store_day_raw(traffic, tables, cfg, stores), cfg, [*TRAFFIC_MEASURES, *ORDER_MEASURES])
