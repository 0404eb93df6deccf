"""Sums of many campaigns from one store-day fact: an interval join of days with period windows, kept an equi-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campaign_lift.config import BASELINE, PERIODS, PROMO, CampaignConfig
from campaign_lift.functions.columns import is_sunday, pad_store_code, to_number
from campaign_lift.operators.metrics import STORE_SUMS, kpi_rows, store_funnel_kpis, store_sums
from campaign_lift.operators.store_day import (
    ORDER_MEASURES,
    TRAFFIC_MEASURES,
    MEASURE_FIELDS,
    order_sums,
    traffic_sums,
    visits_with_sales,
)
from campaign_lift.sources.campaign_tables import CampaignTables
from campaign_lift.sources.orders import OrderTables, seller_values
from campaign_lift.sources.traffic import traffic_of_days

#: Days of a bucket of the interval join. A window of d days is in d / 16 + 1 buckets or one more.
BUCKET_DAYS = 16
#: Stands for "any store" in the rows that only say that a day had traffic.
ANY_STORE = ""
KEYS = ("campaign", "grp", "period")


def bucket(day: Column) -> Column:
    return F.floor(F.unix_date(day) / BUCKET_DAYS).cast("int")


def campaign_store_days(traffic: DataFrame, tables: OrderTables, seller: CampaignConfig, plan: CampaignTables) -> DataFrame:
    """The unscaled store-day fact over the days of all campaigns, once for all of them, with one more row for each day that
    had traffic anywhere (store ``ANY_STORE``, no measures).

    ``seller`` gives business unit, country, company and channel. Orders are read for members of groups only.
    """
    if plan.bounds is None:
        traffic, tables, (first, last) = traffic.limit(0), tables.where(F.lit(False)), (seller.selected_dates[0],) * 2
    else:
        first, last = plan.bounds
    visits = traffic_sums(traffic_of_days(traffic, seller, plan.days, first, last), seller)
    chosen = tables.for_seller(seller).on_days_of(plan.days, first, last).of_stores_in(plan.stores)
    sales = order_sums(chosen.item_rows(MEASURE_FIELDS)).withColumns(seller_values(seller))
    # both grains come from the store-days, so that traffic rows are grouped once
    names = [c for c in visits.columns if c not in ("ordered_date", "store_code", "store_name")]
    whole = ["ordered_date", "store_code", "store_name"]
    grains = visits.groupingSets([[F.col(c) for c in whole], [F.col("ordered_date")]], *whole).agg(
        *[F.max(c).alias(f"max_{c}") for c in names], F.grouping("store_code").alias("is_day")
    )
    own = F.col("is_day") == 0
    kept = {c: F.when(own, F.col(f"max_{c}")) for c in names if c not in ("country", "business_unit")}
    marked = grains.select(
        "ordered_date",
        F.col("max_country").alias("country"),
        F.col("max_business_unit").alias("business_unit"),
        F.when(own, F.col("store_code")).otherwise(ANY_STORE).alias("store_code"),
        "store_name",
        *[value.alias(c) for c, value in kept.items()],
    )
    return visits_with_sales(marked, sales)


def memberships(plan: CampaignTables) -> DataFrame:
    """(campaign, grp, store_code, first_day, last_day, in_baseline, in_promo, settings, bucket): each group's stores on each
    stretch of days and bucket; ``ANY_STORE`` is in every campaign, in no group."""
    settings = plan.campaigns.select("campaign", "baseline_coefficient", "include_sunday").distinct()
    members = plan.members.select("campaign", "grp", pad_store_code(F.col("store_code")).alias("store_code")).where("store_code <> ''").distinct()
    stretches = plan.segments.join(settings, "campaign")
    in_groups = members.join(stretches, "campaign")
    anywhere = stretches.withColumns({"grp": F.lit(None).cast("string"), "store_code": F.lit(ANY_STORE)})
    both = in_groups.unionByName(anywhere)
    return both.withColumn("bucket", F.explode(F.sequence(bucket(F.col("first_day")), bucket(F.col("last_day")))))


def campaign_period_rows(facts: DataFrame, plan: CampaignTables) -> DataFrame:
    """Fact rows for each campaign, group and period they count in, scaled on days of the campaign's baseline.

    Days meet windows on (store, bucket of days), an equi-join that can shuffle and split hot keys, and a comparison keeps
    the days inside. A row that only shows that there was traffic, or lies on a Sunday that does not count, has no group.
    """
    inside = memberships(plan)
    rows = facts.withColumn("bucket", bucket(F.col("ordered_date"))).join(inside, ["store_code", "bucket"])
    rows = rows.where((F.col("ordered_date") >= F.col("first_day")) & (F.col("ordered_date") <= F.col("last_day")))
    factor = F.when(F.col("in_baseline"), F.col("baseline_coefficient")).otherwise(1.0)
    scaled = {c: to_number(F.col(c)) * factor for c in (*TRAFFIC_MEASURES, *ORDER_MEASURES)}
    counts = F.col("include_sunday") | ~is_sunday(F.col("ordered_date"))
    periods = F.array_compact(F.array(F.when(F.col("in_baseline"), BASELINE), F.when(F.col("in_promo"), PROMO)))
    return rows.withColumns(scaled | {"grp": F.when(counts, F.col("grp")), "period": F.explode(periods)})


def campaign_sums(facts: DataFrame, plan: CampaignTables) -> DataFrame:
    """Sums of each campaign, group and period; zeros for groups without rows, nothing for campaigns without any traffic."""
    sums = store_sums(campaign_period_rows(facts, plan), KEYS, count_stores=True)
    values = [*STORE_SUMS, "trackable_stores"]
    groups = plan.groups.select("campaign", F.col("grp").alias("named")).distinct()
    # rows without a group become a row of zeros for each group and period of their campaign
    placed = sums.join(groups, "campaign").where(F.col("grp").isNull() | (F.col("grp") == F.col("named")))
    empty = F.col("grp").isNull()
    periods = F.explode(F.when(empty, F.array(*map(F.lit, PERIODS))).otherwise(F.array("period")))
    opened = placed.select("campaign", F.col("named").alias("grp"), periods.alias("period"), *[F.when(~empty, F.col(v)).alias(v) for v in values])
    return opened.groupBy(*KEYS).agg(*[F.coalesce(F.max(v), F.lit(0)).alias(v) for v in values])


def campaign_funnel(sums: DataFrame, plan: CampaignTables) -> DataFrame:
    """``store_funnel`` of each campaign, with its own VAT."""
    rows = sums.join(plan.campaigns.select("campaign", "vat").distinct(), "campaign")
    kpis = store_funnel_kpis({name: F.col(name) for name in STORE_SUMS}, F.col("vat"))
    return kpi_rows(rows, kpis, zero_base=0.0, nothing=[0.0] * len(kpis), keys=("campaign", "grp"))
