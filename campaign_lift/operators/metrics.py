"""Sums per group and period, and the ratios made of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campaign_lift.config import BASELINE, PROMO
from campaign_lift.functions.columns import pct_diff, ratio_or_zero, sum_where
from campaign_lift.operators.store_day import ORDER_MEASURES, TRAFFIC_MEASURES

# KPI columns of the weekday and daily tables, in display order (fixed values).
SERIES_KPIS = (
    "avg_store_absorption_rate",
    "cal_store_conversion_rate",
    "total_orders",
    "AOV",
    "total_quantity",
    "price_per_item",
    "total_revenue",
    "total_PC1",
    "margin",
    "RP_revenue_share",
    "promo_revenue_share",
)

STORE_SUMS = (*TRAFFIC_MEASURES, *ORDER_MEASURES, "counted_visitors", "counted_footfall")


def store_sums(subset: DataFrame, keys: Sequence[str], count_stores: bool = False, total: str | None = None) -> DataFrame:
    """Sums of all store-day measures per key, 0 where there is nothing to add. ``total`` names a flag: with it, a row over
    all keys is added by a further grouping set, if there are any rows."""
    counted = F.col("pedestrian_footfall") > 0
    sums = {name: F.sum(name) for name in (*TRAFFIC_MEASURES, *ORDER_MEASURES)}
    sums["counted_visitors"] = sum_where(counted, F.col("incoming_visitors"))
    sums["counted_footfall"] = sum_where(counted, F.col("pedestrian_footfall"))
    columns = [value.cast("double").alias(name) for name, value in sums.items()]
    if count_stores:
        tracked = F.when(F.col("pedestrian_footfall").isNotNull(), F.col("store_code"))
        columns.append(F.countDistinct(tracked).alias("trackable_stores"))
    if total is None:
        return subset.groupBy(*keys).agg(*columns).fillna(0.0, list(sums))
    grouped = subset.groupingSets([[F.col(k) for k in keys], []], *keys).agg(*columns, (F.grouping(keys[0]) == 1).alias(total))
    return grouped.fillna(0.0, list(sums))


def store_ratios(value: Mapping[str, Column], vat: float) -> dict[str, Column]:
    """The eleven KPIs that funnel, weekday and daily tables share."""
    revenue, quantity, orders = value["total_revenue"], value["total_quantity"], value["orders"]
    return {
        "avg_store_absorption_rate": ratio_or_zero(value["counted_visitors"], value["counted_footfall"]),
        "cal_store_conversion_rate": ratio_or_zero(orders, value["incoming_visitors"]),
        "total_orders": orders,
        "AOV": ratio_or_zero(revenue, orders),
        "total_quantity": quantity,
        "price_per_item": ratio_or_zero(revenue, quantity),
        "total_revenue": revenue,
        "total_PC1": value["total_PC1"],
        "margin": ratio_or_zero(value["total_PC1"], revenue) * vat,
        "RP_revenue_share": ratio_or_zero(value["total_RP_revenue"], revenue),
        "promo_revenue_share": ratio_or_zero(value["total_promo_revenue"], revenue),
    }


def store_funnel_kpis(value: Mapping[str, Column], vat: float) -> dict[str, Column]:
    """The 26 funnel KPIs in display order; the keys are fixed values."""
    ratios = store_ratios(value, vat)
    revenue = value["total_revenue"]

    def margin(part: str) -> Column:
        return ratio_or_zero(value[f"total_{part}_PC1"], value[f"total_{part}_revenue"]) * vat

    return {
        "pedestrian footfall": value["pedestrian_footfall"],
        "store absorption rate": ratios["avg_store_absorption_rate"],
        "incoming visitors": value["incoming_visitors"],
        "store conversion rate": ratios["cal_store_conversion_rate"],
        "total orders": ratios["total_orders"],
        "AOV": ratios["AOV"],
        "total quantity": ratios["total_quantity"],
        "price per item": ratios["price_per_item"],
        "total revenue": revenue,
        "total PC1": value["total_PC1"],
        "margin": ratios["margin"],
        "RP revenue": value["total_RP_revenue"],
        "promo revenue": value["total_promo_revenue"],
        "existing revenue": value["total_existing_revenue"],
        "RP quantity": value["total_RP_quantity"],
        "promo quantity": value["total_promo_quantity"],
        "existing quantity": value["total_existing_quantity"],
        "RP PC1": value["total_RP_PC1"],
        "promo PC1": value["total_promo_PC1"],
        "existing PC1": value["total_existing_PC1"],
        "RP margin": margin("RP"),
        "promo margin": margin("promo"),
        "existing margin": margin("existing"),
        "RP revenue share": ratios["RP_revenue_share"],
        "promo revenue share": ratios["promo_revenue_share"],
        "existing revenue share": ratio_or_zero(value["total_existing_revenue"], revenue),
    }


def periods_side_by_side(rows: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per key with a ``baseline`` and a ``promo`` struct; an absent period is a NULL struct."""
    packed = F.struct(*values)
    return rows.groupBy(*keys).agg(
        F.max(F.when(F.col("period") == BASELINE, packed)).alias("baseline"),
        F.max(F.when(F.col("period") == PROMO, packed)).alias("promo"),
    )


def kpi_rows(
    rows: DataFrame,
    kpis: Mapping[str, Column],
    zero_base: float | None,
    nothing: Sequence[float | None],
    keys: Sequence[str] = ("grp",),
) -> DataFrame:
    """KPIs of (group, period) rows as one row per group and KPI with absolute and relative change.

    The KPIs travel as one array per period, so a row stays small in the plan however many
    there are. ``nothing`` holds the values of a period without rows.
    """
    packed = rows.select(*keys, "period", F.array(*kpis.values()).alias("values"))
    empty = F.array(*[F.lit(v).cast("double") for v in nothing])
    sides = periods_side_by_side(packed, keys, ["values"]).select(
        *keys,
        F.sequence(F.lit(1), F.lit(len(kpis))).alias("kpi_seq"),
        F.array(*[F.lit(name) for name in kpis]).alias("kpi"),
        F.coalesce(F.col("baseline")["values"], empty).alias("baseline_value"),
        F.coalesce(F.col("promo")["values"], empty).alias("promo_value"),
    )
    long = sides.select(*keys, F.inline(F.arrays_zip("kpi_seq", "kpi", "baseline_value", "promo_value")))
    base, new = F.col("baseline_value"), F.col("promo_value")
    return long.select("*", pct_diff(new, base, zero_base).alias("pct_diff"), (new - base).alias("abs_diff"))
