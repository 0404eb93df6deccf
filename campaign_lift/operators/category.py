"""The category fact: order items per store, day and article dimensions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from campaign_lift.config import BASELINE, CampaignConfig
from campaign_lift.functions.columns import cents, in_values, micros, or_unknown, pad_store_code, price_type, promo_check, sum_where
from campaign_lift.operators.metrics import kpi_rows
from campaign_lift.operators.store_day import scale_baseline
from campaign_lift.operators.subsets import group_period_subset
from campaign_lift.sources.options import not_excepted
from campaign_lift.sources.orders import OrderTables, seller_values
from campaign_lift.sources.schemas import PC1, QUANTITY, REVENUE

DIMENSIONS = (
    "ordered_date",
    "country",
    "company_name_short",
    "channel",
    "store_code",
    "store_name",
    "article_section_group",
    "article_section",
    "article_season",
    "article_brand_group",
    "insider_customer_type",
    "price_type",
    "promo_check",
)
MEASURE_FIELDS = {"total_revenue": REVENUE, "total_quantity": QUANTITY, "total_PC1": PC1}
MEASURES = tuple(MEASURE_FIELDS)


# Dimensions derived from the item, and the item fields they come from.
ITEM_LABELS = {
    "article_section_group": "article_section_group",
    "article_section": "article_section",
    "article_season": "article_season",
    "article_brand_group": "article_brand_group",
    "price_type": "article_price_red_eur",
    "promo_check": "has_promotion",
}


def _label(name: str) -> Column:
    source = F.col(ITEM_LABELS[name])
    return {"price_type": price_type, "promo_check": promo_check}.get(name, or_unknown)(source)


def _keep(rows: DataFrame, lists: dict[str, tuple[str, ...]]) -> DataFrame:
    tests = [in_values(F.col(name), values) for name, values in lists.items() if values]
    return rows.where(reduce(and_, tests)) if tests else rows


def _category_items(
    tables: OrderTables, cfg: CampaignConfig, labels: Sequence[str], measures: Sequence[str] = ()
) -> DataFrame:
    """Item rows that pass all value lists, with the asked labels and measures.

    Except lists are tested ahead of any aggregation. Labels are never null, so that a row without a value goes by the label
    that stands for it.
    """
    fields = list(dict.fromkeys([*(ITEM_LABELS[name] for name in labels), *measures]))
    items = _chosen_orders(tables, cfg).item_rows(fields)
    rows = _keep(items.withColumns({name: _label(name) for name in labels}), cfg.category.item_lists())
    for name in cfg.category.item_excepts():
        rows = rows.where(not_excepted(tables, cfg, name, _label(name), [ITEM_LABELS[name]]))
    return rows


def _chosen_orders(tables: OrderTables, cfg: CampaignConfig) -> OrderTables:
    """Orders of the seller and the selected days that pass the lists on order columns."""
    chosen = cfg.category
    lists = [
        in_values(pad_store_code(F.col("tenant")), chosen.store_codes),
        in_values(F.col("insider_customer_type"), chosen.insider_customer_types),
    ]
    found = tables.for_seller(cfg).on_dates(cfg.selected_dates)
    if cfg.open_groups and not chosen.store_codes and cfg.member_table is not None:
        found = found.of_stores_in(cfg.member_table.select("store_code").distinct())
    for test in lists:
        if test is not None:
            found = found.where(test)
    return found.with_order_column("store_code", pad_store_code(F.col("tenant")))


def category_sums(tables: OrderTables, cfg: CampaignConfig, measures: Sequence[str] = MEASURES) -> DataFrame:
    """The asked measures per thirteen dimensions, rounded to cents, baseline scaled."""
    sources = {name: MEASURE_FIELDS[name] for name in measures}
    items = _category_items(tables, cfg, list(ITEM_LABELS), list(sources.values()))
    sums = [cents(F.coalesce(F.sum(micros(F.col(field))), F.lit(0))).alias(name) for name, field in sources.items()]
    pinned = seller_values(cfg)
    facts = items.groupBy(*[d for d in DIMENSIONS if d not in pinned]).agg(*sums).withColumns(pinned)
    return scale_baseline(facts.select(*DIMENSIONS, *measures), cfg, measures)


def store_day_order_counts(tables: OrderTables, cfg: CampaignConfig) -> DataFrame:
    """Distinct orders per day and store where no item filter is set.

    Two steps of partial aggregation: the distinct (day, store, order) rows are spread by order,
    so a store that holds most orders is still counted by many tasks. Every order record
    matches, so the count never opens the items.
    """
    rows = _chosen_orders(tables, cfg).orders
    return rows.groupBy("ordered_date", "store_code").agg(F.countDistinct("order_id").alias("order_count"))


def category_raw(tables: OrderTables, cfg: CampaignConfig) -> DataFrame:
    """Category sums with the order count of their store-day.

    The count stands for a distinct count over a (date, store) window, which Spark does not
    have. Without an item filter it is counted from the order records alone and joined back; the join is null-safe because
    a window keeps the rows without a store code as one partition. How the two meet is left to the planner and to
    adaptive execution, which know both sizes. With an item filter both come from one read of the items.
    """
    if cfg.category.tested():
        return _both_grains(tables, cfg)
    sums = category_sums(tables, cfg)
    counts = store_day_order_counts(tables, cfg).select(
        F.col("ordered_date").alias("count_date"), F.col("store_code").alias("count_store"), "order_count"
    )
    same_day = F.col("ordered_date") == F.col("count_date")
    same_store = F.col("store_code").eqNullSafe(F.col("count_store"))
    return sums.join(counts, same_day & same_store, "left").select(*DIMENSIONS, *MEASURES, "order_count")


def _both_grains(tables: OrderTables, cfg: CampaignConfig) -> DataFrame:
    """Category sums and order counts from one pass over the matching items.

    Two grouping sets leave the items: the dimensions with their sums, and the distinct (day, store, order) keys, which are
    spread by order. The keys are then counted on the map side, so that one row per store-day and task travels, and meet
    the sums of their store-day in a window: it holds the dimension rows of one store-day and no orders.
    """
    items = _category_items(tables, cfg, list(ITEM_LABELS), list(MEASURE_FIELDS.values()))
    pinned = seller_values(cfg)
    keys = [d for d in DIMENSIONS if d not in pinned]
    store_day = ["ordered_date", "store_code"]
    sums = [F.coalesce(F.sum(micros(F.col(field))), F.lit(0)).alias(name) for name, field in MEASURE_FIELDS.items()]
    grains = items.groupingSets([[F.col(k) for k in keys], [F.col(k) for k in (*store_day, "order_id")]], *keys, "order_id").agg(
        *sums, F.grouping("order_id").alias("is_fact")
    )
    counted = grains.groupBy(*keys, "is_fact").agg(
        *[F.max(name).alias(name) for name in MEASURES], F.count("order_id").alias("n_orders")
    )
    orders = F.sum("n_orders").over(Window.partitionBy(*store_day))
    facts = counted.withColumn("order_count", orders).where(F.col("is_fact") == 1).withColumns(pinned)
    rounded = facts.withColumns({name: cents(F.col(name)) for name in MEASURES})
    return scale_baseline(rounded.select(*DIMENSIONS, *MEASURES, "order_count"), cfg, MEASURES)


def category_funnel(facts: DataFrame, cfg: CampaignConfig) -> DataFrame:
    """22 KPIs of the selected categories per group. Groups without any row are left out.

    Here a sum over nothing is NULL and so is a change on a zero base. Orders are counted once
    per store-day, on baseline dates times the coefficient.
    """
    parts = {
        "RP": F.col("price_type") == "RP",
        "promo": F.col("promo_check") == "promo",
        "existing": F.col("insider_customer_type") == "EXISTING",
    }
    measures = {"revenue": "total_revenue", "quantity": "total_quantity", "PC1": "total_PC1"}
    sums = [F.sum(column).alias(f"total_{name}") for name, column in measures.items()]
    sums += [
        sum_where(rule, F.col(column)).alias(f"{part}_{name}")
        for part, rule in parts.items()
        for name, column in measures.items()
    ]
    values = [f"{part}_{name}" for part in ("total", *parts) for name in measures]
    per_day = (
        group_period_subset(facts, cfg)
        .groupBy("grp", "period", "ordered_date", "store_code")
        .agg(*sums, F.max("order_count").alias("order_count"))
    )
    per_period = per_day.groupBy("grp", "period").agg(
        *[F.sum(v).alias(v) for v in values], F.sum("order_count").cast("double").alias("orders")
    )
    kpis = _category_kpis(cfg)
    # A period without rows has no orders, and nothing else to add up.
    return kpi_rows(per_period, kpis, zero_base=None, nothing=[0.0] + [None] * (len(kpis) - 1))


def _category_kpis(cfg: CampaignConfig) -> dict[str, Column]:
    """KPIs of a (grp, period) row in display order; the keys are fixed values."""
    value = F.col
    revenue, quantity = value("total_revenue"), value("total_quantity")
    scale = F.when(F.col("period") == BASELINE, F.lit(float(cfg.baseline_coefficient))).otherwise(1.0)
    orders = F.coalesce("orders", F.lit(0.0)) * scale

    def margin(part: str) -> Column:
        return F.bround(F.try_divide(value(f"{part}_PC1"), value(f"{part}_revenue")) * cfg.vat, 4)

    def share(part: str) -> Column:
        return F.try_divide(value(f"{part}_revenue"), revenue)

    kpis = {
        "total orders": orders,
        "AOV": F.try_divide(revenue, orders),
        "total quantity": quantity,
        "price per item": F.try_divide(revenue, quantity),
        "total revenue": revenue,
        "total PC1": value("total_PC1"),
        "margin": margin("total"),
        "RP revenue": value("RP_revenue"),
        "promo revenue": value("promo_revenue"),
        "existing revenue": value("existing_revenue"),
        "RP quantity": value("RP_quantity"),
        "promo quantity": value("promo_quantity"),
        "existing quantity": value("existing_quantity"),
        "RP PC1": value("RP_PC1"),
        "promo PC1": value("promo_PC1"),
        "existing PC1": value("existing_PC1"),
        "RP margin": margin("RP"),
        "promo margin": margin("promo"),
        "existing margin": margin("existing"),
        "RP revenue share": share("RP"),
        "promo revenue share": share("promo"),
        "existing revenue share": share("existing"),
    }
    return {f"{name} (selected categories)": kpi for name, kpi in kpis.items()}
