"""Store funnel: KPIs of every group, baseline against promo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campaign_lift.config import PERIODS, CampaignConfig
from campaign_lift.functions.columns import is_sunday
from campaign_lift.operators.metrics import STORE_SUMS, kpi_rows, periods_side_by_side, store_funnel_kpis, store_sums
from campaign_lift.operators.subsets import group_period_rows


def group_sums(facts: DataFrame, cfg: CampaignConfig, include_sunday: bool = False) -> DataFrame:
    """One row per configured group and period with its sums; zeros where there were no rows, nothing at all without facts.

    Facts may hold other stores than those of the groups, singly or as rows without a store: they only show that there
    was traffic.
    """
    subset = group_period_rows(facts, cfg)
    if not include_sunday:
        subset = subset.withColumn("grp", F.when(~is_sunday(F.col("ordered_date")), F.col("grp")))
    return _on_grid(subset, cfg, ["grp", "period"], [{"grp": F.lit(g), "period": F.lit(p)} for g in cfg.groups for p in PERIODS])


def group_sums_both(facts: DataFrame, cfg: CampaignConfig) -> DataFrame:
    """``group_sums`` with and without Sundays, told apart by ``include_sunday``, from one aggregation: a row of a Sunday
    counts once, any other row twice."""
    flags = F.when(is_sunday(F.col("ordered_date")), F.array(F.lit(True))).otherwise(F.array(F.lit(True), F.lit(False)))
    subset = group_period_rows(facts, cfg).withColumn("include_sunday", F.explode(flags))
    places = [
        {"grp": F.lit(g), "period": F.lit(p), "include_sunday": F.lit(s)} for g in cfg.groups for p in PERIODS for s in (True, False)
    ]
    return _on_grid(subset, cfg, ["grp", "period", "include_sunday"], places)


def _on_grid(subset: DataFrame, cfg: CampaignConfig, keys: list[str], places: list[dict[str, Column]]) -> DataFrame:
    """Sums by key with a zero row at every place of the grid, if the subset has any row, whatever its group.

    A grand-total grouping set comes with the sums from the same aggregation. Its one row stands for "there are facts": it
    is opened to the places of the grid and adds nothing to them.
    """
    sums = store_sums(subset, keys, count_stores=True, total="is_total")
    grid = F.array(*[F.struct(*[column.alias(key) for key, column in place.items()]) for place in places])
    own = F.array(F.struct(*keys))
    values = [*STORE_SUMS, "trackable_stores"]
    placed = sums.where(F.col("is_total") | F.col("grp").isNotNull()).select(
        F.inline(F.when(F.col("is_total"), grid).otherwise(own)),
        *[F.when(~F.col("is_total"), F.col(v)).alias(v) for v in values],
    )
    filled = placed.groupBy(*keys).agg(*[F.coalesce(F.max(v), F.lit(0)).alias(v) for v in values])
    label = F.coalesce(*[F.when(F.col("grp") == g, cfg.group_label(g)) for g in cfg.groups])
    return filled.withColumn("grp_label", label)


def store_funnel_both(sums: DataFrame, cfg: CampaignConfig) -> DataFrame:
    """``store_funnel`` of both Sunday settings."""
    kpis = store_funnel_kpis({name: F.col(name) for name in STORE_SUMS}, cfg.vat)
    return kpi_rows(sums, kpis, zero_base=0.0, nothing=[0.0] * len(kpis), keys=("grp", "include_sunday"))


def store_funnel(sums: DataFrame, cfg: CampaignConfig) -> DataFrame:
    """(grp, kpi_seq, kpi, baseline_value, promo_value, pct_diff, abs_diff); change on a zero base is 0."""
    kpis = store_funnel_kpis({name: F.col(name) for name in STORE_SUMS}, cfg.vat)
    return kpi_rows(sums, kpis, zero_base=0.0, nothing=[0.0] * len(kpis))


# Display headings of KPI tables (fixed values).
HEADINGS = {
    "kpi": "KPI",
    "baseline_value": "Baseline Period",
    "promo_value": "Promo Period",
    "pct_diff": "% Diff (Promo vs Baseline)",
    "abs_diff": "Abs Diff (Promo - Baseline)",
}


def for_display(table: DataFrame, grp: str) -> DataFrame:
    """KPI rows of one group under their display headings, in KPI order."""
    rows = table.where(F.col("grp") == grp).orderBy("kpi_seq")
    return rows.select(*[F.col(name).alias(heading) for name, heading in HEADINGS.items()])


# Metric names of the period table and the funnel KPI each stands for (fixed values).
PERIOD_METRICS = {
    "pedestrian_footfall": "pedestrian footfall",
    "store_absorption_rate": "store absorption rate",
    "incoming_visitors": "incoming visitors",
    "cal_store_conversion_rate": "store conversion rate",
    "total_orders": "total orders",
    "AOV": "AOV",
    "total_quantity": "total quantity",
    "price_per_item": "price per item",
    "total_revenue": "total revenue",
    "total_PC1": "total PC1",
    "margin": "margin",
    "RP_revenue": "RP revenue",
    "promo_revenue": "promo revenue",
    "existing_revenue": "existing revenue",
    "RP_quantity": "RP quantity",
    "promo_quantity": "promo quantity",
    "existing_quantity": "existing quantity",
    "RP_PC1": "RP PC1",
    "promo_PC1": "promo PC1",
    "existing_PC1": "existing PC1",
    "RP_margin": "RP margin",
    "promo_margin": "promo margin",
    "existing_margin": "existing margin",
    "RP_revenue_share": "RP revenue share",
    "promo_revenue_share": "promo revenue share",
    "existing_revenue_share": "existing revenue share",
}


def period_metrics(sums: DataFrame, cfg: CampaignConfig) -> DataFrame:
    """The 26 KPIs and the trackable-store count of every group and period, one column each."""
    kpis = store_funnel_kpis({name: F.col(name) for name in STORE_SUMS}, cfg.vat)
    return sums.select(
        "grp",
        "period",
        *[kpis[kpi].alias(name) for name, kpi in PERIOD_METRICS.items()],
        F.col("trackable_stores").alias("footfall_trackable_stores_count"),
    )


def footfall_labels(sums: DataFrame) -> DataFrame:
    """Caption with the number of stores whose footfall was counted in each period."""
    sides = periods_side_by_side(sums, ["grp", "grp_label"], ["trackable_stores"])
    baseline, promo = (F.col(p)["trackable_stores"] for p in ("baseline", "promo"))
    caption = F.concat(
        F.lit("pedestrian footfall\n(trackable stores #: "),
        baseline.cast("string"),
        F.lit(" -->"),
        promo.cast("string"),
        F.lit(")"),
    )
    return sides.select(
        "grp", "grp_label", baseline.alias("baseline_stores"), promo.alias("promo_stores"), caption.alias("footfall_label")
    )
