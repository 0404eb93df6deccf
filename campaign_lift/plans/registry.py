"""The named queries: each operator over the sample tables with the standard settings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import date

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from campaign_lift.config import CampaignConfig, CategoryFilter, Selection, expand_dates, local_table
from campaign_lift.functions import formats
from campaign_lift.operators import bridges, category, decision, funnel, impact, store_day
from campaign_lift.plans.campaign import Campaign
from campaign_lift.plans.campaigns import Campaigns
from campaign_lift.sources import by_day, options, text_feed
from campaign_lift.sources.campaign_tables import CampaignTables
from campaign_lift.sources.orders import OrderTables
from campaign_lift.sources.sample_tables import (
    sample_nested_orders,
    sample_order_rows,
    sample_tables,
    sample_traffic,
    sample_traffic_text,
)
from campaign_lift.sources.schemas import PC1, QUANTITY, REVENUE

Query = Callable[[SparkSession, str], DataFrame]

STANDARD = CampaignConfig(
    traffic_business_unit="NOVA DE",
    traffic_country="DE",
    order_company_name_short="NOVA",
    order_channel="STATIONARY",
    order_country="DE",
    groups={
        "Group 1": ["0", "1", "2"],
        "Group 2": ["2", "3"],
        "Group 3": ["4", "5", "6", "7"],
        "Group 4": [],
    },
    baseline_dates=expand_dates(date(2024, 1, 1), date(2024, 1, 14)),
    promo_dates=[d for d in expand_dates(date(2024, 1, 15), date(2024, 1, 28)) if d != date(2024, 1, 17)],
    descriptions={"Group 1": "no offer", "Group 3": "offer"},
    pairs=(("Group 1", "Group 3"), ("Group 1", "Group 2"), ("Group 2", "Group 4"), ("Group 3", "Group 3")),
)
PROMOTION_ID = "PROMO_A"
PROMOTION_RANGE = (date(2024, 1, 3), date(2024, 1, 24))
SECTION_GROUPS = ("ECONOMY", "STANDARD")
FILTERED = CategoryFilter(
    store_codes=("0000", "0002", "0005"),
    article_section_groups=SECTION_GROUPS,
    article_seasons=("SS", "UNKNOWN"),
    insider_customer_types=("EXISTING", "NEW"),
    price_types=("RP", "BP"),
    promo_checks=("promo",),
)
EXCEPT = CategoryFilter(
    store_codes=("0000", "0002", "0005"),
    article_section_groups=Selection("except", ("ECONOMY", "No such group")),
    article_seasons=Selection("except", ("SS", "UNKNOWN")),
    article_sections=Selection("all"),
)
# Every season and brand group is excepted, which filters nothing.
EXCEPT_ALL = CategoryFilter(
    article_sections=Selection("except", ("Brand#1", "Brand#2")),
    article_seasons=Selection("except", ("SS", "FW", "NOS", "UNKNOWN")),
    article_brand_groups=Selection("except", ("OWN", "BRAND", "UNKNOWN", "No such brand")),
)
OPEN_GROUPS = {"Group 1": Selection("all"), "Group 2": Selection("except", ("1", "0003")), "Group 3": ("4", "5", "6", "7"), "Group 4": ()}
DIMENSION_BRIDGES = {
    "section_group": ("article_section_group", SECTION_GROUPS),
    "section": ("article_section", ()),
    "brand": ("article_brand_group", ("OWN", "BRAND", "UNKNOWN", "LICENSED")),
}


def campaign(spark: SparkSession, folder: str, cfg: CampaignConfig = STANDARD, include_sunday: bool = False) -> Campaign:
    return Campaign(sample_traffic(spark, folder), sample_tables(spark, folder), cfg, include_sunday)


def _of(build: Callable[[Campaign], DataFrame], cfg: CampaignConfig = STANDARD, include_sunday: bool = False) -> Query:
    return lambda spark, folder: build(campaign(spark, folder, cfg, include_sunday))


def _in_eighths(build: Callable[[OrderTables, CampaignConfig], DataFrame]) -> Query:
    """A fact over amounts in eighths of a euro, in which halves of a cent occur."""
    return lambda spark, folder: build(sample_tables(spark, folder, steps=8), STANDARD)


def _nested_items(spark: SparkSession, folder: str) -> DataFrame:
    """Item rows opened from order records."""
    tables = OrderTables.from_nested(sample_nested_orders(spark, folder))
    items = tables.item_rows(["item_no", "article_price_red_eur", "has_promotion", "promotions", REVENUE, QUANTITY, PC1])
    return items.select(
        "order_id",
        "ordered_at",
        "tenant",
        "insider_customer_type",
        "item_no",
        "article_price_red_eur",
        "has_promotion",
        F.array_join(F.col("promotions")["promotion_id"], ",").alias("promotion_ids"),
        F.col(REVENUE).alias("revenue"),
        F.col(QUANTITY).alias("quantity"),
        F.col(PC1).alias("pc1"),
    )


def _nested_promotion_summary(spark: SparkSession, folder: str) -> DataFrame:
    tables = OrderTables.from_nested(sample_nested_orders(spark, folder))
    return Campaign(sample_traffic(spark, folder), tables, STANDARD).promotion_summary(
        PROMOTION_ID, *PROMOTION_RANGE, end_inclusive=True
    )


def _selections(spark: SparkSession, folder: str) -> DataFrame:
    """Include and except choices over the option list of sections."""
    sections = (
        options.category_options(sample_tables(spark, folder), STANDARD)
        .where(F.col("dimension") == "article_section")
        .select(F.col("option").alias("article_section"))
    )
    chosen = ("Brand#1", "Brand#2", "Brand#3", "No such brand")
    parts = [
        options.select_options(sections, "article_section", mode, chosen).select("article_section", F.lit(mode).alias("mode"))
        for mode in ("include", "except")
    ]
    return parts[0].unionByName(parts[1])


def _date_set(spark: SparkSession, folder: str) -> DataFrame:
    """Order days inside two date windows: windows are opened to days, joined, and made distinct."""
    windows = local_table(
        spark,
        {
            "first": (pa.date32(), [date(2024, 1, 14), date(2024, 1, 10), None]),
            "last": (pa.date32(), [date(2024, 1, 1), date(2024, 1, 20), date(2024, 1, 30)]),
        },
    )
    days = options.window_days(windows, "first", "last")
    orders = sample_order_rows(spark, folder).groupBy(F.to_date("ordered_at").alias("ordered_date")).agg(F.count("*").alias("n_orders"))
    return orders.join(days, "ordered_date").orderBy("ordered_date")


#: How many campaigns the queries over campaign tables hold.
MANY = 50


def sample_campaigns(spark: SparkSession) -> CampaignTables:
    """Fifty overlapping campaigns: windows overlap and lie in either order, one has no promo day, one lies where no data
    are, groups share stores, and every fifth campaign has a group without any."""
    ids = spark.range(MANY).withColumn("campaign", F.format_string("C%02d", "id"))
    start = "date_add(CASE WHEN id = 49 THEN DATE '2022-01-01' ELSE DATE '2024-01-01' END, CAST(id % 14 AS INT))"
    windows = ids.selectExpr(
        "campaign",
        f"""inline(array(
            named_struct('period', 'Baseline Period', 'first_day', {start}, 'last_day', date_add({start}, 6)),
            named_struct('period', 'Baseline Period', 'first_day', date_add({start}, 4), 'last_day', date_add({start}, 8)),
            named_struct('period', 'Promo Period', 'first_day', date_add({start}, IF(id % 2 = 0, 8, 15)),
                'last_day', IF(id = 48, NULL, date_add({start}, IF(id % 2 = 0, 15, 8))))))""",
    )
    members = ids.selectExpr(
        "campaign",
        """inline(transform(array(0, 1, 13, 14, 11, IF(id % 5 = 0, NULL, 26)),
            k -> named_struct('grp', concat('Group ', 1 + CAST(floor(k / 10) AS INT)), 'store_code', CAST((id + k % 10) % 8 AS STRING))))""",
    )
    return CampaignTables(
        campaigns=ids.selectExpr(
            "campaign",
            "IF(id % 2 = 0, 1.19D, 1.2D) AS vat",
            "element_at(array(1D, 1.5D, 0.5D), 1 + CAST(id % 3 AS INT)) AS baseline_coefficient",
            "element_at(array('BOTH', 'BP_ONLY', 'RP_ONLY'), 1 + CAST(id % 3 AS INT)) AS promo_mechanism",
            "id % 4 = 0 AS include_sunday",
        ),
        groups=ids.selectExpr("campaign", "explode(array('Group 1', 'Group 2', 'Group 3')) AS grp"),
        members=members.where("grp IS NOT NULL AND store_code IS NOT NULL"),
        windows=windows,
        pairs=ids.selectExpr(
            "campaign",
            """inline(array(named_struct('control_group', 'Group 1', 'testing_group', 'Group 2'),
                named_struct('control_group', 'Group 2', 'testing_group', 'Group 3')))""",
        ),
    )


def sample_many(spark: SparkSession, folder: str) -> Campaigns:
    return Campaigns(sample_traffic(spark, folder), sample_tables(spark, folder), STANDARD, sample_campaigns(spark))


def sample_many_by_day(spark: SparkSession, folder: str) -> Campaigns:
    """The same campaigns over both tables laid out by day."""
    path = by_day.shared_folder(spark)
    by_day.write_traffic_by_day(sample_traffic(spark, folder), f"{path}/traffic")
    by_day.write_orders_by_day(OrderTables.from_nested(sample_nested_orders(spark, folder)), f"{path}/orders", dealt=True)
    traffic, tables = by_day.read_traffic_by_day(spark, f"{path}/traffic"), by_day.read_orders_by_day(spark, f"{path}/orders")
    return Campaigns(traffic, tables, STANDARD, sample_campaigns(spark))


def _of_many(build: Callable[[Campaigns], DataFrame]) -> Query:
    return lambda spark, folder: build(sample_many(spark, folder))


def _winner(c: Campaign | Campaigns) -> DataFrame:
    rows = c.ab_winner()
    return rows.select(
        *[n for n in rows.columns if n not in ("comparisons", "reason_codes")],
        F.array_join("reason_codes", ",").alias("reason_codes"),
    )


def all_queries() -> dict[str, Query]:
    scaled = replace(STANDARD, baseline_coefficient=1.5)
    queries: dict[str, Query] = {
        "nested_order_items": _nested_items,
        "traffic_store_day": _of(lambda c: store_day.traffic_store_day(c.traffic, c.cfg)),
        "text_feed_store_day": lambda spark, folder: store_day.traffic_store_day(
            text_feed.typed_traffic(sample_traffic_text(spark, folder)), STANDARD
        ),
        "text_feed_rejects": lambda spark, folder: text_feed.rejected(text_feed.typed_traffic(sample_traffic_text(spark, folder))),
        "order_store_day": _of(lambda c: store_day.order_store_day(c.tables, c.cfg)),
        "order_store_day_eighths": _in_eighths(store_day.order_store_day),
        "category_raw_eighths": _in_eighths(category.category_raw),
        "store_day_raw": _of(lambda c: c.store_day_raw),
        "store_day_scaled": _of(lambda c: c.store_day, replace(STANDARD, baseline_coefficient=1.1)),
        "store_subset_export": _of(lambda c: c.store_subset_export),
        "store_funnel": _of(lambda c: c.store_funnel),
        "store_funnel_incl_sunday": _of(lambda c: c.store_funnel, include_sunday=True),
        "store_funnel_both": _of(lambda c: c.store_funnel_both),
        "store_funnel_scaled": _of(lambda c: c.store_funnel, scaled),
        "period_metrics": _of(lambda c: c.period_metrics),
        "footfall_labels": _of(lambda c: c.footfall_labels),
        "store_promo_impact": _of(lambda c: c.store_promo_impact),
        "store_promo_impact_display": _of(
            lambda c: impact.impact_for_display(formats.format_impact(c.store_promo_impact), "Group 1", "Group 3")
        ),
        "weekday_kpis": _of(lambda c: c.weekday_kpis),
        "weekday_pct_diff": _of(lambda c: c.weekday_pct_diff),
        "weekday_chart": _of(lambda c: c.weekday_chart(["Group 1", "Group 3"])),
        "daily_kpis": _of(lambda c: c.daily_kpis),
        "daily_trend": _of(lambda c: c.daily_trend(["Group 1", "Group 3"])),
        "discount_breakdown": _of(lambda c: c.discount_breakdown),
        "discount_formatted": _of(lambda c: formats.format_discount_breakdown(c.discount_breakdown)),
        "pc1_bridge_period": _of(lambda c: c.pc1_bridge_period),
        "pc1_bridge_b2p": _of(lambda c: c.pc1_bridge_baseline_to_promo),
        "pc1_bridge_b2p_closed": _of(
            lambda c: bridges.pc1_bridge_baseline_to_promo(c.group_sums, c.cfg, show_full_price=True), include_sunday=True
        ),
        "category_raw": _of(lambda c: category.category_raw(c.tables, c.cfg)),
        "category_raw_filtered": _of(
            lambda c: category.category_raw(c.tables, c.cfg), replace(STANDARD, category=FILTERED)
        ),
        "category_raw_except": _of(lambda c: category.category_raw(c.tables, c.cfg), replace(STANDARD, category=EXCEPT)),
        "category_raw_except_all": _of(lambda c: category.category_raw(c.tables, c.cfg), replace(STANDARD, category=EXCEPT_ALL)),
        "store_funnel_open_groups": _of(lambda c: c.store_funnel, replace(STANDARD, groups=OPEN_GROUPS)),
        "category_funnel_open_groups": _of(lambda c: c.category_funnel, replace(STANDARD, groups=OPEN_GROUPS)),
        "group_members": _of(lambda c: c.cfg.member_frame(c.traffic.sparkSession), replace(STANDARD, groups=OPEN_GROUPS)),
        "category_funnel": _of(lambda c: c.category_funnel),
        "category_funnel_scaled": _of(lambda c: c.category_funnel, scaled),
        "category_promo_impact": _of(lambda c: c.category_promo_impact),
        "bridges_split_all": _of(lambda c: c.split_bridges()),
        "waterfall_coords": _of(
            lambda c: bridges.waterfall_coordinates(c.pc1_bridge_period.unionByName(c.pc1_bridge_baseline_to_promo))
        ),
        "waterfall_coords_category": _of(lambda c: bridges.waterfall_coordinates(c.split_bridges())),
        "promotion_summary": _of(lambda c: c.promotion_summary(PROMOTION_ID, *PROMOTION_RANGE)),
        "promotion_summary_nested": _nested_promotion_summary,
        "store_options": _of(lambda c: c.store_options()),
        "category_option_tuples": _of(lambda c: options.category_option_tuples(c.tables, c.cfg)),
        "category_options": _of(lambda c: c.category_options()),
        "include_except_selection": _selections,
        "date_set": _date_set,
        "kpi_drivers": _of(lambda c: c.kpi_drivers()),
        "kpi_drivers_min_abs": _of(lambda c: c.kpi_drivers(top_n=3, min_abs_value=0.05)),
        "ab_winner": _of(_winner),
        "ab_comparisons": _of(lambda c: c.ab_comparisons()),
        "report_payload": _of(lambda c: c.report_payload.select("control_group", "testing_group", *_payload_figures())),
        "report_payload_kpis": _of(lambda c: _payload_kpis(c.report_payload)),
        "report_payload_drivers": _of(_payload_drivers),
        "report_payload_votes": _of(_payload_votes),
        "driver_insights": _of(lambda c: c.driver_insights),
        "driver_summary": _of(lambda c: c.driver_summary),
        "sink_csv": _of(lambda c: c.files["store_level_all_categories"]().select("is_row", "line")),
        "sink_csv_category": _of(lambda c: c.files["selected_categories"]().select("is_row", "line")),
        "sink_tsv": _of(lambda c: c.files["store_funnel"]().select("is_row", "line")),
        "sink_summary": _of(lambda c: c.files["summary"]()),
        "sink_payload": _of(_written_payload),
        "sink_selection": _of(lambda c: c.files["selection"](), replace(STANDARD, groups=OPEN_GROUPS, category=EXCEPT)),
        "funnel_formatted": _of(lambda c: formats.format_funnel(c.store_funnel)),
        "store_funnel_display": _of(lambda c: funnel.for_display(formats.format_funnel(c.store_funnel), "Group 1")),
        "impact_formatted": _of(lambda c: formats.format_impact(c.store_promo_impact)),
    }
    queries |= {
        "campaigns_store_funnel": _of_many(lambda c: c.store_funnel),
        "campaigns_store_funnel_by_day": lambda spark, folder: sample_many_by_day(spark, folder).store_funnel,
        "campaigns_promo_impact": _of_many(lambda c: c.store_promo_impact),
        "campaigns_ab_winner": _of_many(_winner),
        "campaigns_ab_comparisons": _of_many(lambda c: c.ab_comparisons()),
        "campaigns_kpi_drivers": _of_many(lambda c: c.kpi_drivers(top_n=3)),
        "campaigns_driver_insights": _of_many(lambda c: c.driver_insights),
    }
    for mechanism in ("BP_ONLY", "RP_ONLY"):
        queries[f"driver_summary_{mechanism.lower()}"] = _of(
            lambda c: c.driver_summary, replace(STANDARD, promo_mechanism=mechanism)
        )
    for split in bridges.SPLITS:
        for metric in bridges.METRICS:
            queries[f"bridge_{split}_{metric.lower()}"] = _of(
                lambda c, split=split, metric=metric: c.split_bridges([split], [metric])
            )
    for name, (dimension, selected) in DIMENSION_BRIDGES.items():
        for metric in bridges.METRICS:
            queries[f"bridge_dim_{name}_{metric.lower()}"] = _of(
                lambda c, dimension=dimension, metric=metric, selected=selected: c.dimension_bridge(
                    dimension, metric, selected
                )
            )
    specs = [(d, metric, selected) for d, selected in DIMENSION_BRIDGES.values() for metric in bridges.METRICS]
    queries["bridges_dim_all"] = _of(lambda c: c.dimension_bridges(specs))
    queries["bridge_dim_section_group_value"] = _of(
        lambda c: c.dimension_bridge("article_section_group", "revenue", one_sided="value")
    )
    return queries


def _written_payload(c: Campaign) -> DataFrame:
    """All KPI rows of the report record as they are read back from the written JSON."""
    lines, record = c.files["payload"](), c.report_payload.schema
    parsed = lines.select(*decision.PAIR, F.from_json("line", T.StructType([record["kpis"]])).alias("read"))
    return _payload_kpis(parsed.select(*decision.PAIR, "read.*"))


def _payload_kpis(payload: DataFrame) -> DataFrame:
    """All KPI rows of the report record: both funnels and the impact, in long form."""
    pair, kpis = ["control_group", "testing_group"], F.col("kpis")
    figures = ("baseline_value", "promo_value", "pct_diff", "abs_diff")
    impact_figures = (
        "testing_pct_diff", "testing_abs_diff", "control_pct_diff", "control_abs_diff",
        "testing_minus_control_pct_diff", "testing_minus_control_abs_diff",
    )

    def long(part: str, names: tuple[str, ...]) -> Column:
        def entry(row: Column) -> Column:
            named = F.array(*[F.struct(F.lit(n).alias("figure"), row[n].alias("value")) for n in names])
            return F.struct(F.lit(part).alias("part"), row["kpi_seq"].alias("kpi_seq"), row["kpi"].alias("kpi"), named.alias("figures"))

        return F.transform(kpis[part], entry)

    parts = [long("control_funnel", figures), long("testing_funnel", figures), long("promo_impact", impact_figures)]
    rows = payload.select(*pair, F.inline(F.concat(*parts)))
    return rows.select(*pair, "part", "kpi_seq", "kpi", F.inline("figures"))


def _payload_drivers(c: Campaign) -> DataFrame:
    """All driver lists of the report record, in long form."""
    analysis = F.col("phase1_driver_analysis")
    lists = [
        F.struct(F.lit(source).alias("source"), F.lit(ranking).alias("ranking"), analysis[source][ranking].alias("entries"))
        for source in ("control_group_drivers", "testing_group_drivers", "promo_impact_drivers")
        for ranking in decision.RANKINGS
    ]
    rows = c.report_payload.select("control_group", "testing_group", F.inline(F.array(*lists)))
    opened = rows.select("control_group", "testing_group", "source", "ranking", F.posexplode("entries").alias("place", "entry"))
    return opened.select(
        "control_group", "testing_group", "source", "ranking", (F.col("place") + 1).alias("position"),
        F.col("entry.kpi").alias("kpi"), F.col("entry.value").alias("value"),
    )


def _payload_votes(c: Campaign) -> DataFrame:
    """The comparisons, votes and reasons of the report record."""
    w = F.col("winner_assessment")
    rows = c.report_payload.select(
        "control_group", "testing_group", w["winner"].alias("winner"), w["confidence"].alias("confidence"),
        w["vote_count"]["testing"].alias("testing_votes"), w["vote_count"]["control"].alias("control_votes"),
        F.array_join(w["reason_codes"], ",").alias("reason_codes"), F.inline(w["comparisons"]),
    )
    return rows


def _payload_figures() -> list:
    """Figures of the nested report record as plain columns."""
    meta, kpis, winner = F.col("meta"), F.col("kpis"), F.col("winner_assessment")
    drivers = F.col("phase1_driver_analysis")
    return [
        meta["promo_mechanism"].alias("promo_mechanism"),
        F.size(meta["baseline_dates"]).alias("n_baseline_dates"),
        F.size(meta["promo_dates"]).alias("n_promo_dates"),
        meta["control_group"]["description"].alias("control_description"),
        F.array_join(meta["control_group"]["store_codes"], ",").alias("control_store_codes"),
        F.array_join(meta["testing_group"]["store_codes"], ",").alias("testing_store_codes"),
        F.size(kpis["control_funnel"]).alias("n_control_kpis"),
        F.size(kpis["promo_impact"]).alias("n_impact_kpis"),
        winner["winner"].alias("winner"),
        winner["confidence"].alias("confidence"),
        drivers["testing_group_drivers"]["top_positive"][0]["kpi"].alias("best_testing_kpi"),
        drivers["promo_impact_drivers"]["top_absolute"][0]["value"].alias("largest_impact"),
    ]
