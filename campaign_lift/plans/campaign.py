"""A campaign analysis as a set of lazy DataFrames over two source tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from datetime import date
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campaign_lift import sinks
from campaign_lift.config import CampaignConfig, as_selection
from campaign_lift.functions import formats
from campaign_lift.operators import bridges, category, decision, funnel, impact, narrative, promotion, render, series, store_day, subsets
from campaign_lift.sources import options
from campaign_lift.sources.orders import OrderTables


@dataclass(frozen=True)
class Campaign:
    """Every table of the analysis. Nothing runs until a result is read or written.

    The category fact is limited to the stores of the groups, as its list filter says; the
    store-day fact holds every store of the business unit.
    """

    traffic: DataFrame
    tables: OrderTables
    cfg: CampaignConfig
    include_sunday: bool = False

    def __post_init__(self):
        if self.cfg.open_groups and self.cfg.member_table is None:
            members = options.group_members(self.tables, self.cfg)
            object.__setattr__(self, "cfg", replace(self.cfg, member_table=members))

    # facts

    @cached_property
    def _facts_held(self) -> bool:
        return False

    @cached_property
    def store_day_raw(self) -> DataFrame:
        return store_day.store_day_raw(self.traffic, self.tables, self.cfg)

    @cached_property
    def store_day(self) -> DataFrame:
        return store_day.store_day(self.traffic, self.tables, self.cfg)

    @cached_property
    def _category_cfg(self) -> CampaignConfig:
        stores = self.cfg.category.store_codes or self.cfg.known_store_codes or ()
        return replace(self.cfg, category=replace(self.cfg.category, store_codes=stores))

    @cached_property
    def category_raw(self) -> DataFrame:
        return category.category_raw(self.tables, self._category_cfg)

    def _category_sums(self, metrics: Sequence[str]) -> DataFrame:
        """The category fact without order counts, with no more measures than the metrics need."""
        if self._facts_held:
            return self.category_raw
        return category.category_sums(self.tables, self._category_cfg, [bridges.METRICS[m] for m in metrics])

    def hold_facts(self) -> Campaign:
        """The same campaign with both facts kept on the executors, for several outputs of one run.

        They are aggregates. A lost executor's part is computed again from the sources.
        """
        held = replace(self)
        held.__dict__.update(
            store_day=self.store_day.persist(StorageLevel.MEMORY_AND_DISK),
            category_raw=self.category_raw.persist(StorageLevel.MEMORY_AND_DISK),
            _facts_held=True,
        )
        return held

    def release_facts(self) -> None:
        for fact in (self.store_day, self.category_raw):
            fact.unpersist()

    # store level

    @cached_property
    def _member_days(self) -> DataFrame:
        """Store-days for sums by group: if the fact is not held, those of other stores come as one row per day."""
        if self._facts_held:
            return self.store_day
        return store_day.store_day(self.traffic, self.tables, self.cfg, self.cfg.known_store_codes)

    @cached_property
    def group_sums(self) -> DataFrame:
        return funnel.group_sums(self._member_days, self.cfg, self.include_sunday)

    @cached_property
    def store_funnel_both(self) -> DataFrame:
        """The funnel with and without Sundays in one pass, whatever ``include_sunday`` says."""
        return funnel.store_funnel_both(funnel.group_sums_both(self._member_days, self.cfg), self.cfg)

    @cached_property
    def store_funnel(self) -> DataFrame:
        return funnel.store_funnel(self.group_sums, self.cfg)

    @cached_property
    def period_metrics(self) -> DataFrame:
        return funnel.period_metrics(self.group_sums, self.cfg)

    @cached_property
    def footfall_labels(self) -> DataFrame:
        return funnel.footfall_labels(self.group_sums)

    @cached_property
    def store_promo_impact(self) -> DataFrame:
        return impact.promo_impact(self.store_funnel, self.cfg)

    @cached_property
    def discount_breakdown(self) -> DataFrame:
        return bridges.discount_breakdown(self.group_sums, self.cfg)

    @cached_property
    def pc1_bridge_period(self) -> DataFrame:
        return bridges.pc1_bridge_period(self.group_sums, self.cfg)

    @cached_property
    def pc1_bridge_baseline_to_promo(self) -> DataFrame:
        return bridges.pc1_bridge_baseline_to_promo(self.group_sums, self.cfg)

    @cached_property
    def weekday_kpis(self) -> DataFrame:
        return series.weekday_kpis(self.store_day, self.cfg)

    @cached_property
    def weekday_pct_diff(self) -> DataFrame:
        return series.weekday_pct_diff(self.store_day, self.cfg)

    @cached_property
    def daily_kpis(self) -> DataFrame:
        return series.daily_kpis(self.store_day, self.cfg)

    def daily_trend(self, groups: Sequence[str] | None = None) -> DataFrame:
        return series.daily_trend(self.daily_kpis, self.cfg, groups)

    def weekday_chart(self, groups: Sequence[str] | None = None) -> DataFrame:
        return series.weekday_chart(self.weekday_pct_diff, self.cfg, groups)

    @cached_property
    def store_subset_export(self) -> DataFrame:
        return subsets.store_subset_export(self.store_day, self.cfg)

    # category level

    @cached_property
    def category_funnel(self) -> DataFrame:
        return category.category_funnel(self.category_raw, self.cfg)

    @cached_property
    def category_promo_impact(self) -> DataFrame:
        return impact.promo_impact(self.category_funnel, self.cfg)

    def split_bridges(self, splits: Sequence[str] = tuple(bridges.SPLITS), metrics: Sequence[str] = tuple(bridges.METRICS)) -> DataFrame:
        return bridges.split_bridges(self._category_sums(metrics), self.cfg, splits, metrics)

    def dimension_bridge(self, dimension: str, metric: str, selected: Sequence[str] = (), **rules) -> DataFrame:
        return bridges.dimension_bridge(self._category_sums([metric]), self.cfg, dimension, metric, selected, **rules)

    def dimension_bridges(self, specs: Sequence[tuple[str, str, Sequence[str]]] | None = None, **rules) -> DataFrame:
        """Bridges of several (dimension, metric, selected values) in one pass; by default the three article dimensions of
        the report with each metric and the values that the category filter lists. A choice of all values, or all except
        some, lists none: the facts hold what is left."""
        chosen = self.cfg.category
        if specs is None:
            values = {
                "article_section_group": chosen.article_section_groups,
                "article_section": chosen.article_sections,
                "article_brand_group": chosen.article_brand_groups,
            }
            listed = {name: choice.values if choice.mode == "include" else () for name, choice in ((n, as_selection(v)) for n, v in values.items())}
            specs = [(name, metric, selected) for name, selected in listed.items() for metric in bridges.METRICS]
        metrics = list(dict.fromkeys(metric for _, metric, _ in specs))
        return bridges.dimension_bridges(self._category_sums(metrics), self.cfg, specs, **rules)

    # decision and text

    @cached_property
    def pair_tables(self) -> DataFrame:
        return decision.pair_tables(self.store_funnel, self.cfg)

    def kpi_drivers(self, top_n: int = 5, min_abs_value: float = 0.0) -> DataFrame:
        return decision.kpi_drivers(self.pair_tables, top_n, min_abs_value)

    def ab_winner(self, **rules) -> DataFrame:
        return decision.ab_winner(self.pair_tables, **rules)

    def ab_comparisons(self, **rules) -> DataFrame:
        return decision.ab_comparisons(self.pair_tables, **rules)

    @cached_property
    def report_payload(self) -> DataFrame:
        return decision.report_payload(self.pair_tables, self.cfg)

    @cached_property
    def driver_insights(self) -> DataFrame:
        return narrative.driver_insights(self.pair_tables, self.cfg)

    @cached_property
    def driver_summary(self) -> DataFrame:
        return narrative.driver_summary(self.pair_tables, self.cfg)

    # options and the single-promotion summary

    def store_options(self) -> DataFrame:
        return options.store_options(self.tables, self.cfg)

    def category_options(self) -> DataFrame:
        return options.category_options(self.tables, self.cfg)

    def promotion_summary(self, promotion_id: str, start: date, end: date, end_inclusive: bool = False) -> DataFrame:
        return promotion.promotion_summary(self.tables, self.cfg, promotion_id, start, end, end_inclusive)

    # outputs

    @cached_property
    def selection(self) -> DataFrame:
        """(selection): the run settings as JSON, each choice as it was made and, for groups, the stores it came to."""
        spark = self.traffic.sparkSession
        stores = self.cfg.member_frame(spark).groupBy("grp").agg(F.sort_array(F.collect_set("store_code")).alias("stores"))
        groups = self.cfg.group_frame(spark).select("grp").join(stores, "grp", "left")
        entry = F.struct(F.col("grp"), F.coalesce("stores", F.array().cast("array<string>")).alias("stores"))
        resolved = groups.agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("resolved"))
        record = decision.selection_json(self.cfg, self.include_sunday)
        kept, rest = F.lit(record.removesuffix("\n}")), F.to_json("resolved")
        return resolved.select(F.concat(kept, F.lit(',\n  "group_stores": '), rest, F.lit("\n}")).alias("selection"))

    def _tables(self) -> dict[str, tuple[Callable[[], DataFrame], list[str]]]:
        """The KPI tables of the report and their order. Each is planned when it is asked for."""
        pair_order, bridge_order = ["control_group", "testing_group", "kpi_seq"], ["grp", "bridge", "step_seq"]

        def coordinates(steps: Callable[[], DataFrame]) -> Callable[[], DataFrame]:
            return lambda: bridges.waterfall_coordinates(steps())

        return {
            "store_funnel": (lambda: formats.format_funnel(self.store_funnel), ["grp", "kpi_seq"]),
            "store_funnel_both": (lambda: formats.format_funnel(self.store_funnel_both), ["include_sunday", "grp", "kpi_seq"]),
            "store_promo_impact": (lambda: formats.format_impact(self.store_promo_impact), pair_order),
            "discount_breakdown": (lambda: formats.format_discount_breakdown(self.discount_breakdown), ["grp", "kpi_seq"]),
            "category_funnel": (lambda: formats.format_funnel(self.category_funnel), ["grp", "kpi_seq"]),
            "category_promo_impact": (lambda: formats.format_impact(self.category_promo_impact), pair_order),
            "pc1_bridges": (coordinates(lambda: self.pc1_bridge_period.unionByName(self.pc1_bridge_baseline_to_promo)), bridge_order),
            "category_bridges": (coordinates(self.split_bridges), bridge_order),
            "dimension_bridges": (coordinates(self.dimension_bridges), bridge_order),
            "period_metrics": (lambda: self.period_metrics, ["grp", "period"]),
            "weekday_kpis": (lambda: self.weekday_kpis, ["grp", "period", "weekday_seq"]),
            "weekday_chart": (self.weekday_chart, ["grp", "chart_seq", "weekday_seq"]),
            "weekday_pct_diff": (lambda: self.weekday_pct_diff, ["grp", "weekday_seq"]),
            "footfall_labels": (lambda: self.footfall_labels, ["grp"]),
            "store_options": (self.store_options, ["store_code"]),
            "category_options": (self.category_options, ["dimension", "option"]),
            "daily_trend": (self.daily_trend, ["grp", "ordered_date", "period"]),
        }

    @property
    def files(self) -> dict[str, Callable[[], DataFrame]]:
        """Every output of a run by name: a frame of lines in file order."""
        pair = decision.PAIR
        tables = {
            name: lambda build=build, order=order: render.csv_lines(build(), order, sep="\t") for name, (build, order) in self._tables().items()
        }
        return {
            "store_level_all_categories": lambda: render.csv_lines(
                subsets.store_subset_rows(self.store_day, self.cfg), subsets.EXPORT_ORDER
            ),
            "selected_categories": lambda: render.csv_lines(self.category_raw, category.DIMENSIONS),
            **tables,
            "summary": lambda: render.text_lines(self.driver_summary, pair, "summary"),
            "payload": lambda: decision.payload_json(self.report_payload).select(*pair, F.col("payload").alias("line")).orderBy(*pair),
            "selection": lambda: render.text_lines(self.selection, [], "selection"),
        }

    def write_report(self, folder: str) -> None:
        """All tables of the analysis under one folder."""
        run = self.hold_facts()
        try:
            for name, lines in run.files.items():
                sinks.write_lines(lines(), f"{folder}/{name}")
        finally:
            run.release_facts()
