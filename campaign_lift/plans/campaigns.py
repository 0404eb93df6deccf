"""Many campaigns of one seller in one job: every table of the single analysis with the campaign in its key."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campaign_lift.config import CampaignConfig
from campaign_lift.operators import decision, impact, many, narrative
from campaign_lift.sources.campaign_tables import CampaignTables
from campaign_lift.sources.orders import OrderTables

PAIR = ("campaign", *decision.PAIR)


@dataclass(frozen=True)
class Campaigns:
    """Both facts are derived once, whatever the number of campaigns. ``seller`` gives the filters that all share; its
    groups and dates are not used."""

    traffic: DataFrame
    tables: OrderTables
    seller: CampaignConfig
    plan: CampaignTables

    @cached_property
    def store_days(self) -> DataFrame:
        return many.campaign_store_days(self.traffic, self.tables, self.seller, self.plan)

    @cached_property
    def group_sums(self) -> DataFrame:
        return many.campaign_sums(self.store_days, self.plan)

    @cached_property
    def store_funnel(self) -> DataFrame:
        return many.campaign_funnel(self.group_sums, self.plan)

    @cached_property
    def store_promo_impact(self) -> DataFrame:
        return impact.impact_of_roles(self.store_funnel, self.plan.roles, ["campaign"])

    @cached_property
    def pair_tables(self) -> DataFrame:
        return decision.pairs_of_roles(self.store_funnel, self.plan.roles, ["campaign"])

    def kpi_drivers(self, top_n: int = 5, min_abs_value: float = 0.0) -> DataFrame:
        return decision.kpi_drivers(self.pair_tables, top_n, min_abs_value, PAIR)

    def ab_winner(self, **rules) -> DataFrame:
        return decision.ab_winner(self.pair_tables, PAIR, **rules)

    def ab_comparisons(self, **rules) -> DataFrame:
        return decision.ab_comparisons(self.pair_tables, PAIR, **rules)

    @cached_property
    def _codes(self) -> DataFrame:
        settings = self.plan.campaigns.select("campaign", "promo_mechanism").distinct()
        pairs = self.pair_tables.join(settings, "campaign")
        return narrative.driver_codes(pairs, F.col("promo_mechanism"), (*PAIR, "promo_mechanism"))

    @cached_property
    def driver_insights(self) -> DataFrame:
        return narrative.insights_of(self._codes, PAIR)

    @cached_property
    def driver_summary(self) -> DataFrame:
        codes = self._codes.join(self.plan.texts_of_dates, "campaign")
        keys = (*PAIR, "baseline_dates", "promo_dates")
        text = narrative.summary_of(codes, F.col("baseline_dates"), F.col("promo_dates"), keys)
        return text.select(*PAIR, "summary")
