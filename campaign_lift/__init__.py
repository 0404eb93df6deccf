"""Promotion lift analysis on Spark DataFrames."""

from campaign_lift.config import CampaignConfig, CategoryFilter, expand_dates
from campaign_lift.plans.campaign import Campaign
from campaign_lift.sources.orders import OrderTables

__all__ = ["Campaign", "CampaignConfig", "CategoryFilter", "OrderTables", "expand_dates"]
