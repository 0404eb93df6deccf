"""Option lists: which stores and article values can be chosen."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campaign_lift.config import CampaignConfig, local_table
from campaign_lift.functions.columns import or_unknown, pad_store_code
from campaign_lift.sources.orders import OrderTables

ARTICLE_DIMENSIONS = ("article_section_group", "article_section", "article_season", "article_brand_group")


def store_options(tables: OrderTables, cfg: CampaignConfig) -> DataFrame:
    """Distinct store codes of the seller, sorted. Items play no part, so none are opened."""
    orders = tables.for_seller(cfg).orders
    return orders.select(pad_store_code(F.col("tenant")).alias("store_code")).distinct().orderBy("store_code")


def category_option_tuples(tables: OrderTables, cfg: CampaignConfig) -> DataFrame:
    """Distinct combinations of the four article dimensions on the selected days."""
    items = tables.for_seller(cfg).on_dates(cfg.selected_dates).item_rows(ARTICLE_DIMENSIONS)
    return items.select(*[or_unknown(F.col(c)).alias(c) for c in ARTICLE_DIMENSIONS]).distinct()


def category_options(tables: OrderTables, cfg: CampaignConfig) -> DataFrame:
    """(dimension, option): the sorted distinct values of each article dimension.

    The combinations are made distinct first, so that the unpivot multiplies few rows.
    """
    tuples = category_option_tuples(tables, cfg)
    long = tuples.select(
        F.inline(
            F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).alias("option")) for c in ARTICLE_DIMENSIONS])
        )
    )
    return long.where(F.col("option").isNotNull()).distinct().orderBy("dimension", "option")


def select_options(options: DataFrame, column: str, mode: str, chosen: Sequence[str] = ()) -> DataFrame:
    """Include / except choice as a semi or anti join of the option table with the chosen values."""
    if mode == "all":
        return options
    how = {"include": "left_semi", "except": "left_anti"}.get(mode)
    if how is None:
        raise ValueError(f"unknown selection mode {mode!r}")
    picked = local_table(options.sparkSession, {column: (pa.string(), sorted(set(chosen)))})
    return options.join(picked, column, how)


def window_days(windows: DataFrame, first: str, last: str) -> DataFrame:
    """Distinct days of all date windows. Bounds may come in either order; a window that lacks
    one has no days."""
    closed = windows.where(F.col(first).isNotNull() & F.col(last).isNotNull())
    days = F.sequence(F.least(first, last), F.greatest(first, last))
    return closed.select(F.explode(days).alias("ordered_date")).distinct()


def group_members(tables: OrderTables, cfg: CampaignConfig) -> DataFrame:
    """(grp, store_code): the listed stores of groups and, for groups of all stores or all except some, the store options
    less the excepted ones. An option without a code is in no group."""
    spark = tables.records.sparkSession
    members = cfg.listed_members(spark)
    if not cfg.open_groups:
        return members
    options = store_options(tables, cfg).where(F.col("store_code").isNotNull())
    names = list(cfg.open_groups)
    every = options.select(F.explode(F.array(*map(F.lit, names))).alias("grp"), "store_code")
    excepted = [(name, code) for name, choice in cfg.open_groups.items() for code in choice.values]
    columns = {"grp": (pa.string(), [r[0] for r in excepted]), "store_code": (pa.string(), [r[1] for r in excepted])}
    return members.unionByName(every.join(local_table(spark, columns), ["grp", "store_code"], "left_anti"))


def not_excepted(tables: OrderTables, cfg: CampaignConfig, dimension: str, label: Column, fields: Sequence[str]) -> Column:
    """Test of an except list on a label that is never null. A list that leaves no option of the selected days keeps every
    row, as an empty choice means no filter.

    Whether an option is left is a scalar subquery over the item field; nothing is collected.
    """
    kept = ~label.isin(list(cfg.category.item_excepts()[dimension]))
    items = tables.for_seller(cfg).on_dates(cfg.selected_dates).item_rows(fields)
    return kept | ~items.agg(F.coalesce(F.bool_or(kept), F.lit(False)).alias("left")).scalar()
