"""Campaigns as tables: settings, groups, members, period windows and pairs of any number of campaigns."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import date
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from campaign_lift.config import BASELINE, PERIODS, PROMO, CampaignConfig, local_table
from campaign_lift.functions.columns import date_runs, pad_store_code
from campaign_lift.sources.schemas import require_columns

TABLES = {
    "campaigns": ("campaign", "vat", "baseline_coefficient", "promo_mechanism", "include_sunday"),
    "groups": ("campaign", "grp"),
    "members": ("campaign", "grp", "store_code"),
    "windows": ("campaign", "period", "first_day", "last_day"),
    "pairs": ("campaign", "control_group", "testing_group"),
}


@dataclass(frozen=True)
class CampaignTables:
    """Columns as in TABLES. A window has its first and last day in either order; one that lacks a day has no days, and
    windows of a period may overlap. Groups need no members. Repeated rows count once."""

    campaigns: DataFrame
    groups: DataFrame
    members: DataFrame
    windows: DataFrame
    pairs: DataFrame

    def __post_init__(self):
        for name, columns in TABLES.items():
            require_columns(getattr(self, name), columns, name)

    @classmethod
    def of_configs(cls, spark: SparkSession, configs: Mapping[str, CampaignConfig], include_sunday: bool = False) -> CampaignTables:
        """The tables of campaigns that are written down as settings."""
        opened = sorted(name for name, c in configs.items() if c.open_groups)
        if opened:
            raise ValueError(f"give the members of {opened} as a table: the data decide about them")
        text, day = pa.string(), pa.date32()
        kinds = {"vat": pa.float64(), "baseline_coefficient": pa.float64(), "include_sunday": pa.bool_(), "first_day": day, "last_day": day}
        windows = [
            (name, period, *run)
            for name, c in configs.items()
            for period, days in ((BASELINE, c.baseline_dates), (PROMO, c.promo_dates))
            for run in date_runs(days)
        ]
        rows = {
            "campaigns": [(n, c.vat, c.baseline_coefficient, c.promo_mechanism, include_sunday) for n, c in configs.items()],
            "groups": [(n, g) for n, c in configs.items() for g in c.groups],
            "members": [(n, g, code) for n, c in configs.items() for g, codes in c.groups.items() for code in codes],
            "windows": windows,
            "pairs": [(n, *pair) for n, c in configs.items() for pair in c.pairs],
        }
        made = {
            name: local_table(spark, {c: (kinds.get(c, text), [r[i] for r in rows[name]]) for i, c in enumerate(columns)})
            for name, columns in TABLES.items()
        }
        return cls(**made)

    @property
    def roles(self) -> DataFrame:
        """(campaign, control_group, testing_group, role, grp): two rows for each pair."""
        sides = F.array(*[F.struct(F.lit(r).alias("role"), F.col(f"{r}_group").alias("grp")) for r in ("control", "testing")])
        pair = TABLES["pairs"]
        return self.pairs.select(*pair).distinct().select(*pair, F.inline(sides))

    @property
    def closed_windows(self) -> DataFrame:
        rows = self.windows.where(F.col("first_day").isNotNull() & F.col("last_day").isNotNull() & F.col("period").isin(*PERIODS))
        return rows.select("campaign", "period", F.least("first_day", "last_day").alias("first_day"), F.greatest("first_day", "last_day").alias("last_day"))

    @property
    def segments(self) -> DataFrame:
        """(campaign, first_day, last_day, in_baseline, in_promo): disjoint stretches of days on which a campaign is in the
        same periods, by a sweep over the days on which windows begin and end. A campaign has no more such days than the
        calendar, whatever the number of its windows."""
        changes = F.array(
            F.struct(F.col("first_day").alias("day"), F.lit(1).alias("step")),
            F.struct(F.date_add("last_day", 1).alias("day"), F.lit(-1).alias("step")),
        )
        opened = self.closed_windows.select("campaign", "period", F.inline(changes))
        steps = opened.groupBy("campaign", "day").agg(
            *[F.sum(F.when(F.col("period") == p, F.col("step")).otherwise(0)).alias(p) for p in PERIODS]
        )
        sweep = Window.partitionBy("campaign").orderBy("day")
        swept = steps.select(
            "campaign",
            F.col("day").alias("first_day"),
            F.date_sub(F.lead("day").over(sweep), 1).alias("last_day"),
            (F.sum(BASELINE).over(sweep) > 0).alias("in_baseline"),
            (F.sum(PROMO).over(sweep) > 0).alias("in_promo"),
        )
        return swept.where(F.col("in_baseline") | F.col("in_promo"))

    @property
    def days(self) -> DataFrame:
        """The distinct days of all windows."""
        return self.closed_windows.select(F.explode(F.sequence("first_day", "last_day")).alias("ordered_date")).distinct()

    @cached_property
    def bounds(self) -> tuple[date, date] | None:
        """First and last day of all windows, read at once: two values that reach the scans as literals."""
        row = self.closed_windows.agg(F.min("first_day"), F.max("last_day")).first()
        return None if row is None or row[0] is None else (row[0], row[1])

    @property
    def stores(self) -> DataFrame:
        """The padded codes of all members."""
        return self.members.select(pad_store_code(F.col("store_code")).alias("store_code")).where("store_code <> ''").distinct()

    @property
    def texts_of_dates(self) -> DataFrame:
        """(campaign, baseline_dates, promo_dates): the days of both periods as text, at most the calendar for each."""
        opened = self.segments.select("*", F.explode(F.sequence("first_day", "last_day")).alias("day"))
        listed = [
            F.array_join(F.sort_array(F.collect_set(F.when(F.col(f"in_{p}"), F.col("day").cast("string")))), ", ").alias(f"{p}_dates")
            for p in ("baseline", "promo")
        ]
        return opened.groupBy("campaign").agg(*listed)
