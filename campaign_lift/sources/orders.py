"""Orders: one record per order with repeated items, and the item rows opened from it."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from datetime import date, datetime, timedelta, timezone
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from campaign_lift.config import CampaignConfig, expand_dates
from campaign_lift.functions.columns import days_between, in_dates, pad_store_code
from campaign_lift.sources.schemas import ITEM_COLUMNS, ORDER_COLUMNS, ORDER_ITEM, ORDERS, require_columns, require_types


def seller_values(cfg: CampaignConfig) -> dict[str, Column]:
    """The order columns that the seller filter pins to one value.

    Facts are grouped without them and get them back as constants: a grouping key that cannot
    vary would only widen the rows that are hashed and shuffled.
    """
    return {
        "country": F.lit(cfg.order_country),
        "company_name_short": F.lit(cfg.order_company_name_short),
        "channel": F.lit(cfg.order_channel),
    }


def open_items(orders: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row per item with the given item fields. An order with no items stays as one row
    whose item fields are NULL.

    Exploding the item array itself makes the scan read every item field as soon as two are
    used. Here the wanted fields are taken out as arrays, zipped and opened together, so the
    scan reads these fields and no others.
    """
    wanted = F.arrays_zip(*[F.col("order_items")[name] for name in fields])
    return orders.select(*[c for c in orders.columns if c != "order_items"], F.inline_outer(wanted))


#: Partition column of orders that are laid out by UTC day.
ORDER_DAY = "order_day"

Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class OrderTables:
    """Orders at two grains: order records, and item rows with empty orders kept.

    What needs no item (store options, plain order counts) uses ``orders`` and never opens the
    items. ``flat_items`` is set for sources that hold the item rows flat already. ``steps``
    are changes on order columns, made to whichever grain is asked for.
    """

    records: DataFrame
    flat_items: DataFrame | None = None
    steps: tuple[Step, ...] = ()

    @classmethod
    def from_nested(cls, orders: DataFrame) -> OrderTables:
        require_columns(orders, [*ORDER_COLUMNS, "order_items"], "orders")
        require_types(orders, ORDERS, "orders")
        return cls(orders)

    @classmethod
    def from_rows(cls, orders: DataFrame, items: DataFrame) -> OrderTables:
        require_columns(orders, ORDER_COLUMNS, "orders")
        require_types(orders, ORDERS, "orders")
        require_columns(items, [*ORDER_COLUMNS, *[c for c in ITEM_COLUMNS if c != "item_no"]], "order items")
        require_types(items, ORDER_ITEM, "order items")
        return cls(orders, items)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> OrderTables:
        return cls.from_nested(spark.read.parquet(path))

    @cached_property
    def time_type(self) -> T.DataType:
        return self.records.schema["ordered_at"].dataType

    @property
    def day(self) -> Column:
        """The UTC day of an order; the partition column where orders are laid out by day."""
        if ORDER_DAY in self.records.columns:
            return F.col(ORDER_DAY)
        return F.to_date(utc_wall_time(F.col("ordered_at"), self.time_type))

    @property
    def orders(self) -> DataFrame:
        return self._stepped(self.records)

    def item_rows(self, fields: Sequence[str]) -> DataFrame:
        """Item rows with the order columns and the given item fields."""
        if self.flat_items is None:
            return open_items(self.orders, fields)
        others = [c for c in ITEM_COLUMNS if c not in fields]
        return self._stepped(self.flat_items).drop(*others)

    def _stepped(self, rows: DataFrame) -> DataFrame:
        for step in self.steps:
            rows = step(rows)
        return rows

    def _with(self, step: Step) -> OrderTables:
        return replace(self, steps=(*self.steps, step))

    def where(self, condition: Column) -> OrderTables:
        """Keep orders by a condition on order columns."""
        return self._with(lambda rows: rows.where(condition))

    def with_order_column(self, name: str, value: Column) -> OrderTables:
        """Add a column made of order columns."""
        return self._with(lambda rows: rows.withColumn(name, value))

    def for_seller(self, cfg: CampaignConfig) -> OrderTables:
        """Company, channel and country of the order side."""
        return self.where(
            (F.col("channel") == cfg.order_channel)
            & (F.col("company_name_short") == cfg.order_company_name_short)
            & (F.col("country") == cfg.order_country)
        )

    def on_dates(self, dates: Sequence[date]) -> OrderTables:
        """Orders of the given UTC days, with their ``ordered_date``."""
        kind = self.time_type
        day = self.day
        condition = in_dates(day, dates)
        if dates and isinstance(kind, T.TimestampType):
            start = datetime.combine(min(dates), datetime.min.time(), timezone.utc)
            end = datetime.combine(max(dates) + timedelta(days=1), datetime.min.time(), timezone.utc)
            condition = (F.col("ordered_at") >= F.lit(start)) & (F.col("ordered_at") < F.lit(end)) & condition
        return self.where(condition).with_order_column("ordered_date", day)


    def on_days_of(self, days: DataFrame, first: date, last: date) -> OrderTables:
        """Orders of the UTC days that a table ``ordered_date`` lists, with their day. The bounds of the table, which the
        caller knows, reach the scan; its days are a semi join."""
        bounded = self.on_dates(expand_dates(first, last))
        return bounded._with(lambda rows: rows.join(days_between(days, first, last), "ordered_date", "left_semi"))

    def of_stores_in(self, stores: DataFrame) -> OrderTables:
        """Orders of the stores that a table ``store_code`` lists, with their padded code."""
        coded = self.with_order_column("store_code", pad_store_code(F.col("tenant")))
        return coded._with(lambda rows: rows.join(stores, "store_code", "left_semi"))


def utc_wall_time(ordered_at: Column, kind: T.DataType) -> Column:
    """UTC wall time without zone. A zoned timestamp is converted, a zoneless one is UTC already."""
    if isinstance(kind, T.TimestampType):
        return F.convert_timezone(F.current_timezone(), F.lit("UTC"), ordered_at.cast("timestamp_ntz"))
    return ordered_at


def utc_moment(moment: datetime, kind: T.DataType) -> Column:
    """A literal of the same type as the order timestamp, so that a comparison can be pushed down."""
    if isinstance(kind, T.TimestampType):
        return F.lit(moment.replace(tzinfo=timezone.utc))
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")
