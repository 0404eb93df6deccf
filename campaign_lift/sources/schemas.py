"""Declared shapes of the two source tables. They are checked once, when a table is opened."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

TRAFFIC = T.StructType(
    [
        T.StructField("visited_on", T.DateType(), False),
        T.StructField("country", T.StringType(), False),
        T.StructField("business_unit", T.StringType(), False),
        T.StructField("store_code", T.IntegerType(), False),
        T.StructField("store_name", T.StringType(), False),
        T.StructField("pedestrian_footfall", T.LongType(), True),
        T.StructField("incoming_visitors", T.LongType(), True),
        T.StructField("orders", T.LongType(), True),
    ]
)

PROMOTION = T.StructType([T.StructField("promotion_id", T.StringType(), True)])

# Measure column names of the item record.
QUANTITY = "quantity_ordered_after_cancellations_and_returns_incl_forecast"
REVENUE = "revenue_after_cancellations_and_returns_eur_incl_forecast"
PC1 = "profit_contribution_1_eur_incl_forecast"

ORDER_ITEM = T.StructType(
    [
        T.StructField("item_no", T.IntegerType(), True),
        T.StructField("article_price_black_eur", T.DoubleType(), True),
        T.StructField("article_price_red_eur", T.DoubleType(), True),
        T.StructField("article_price_green_eur", T.DoubleType(), True),
        T.StructField("article_cost_eur", T.DoubleType(), True),
        T.StructField("promotion_discount_eur", T.DoubleType(), True),
        T.StructField(QUANTITY, T.DoubleType(), True),
        T.StructField(REVENUE, T.DoubleType(), True),
        T.StructField(PC1, T.DoubleType(), True),
        T.StructField("has_promotion", T.BooleanType(), True),
        T.StructField("promotions", T.ArrayType(PROMOTION), True),
        T.StructField("article_section_group", T.StringType(), True),
        T.StructField("article_section", T.StringType(), True),
        T.StructField("article_season", T.StringType(), True),
        T.StructField("article_brand_group", T.StringType(), True),
    ]
)

ORDERS = T.StructType(
    [
        T.StructField("order_id", T.StringType(), False),
        T.StructField("ordered_at", T.TimestampNTZType(), False),
        T.StructField("company_name_short", T.StringType(), False),
        T.StructField("channel", T.StringType(), False),
        T.StructField("country", T.StringType(), False),
        T.StructField("tenant", T.IntegerType(), True),
        T.StructField("store_name", T.StringType(), False),
        T.StructField("insider_customer_type", T.StringType(), True),
        T.StructField("order_items", T.ArrayType(ORDER_ITEM), True),
    ]
)

ORDER_COLUMNS = tuple(f.name for f in ORDERS if f.name != "order_items")
ITEM_COLUMNS = ORDER_ITEM.fieldNames()


def _fits(have: T.DataType, want: T.DataType) -> bool:
    if isinstance(want, T.ArrayType):
        return isinstance(have, T.ArrayType) and _fits(have.elementType, want.elementType)
    if isinstance(want, T.StructType):
        return isinstance(have, T.StructType) and all(_fits(have[f.name].dataType, f.dataType) for f in want if f.name in have.names)
    if isinstance(want, T.IntegerType):  # numbers of stores and items
        return isinstance(have, T.IntegralType | T.StringType)
    if isinstance(want, T.NumericType):
        return isinstance(have, T.NumericType)
    if isinstance(want, T.TimestampNTZType):
        return isinstance(have, T.TimestampNTZType | T.TimestampType)
    if isinstance(want, T.DateType):
        return isinstance(have, T.DateType | T.TimestampNTZType | T.TimestampType)
    return isinstance(have, type(want))


def require_types(table: DataFrame, wanted: T.StructType, what: str) -> None:
    """Refuse a table whose columns have other kinds of types. Any number serves as an amount, DECIMAL included."""
    wrong = [f.name for f in wanted if f.name in table.columns and not _fits(table.schema[f.name].dataType, f.dataType)]
    if wrong:
        raise ValueError(f"{what} has columns of wrong types: {[(n, table.schema[n].dataType.simpleString()) for n in wrong]}")


def require_columns(table: DataFrame, names: Sequence[str], what: str) -> None:
    missing = [name for name in names if name not in table.columns]
    if missing:
        raise ValueError(f"{what} lacks columns {missing}")
