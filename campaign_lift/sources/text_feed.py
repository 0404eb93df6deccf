"""Traffic that arrives as text: coerced columns, and what was rejected next to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from campaign_lift.sources.schemas import TRAFFIC, require_columns

REJECTS = "rejects"


def _coerced(text: Column, kind: T.DataType) -> Column:
    """The value of a text, or NULL if it has none of that type. White space around it does not matter; a whole number may be
    written with a point or an exponent, but must be whole."""
    if isinstance(kind, T.DateType):
        return text.try_cast("date")
    if isinstance(kind, T.IntegralType):
        number = text.try_cast("double")
        return F.when(number == F.floor(number), number).try_cast(kind)
    return text.try_cast(kind)


def typed(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of a schema, coerced from text where they are text, and ``rejects``: an array of (column, value) for each
    text that is neither empty nor a value of its type. A rejected value is NULL in its column."""
    require_columns(rows, schema.fieldNames(), "feed")
    values, rejects = [], []
    for field in schema:
        raw = F.col(f"`{field.name}`")
        if not isinstance(rows.schema[field.name].dataType, T.StringType) or isinstance(field.dataType, T.StringType):
            values.append(raw.alias(field.name))
            continue
        text = F.trim(raw)
        value = _coerced(text, field.dataType)
        values.append(value.alias(field.name))
        rejects.append(F.when((text != "") & value.isNull(), F.struct(F.lit(field.name).alias("column"), raw.alias("value"))))
    kept = F.array_compact(F.array(*rejects)) if rejects else F.array().cast("array<struct<column:string,value:string>>")
    return rows.select(*values, kept.alias(REJECTS))


def counted(feed: DataFrame, observation: Observation) -> DataFrame:
    """The feed, with counters of the next action over it: rows, rejected_rows, and rejected values of each column. They are
    counted while the rows pass, in no scan of their own."""

    def rejected_in(name: str) -> Column:
        hit = F.array_contains(F.col(REJECTS)["column"], name)
        return F.count(F.when(hit, 1))  # a row rejects no more than one value of a column

    return feed.observe(
        observation,
        F.count(F.lit(1)).alias("rows"),
        F.count(F.when(F.size(REJECTS) > 0, 1)).alias("rejected_rows"),
        *[rejected_in(name).alias(f"rejected_{name}") for name in TRAFFIC.fieldNames() if name in feed.columns],
    )


def typed_traffic(rows: DataFrame, observation: Observation | None = None) -> DataFrame:
    """Traffic from text columns. Rows without a day are of no period and drop out of every fact."""
    feed = typed(rows, TRAFFIC)
    return feed if observation is None else counted(feed, observation)


def rejected(feed: DataFrame) -> DataFrame:
    """(column, value, n): every rejected value and how often it came."""
    return feed.select(F.inline(REJECTS)).groupBy("column", "value").agg(F.count("*").alias("n"))
