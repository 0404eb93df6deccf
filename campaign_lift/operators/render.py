"""Output files as frames of lines: what is checked as rows is what is written."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Quotes only where needed and doubled inside; nothing for a missing value; white space stays.
CSV_OPTIONS = {
    "escape": '"', "nullValue": "", "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}


def plain_number(value: Column) -> Column:
    """A double in plain digits, as short as tells it apart from others, without exponent; whole ones end in ".0"."""
    digits = F.rtrim(value.try_cast("decimal(38,20)").cast("string"), F.lit("0"))
    short = F.when(F.endswith(digits, F.lit(".")), F.concat(digits, F.lit("0"))).otherwise(digits)
    return F.coalesce(short, value.cast("string"))  # what has more than 18 digits before the point keeps its exponent


def field_text(field: T.StructField) -> Column:
    value = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.DoubleType | T.FloatType):
        return plain_number(value)
    return value.cast("string")


def csv_lines(rows: DataFrame, order: Sequence[str], sep: str = ",") -> DataFrame:
    """(is_row, order columns, line) in file order: a header line, then the rows.

    The order is a global sort: rows are dealt out by ranges of the order columns and sorted within, so the parts of the
    written file, one after the other, are the file.
    """
    options = CSV_OPTIONS | {"sep": sep}
    keys = [F.col(f"`{c}`") for c in order]
    texts = F.struct(*[field_text(f).alias(f.name) for f in rows.schema])
    body = rows.select(F.lit(1).alias("is_row"), *keys, F.to_csv(texts, options).alias("line"))
    names = F.to_csv(F.struct(*[F.lit(c).alias(f"c{i}") for i, c in enumerate(rows.columns)]), options)
    empty = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in order]
    header = rows.sparkSession.range(1).select(F.lit(0).alias("is_row"), *empty, names.alias("line"))
    return header.unionByName(body).orderBy("is_row", *keys)


def text_lines(texts: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """(keys, line_no, line): the lines of one text for each key, in order."""
    lines = F.posexplode(F.split(F.col(text), "\n")).alias("at", "line")
    numbered = texts.select(*keys, lines).select(*keys, (F.col("at") + 1).alias("line_no"), "line")
    return numbered.orderBy(*keys, "line_no")
