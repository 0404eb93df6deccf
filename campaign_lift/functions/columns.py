"""Column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import date, timedelta
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "UNKNOWN"
DAY_NAMES = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def pad_store_code(code: Column) -> Column:
    """At least four characters, filled with zeros on the left; longer codes stay whole."""
    text = code.cast("string")
    return F.when(F.length(text) > 4, text).otherwise(F.lpad(text, 4, "0"))


def or_unknown(value: Column) -> Column:
    return F.coalesce(value, F.lit(UNKNOWN))


def price_type(red_price: Column, red: str = "RP", black: str = "BP") -> Column:
    return F.when(red_price.isNotNull(), red).otherwise(black)


def promo_check(has_promotion: Column) -> Column:
    return F.when(has_promotion, "promo").otherwise("non-promo")


def to_number(value: Column) -> Column:
    """A double; text that is no number becomes NULL."""
    return value.try_cast("double")


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(0.0))


def pct_diff(promo: Column, baseline: Column, zero_base: float | None) -> Column:
    """Relative change. A base of 0 gives ``zero_base``; a missing side gives NULL."""
    change = F.try_divide(promo - baseline, baseline)
    if zero_base is None:
        return change
    return F.when(baseline == 0, F.lit(float(zero_base))).otherwise(change)


def sum_where(condition: Column, value: Column) -> Column:
    """Sum over the rows that meet the condition; NULL when there is nothing to add."""
    return F.sum(F.when(condition, value))


def micros(value: Column) -> Column:
    """An amount as a whole number of millionths, of any numeric source type; what is no number becomes NULL.

    Sums of whole numbers do not depend on the order in which partial sums meet, so a retried task cannot move a total
    over a half cent. A total of more than nine million millions fails instead of wrapping.
    """
    return F.rint(value.cast("double") * 1e6).try_cast("bigint")


def cents(total: Column) -> Column:
    """A total of millionths as an amount, rounded to cents in whole numbers: exact halves go away from zero."""
    whole = F.call_function("div", F.abs(total) + 5_000, F.lit(10_000)).cast("double")
    return F.when(total < 0, F.lit(0.0) - whole).otherwise(whole) / 100.0


def is_sunday(day: Column) -> Column:
    return F.dayofweek(day) == 1


def day_name(day: Column) -> Column:
    return F.date_format(day, "EEEE")


def monday_first(weekday: Column) -> Column:
    """0 for Monday to 6 for Sunday, from the English day name."""
    return F.array_position(F.array(*[F.lit(name) for name in DAY_NAMES]), weekday).cast("int") - 1


def date_runs(dates: Iterable[date]) -> list[tuple[date, date]]:
    """The dates as gapless runs (first day, last day)."""
    runs: list[tuple[date, date]] = []
    for day in sorted(set(dates)):
        if runs and day - runs[-1][1] == timedelta(days=1):
            runs[-1] = (runs[-1][0], day)
        else:
            runs.append((day, day))
    return runs


def in_dates(day: Column, dates: Iterable[date]) -> Column:
    """Date membership as range comparisons.

    The optimizer turns a comparison of a date, or of the date of a timestamp, into a pushed
    range; an IN list on a timestamp's date would not reach the scan. The outer bounds are
    spelled out for scans that take single comparisons only.
    """
    runs = date_runs(dates)
    if not runs:
        return F.lit(False)
    bounds = (day >= F.lit(runs[0][0])) & (day <= F.lit(runs[-1][1]))
    if len(runs) == 1:
        return bounds
    return bounds & reduce(or_, [(day >= F.lit(first)) & (day <= F.lit(last)) for first, last in runs])


#: Days of a calendar that are broadcast: a century of them takes a few hundred kilobytes.
MOST_DAYS = 36_600


def days_between(days: DataFrame, first: date, last: date) -> DataFrame:
    """A table of distinct days, marked for broadcast where its bounds prove it small. A scan that is laid out by day is then
    pruned to these days while it runs, also where the planner does not know the size of the table."""
    return F.broadcast(days) if (last - first).days < MOST_DAYS else days


def in_values(value: Column, values: Sequence[str]) -> Column | None:
    """Value-list test, or None when the list is empty (no filter)."""
    return value.isin(list(values)) if values else None
