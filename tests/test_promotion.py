from datetime import date, datetime

from campaign_lift.operators.promotion import promotion_summary
from tests.conftest import as_dicts, config, item, order, order_tables, plan_text

START, END = date(2024, 3, 29), date(2024, 4, 1)


def promoted(*ids, **other):
    return item(has_promotion=True, promotions=[{"promotion_id": i} for i in ids], **other)


def summary(spark, rows, **rules):
    return promotion_summary(order_tables(spark, rows), config(), "P1", START, END, **rules)


def test_flags_measures_and_ratios(spark):
    noon = datetime(2024, 3, 29, 12)
    rows = [
        order(1, noon, items=[promoted("P2", "P1", revenue=11.9, pc1=5.0, quantity=2.0, discount=3.0, red=4.0), item(revenue=7.0)]),
        order(2, noon, items=[promoted("P1", revenue=11.9, pc1=2.0, red=4.0, green=1.0)]),
        order(3, noon, items=[item(revenue=1.0, promotions=None), item(revenue=2.0, promotions=[{"promotion_id": None}])]),
        order(4, noon, items=[]),
        order(5, noon, items=[promoted("P1", revenue=1.0)], channel="ONLINE"),
    ]
    got = {(r["item_has_specific_promotion_id"], r["price"]): r for r in as_dicts(summary(spark, rows))}
    assert set(got) == {("Yes", "red-price"), ("No", "black-price")}
    yes, no = got["Yes", "red-price"], got["No", "black-price"]
    assert (yes["count_orders"], yes["revenue"], yes["items"], yes["promotion_discount_eur"]) == (2, 23.8, 3.0, 3.0)
    assert yes["revenue_red_price"] == 11.9 and yes["AOR"] == 11.9 and yes["PC1_margin"] == 0.35
    assert no["count_orders"] == 3 and no["revenue"] == 10.0 and no["revenue_red_price"] is None
    assert yes["order_week"] == "2024-03-25" and yes["day_of_week"] == "Friday"


def test_days_are_berlin_days_across_the_clock_change(spark):
    rows = [
        order(1, datetime(2024, 3, 30, 23, 30), items=[item()]),  # 00:30 on Sunday, winter time
        order(2, datetime(2024, 3, 31, 21, 30), items=[item()]),  # 23:30 on Sunday, summer time
        order(3, datetime(2024, 3, 31, 22, 30), items=[item()]),  # 00:30 on Monday
    ]
    got = summary(spark, rows, end_inclusive=True).collect()
    assert [(r["order_week"], r["order_date"], r["day_of_week"], r["count_orders"]) for r in got] == [
        ("2024-04-01", date(2024, 4, 1), "Monday", 1),
        ("2024-03-25", date(2024, 3, 31), "Sunday", 2),
    ]


def test_end_day_is_out_except_midnight(spark):
    rows = [order(1, datetime(2024, 4, 1), items=[item()]), order(2, datetime(2024, 4, 1, 0, 0, 1), items=[item()])]
    assert [r["count_orders"] for r in as_dicts(summary(spark, rows))] == [1]
    assert [r["count_orders"] for r in as_dicts(summary(spark, rows, end_inclusive=True))] == [2]


def test_range_is_pushed_for_zoned_timestamps(spark, tmp_path):
    from pyspark.sql import functions as F

    from campaign_lift.sources.orders import OrderTables

    path = str(tmp_path / "orders")
    rows = order_tables(spark, [order(1, datetime(2024, 3, 30, 23, 30), items=[item()])]).orders
    rows.withColumn("ordered_at", F.col("ordered_at").cast("timestamp")).write.parquet(path)
    got = promotion_summary(OrderTables.read(spark, path), config(), "P1", START, END)
    assert [r["order_date"] for r in got.collect()] == [date(2024, 3, 31)]
    assert "GreaterThanOrEqual(ordered_at,2024-03-29" in plan_text(got)
