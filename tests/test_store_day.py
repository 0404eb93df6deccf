from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from campaign_lift.operators import category
from campaign_lift.operators import store_day as sd
from campaign_lift.operators.subsets import group_period_subset, store_subset_export
from campaign_lift.plans.campaign import Campaign
from campaign_lift.sources.orders import OrderTables
from campaign_lift.sources.schemas import ITEM_COLUMNS, ORDERS, REVENUE
from tests.conftest import as_dicts, config, item, order, order_tables, traffic_frame, visit

D1, D2 = date(2024, 1, 1), date(2024, 1, 2)
NOON = datetime(2024, 1, 1, 12)


def test_traffic_rates_and_missing_counters(spark):
    rows = [
        visit(D1, 1, 100, 30, 5),
        visit(D1, 1, 0, 10, 1),
        visit(D1, 1, None, 8, None),
        visit(D1, 2, None, 4, 2),
        visit(D2, 2, 0, 0, 3),
        visit(D1, 3, 1, 1, 1, business_unit="NOVA AT"),
        visit(date(2024, 1, 3), 1, 1, 1, 1),
    ]
    got = as_dicts(sd.traffic_store_day(traffic_frame(spark, rows), config()), "ordered_date", "store_code")
    assert [(r["store_code"], r["pedestrian_footfall"], r["incoming_visitors"], r["orders"]) for r in got] == [
        ("0001", 100, 48, 6),
        ("0002", None, 4, 2),
        ("0002", 0, 0, 3),
    ]
    assert [r["store_absorption_rate"] for r in got] == [0.3, None, None]
    assert [r["store_conversion_rate"] for r in got] == [6 / 48, 0.5, None]


def test_order_measures(spark):
    tables = order_tables(
        spark,
        [
            order(
                1,
                NOON,
                insider="EXISTING",
                items=[
                    item(revenue=10.006, quantity=2.0, pc1=1.0, black=8.0, red=6.0, cost=3.0, discount=1.0, has_promotion=True),
                    item(revenue=5.0, quantity=1.0, pc1=2.0, black=5.0, cost=2.0, has_promotion=None),
                ],
            ),
            order(2, NOON, items=[]),
            order(3, NOON, insider="NEW", items=[item(revenue=1.0, quantity=0.0, pc1=-1.0, black=9.0, cost=1.0)]),
        ],
    )
    (row,) = as_dicts(sd.order_store_day(tables, config()))
    assert row["store_code"] == "0001"
    want = {
        "total_revenue": 16.01,
        "total_RP_revenue": 10.01,
        "total_promo_revenue": 10.01,
        "total_existing_revenue": 15.01,
        "total_quantity": 3.0,
        "total_RP_quantity": 2.0,
        "total_PC1": 2.0,
        "total_existing_PC1": 3.0,
        "total_full_price_revenue": 21.0,
        "total_cost": 8.0,
        "total_RP_discount_euro": 4.0,
        "total_promo_discount_euro": 2.0,
    }
    assert {k: row[k] for k in want} == want


def test_store_with_only_empty_orders(spark):
    (row,) = as_dicts(sd.order_store_day(order_tables(spark, [order(1, NOON, items=[])]), config()))
    assert row["total_revenue"] == 0.0 and row["total_full_price_revenue"] is None


def test_left_join_keeps_traffic_and_loses_unmatched_orders(spark):
    traffic = traffic_frame(spark, [visit(D1, 1, 10, 5, 1), visit(D1, 2, 10, 5, 1), visit(D1, 3, 10, 5, 1, store_name="renamed")])
    tables = order_tables(spark, [order(n, NOON, n, [item(revenue=7.0)]) for n in (1, 3, 4)])
    got = as_dicts(sd.store_day_raw(traffic, tables, config()), "store_code")
    assert [(r["store_code"], r["channel"], r["total_revenue"]) for r in got] == [
        ("0001", "STATIONARY", 7.0),
        ("0002", None, None),
        ("0003", None, None),
    ]
    assert list(got[0]) == list(sd.STORE_DAY_COLUMNS)


def test_country_mismatch_empties_order_measures(spark):
    traffic = traffic_frame(spark, [visit(D1, 1, 10, 5, 1)])
    tables = order_tables(spark, [order(1, NOON, 1, [item(revenue=7.0)], country="AT")])
    (row,) = as_dicts(sd.store_day_raw(traffic, tables, config(order_country="AT")))
    assert row["total_revenue"] is None


def test_coefficient_scales_baseline_dates_only(spark):
    days = [D1, date(2024, 1, 6)]
    traffic = traffic_frame(spark, [visit(d, 1, 10, 5, 1) for d in days])
    tables = order_tables(spark, [order(d.day, datetime(d.year, d.month, d.day), 1, [item(revenue=7.0)]) for d in days])
    base, promo = as_dicts(sd.store_day(traffic, tables, config(baseline_coefficient=2.0)), "ordered_date")
    assert (base["pedestrian_footfall"], base["orders"], base["total_revenue"]) == (20.0, 2.0, 14.0)
    assert (promo["pedestrian_footfall"], promo["total_revenue"]) == (10.0, 7.0)
    assert base["store_conversion_rate"] == promo["store_conversion_rate"] == 0.2
    # A date in both periods is scaled for both.
    (both,) = as_dicts(sd.store_day(traffic, tables, config(baseline_coefficient=2.0, baseline_dates=[D1], promo_dates=[D1])))
    assert both["total_revenue"] == 14.0


def test_coefficient_one_changes_nothing(spark):
    traffic, tables = traffic_frame(spark, [visit(D1, 1, 10, 5, 1)]), order_tables(spark, [order(1, NOON, 1, [item(revenue=7.0)])])
    raw = sd.store_day_raw(traffic, tables, config())
    assert sd.store_day(traffic, tables, config()).schema == raw.schema


def test_subset_repeats_shared_stores_and_shared_dates(spark):
    cfg = config(baseline_dates=[D1, D1], promo_dates=[D1, D2], groups={"Group 1": ["1", "0001"], "Group 2": ["1", "2"], "Group 3": ["2"]})
    facts = sd.traffic_store_day(traffic_frame(spark, [visit(D1, 1, 1, 1, 1), visit(D2, 9, 1, 1, 1)]), cfg)
    got = as_dicts(group_period_subset(facts, cfg), "grp", "period")
    assert [(r["grp"], r["period"]) for r in got] == [
        ("Group 1", "Baseline Period"),
        ("Group 1", "Promo Period"),
        ("Group 2", "Baseline Period"),
        ("Group 2", "Promo Period"),
    ]


def test_export_order_and_weekday(spark):
    cfg = config()
    traffic = traffic_frame(spark, [visit(D2, 2, 1, 1, 1), visit(D1, 2, 1, 1, 1), visit(D1, 1, 1, 1, 1), visit(date(2024, 1, 7), 1, 1, 1, 1)])
    rows = store_subset_export(sd.traffic_store_day(traffic, cfg), cfg).collect()
    keys = [(r["group"], r["period"], r["ordered_date"], r["store_code"]) for r in rows]
    assert keys == sorted(keys) and len(keys) == 8
    assert {r["weekday"] for r in rows} == {"Monday", "Tuesday", "Sunday"}


@pytest.mark.parametrize("code", [7, 10007])
def test_codes_are_padded_and_stay_whole(spark, code):
    rows = as_dicts(sd.traffic_store_day(traffic_frame(spark, [visit(D1, code, 1, 1, 1)]), config()))
    assert rows[0]["store_code"] == str(code).zfill(4)


def test_long_store_codes_stay_apart(spark):
    """Codes 12345 and 12346 are two stores, also in two groups."""
    cfg = config(groups={"Group 1": ["12345"], "Group 3": ["12346"]})
    rows = [visit(date(2024, 1, 1), code, 10, 5, 1) for code in (12345, 12346)]
    orders = [order(code, datetime(2024, 1, 1), code, [item(revenue=float(code))]) for code in (12345, 12346)]
    run = Campaign(traffic_frame(spark, rows), order_tables(spark, orders), cfg)
    found = {(r["grp"], r["baseline_value"]) for r in run.store_funnel.where("kpi = 'total revenue'").collect()}
    assert found == {("Group 1", 12345.0), ("Group 3", 12346.0)}


def test_sums_do_not_depend_on_the_order_of_partial_sums(spark):
    # sums of doubles over such amounts differ in the last places, and the totals lie on half cents
    amounts = [0.1, 0.7, 1e9 + 0.005, 3.3, -1e9, 0.125, 2.2, 1e-3] * 40
    orders = [order(i, NOON, 1, [item(revenue=x, pc1=x / 2, quantity=3.0, black=19.99, cost=x)]) for i, x in enumerate(amounts)]
    frame = spark.createDataFrame(orders, ORDERS)
    results = set()
    for parts in (1, 2, 3, 7, 16):
        tables = OrderTables.from_nested(frame.repartition(parts, F.rand(parts)))
        results.add(str(as_dicts(sd.order_store_day(tables, config()))) + str(as_dicts(category.category_raw(tables, config()))))
    assert len(results) == 1
    row = as_dicts(sd.order_store_day(OrderTables.from_nested(frame), config()))[0]
    assert row["total_revenue"] == round(40 * (0.1 + 0.7 + 0.005 + 3.3 + 0.125 + 2.2 + 0.001), 2)
    assert row["total_full_price_revenue"] == round(320 * 19.99 * 3, 2)


@pytest.mark.parametrize("total, cents", [(0.125, 0.13), (0.375, 0.38), (-0.125, -0.13), (2.675, 2.68), (1.005, 1.01), (0.1249, 0.12)])
def test_halves_of_a_cent_go_away_from_zero(spark, total, cents):
    tables = order_tables(spark, [order(1, NOON, 1, [item(revenue=total - 5), item(revenue=5.0)])])
    assert as_dicts(sd.order_store_day(tables, config()))[0]["total_revenue"] == cents
    assert sum(r["total_revenue"] for r in as_dicts(category.category_raw(tables, config()))) == cents


def test_decimal_amounts_are_added_exactly(spark):
    rows = spark.createDataFrame([order(i, NOON, 1, [item(revenue=0.005, black=1.1, quantity=2.0)]) for i in range(3)], ORDERS)
    items = "transform(order_items, i -> named_struct(%s)) AS order_items"
    money = {REVENUE, "article_price_black_eur", "article_price_red_eur", "article_cost_eur", "promotion_discount_eur"}
    fields = ", ".join(f"'{c}', {f'CAST(i.{c} AS DECIMAL(12,3))' if c in money else f'i.{c}'}" for c in ITEM_COLUMNS)
    decimal = rows.selectExpr(*[c for c in rows.columns if c != "order_items"], items % fields)
    tables = OrderTables.from_nested(decimal)
    row = as_dicts(sd.order_store_day(tables, config()))[0]
    assert row["total_revenue"] == 0.02 and row["total_full_price_revenue"] == 6.6  # 0.015 is a tie
    assert as_dicts(category.category_raw(tables, config()))[0]["total_revenue"] == 0.02


def test_amounts_that_are_no_numbers_are_left_out(spark):
    tables = order_tables(spark, [order(1, NOON, 1, [item(revenue=float("nan")), item(revenue=float("inf")), item(revenue=2.0)])])
    assert as_dicts(sd.order_store_day(tables, config()))[0]["total_revenue"] == 2.0
