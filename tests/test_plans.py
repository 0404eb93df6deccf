"""What the physical plans must and must not hold."""

import pytest

from __spark_entry__ import queries
from campaign_lift.sources import by_day
from campaign_lift.sources.orders import ORDER_DAY, OrderTables
from campaign_lift.sources.sample_tables import sample_nested_orders
from tests.conftest import plan_text

FOLDER = "/root/testdata/sf0.001"


def test_dates_and_columns_are_pushed_to_the_traffic_scan(spark):
    plan = plan_text(queries()["traffic_store_day"](spark, FOLDER))
    assert "GreaterThanOrEqual(ts,2024-01-01T00:00)" in plan and "LessThan(ts,2024-01-29T00:00)" in plan
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in plan


def test_order_filters_sit_below_the_join(spark):
    plan = plan_text(queries()["order_store_day"](spark, FOLDER))
    scan = next(part for part in plan.split("\n") if "FileScan" in part and "o_custkey" in part)
    assert "o_orderpriority" in scan and "5-LOW" in scan.split("DataFilters")[1]


def test_one_measure_bridges_read_one_measure(spark):
    plan = plan_text(queries()["bridge_rp_quantity"](spark, FOLDER))
    assert "l_quantity" in plan and "l_tax" not in plan  # the tax column is read for revenue only


def test_counts_do_not_shuffle_items(spark):
    plan = plan_text(queries()["category_raw"](spark, FOLDER))
    assert plan.count("partial_count(distinct") >= 1
    items = [line for line in plan.split("\n") if "FileScan" in line and "l_extendedprice" in line]
    assert len(items) == 1


def scans(plan: str, column: str) -> int:
    return sum("FileScan" in line and column in line for line in plan.split("\n"))


@pytest.mark.parametrize("name", ["store_funnel", "store_funnel_both", "store_promo_impact", "ab_winner", "driver_summary", "report_payload"])
def test_traffic_is_scanned_once_for_sums_and_presence(spark, name):
    plan = plan_text(queries()[name](spark, FOLDER))
    assert scans(plan, "event_type") == 1 and "NestedLoop" not in plan


def test_one_read_of_the_items_feeds_sums_and_order_counts(spark):
    plan = plan_text(queries()["category_raw_filtered"](spark, FOLDER))
    assert scans(plan, "l_extendedprice") == 1 and "Expand" in plan


def test_nested_records_travel_once_before_their_prices_are_made(spark, tmp_path):
    frame = sample_nested_orders(spark, FOLDER)
    plan = plan_text(frame)
    exchanges = [line for line in plan.split("\n") if "Exchange hashpartitioning(" in line]
    assert sum("day_no" in line for line in exchanges) == 1 and not any("order_id" in line for line in exchanges)
    dealt = plan[plan.index("Exchange hashpartitioning(day_no") :].split("\n")
    assert "PROMO_B" not in "".join(dealt[1:]) and "PROMO_B" in plan
    by_day.write_orders_by_day(OrderTables.from_nested(frame), str(tmp_path / "orders"), dealt=True)
    written = by_day.read_orders_by_day(spark, str(tmp_path / "orders")).records.drop(ORDER_DAY)
    assert written.count() == frame.count() and written.exceptAll(frame.select(written.columns)).isEmpty()
