"""Tables laid out by day are opened for wanted days only; text feeds keep what they reject."""

from datetime import date, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from campaign_lift.config import BASELINE, PROMO
from campaign_lift.operators import store_day
from campaign_lift.plans.campaign import Campaign
from campaign_lift.plans.campaigns import Campaigns
from campaign_lift.sources import by_day, text_feed
from campaign_lift.sources.campaign_tables import CampaignTables
from campaign_lift.sources.orders import OrderTables
from campaign_lift.sources.schemas import ORDERS, TRAFFIC
from tests.conftest import as_dicts, config, item, order, order_tables, plan_text, traffic_frame, visit

START = date(2024, 1, 1)


def day(n: int) -> date:
    return START + timedelta(days=n)


@pytest.fixture(scope="module")
def sources(spark):
    traffic = traffic_frame(spark, [visit(day(n), s, 10 + n, 5, 1) for n in range(20) for s in (1, 2)])
    orders = [
        order(100 * n + s, datetime(2024, 1, 1, 23) + timedelta(days=n), s, [item(revenue=1.5 * n), item(revenue=2.0)]) for n in range(20) for s in (1, 2)
    ]
    return traffic, order_tables(spark, orders)


def laid_out(spark, sources, folder: Path):
    """The sources by day, with every file of a day after the eighth made unreadable."""
    by_day.write_traffic_by_day(sources[0], f"{folder}/traffic")
    by_day.write_orders_by_day(sources[1], f"{folder}/orders")
    tables = by_day.read_traffic_by_day(spark, f"{folder}/traffic"), by_day.read_orders_by_day(spark, f"{folder}/orders")
    broken = 0
    for path in folder.glob("*/*=*/*.parquet"):
        if date.fromisoformat(path.parent.name.split("=")[1]) > day(7):
            path.write_bytes(b"no parquet")
            (path.parent / f".{path.name}.crc").unlink(missing_ok=True)
            broken += 1
    assert broken >= 24
    return tables


def test_days_of_the_settings_prune_folders(spark, sources, tmp_path):
    traffic, orders = laid_out(spark, sources, tmp_path)
    cfg = config(baseline_dates=[day(0), day(1)], promo_dates=[day(6)])
    run = Campaign(traffic, orders, cfg)
    plan = plan_text(run.store_funnel)
    for column in ("visited_on", "order_day"):
        assert f"PartitionFilters: [isnotnull({column}" in plan and f"({column}#" in plan.split(f"[isnotnull({column}")[1][:200]
    want = Campaign(*sources, cfg)
    for build in (lambda c: c.store_funnel, lambda c: c.category_funnel, lambda c: c.category_options()):
        assert sorted(map(str, build(run).collect())) == sorted(map(str, build(want).collect()))


def test_days_of_campaign_tables_prune_folders_while_running(spark, sources, tmp_path):
    traffic, orders = laid_out(spark, sources, tmp_path)
    cfg = config()
    windows = [("A", BASELINE, day(0), day(1)), ("A", PROMO, day(5), day(6)), ("B", PROMO, day(3), day(3)), ("B", BASELINE, day(25), day(26))]
    base = CampaignTables.of_configs(spark, {"A": cfg, "B": cfg})
    tables = CampaignTables(
        base.campaigns, base.groups, base.members,
        spark.createDataFrame(windows, "campaign string, period string, first_day date, last_day date"), base.pairs,
    )
    # the bounds of the windows reach over the unreadable days, so only the table of days keeps them closed
    assert tables.bounds == (day(0), day(26))
    run = Campaigns(traffic, orders, cfg, tables)
    plan = plan_text(run.store_funnel)
    for column in ("visited_on", "order_day"):
        filters = [line for line in plan.split("\n") if "FileScan" in line and f"isnotnull({column}" in line]
        assert filters and "dynamicpruning" in filters[0]
    want = Campaigns(*sources, cfg, tables)
    assert sorted(map(str, run.store_funnel.collect())) == sorted(map(str, want.store_funnel.collect()))


def test_a_day_with_most_rows_is_written_whole(spark, tmp_path):
    rows = [order(i, datetime(2024, 1, 1 + (i % 10 == 0)), 1, [item(revenue=1.0)]) for i in range(2000)]
    tables = OrderTables.from_nested(spark.createDataFrame(rows, ORDERS).repartition(6))
    by_day.write_orders_by_day(tables, str(tmp_path / "o"))
    back = by_day.read_orders_by_day(spark, str(tmp_path / "o"))
    assert {r[0]: r[1] for r in back.records.groupBy("order_day").count().collect()} == {day(0): 1800, day(1): 200}
    assert as_dicts(store_day.order_store_day(back, config()), "ordered_date") == as_dicts(store_day.order_store_day(tables, config()), "ordered_date")


# text feeds

FEED = "visited_on string, country string, business_unit string, store_code string, store_name string, pedestrian_footfall string, incoming_visitors string, orders string"
LINES = [
    ("2024-01-01", "DE", "NOVA DE", "1", "S1", "100", " 30 ", "5"),
    ("2024-01-01", "DE", "NOVA DE", "1", "S1", "n/a", "1e1", "2.0"),
    ("2024-01-01 08:00:00", "DE", "NOVA DE", "2", "S2", "", None, "2.5"),
    ("01.02.2024", "DE", "NOVA DE", "2", "S2", "7", "7", "7"),
    ("2024-13-01", "DE", "NOVA DE", "x", "S2", "9" * 30, "NaN", "-"),
    (None, "DE", "NOVA DE", "2", "S2", "7", "7", "7"),
]


def test_text_is_coerced_and_rejects_are_kept(spark):
    feed = text_feed.typed_traffic(spark.createDataFrame(LINES, FEED))
    assert [(f.name, f.dataType) for f in feed.schema][:8] == [(f.name, f.dataType) for f in TRAFFIC]
    got = feed.collect()
    assert [r.visited_on for r in got] == [day(0), day(0), day(0), None, None, None]
    assert [(r.pedestrian_footfall, r.incoming_visitors, r.orders) for r in got[:3]] == [(100, 30, 5), (None, 10, 2), (None, None, None)]
    assert [[tuple(x) for x in r.rejects] for r in got] == [
        [],
        [("pedestrian_footfall", "n/a")],
        [("orders", "2.5")],
        [("visited_on", "01.02.2024")],
        [("visited_on", "2024-13-01"), ("store_code", "x"), ("pedestrian_footfall", "9" * 30), ("incoming_visitors", "NaN"), ("orders", "-")],
        [],
    ]
    facts = as_dicts(store_day.traffic_store_day(feed, config()), "store_code")
    assert [(r["store_code"], r["pedestrian_footfall"], r["incoming_visitors"], r["orders"]) for r in facts] == [("0001", 100, 40, 7), ("0002", None, 0, 0)]


def test_rejects_are_counted_while_the_fact_is_made(spark):
    seen = Observation()
    feed = text_feed.typed_traffic(spark.createDataFrame(LINES, FEED), seen)
    facts = store_day.traffic_store_day(feed, config())
    assert facts.count() == 2
    got = seen.get
    assert (got["rows"], got["rejected_rows"], got["rejected_visited_on"], got["rejected_orders"]) == (6, 4, 2, 2)
    assert got["rejected_country"] == 0 and got["rejected_pedestrian_footfall"] == 2
    assert {(r["column"], r["value"]): r["n"] for r in as_dicts(text_feed.rejected(feed))}["orders", "-"] == 1


def test_typed_columns_pass_and_an_empty_feed_rejects_nothing(spark):
    traffic = traffic_frame(spark, [visit(day(0), 1, 1, 1, 1)])
    assert text_feed.typed_traffic(traffic).collect()[0].rejects == []
    seen = Observation()
    empty = text_feed.typed_traffic(spark.createDataFrame([], FEED), seen)
    assert empty.count() == 0 and seen.get["rejected_rows"] == 0 and seen.get["rejected_visited_on"] == 0
    with pytest.raises(ValueError, match="lacks columns"):
        text_feed.typed_traffic(spark.createDataFrame(LINES, FEED).drop("orders"))


def test_a_date_column_that_is_text_elsewhere_drops_rows_without_a_day(spark):
    rows = spark.createDataFrame(LINES, FEED).withColumn("visited_on", F.when(F.col("orders") == "5", F.col("visited_on")))
    facts = store_day.traffic_store_day(text_feed.typed_traffic(rows), config())
    assert [r["store_code"] for r in as_dicts(facts)] == ["0001"]
