from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from campaign_lift.sources import options
from campaign_lift.sources.orders import OrderTables
from campaign_lift.sources.traffic import read_traffic
from tests.conftest import as_dicts, config, item, order, order_tables, plan_text, traffic_frame, visit

NOON = datetime(2024, 1, 1, 12)


def test_empty_and_missing_item_arrays_keep_one_row(spark):
    tables = order_tables(
        spark, [order(1, NOON, items=[item(), item()]), order(2, NOON, items=[]), order(3, NOON, items=None)]
    )
    counts = {r["order_id"]: r["n"] for r in as_dicts(tables.item_rows(["item_no"]).groupBy("order_id").agg(F.count("*").alias("n")))}
    assert counts == {"1": 2, "2": 1, "3": 1}
    empty = tables.item_rows(["item_no", "has_promotion"]).where("order_id = '2'").first()
    assert empty["item_no"] is None and empty["has_promotion"] is None


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="order_items"):
        OrderTables.from_nested(spark.range(1).select(F.lit("x").alias("order_id")))


def test_store_options_are_distinct_padded_sorted(spark):
    tables = order_tables(
        spark,
        [
            order(1, NOON, 12),
            order(2, NOON, 3),
            order(3, NOON, 12),
            order(4, NOON, 9, channel="ONLINE"),
            order(5, NOON, 12345),
        ],
    )
    codes = [r["store_code"] for r in options.store_options(tables, config()).collect()]
    assert codes == ["0003", "0012", "12345"]


def test_category_options_name_missing_values(spark):
    tables = order_tables(
        spark,
        [
            order(1, NOON, items=[item(article_section="B"), item(article_section="A", article_season="SS")]),
            order(2, NOON, items=[]),
            order(3, datetime(2025, 1, 1), items=[item(article_section="Z")]),
        ],
    )
    rows = [(r["dimension"], r["option"]) for r in options.category_options(tables, config()).collect()]
    assert rows == [
        ("article_brand_group", "UNKNOWN"),
        ("article_season", "SS"),
        ("article_season", "UNKNOWN"),
        ("article_section", "A"),
        ("article_section", "B"),
        ("article_section", "UNKNOWN"),
        ("article_section_group", "UNKNOWN"),
    ]
    assert options.category_option_tuples(tables, config()).count() == 3


def test_select_options(spark):
    stores = spark.createDataFrame([("a",), ("b",), ("c",)], "v string")

    def chosen(mode, *values):
        return sorted(r["v"] for r in options.select_options(stores, "v", mode, values).collect())

    assert chosen("all") == ["a", "b", "c"]
    assert chosen("include", "b", "x") == ["b"]
    assert chosen("except", "b") == ["a", "c"]
    assert chosen("include") == []
    with pytest.raises(ValueError):
        chosen("some")


def test_order_days_are_utc_days_for_both_timestamp_kinds(spark):
    plain = order_tables(
        spark,
        [order(1, datetime(2024, 1, 1, 23, 59)), order(2, datetime(2024, 1, 3)), order(3, datetime(2023, 12, 31, 23, 59))],
    ).orders
    days = [date(2024, 1, 1), date(2024, 1, 2)]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        zoned = plain.withColumn(
            "ordered_at",
            F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), F.col("ordered_at")).cast("timestamp"),
        )
        for frame in (plain, zoned):
            kept = OrderTables.from_nested(frame).on_dates(days).orders.select("order_id", "ordered_date").collect()
            assert [(r[0], r[1]) for r in kept] == [("1", date(2024, 1, 1))]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_filters_and_columns_reach_the_nested_scan(spark, tmp_path):
    path = str(tmp_path / "orders")
    order_tables(spark, [order(1, NOON, items=[item(revenue=5.0)])]).orders.write.parquet(path)
    cfg = config()
    tables = OrderTables.read(spark, path)
    items = tables.for_seller(cfg).on_dates(cfg.selected_dates).item_rows(["article_cost_eur", "has_promotion"])
    plan = plan_text(items.groupBy("ordered_date", "has_promotion").agg(F.sum("article_cost_eur")))
    pushed = plan[plan.index("PushedFilters") : plan.index("ReadSchema")]
    assert "GreaterThanOrEqual(ordered_at" in pushed and "EqualTo(channel,STATIONARY)" in pushed
    schema = plan[plan.index("ReadSchema") :].split("\n")[0]
    assert "order_items:array<struct<article_cost_eur:double,has_promotion:boolean>>" in schema
    assert "store_name" not in schema
    # Plain order columns never open the items.
    counts = tables.for_seller(cfg).on_dates(cfg.selected_dates).orders.select("order_id")
    assert "order_items" not in plan_text(counts).split("ReadSchema")[1]


def test_traffic_reads_parquet(spark, tmp_path):
    path = str(tmp_path / "traffic")
    traffic_frame(spark, [visit(date(2024, 1, 1), 1, 5, 2, 1)]).write.parquet(path)
    assert read_traffic(spark, path).count() == 1
    spark.range(1).write.parquet(str(tmp_path / "other"))
    with pytest.raises(ValueError, match="visited_on"):
        read_traffic(spark, str(tmp_path / "other"))


def test_window_days(spark):
    days = [date(2024, 1, d) for d in (1, 2, 3)]
    frame = spark.createDataFrame([(days[2], days[1]), (days[0], days[1]), (None, days[0])], "a date, b date")
    assert sorted(r[0] for r in options.window_days(frame, "a", "b").collect()) == days


def test_text_numbers_are_read_and_bad_ones_dropped(spark):
    from campaign_lift.functions.columns import to_number

    frame = spark.createDataFrame([("1.5",), ("x",), (None,)], "v string")
    assert [r[0] for r in frame.select(to_number(F.col("v"))).collect()] == [1.5, None, None]


def test_wrong_types_are_refused_and_decimals_are_amounts(spark):
    rows = order_tables(spark, [order(1, NOON, items=[item(revenue=2.5)])]).records
    with pytest.raises(ValueError, match="ordered_at"):
        OrderTables.from_nested(rows.withColumn("ordered_at", F.col("ordered_at").cast("string")))
    items = F.transform("order_items", lambda x: x.withField("article_cost_eur", x["article_cost_eur"].cast("decimal(12,2)")))
    OrderTables.from_nested(rows.withColumn("order_items", items))
    with pytest.raises(ValueError, match="order_items"):
        OrderTables.from_nested(rows.withColumn("order_items", F.transform("order_items", lambda x: x.withField("has_promotion", F.lit("yes")))))
