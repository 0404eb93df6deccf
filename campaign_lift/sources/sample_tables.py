"""Traffic and orders derived from the sample star schema (``FIXTURES.md`` has the meaning).

Orders are the distributed join of three tables. No step gathers the items of an order: a
third of all lines may share one order key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from campaign_lift.sources.orders import OrderTables
from campaign_lift.sources.schemas import ITEM_COLUMNS, ORDER_COLUMNS, ORDERS, PC1, QUANTITY, REVENUE


LINES_PER_RECORD = 3
#: Tasks that the records of one day are dealt to at most.
DEALS_PER_DAY = 32

# Columns read from the sample tables. Declared, so that opening a table starts no job.
SAMPLE_SCHEMAS = {
    "events": "ts timestamp_ntz, user_id bigint, event_type string, value double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string",
    "part": "p_partkey bigint, p_brand string, p_type string, p_size int",
}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SAMPLE_SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def sample_traffic(spark: SparkSession, folder: str) -> DataFrame:
    return _traffic(_table(spark, folder, "events"))


def _traffic(events: DataFrame, *others: str) -> DataFrame:
    return events.selectExpr(
        *others,
        "CAST(ts AS DATE) AS visited_on",
        "'DE' AS country",
        "'NOVA DE' AS business_unit",
        "CAST(user_id % 8 AS INT) AS store_code",
        "concat('STORE_', user_id % 8) AS store_name",
        """CASE WHEN user_id % 8 = 7 OR event_type = 'error' THEN NULL
                WHEN event_type = 'signup' THEN 0L ELSE CAST(floor(value) AS BIGINT) END AS pedestrian_footfall""",
        "CASE WHEN event_type IN ('view', 'click', 'signup') THEN CAST(floor(value / 4) AS BIGINT) END AS incoming_visitors",
        "CASE WHEN event_type = 'purchase' THEN 1L END AS orders",
    )


def sample_traffic_text(spark: SparkSession, folder: str) -> DataFrame:
    """The same traffic as text, with days and numbers that are none."""
    text = {
        "visited_on": "CASE WHEN user_id % 97 = 3 THEN 'not a date' WHEN user_id % 89 = 5 THEN '' WHEN user_id % 83 = 4 THEN '2024-02-30' ELSE {} END",
        "store_code": "CASE WHEN user_id % 53 = 9 THEN 'S-1' ELSE {} END",
        "pedestrian_footfall": "CASE WHEN user_id % 31 = 7 THEN 'n/a' WHEN user_id % 37 = 2 THEN concat('  ', {}, ' ') ELSE {} END",
        "incoming_visitors": "CASE WHEN user_id % 41 = 1 THEN '1.5' WHEN user_id % 43 = 1 THEN concat({}, '.0') ELSE {} END",
        "orders": "CASE WHEN user_id % 47 = 6 THEN '1e0' ELSE {} END",
    }
    rows = _traffic(_table(spark, folder, "events"), "user_id")
    return rows.selectExpr(
        *[f"{text[c].replace('{}', f'CAST({c} AS STRING)')} AS {c}" if c in text else c for c in rows.columns if c != "user_id"]
    )


def sample_order_rows(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order, without items."""
    return _order_rows(_table(spark, folder, "orders"), "o_orderkey")


def _order_rows(orders: DataFrame, *others: str) -> DataFrame:
    return orders.selectExpr(
        *others,
        "CAST(o_orderkey AS STRING) AS order_id",
        """CAST(date_add(DATE '2024-01-01', CAST(o_orderkey % 30 AS INT)) AS TIMESTAMP_NTZ)
             + make_dt_interval(0, CAST(o_custkey % 24 AS INT)) AS ordered_at""",
        "CASE WHEN o_custkey % 5 = 4 THEN 'ALTA' ELSE 'NOVA' END AS company_name_short",
        "CASE WHEN o_orderpriority = '5-LOW' THEN 'ONLINE' ELSE 'STATIONARY' END AS channel",
        "CASE WHEN o_orderstatus = 'P' THEN 'AT' ELSE 'DE' END AS country",
        "CAST(o_custkey % 8 AS INT) AS tenant",
        "concat('STORE_', o_custkey % 8) AS store_name",
        "CASE o_custkey % 3 WHEN 0 THEN 'EXISTING' WHEN 1 THEN 'NEW' END AS insider_customer_type",
    )


def _priced(lines: DataFrame, steps: int, *others: str) -> DataFrame:
    """Lines joined to their parts, as item rows. Amounts are whole numbers of 1/steps euro; with a power of two as steps
    they and their sums are exact doubles, and halves of a cent are true ties."""
    unit = "try_divide(l_extendedprice, l_quantity)"

    def whole(amount: str) -> str:
        return f"CAST(floor({amount}) AS DOUBLE)" if steps == 1 else f"floor(({amount}) * {steps}) / {steps}D"

    amounts = lines.selectExpr(
        *others,
        *ORDER_COLUMNS,
        "l_linenumber AS item_no",
        f"{whole(unit)} AS black",
        f"CASE WHEN l_discount > 0.055D THEN {whole(f'{unit} * (1 - l_discount)')} END AS red",
        f"CASE WHEN l_discount > 0.085D THEN {whole(f'{unit} * 0.5D')} END AS green",
        f"{whole(f'{unit} * 0.4D')} AS cost",
        f"CASE WHEN l_linestatus = 'F' THEN {whole(f'{unit} * l_tax')} ELSE 0D END AS promo",
        "CASE WHEN l_returnflag = 'R' THEN 0D ELSE l_quantity END AS qty",
        "l_linestatus = 'F' AS has_promotion",
        """CASE WHEN l_linestatus <> 'F' OR l_linestatus IS NULL THEN CAST(array() AS ARRAY<STRING>)
                WHEN l_tax > 0.065D THEN array('PROMO_B', 'PROMO_A') WHEN l_tax > 0.045D THEN array('PROMO_B')
                ELSE array('PROMO_A') END AS promotion_ids""",
        "p_type AS article_section_group",
        "p_brand AS article_section",
        "CASE p_size % 4 WHEN 0 THEN 'SS' WHEN 1 THEN 'FW' WHEN 2 THEN 'NOS' END AS article_season",
        "CASE p_size % 3 WHEN 0 THEN 'OWN' WHEN 1 THEN 'BRAND' END AS article_brand_group",
    )
    revenue = "qty * (coalesce(red, black) - promo)"
    return amounts.selectExpr(
        *others,
        *ORDER_COLUMNS,
        "item_no",
        "black AS article_price_black_eur",
        "red AS article_price_red_eur",
        "green AS article_price_green_eur",
        "cost AS article_cost_eur",
        "promo AS promotion_discount_eur",
        f"qty AS {QUANTITY}",
        f"{revenue} AS {REVENUE}",
        f"{whole(f'({revenue}) / 1.19D')} - cost * qty AS {PC1}",
        "has_promotion",
        "transform(promotion_ids, p -> named_struct('promotion_id', p)) AS promotions",
        "article_section_group",
        "article_section",
        "article_season",
        "article_brand_group",
    )


def _orders_without_lines(spark: SparkSession, folder: str, orders: DataFrame) -> DataFrame:
    """Orders that no priced line names. The line keys are made distinct before they are shuffled."""
    parts = _table(spark, folder, "part").select("p_partkey")
    keys = (
        _table(spark, folder, "lineitem")
        .select("l_orderkey", "l_partkey")
        .join(parts, F.col("l_partkey") == F.col("p_partkey"), "left_semi")
        .select("l_orderkey")
        .distinct()
    )
    return orders.join(keys, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")


def sample_item_rows(spark: SparkSession, folder: str, steps: int = 1) -> DataFrame:
    """One row per order item, empty orders kept with NULL item fields.

    An outer join could not split a hot order key, so the matched rows come from an inner join
    (whose line side may be split at run time) and the empty orders from an anti join. Lines
    meet the filtered orders first and the parts second: fewer and narrower rows travel.
    """
    orders = sample_order_rows(spark, folder)
    matched = _priced(
        _table(spark, folder, "lineitem")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(_table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey")),
        steps,
    )
    empty = _orders_without_lines(spark, folder, orders).select(*ORDER_COLUMNS)
    return matched.unionByName(empty, allowMissingColumns=True)


def sample_nested_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Order records with an item array. A record carries the lines of its order whose numbers fall
    into one run of ``LINES_PER_RECORD``, or none.

    Line numbers are unique in an order, so a record is bounded however many lines an order has,
    and the records of a hot order are built by many tasks. Order counts are distinct counts, so
    they do not change.

    Lines travel once, as the narrow columns of the sample tables, dealt by day and a hash of their
    record. Prices, names and records are made where they arrive, and a layout by day can be written from there.
    """
    orders = _table(spark, folder, "orders")
    matched = (
        _table(spark, folder, "lineitem")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(_table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .drop("l_orderkey", "l_partkey", "p_partkey")
    )
    lines = matched.unionByName(_orders_without_lines(spark, folder, orders), allowMissingColumns=True)
    chunk = F.floor((F.col("l_linenumber") - 1) / LINES_PER_RECORD).alias("chunk")
    deal = F.pmod(F.xxhash64("o_orderkey", chunk), F.lit(DEALS_PER_DAY)).alias("deal")
    kept = [c for c in lines.columns if not c.startswith("o_")]
    keyed = lines.select("*", chunk, deal, F.pmod("o_orderkey", F.lit(30)).alias("day_no"))
    dealt = keyed.repartition("day_no", "deal")
    rows = _priced(_order_rows(dealt, "day_no", "deal", "chunk", *kept), 1, "day_no", "deal", "chunk")
    item = F.when(F.col("item_no").isNotNull(), F.struct(*[F.col(c) for c in ITEM_COLUMNS]))
    records = rows.groupBy("day_no", "deal", *ORDER_COLUMNS, "chunk").agg(F.sort_array(F.collect_list(item)).alias("order_items"))
    return records.select(*ORDER_COLUMNS, F.col("order_items").cast(ORDERS["order_items"].dataType).alias("order_items"))


def sample_tables(spark: SparkSession, folder: str, steps: int = 1) -> OrderTables:
    return OrderTables.from_rows(sample_order_rows(spark, folder), sample_item_rows(spark, folder, steps))
