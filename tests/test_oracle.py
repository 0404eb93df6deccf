"""Every named query against its SQL counterpart, and skewed tables with joins that cannot broadcast."""

from datetime import datetime, timedelta
from pathlib import Path

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from __spark_entry__ import entry
from campaign_lift.plans.registry import all_queries as queries
from check_oracle import compare
from sql_counterparts.statements import all_statements as oracle_sql
from tests.conftest import plan_text

FOLDER = "/root/testdata/sf0.001"
BANNED_NODES = ("EvalPython", "InPandas", "InArrow", "CartesianProduct", "BroadcastNestedLoopJoin", "ExistingRDD")


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.fixture(scope="module")
def sample_db():
    return database(FOLDER)


def test_every_query_has_a_statement():
    assert set(queries()) == set(oracle_sql())


def test_entry(spark):
    assert entry(spark).count() == 4 * 26


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_statement(spark, sample_db, name):
    frame = queries()[name](spark, FOLDER)
    plan = plan_text(frame)
    for node in BANNED_NODES:
        assert node not in plan
    message, _ = compare(spark, sample_db, name, lambda *_: frame, oracle_sql()[name], FOLDER)
    assert message == ""


@pytest.fixture(scope="module")
def skewed(tmp_path_factory) -> str:
    """A third of the lines sit in one order, half of them name one part, one store has most
    orders; some orders have no line, and some lines name a part that does not exist."""
    folder = tmp_path_factory.mktemp("skewed")
    n_orders, n_lines = 400, 6000
    customers = [3 if i % 3 else i for i in range(n_orders)]

    def write(name, **columns):
        pq.write_table(pa.table(columns), folder / f"{name}.parquet")

    write(
        "orders",
        o_orderkey=pa.array(range(n_orders), pa.int64()),
        o_custkey=pa.array(customers, pa.int64()),
        o_orderstatus=["OFP"[i % 7 % 3] for i in range(n_orders)],
        o_orderpriority=["5-LOW" if i % 5 == 4 else "1-URGENT" for i in range(n_orders)],
    )
    write(
        "lineitem",
        l_orderkey=pa.array([7 if i % 3 == 0 else i % 300 for i in range(n_lines)], pa.int64()),
        l_partkey=pa.array([5 if i % 2 else i % 70 for i in range(n_lines)], pa.int64()),
        l_linenumber=pa.array([i % 7 + 1 for i in range(n_lines)], pa.int32()),
        l_quantity=[float(i % 50 + 1) for i in range(n_lines)],
        l_extendedprice=[float(1000 + i % 977) for i in range(n_lines)],
        l_discount=[i % 11 / 100 for i in range(n_lines)],
        l_tax=[i % 9 / 100 for i in range(n_lines)],
        l_returnflag=["RAN"[i % 3] for i in range(n_lines)],
        l_linestatus=["OF"[i % 4 // 2] for i in range(n_lines)],
    )
    write(
        "part",
        p_partkey=pa.array(range(60), pa.int64()),
        p_brand=[f"Brand#{i % 25}" for i in range(60)],
        p_type=[("ECONOMY", "STANDARD", "PROMO")[i % 3] for i in range(60)],
        p_size=pa.array([i % 50 for i in range(60)], pa.int32()),
    )
    start = datetime(2024, 1, 1)
    write(
        "events",
        ts=pa.array([start + timedelta(minutes=21 * i) for i in range(2000)], pa.timestamp("us")),
        user_id=pa.array([3 if i % 3 else i for i in range(2000)], pa.int64()),
        event_type=[("view", "click", "signup", "purchase", "error")[i % 5] for i in range(2000)],
        value=[float(i % 400) for i in range(2000)],
    )
    return str(folder)


@pytest.mark.parametrize(
    "name",
    [
        "nested_order_items",
        "store_day_raw",
        "store_funnel",
        "category_raw",
        "category_raw_filtered",
        "category_funnel",
        "bridges_split_all",
        "bridge_dim_section_revenue",
        "promotion_summary",
        "category_options",
        "ab_winner",
    ],
)
def test_skewed_tables_without_broadcast(spark, skewed, name):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        message, _ = compare(spark, database(skewed), name, queries()[name], oracle_sql()[name], skewed)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert message == ""
