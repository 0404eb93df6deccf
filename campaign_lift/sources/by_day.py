"""Both source tables laid out by day, so that days outside all periods are not opened."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from campaign_lift.sources.orders import ORDER_DAY, OrderTables
from campaign_lift.sources.traffic import read_traffic


def write_traffic_by_day(traffic: DataFrame, path: str) -> None:
    """Traffic with a folder for each day of visit."""
    by_day = traffic.withColumn("visited_on", F.col("visited_on").cast("date"))
    _write(by_day, "visited_on", path)


def write_orders_by_day(tables: OrderTables, path: str, dealt: bool = False) -> None:
    """Order records, items and all, with a folder for each UTC day of ordering. Records that are ``dealt`` by day already are
    written where they lie."""
    _write(tables.records.withColumn(ORDER_DAY, tables.day), ORDER_DAY, path, dealt)


def _write(rows: DataFrame, day: str, path: str, dealt: bool = False) -> None:
    """Rows are dealt out by day before they are written, so that a day has few files; the hint lets adaptive execution split
    a day that holds a large share of all rows."""
    placed = rows if dealt else rows.hint("rebalance", F.col(day))
    placed.write.mode("overwrite").partitionBy(day).parquet(path)


def read_traffic_by_day(spark: SparkSession, path: str) -> DataFrame:
    return read_traffic(spark, path)


def read_orders_by_day(spark: SparkSession, path: str) -> OrderTables:
    """Dates given as settings prune folders when the query is planned; days given as a table prune them while it runs."""
    return OrderTables.read(spark, path)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share; a local session without that setting gets a folder of
    its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="by-day-")
    return f"{base}/by-day-{uuid.uuid4().hex}"
