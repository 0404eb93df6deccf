from __future__ import annotations

import sys
from datetime import date, datetime
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from campaign_lift.config import CampaignConfig  # noqa: E402
from campaign_lift.session import build_session  # noqa: E402
from campaign_lift.sources.orders import OrderTables  # noqa: E402
from campaign_lift.sources.schemas import ITEM_COLUMNS, ORDERS, PC1, QUANTITY, REVENUE, TRAFFIC  # noqa: E402


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    session = build_session(
        "campaign-lift-tests",
        "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false",
            "spark.sql.maxMetadataStringLength": "100000", "spark.sql.debug.maxToStringFields": "1000"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def config(**changes) -> CampaignConfig:
    """Two baseline days and two promo days; 2024-01-07 is a Sunday."""
    settings = {
        "traffic_business_unit": "NOVA DE",
        "traffic_country": "DE",
        "order_company_name_short": "NOVA",
        "order_channel": "STATIONARY",
        "order_country": "DE",
        "groups": {"Group 1": ["1"], "Group 2": ["1", "2"], "Group 3": ["2"], "Group 4": []},
        "baseline_dates": [date(2024, 1, 1), date(2024, 1, 2)],
        "promo_dates": [date(2024, 1, 6), date(2024, 1, 7)],
        "vat": 1.2,
    }
    return CampaignConfig(**(settings | changes))


def visit(day: date, store: int, footfall=None, visitors=None, tills=None, **other) -> dict:
    row = {
        "visited_on": day,
        "country": "DE",
        "business_unit": "NOVA DE",
        "store_code": store,
        "store_name": f"S{store}",
        "pedestrian_footfall": footfall,
        "incoming_visitors": visitors,
        "orders": tills,
    }
    return row | other


def item(revenue=0.0, quantity=1.0, pc1=0.0, black=10.0, red=None, green=None, cost=4.0, discount=0.0, **other) -> dict:
    row = dict.fromkeys(ITEM_COLUMNS) | {
        "item_no": 1,
        REVENUE: revenue,
        QUANTITY: quantity,
        PC1: pc1,
        "article_price_black_eur": black,
        "article_price_red_eur": red,
        "article_price_green_eur": green,
        "article_cost_eur": cost,
        "promotion_discount_eur": discount,
        "has_promotion": False,
        "promotions": [],
    }
    return row | other


def order(number, at: datetime, store: int | None = 1, items=(), insider=None, **other) -> dict:
    row = {
        "order_id": str(number),
        "ordered_at": at,
        "company_name_short": "NOVA",
        "channel": "STATIONARY",
        "country": "DE",
        "tenant": store,
        "store_name": f"S{store}",
        "insider_customer_type": insider,
        "order_items": None if items is None else list(items),
    }
    return row | other


def traffic_frame(spark, rows):
    fields = [T.StructField(f.name, f.dataType, True) for f in TRAFFIC]
    return spark.createDataFrame([tuple(r[f.name] for f in fields) for r in rows], T.StructType(fields))


def order_tables(spark, rows) -> OrderTables:
    return OrderTables.from_nested(spark.createDataFrame(rows, ORDERS))


def as_dicts(frame, *keys) -> list[dict]:
    rows = [r.asDict(recursive=True) for r in frame.collect()]
    return sorted(rows, key=lambda r: tuple(str(r[k]) for k in keys)) if keys else rows


def by_kpi(frame, grp: str) -> dict[str, dict]:
    return {r["kpi"]: r for r in as_dicts(frame) if r["grp"] == grp}


def plan_text(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()
