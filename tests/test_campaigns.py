"""Many campaigns in one job: segments by sweep, the interval join, and equality with single runs."""

from dataclasses import replace
from datetime import date, datetime, timedelta

import pytest

from __spark_entry__ import queries
from campaign_lift.config import BASELINE, PROMO, expand_dates
from campaign_lift.operators import many
from campaign_lift.plans.campaign import Campaign
from campaign_lift.plans.campaigns import Campaigns
from campaign_lift.plans.registry import sample_campaigns, sample_many
from campaign_lift.sources.campaign_tables import CampaignTables
from campaign_lift.sources.sample_tables import sample_tables, sample_traffic
from tests.conftest import as_dicts, config, item, order, order_tables, plan_text, traffic_frame, visit

FOLDER = "/root/testdata/sf0.001"
START = date(2024, 1, 1)


def day(n: int) -> date:
    return START + timedelta(days=n)


def plan_of(spark, windows, **tables) -> CampaignTables:
    names = sorted({w[0] for w in windows}) or ["A"]
    made = {
        "campaigns": spark.createDataFrame(
            [(n, 1.2, 1.0, "BOTH", True) for n in names],
            "campaign string, vat double, baseline_coefficient double, promo_mechanism string, include_sunday boolean",
        ),
        "groups": spark.createDataFrame([(n, "G") for n in names], "campaign string, grp string"),
        "members": spark.createDataFrame([(n, "G", "1") for n in names], "campaign string, grp string, store_code string"),
        "windows": spark.createDataFrame(windows, "campaign string, period string, first_day date, last_day date"),
        "pairs": spark.createDataFrame([], "campaign string, control_group string, testing_group string"),
    }
    return CampaignTables(**(made | tables))


def test_segments_are_disjoint_and_cover_each_period_once(spark):
    windows = [
        ("A", BASELINE, day(0), day(9)),
        ("A", BASELINE, day(5), day(3)),  # inside, given in reverse
        ("A", BASELINE, day(10), day(12)),  # meets the first
        ("A", PROMO, day(8), day(20)),
        ("A", PROMO, day(30), None),
        ("A", "another period", day(40), day(41)),
        ("B", PROMO, day(3), day(3)),
        ("B", PROMO, day(3), day(3)),
    ]
    got = as_dicts(plan_of(spark, windows).segments, "campaign", "first_day")
    for r in got:
        assert r["first_day"] <= r["last_day"]
    covered = {(r["campaign"], d, p) for r in got for d in expand_dates(r["first_day"], r["last_day"]) for p in ("in_baseline", "in_promo") if r[p]}
    want = {("A", d, "in_baseline") for d in expand_dates(day(0), day(12))} | {("A", d, "in_promo") for d in expand_dates(day(8), day(20))}
    assert covered == want | {("B", day(3), "in_promo")}
    days = [(r["campaign"], d) for r in got for d in expand_dates(r["first_day"], r["last_day"])]
    assert len(days) == len(set(days))


def test_buckets_keep_every_day_of_long_windows(spark, monkeypatch):
    facts = spark.createDataFrame([(day(n),) for n in range(-40, 90)], "ordered_date date").selectExpr("ordered_date", "'0001' AS store_code")
    plan = plan_of(spark, [("A", BASELINE, day(-33), day(70)), ("B", PROMO, day(15), day(16)), ("C", PROMO, day(16), day(16))])
    inside = many.memberships(plan).where("grp = 'G'")
    for width in (1, 7, 16):
        monkeypatch.setattr(many, "BUCKET_DAYS", width)
        inside = many.memberships(plan).where("grp = 'G'")
        rows = facts.withColumn("bucket", many.bucket(facts["ordered_date"])).join(inside, ["store_code", "bucket"])
        met = rows.where("ordered_date BETWEEN first_day AND last_day").groupBy("campaign").count()
        assert {r["campaign"]: r["count"] for r in met.collect()} == {"A": 104, "B": 2, "C": 1}


def test_campaigns_equal_their_single_runs(spark):
    traffic, orders = sample_traffic(spark, FOLDER), sample_tables(spark, FOLDER)
    base = config(
        groups={"Group 1": ["0", "1", "2"], "Group 2": ["2", "3"], "Group 3": ["4", "7"], "Group 4": []},
        pairs=[("Group 1", "Group 3"), ("Group 2", "Group 1"), ("Group 3", "Group 4"), ("Group 2", "Group 2")],
    )
    configs = {
        "plain": replace(base, baseline_dates=expand_dates(day(0), day(6)), promo_dates=expand_dates(day(7), day(13))),
        "overlap": replace(
            base, baseline_dates=expand_dates(day(2), day(11)), promo_dates=expand_dates(day(9), day(20)), baseline_coefficient=1.5,
            promo_mechanism="BP_ONLY",
        ),
        "gaps": replace(
            base, baseline_dates=[day(1), day(3), day(5), day(6)], promo_dates=[d for d in expand_dates(day(14), day(27)) if d != day(16)],
            vat=1.19, baseline_coefficient=0.5, promo_mechanism="RP_ONLY",
        ),
        "no promo": replace(base, baseline_dates=[day(3)], promo_dates=[]),
        "no data": replace(base, baseline_dates=[date(2021, 1, 1)], promo_dates=[date(2021, 1, 2)]),
    }
    run = Campaigns(traffic, orders, base, CampaignTables.of_configs(spark, configs))
    tables = {
        "store_funnel": lambda c: c.store_funnel,
        "store_promo_impact": lambda c: c.store_promo_impact,
        "ab_winner": lambda c: c.ab_winner(),
        "kpi_drivers": lambda c: c.kpi_drivers(),
        "driver_insights": lambda c: c.driver_insights,
        "driver_summary": lambda c: c.driver_summary,
    }
    whole = {name: build(run).collect() for name, build in tables.items()}
    for campaign, cfg in configs.items():
        single = Campaign(traffic, orders, cfg)
        for name, build in tables.items():
            want = sorted(repr(sorted(r.asDict(True).items())) for r in build(single).collect())
            rows = [r.asDict(True) for r in whole[name] if r["campaign"] == campaign]
            got = sorted(repr(sorted((k, v) for k, v in r.items() if k != "campaign")) for r in rows)
            assert got == want, (campaign, name)


def test_a_store_in_several_groups_and_repeated_members_count_once(spark):
    members = spark.createDataFrame(
        [("A", "G", "1"), ("A", "G", "0001"), ("A", "H", "1"), ("A", "H", ""), ("A", "H", None)], "campaign string, grp string, store_code string"
    )
    groups = spark.createDataFrame([("A", "G"), ("A", "H"), ("A", "empty"), ("A", "empty")], "campaign string, grp string")
    plan = plan_of(spark, [("A", PROMO, day(0), day(1))], members=members, groups=groups)
    traffic = traffic_frame(spark, [visit(day(0), 1, 10, 5, 1), visit(day(1), 9, 7, 7, 7)])
    orders = order_tables(spark, [order(1, datetime(2024, 1, 1), 1, [item(revenue=3.0)])])
    run = Campaigns(traffic, orders, config(), plan)
    got = {(r["grp"], r["period"]): (r["pedestrian_footfall"], r["total_revenue"], r["trackable_stores"]) for r in run.group_sums.collect()}
    assert got == {(g, p): (10.0, 3.0, 1) if g != "empty" and p == PROMO else (0.0, 0.0, 0) for g in ("G", "H", "empty") for p in (BASELINE, PROMO)}


@pytest.mark.parametrize("windows", [[], [("A", PROMO, None, day(3))]])
def test_campaigns_without_days_give_nothing(spark, windows):
    run = Campaigns(traffic_frame(spark, [visit(day(0), 1, 1, 1, 1)]), order_tables(spark, []), config(), plan_of(spark, windows))
    assert run.store_funnel.count() == 0 and run.ab_winner().count() == 0


@pytest.mark.parametrize("name", ["campaigns_store_funnel", "campaigns_ab_winner", "campaigns_driver_insights"])
def test_each_fact_is_derived_once_for_fifty_campaigns(spark, name):
    plan = plan_text(queries()[name](spark, FOLDER))
    scans = [line for line in plan.split("\n") if "FileScan" in line]
    assert sum("event_type" in line for line in scans) == 1 and sum("l_extendedprice" in line for line in scans) == 1
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert "GreaterThanOrEqual(ts,2022-01-08T00:00)" in plan and "LessThan(ts,2024-01-30T00:00)" in plan


def test_summaries_name_the_dates_of_their_campaign(spark):
    rows = {(r.campaign, r.control_group): r.summary for r in sample_many(spark, FOLDER).driver_summary.collect()}
    assert len(rows) == 98 and "2024-01-01, 2024-01-02" in rows["C00", "Group 1"] and "2024-01-03" in rows["C02", "Group 1"]
    assert sample_campaigns(spark).bounds == (date(2022, 1, 8), date(2024, 1, 29))


def test_campaigns_without_broadcast_and_with_a_hot_store(spark):
    """A store that holds most rows and sits in every campaign, joined by shuffles that split hot keys."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
    }
    windows = [(f"C{i:03}", PROMO if i % 2 else BASELINE, day(i % 9), day(i % 9 + 20)) for i in range(120)]
    plan = plan_of(spark, windows)
    traffic = traffic_frame(spark, [visit(day(n % 30), 1 if n % 5 else n % 40, 2, 1, 1) for n in range(3000)])
    run = Campaigns(traffic, order_tables(spark, [order(1, datetime(2024, 1, 9), 1, [item(revenue=3.0)])]), config(), plan)
    want = sorted(map(str, run.group_sums.collect()))
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        run = Campaigns(traffic, order_tables(spark, [order(1, datetime(2024, 1, 9), 1, [item(revenue=3.0)])]), config(), plan)
        assert sorted(map(str, run.group_sums.collect())) == want
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert len(want) == 240
