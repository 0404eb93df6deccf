from datetime import date, date, datetime

import pytest

from campaign_lift.operators import bridges, funnel, impact, series, store_day
from campaign_lift.plans.campaign import Campaign
from tests.conftest import as_dicts, by_kpi, config, item, order, order_tables, traffic_frame, visit

D1, D2, SAT, SUN = date(2024, 1, 1), date(2024, 1, 2), date(2024, 1, 6), date(2024, 1, 7)


def at(day: date) -> datetime:
    return datetime(day.year, day.month, day.day, 10)


@pytest.fixture(scope="module")
def tables(spark):
    """Store 1 sells on all days, store 2 only in the promo period and has no counter."""
    traffic = traffic_frame(
        spark,
        [
            visit(D1, 1, 100, 40, 4),
            visit(D2, 1, 0, 10, 1),
            visit(SAT, 1, 200, 50, 5),
            visit(SUN, 1, 300, 60, 6),
            visit(SAT, 2, None, 20, 2),
        ],
    )
    orders = order_tables(
        spark,
        [
            order(1, at(D1), 1, [item(revenue=60.0, quantity=3.0, pc1=20.0, black=20.0, red=18.0, cost=5.0)], "EXISTING"),
            order(2, at(D2), 1, [item(revenue=40.0, quantity=1.0, pc1=10.0, black=45.0, cost=20.0, discount=5.0, has_promotion=True)]),
            order(3, at(SAT), 1, [item(revenue=150.0, quantity=5.0, pc1=50.0, black=30.0, cost=10.0)], "NEW"),
            order(4, at(SUN), 1, [item(revenue=90.0, quantity=3.0, pc1=30.0, black=30.0, cost=10.0)], "EXISTING"),
            order(5, at(SAT), 2, [item(revenue=10.0, quantity=1.0, pc1=2.0, black=12.0, red=10.0, cost=5.0)]),
        ],
    )
    return traffic, orders


def campaign(tables, include_sunday=False, **changes) -> Campaign:
    return Campaign(*tables, config(**changes), include_sunday)


def test_funnel_values(tables):
    rows = by_kpi(campaign(tables).store_funnel, "Group 1")
    assert len(rows) == 26 and [r["kpi_seq"] for r in rows.values()] == sorted(r["kpi_seq"] for r in rows.values())

    def pair(kpi):
        return rows[kpi]["baseline_value"], rows[kpi]["promo_value"]

    assert pair("pedestrian footfall") == (100.0, 200.0)
    assert pair("store absorption rate") == (0.4, 0.25)  # the day with footfall 0 does not count
    assert pair("incoming visitors") == (50.0, 50.0)
    assert pair("store conversion rate") == (0.1, 0.1)
    assert pair("AOV") == (20.0, 30.0)
    assert pair("price per item") == (25.0, 30.0)
    assert pair("margin") == (30.0 / 100.0 * 1.2, 50.0 / 150.0 * 1.2)
    assert pair("existing revenue") == (60.0, 0.0)
    assert pair("RP revenue share") == (0.6, 0.0)
    assert rows["total revenue"]["pct_diff"] == 0.5 and rows["total revenue"]["abs_diff"] == 50.0
    assert rows["existing margin"]["pct_diff"] == -1.0
    assert rows["store conversion rate"]["pct_diff"] == 0.0


def test_sunday_switch_and_zero_base(tables):
    with_sunday = by_kpi(campaign(tables, include_sunday=True).store_funnel, "Group 1")
    assert with_sunday["total revenue"]["promo_value"] == 240.0
    third = by_kpi(campaign(tables).store_funnel, "Group 3")
    assert third["total revenue"]["baseline_value"] == 0.0
    assert third["total revenue"]["pct_diff"] == 0.0 and third["total revenue"]["abs_diff"] == 10.0
    # Footfall without a counter is 0 and so is its absorption.
    assert third["pedestrian footfall"]["promo_value"] == 0.0 and third["store absorption rate"]["promo_value"] == 0.0


def test_sunday_only_period_is_zero_without_sundays(tables):
    rows = by_kpi(campaign(tables, promo_dates=[SUN]).store_funnel, "Group 1")
    assert rows["total revenue"]["promo_value"] == 0.0 and rows["total revenue"]["pct_diff"] == -1.0


def test_groups_without_stores_get_zero_rows(tables):
    rows = by_kpi(campaign(tables).store_funnel, "Group 4")
    assert len(rows) == 26 and all(r["promo_value"] == 0.0 and r["pct_diff"] == 0.0 for r in rows.values())


def test_empty_raw_gives_no_rows(spark, tables):
    empty = traffic_frame(spark, [visit(D1, 1, 1, 1, 1, country="AT")])
    assert Campaign(empty, tables[1], config()).store_funnel.count() == 0
    # Other stores only: the raw fact has rows, so every group is reported with zeros.
    other = traffic_frame(spark, [visit(D1, 9, 1, 1, 1)])
    assert Campaign(other, tables[1], config()).store_funnel.count() == 4 * 26


def test_trackable_stores_count_footfall_zero_but_not_missing(tables):
    labels = {r["grp"]: r for r in as_dicts(campaign(tables).footfall_labels)}
    assert (labels["Group 2"]["baseline_stores"], labels["Group 2"]["promo_stores"]) == (1, 1)
    assert labels["Group 3"]["footfall_label"] == "pedestrian footfall\n(trackable stores #: 0 -->0)"


def test_coefficient_cancels_in_ratios(tables):
    plain, scaled = (by_kpi(campaign(tables, baseline_coefficient=k).store_funnel, "Group 1") for k in (1.0, 2.0))
    for kpi in ("AOV", "store conversion rate", "store absorption rate", "margin", "RP revenue share"):
        assert plain[kpi]["baseline_value"] == pytest.approx(scaled[kpi]["baseline_value"])
    assert scaled["total revenue"]["baseline_value"] == 2 * plain["total revenue"]["baseline_value"]


def test_impact_is_testing_minus_control_and_antisymmetric(tables):
    pairs = [("Group 1", "Group 3"), ("Group 3", "Group 1"), ("Group 1", "Group 1")]
    rows = as_dicts(campaign(tables, pairs=pairs).store_promo_impact)
    assert len(rows) == 3 * 26
    values = {(r["control_group"], r["testing_group"], r["kpi"]): r for r in rows}
    forth = values["Group 1", "Group 3", "total revenue"]
    assert forth["testing_minus_control_abs_diff"] == 10.0 - 50.0
    for (a, b, kpi), row in values.items():
        back = values[b, a, kpi]
        assert row["testing_minus_control_pct_diff"] == -back["testing_minus_control_pct_diff"] or a == b
        if a == b:
            assert row["testing_minus_control_abs_diff"] == 0.0


def test_display_headings_tell_equal_groups_apart(tables):
    shown = impact.impact_for_display(campaign(tables, pairs=[("Group 1", "Group 1")]).store_promo_impact, "Group 1", "Group 1")
    assert "Group 1 (Control) % Diff (Promo vs Baseline)" in shown.columns
    assert "Group 1 (Testing) Abs Diff (Promo vs Baseline)" in shown.columns
    assert shown.first()["KPI"] == "pedestrian footfall"


def test_weekday_change_with_and_without_baseline(tables):
    c = campaign(tables, baseline_dates=[D1, D2, date(2023, 12, 30)])
    rows = as_dicts(c.weekday_pct_diff, "grp", "weekday")
    first = {r["weekday"]: r for r in rows if r["grp"] == "Group 1"}
    assert set(first) == {"Saturday", "Sunday"} and first["Sunday"]["weekday_seq"] == 6
    assert first["Saturday"]["total_revenue_pct_diff"] is None
    same = as_dicts(campaign(tables, baseline_dates=[SUN], promo_dates=[SAT, SUN]).weekday_pct_diff)
    sunday = next(r for r in same if r["grp"] == "Group 1" and r["weekday"] == "Sunday")
    assert sunday["total_revenue_pct_diff"] == 0.0 and sunday["RP_revenue_share_pct_diff"] == 0.0


def test_weekday_and_daily_tables_include_sundays(tables):
    c = campaign(tables)
    days = {(r["grp"], r["period"], r["ordered_date"]): r for r in as_dicts(c.daily_kpis)}
    assert days["Group 1", "Promo Period", SUN]["total_revenue"] == 90.0
    weekdays = {(r["grp"], r["period"], r["weekday"]): r for r in as_dicts(c.weekday_kpis)}
    assert weekdays["Group 1", "Baseline Period", "Monday"]["AOV"] == 15.0
    assert weekdays["Group 1", "Promo Period", "Sunday"]["price_per_item"] == 30.0


def test_series_labels(tables):
    c = campaign(tables, descriptions={"Group 1": "blue"})
    rows = as_dicts(c.daily_trend(["Group 1"]), "ordered_date")
    assert rows[0]["date_weekday_label"] == "2024-01-01\nMonday"
    assert rows[0]["series"] == "Group 1 (blue) - Baseline Period"
    chart = as_dicts(c.weekday_chart(["Group 1", "Group 3"]))
    assert {r["grp"] for r in chart} == {"Group 1", "Group 3"} and {r["chart_seq"] for r in chart} == set(range(1, 12))
    assert len(series.WEEKDAY_TITLES) == 11


def test_discount_breakdown_and_bridges(tables):
    c = campaign(tables)
    rows = by_kpi(c.discount_breakdown, "Group 1")
    assert len(rows) == 12
    full = 20.0 * 3 + 45.0
    cost, red, promo = 5.0 * 3 + 20.0, 2.0 * 3, 5.0
    assert rows["Total Full Price Revenue"]["baseline_value"] == full
    assert rows["Total Full Price PC1, EUR"]["baseline_value"] == full / 1.2 - cost
    assert rows["Final PC1, EUR"]["baseline_value"] == (full - red - promo) / 1.2 - cost
    assert rows["Black Price, EUR (before all discounts and reductions)"]["baseline_value"] == full / 4.0

    steps = {(r["bridge"], r["step_seq"]): r for r in as_dicts(c.pc1_bridge_period) if r["grp"] == "Group 1"}
    total = steps["Baseline Period", 1]["value"] + steps["Baseline Period", 2]["value"] + steps["Baseline Period", 3]["value"]
    assert total == pytest.approx(steps["Baseline Period", 4]["value"])
    assert as_dicts(bridges.pc1_bridge_period(c.group_sums, c.cfg, ["Promo Period"]))[0]["bridge"] == "Promo Period"

    closed = bridges.pc1_bridge_baseline_to_promo(c.group_sums, c.cfg, show_full_price=True)
    first = sorted((r for r in as_dicts(closed) if r["grp"] == "Group 1"), key=lambda r: r["step_seq"])
    assert [r["type"] for r in first] == ["total", "delta", "delta", "delta", "total"]
    assert sum(r["value"] for r in first[:-1]) == pytest.approx(first[-1]["value"])
    assert c.pc1_bridge_baseline_to_promo.where("grp = 'Group 1'").count() == 4


def test_zero_vat_gives_zero_revenue_part(tables):
    rows = by_kpi(campaign(tables, vat=0.0).discount_breakdown, "Group 1")
    assert rows["Total Full Price PC1, EUR"]["baseline_value"] == -35.0
    assert rows["Final PC1 Margin, %%"]["baseline_value"] == 0.0


def test_negative_baseline_keeps_the_sign_of_the_base(spark):
    traffic = traffic_frame(spark, [visit(D1, 1, 1, 1, 1), visit(SAT, 1, 1, 1, 1)])
    orders = order_tables(spark, [order(1, at(D1), 1, [item(pc1=-10.0)]), order(2, at(SAT), 1, [item(pc1=5.0)])])
    row = by_kpi(Campaign(traffic, orders, config()).store_funnel, "Group 1")["total PC1"]
    assert row["abs_diff"] == 15.0 and row["pct_diff"] == -1.5


def test_group_sums_of_single_and_of_gathered_stores_agree(tables):
    cfg = config(groups={"Group 1": ["1"], "Group 4": []})
    every = funnel.group_sums(store_day.store_day(*tables, cfg), cfg)
    gathered = funnel.group_sums(store_day.store_day(*tables, cfg, cfg.all_store_codes), cfg)
    assert as_dicts(every, "grp", "period") == as_dicts(gathered, "grp", "period") and every.count() == 4


def test_traffic_of_other_stores_gives_zeros_and_no_traffic_gives_nothing(spark):
    cfg = config()
    orders = order_tables(spark, [])
    elsewhere = Campaign(traffic_frame(spark, [visit(D1, 9, 5, 5, 5)]), orders, cfg)
    assert elsewhere.store_funnel.count() == 4 * 26 and elsewhere.store_funnel_both.count() == 8 * 26
    assert {r["baseline_value"] for r in as_dicts(elsewhere.store_funnel)} == {0.0}
    on_a_sunday = Campaign(traffic_frame(spark, [visit(date(2024, 1, 7), 1, 5, 5, 5)]), orders, cfg)
    assert {r["promo_value"] for r in as_dicts(on_a_sunday.store_funnel)} == {0.0}
    nothing = Campaign(traffic_frame(spark, [visit(date(2023, 1, 7), 1, 5, 5, 5)]), orders, cfg)
    assert nothing.store_funnel.count() == 0 and nothing.store_funnel_both.count() == 0


def test_no_pairs_and_no_promo_dates(tables):
    c = campaign(tables, groups={"North": ["1"]}, promo_dates=[])
    assert c.store_promo_impact.count() == 0 and c.driver_summary.count() == 0
    rows = by_kpi(c.store_funnel, "North")
    assert rows["total revenue"]["baseline_value"] == 100.0 and rows["total revenue"]["promo_value"] == 0.0
