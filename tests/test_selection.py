"""Choices from option lists: all, include, except, in facts, groups and the selection record."""

import json
from dataclasses import replace
from datetime import date, datetime

import pytest

from __spark_entry__ import queries
from campaign_lift.config import CategoryFilter, Selection
from campaign_lift.operators import category, decision
from campaign_lift.plans.campaign import Campaign
from tests.conftest import as_dicts, config, item, order, order_tables, plan_text, traffic_frame, visit

FOLDER = "/root/testdata/sf0.001"
D1, SAT = datetime(2024, 1, 1), datetime(2024, 1, 6)


@pytest.fixture(scope="module")
def tables(spark):
    rows = [
        order(1, D1, 1, [item(revenue=1.0, article_section="A"), item(revenue=2.0, article_section="B")]),
        order(2, D1, 2, [item(revenue=4.0, article_section=None)]),
        order(3, SAT, 3, [item(revenue=8.0, article_section="C")]),
        order(4, SAT, None, [item(revenue=16.0, article_section="A")]),
        order(5, D1, 9, [item(revenue=32.0, article_section="D")], channel="ONLINE"),
        order(6, SAT, 2, []),
    ]
    return order_tables(spark, rows)


def revenue(tables, **lists):
    rows = as_dicts(category.category_raw(tables, config(category=CategoryFilter(**lists))))
    return sum(r["total_revenue"] for r in rows), {(r["store_code"], r["order_count"]) for r in rows}


def test_except_lists_reach_the_fact(tables):
    assert revenue(tables, article_sections=Selection("except", ("A",)))[0] == 14.0
    # a missing section goes by its label; the order without items has it as well
    assert revenue(tables, article_sections=Selection("except", ("UNKNOWN", "A"))) == (10.0, {("0001", 1), ("0003", 1)})
    assert revenue(tables, article_sections=Selection("except", ("Z",)))[0] == 31.0
    assert revenue(tables, article_sections=Selection("except"))[0] == 31.0
    assert revenue(tables, article_sections=Selection("all"))[0] == 31.0
    assert revenue(tables, article_sections=Selection("include", ("A", "C")))[0] == 25.0


def test_except_of_every_option_filters_nothing(tables):
    every = Selection("except", ("A", "B", "C", "UNKNOWN"))
    assert revenue(tables, article_sections=every) == revenue(tables)
    # an option of the online seller is none here; an option of another store is one
    assert revenue(tables, article_sections=Selection("except", ("A", "B", "UNKNOWN")), store_codes=("1",))[0] == 0.0
    assert revenue(tables, article_sections=every, article_section_groups=Selection("except", ("UNKNOWN",)))[0] == 31.0
    both = {"article_sections": every, "article_seasons": Selection("except", ("SS",)), "price_types": ("BP",)}
    assert revenue(tables, **both)[0] == 31.0


def test_except_is_tested_below_the_aggregation_by_a_subquery(spark):
    lines = plan_text(queries()["category_raw_except"](spark, FOLDER)).split("\n")
    expand = next(i for i, line in enumerate(lines) if "Expand" in line)
    tests = [i for i, line in enumerate(lines) if "Filter" in line and "subquery" in line.lower()]
    assert tests and min(tests) > expand  # deeper lines run first
    assert not any("NestedLoop" in line for line in lines)


def test_groups_of_all_stores_or_all_except_some(spark, tables):
    traffic = traffic_frame(spark, [visit(d.date(), s, 10 * s, s, 1) for d in (D1, SAT) for s in (1, 2, 3, 4)])
    groups = {"Group 1": Selection("all"), "Group 2": Selection("except", ("1", "0003")), "Group 3": ["3"], "Group 4": Selection("except", ("1", "2", "3"))}
    listed = {"Group 1": ["1", "2", "3"], "Group 2": ["2"], "Group 3": ["3"], "Group 4": []}
    pairs = [("Group 1", "Group 2"), ("Group 4", "Group 3")]
    opened, closed = (Campaign(traffic, tables, config(groups=g, pairs=pairs)) for g in (groups, listed))
    for build in (
        lambda c: c.store_funnel,
        lambda c: c.store_funnel_both,
        lambda c: c.category_funnel,
        lambda c: c.weekday_kpis,
        lambda c: c.store_subset_export,
        lambda c: c.split_bridges(),
        lambda c: c.ab_winner(),
        lambda c: decision.payload_json(c.report_payload),
    ):
        assert sorted(map(str, build(opened).collect())) == sorted(map(str, build(closed).collect()))


def test_open_groups_need_their_members(spark):
    cfg = config(groups={"Group 1": Selection("all")}, pairs=[])
    with pytest.raises(ValueError, match="table of members"):
        cfg.member_frame(spark)
    with pytest.raises(ValueError, match="no list of codes"):
        cfg.all_store_codes
    with pytest.raises(ValueError, match="unknown selection mode"):
        Selection("none")


def test_selection_record_holds_each_choice_as_made():
    cfg = config(
        groups={"Group 1": Selection("all"), "Group 2": Selection("except", ("7", "8")), "Group 3": ["49"], "Group 4": []},
        category=CategoryFilter(
            store_codes=("5",), article_sections=Selection("except", ("B", "A")), article_seasons=("SS",), article_brand_groups=Selection("all"),
            price_types=("RP",),
        ),
        promo_mechanism="BP_ONLY",
        descriptions={"Group 3": "tést"},
    )
    record = json.loads(decision.selection_json(cfg, include_sunday=True))
    assert record["groups"] == {
        "Group 1": {"select all stores": True},
        "Group 2": {"select all stores": False, "except": ["0007", "0008"]},
        "Group 3": {"select all stores": False, "include": ["0049"]},
        "Group 4": {"select all stores": False, "include": []},
    }
    assert record["article_sections"] == {"select all article_section": False, "except": ["B", "A"]}
    assert record["article_seasons"] == {"select all article_season": False, "include": ["SS"]}
    assert record["article_brand_groups"] == {"select all article_brand_group": True}
    assert record["article_section_groups"] == {"select all article_section_group": True}
    assert record["price_types"] == ["RP"] and record["category_store_codes"] == ["0005"]
    assert record["pairs"] == [{"control_group": "Group 1", "testing_group": "Group 3"}]
    assert record["promo_mechanism"] == "BP_ONLY" and record["include_sunday"] is True
    assert record["baseline_dates"] == ["2024-01-01", "2024-01-02"] and record["group_descriptions"]["Group 3"] == "tést"
    assert replace(cfg, promo_dates=[date(2024, 2, 1)]).open_groups.keys() == {"Group 1", "Group 2"}
