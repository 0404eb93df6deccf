from datetime import date, datetime

import pytest

from campaign_lift.config import CategoryFilter
from campaign_lift.operators import bridges, category
from tests.conftest import as_dicts, by_kpi, config, item, order, order_tables

D1, D2, SAT = date(2024, 1, 1), date(2024, 1, 2), date(2024, 1, 6)


def at(day: date) -> datetime:
    return datetime(day.year, day.month, day.day, 10)


def sold(section, revenue, **other):
    return item(revenue=revenue, pc1=revenue / 2, article_section=section, **other)


@pytest.fixture(scope="module")
def tables(spark):
    return order_tables(
        spark,
        [
            order(1, at(D1), 1, [sold("A", 10.0), sold("B", 20.0, red=5.0), sold("A", 30.0)], "EXISTING"),
            order(2, at(D1), 1, [sold("A", 5.0, has_promotion=True)]),
            order(3, at(D1), None, [sold("A", 1.0)]),
            order(4, at(D1), None, [sold("B", 1.0)]),
            order(5, at(D2), 1, []),
            order(6, at(SAT), 1, [sold("A", 100.0), sold("C", 7.0)], "NEW"),
            order(7, at(SAT), 2, [sold("B", 9.0, has_promotion=True)]),
        ],
    )


def test_grain_labels_and_order_counts(tables):
    rows = as_dicts(category.category_raw(tables, config()), "ordered_date", "store_code", "article_section", "insider_customer_type")
    at_store = [r for r in rows if r["store_code"] == "0001" and r["ordered_date"] == D1]
    assert {r["order_count"] for r in at_store} == {2}
    both = next(r for r in at_store if r["article_section"] == "A" and r["insider_customer_type"] == "EXISTING")
    assert both["total_revenue"] == 40.0 and both["price_type"] == "BP" and both["promo_check"] == "non-promo"
    assert both["article_season"] == "UNKNOWN"
    # Rows without a store code are one partition of their day.
    assert [r["order_count"] for r in rows if r["store_code"] is None] == [2, 2]
    empty = next(r for r in rows if r["ordered_date"] == D2)
    assert (empty["article_section"], empty["price_type"], empty["promo_check"]) == ("UNKNOWN", "BP", "non-promo")
    assert (empty["total_revenue"], empty["order_count"]) == (0.0, 1)


def test_order_count_follows_the_filters(tables):
    def counts(**lists):
        cfg = config(category=CategoryFilter(**lists))
        return {(r["ordered_date"], r["store_code"]): r["order_count"] for r in as_dicts(category.category_raw(tables, cfg))}

    assert counts(article_sections=("B",)) == {(D1, "0001"): 1, (D1, None): 1, (SAT, "0002"): 1}
    assert counts(article_sections=("UNKNOWN",)) == {(D2, "0001"): 1}
    assert counts(store_codes=("1",)) == {(D1, "0001"): 2, (D2, "0001"): 1, (SAT, "0001"): 1}
    assert counts(insider_customer_types=("EXISTING", "NEW")) == {(D1, "0001"): 1, (SAT, "0001"): 1}
    assert counts(price_types=("RP",)) == {(D1, "0001"): 1}
    assert counts(promo_checks=("promo",), store_codes=("0001",)) == {(D1, "0001"): 1}
    assert counts(article_seasons=("SS",)) == {}


def test_both_grains_agree_with_and_without_opening_items(tables):
    every_type = config(category=CategoryFilter(price_types=("RP", "BP")))
    assert as_dicts(category.category_raw(tables, config()), *category.DIMENSIONS) == as_dicts(
        category.category_raw(tables, every_type), *category.DIMENSIONS
    )


def test_funnel_nulls_and_rounding(tables):
    cfg = config()
    rows = category.category_funnel(category.category_raw(tables, cfg), cfg)
    first = {k.removesuffix(" (selected categories)"): v for k, v in by_kpi(rows, "Group 1").items()}
    assert len(first) == 22
    assert first["total orders"]["baseline_value"] == 3.0 and first["total orders"]["promo_value"] == 1.0
    assert first["AOV"]["baseline_value"] == 65.0 / 3.0
    assert first["margin"]["baseline_value"] == 0.6
    assert first["RP revenue"]["baseline_value"] == 20.0 and first["RP revenue"]["promo_value"] is None
    assert first["RP revenue"]["pct_diff"] is None and first["RP revenue"]["abs_diff"] is None
    third = {k.removesuffix(" (selected categories)"): v for k, v in by_kpi(rows, "Group 3").items()}
    assert third["total orders"]["baseline_value"] == 0.0 and third["total orders"]["pct_diff"] is None
    assert third["total orders"]["abs_diff"] == 1.0
    assert third["AOV"]["baseline_value"] is None and third["total revenue"]["promo_value"] == 9.0
    assert by_kpi(rows, "Group 4") == {}


def test_orders_are_scaled_with_the_coefficient(tables):
    cfg = config(baseline_coefficient=2.0)
    raw = category.category_raw(tables, cfg)
    assert {r["order_count"] for r in as_dicts(raw) if r["store_code"] == "0001" and r["ordered_date"] == D1} == {2}
    first = by_kpi(category.category_funnel(raw, cfg), "Group 1")
    assert first["total orders (selected categories)"]["baseline_value"] == 6.0
    assert first["total revenue (selected categories)"]["baseline_value"] == 130.0
    assert first["total orders (selected categories)"]["promo_value"] == 1.0


def test_split_bridges_close(tables):
    cfg = config()
    rows = as_dicts(bridges.split_bridges(category.category_sums(tables, cfg), cfg), "grp", "bridge", "step_seq")
    assert len({r["bridge"] for r in rows}) == 9
    steps = {(r["grp"], r["bridge"], r["step_seq"]): r for r in rows}
    existing = [steps["Group 1", "existing revenue", i] for i in range(1, 5)]
    assert [r["step"] for r in existing] == [
        "Baseline revenue",
        "Existing insider revenue change",
        "New + non insider revenue change",
        "Promo period revenue",
    ]
    # No existing insider bought in the promo period: the change is unknown, not -60.
    assert [r["value"] for r in existing] == [65.0, None, 102.0, 107.0]
    for (grp, bridge, seq), row in steps.items():
        if seq == 1:
            parts = [steps[grp, bridge, i]["value"] for i in range(1, 5)]
            if None not in parts:
                assert sum(parts[:3]) == pytest.approx(parts[3])
    assert all(r["grp"] != "Group 4" for r in rows)


def values(frame, grp="Group 1"):
    rows = sorted((r for r in as_dicts(frame) if r["grp"] == grp), key=lambda r: r["step_seq"])
    assert [r["step_seq"] for r in rows] == list(range(1, len(rows) + 1))
    return [(r["step"], r["value"]) for r in rows]


def test_dimension_bridge_one_sided_values(tables):
    cfg = config()
    facts = category.category_sums(tables, cfg)
    every = bridges.dimension_bridge(facts, cfg, "article_section", "revenue")
    # B (baseline only), UNKNOWN (baseline only) and C (promo only) count as 0.
    assert values(every) == [("Baseline revenue", 65.0), ("A", 55.0), ("Promo period revenue", 107.0)]
    counted = bridges.dimension_bridge(facts, cfg, "article_section", "revenue", one_sided="value")
    assert values(counted) == [
        ("Baseline revenue", 65.0),
        ("A", 55.0),
        ("C", 7.0),
        ("Other", -20.0),
        ("Promo period revenue", 107.0),
    ]
    with pytest.raises(ValueError):
        bridges.dimension_bridge(facts, cfg, "article_section", "revenue", one_sided="maybe")


def test_dimension_bridge_selected_values(tables):
    cfg = config()
    facts = category.category_sums(tables, cfg)
    few = bridges.dimension_bridge(facts, cfg, "article_section", "revenue", ["Z", "A", "", "C"])
    assert values(few) == [("Baseline revenue", 65.0), ("A", 55.0), ("C", 0.0), ("Z", 0.0), ("Promo period revenue", 107.0)]
    many = bridges.dimension_bridge(facts, cfg, "article_section", "revenue", ["B", "C", "Y", "Z"], one_sided="value")
    assert values(many) == [("Baseline revenue", 65.0), ("C", 7.0), ("Other", -20.0), ("Promo period revenue", 107.0)]
    none = bridges.dimension_bridge(facts, cfg, "article_section", "revenue", ["W", "X", "Y", "Z"])
    assert values(none) == [("Baseline revenue", 65.0), ("Promo period revenue", 107.0)]


def test_top_three_gains_and_other(spark):
    gains = {"A": 5.0, "B": 5.0, "C": 40.0, "D": 1.0, "E": -8.0}
    rows = [order(1, at(D1), 1, [sold(s, 10.0) for s in gains]), order(2, at(SAT), 1, [sold(s, 10.0 + g) for s, g in gains.items()])]
    cfg = config()
    frame = bridges.dimension_bridge(category.category_sums(order_tables(spark, rows), cfg), cfg, "article_section", "revenue")
    assert values(frame) == [
        ("Baseline revenue", 50.0),
        ("C", 40.0),
        ("A", 5.0),
        ("B", 5.0),
        ("Other", -7.0),
        ("Promo period revenue", 93.0),
    ]


def test_waterfall_coordinates(spark):
    rows = [
        ("g", "x", 1, "start", 10.5, "total"),
        ("g", "x", 2, "up", 3.5, "delta"),
        ("g", "x", 3, "down", -20.0, "delta"),
        ("g", "x", 4, "none", None, "delta"),
        ("g", "x", 5, "end", 2.0, "total"),
        ("g", "x", 6, "more", 1.0, "delta"),
        ("g", "y", 1, "first", -3.0, "delta"),
    ]
    frame = spark.createDataFrame(rows, "grp string, bridge string, step_seq int, step string, value double, type string")
    got = as_dicts(bridges.waterfall_coordinates(frame), "bridge", "step_seq")
    assert [(r["value"], r["start"], r["end"], r["lower"], r["upper"], r["color_type"]) for r in got] == [
        (10.0, 0.0, 10.0, 0.0, 10.0, "total"),
        (4.0, 10.0, 14.0, 10.0, 14.0, "increase"),
        (-20.0, 14.0, -6.0, -6.0, 14.0, "decrease"),
        (0.0, -6.0, -6.0, -6.0, -6.0, "increase"),
        (2.0, 0.0, 2.0, 0.0, 2.0, "total"),
        (1.0, 2.0, 3.0, 2.0, 3.0, "increase"),
        (-3.0, 0.0, -3.0, -3.0, 0.0, "decrease"),
    ]
