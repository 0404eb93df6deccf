import json

import pytest
from pyspark.sql import functions as F

from campaign_lift.functions import formats
from campaign_lift.operators import decision, narrative
from tests.conftest import as_dicts, config

FUNNEL = "grp string, kpi_seq int, kpi string, baseline_value double, promo_value double, pct_diff double, abs_diff double"


def funnel(spark, groups: dict[str, dict[str, tuple]]):
    """Rows from {group: {kpi: (baseline, promo) or pct_diff}}."""
    rows = []
    for grp, kpis in groups.items():
        for seq, (kpi, value) in enumerate(kpis.items(), start=1):
            if isinstance(value, tuple):
                b, p = value
                rows.append((grp, seq, kpi, b, p, (p - b) / b if b else 0.0, p - b))
            else:
                rows.append((grp, seq, kpi, None, None, value, value))
    return spark.createDataFrame(rows, FUNNEL)


def pairs(spark, control, testing, **changes):
    cfg = config(**changes)
    return decision.pair_tables(funnel(spark, {"Group 1": control, "Group 3": testing}), cfg), cfg


def primary(revenue, pc1, margin):
    return {"total revenue": revenue, "total PC1": pc1, "margin": margin}


def many_pairs(spark, cases, **changes):
    """One frame for many (control, testing) cases; case i compares groups "c<i>" and "t<i>"."""
    groups = {f"{side}{i}": kpis for i, case in enumerate(cases) for side, kpis in zip("ct", case, strict=True)}
    cfg = config(groups={g: ["1"] for g in groups}, pairs=[(f"c{i}", f"t{i}") for i in range(len(cases))], **changes)
    return decision.pair_tables(funnel(spark, groups), cfg), cfg


def in_case_order(rows):
    return sorted(rows, key=lambda r: int(r["control_group"][1:]))


def test_winner(spark):
    cases = [
        ((0.10, 0.10, 0.10), "testing", "high", (3, 0), ["total revenue", "total PC1", "margin"]),
        ((0.10, 0.10, 0.005), "testing", "medium", (2, 0), ["total revenue", "total PC1"]),
        ((0.10, 0.10, -0.50), "testing", "medium", (2, 1), ["total revenue", "total PC1"]),
        ((-0.10, -0.10, -0.10), "control", "high", (0, 3), ["total revenue", "total PC1", "margin"]),
        ((0.10, 0.0, 0.0), "testing", "low", (1, 0), ["total revenue"]),
        ((0.10, -0.10, 0.0), "tie", "low", (1, 1), ["margin"]),
        ((0.01, -0.01, None), "tie", "low", (1, 1), []),
        ((None, None, None), "tie", "low", (0, 0), []),
    ]
    frame, _ = many_pairs(spark, [(primary(0.0, 0.0, 0.0), primary(*testing)) for testing, *_ in cases])
    rows = in_case_order(as_dicts(decision.ab_winner(frame)))
    got = [
        (r["winner"], r["confidence"], (r["testing_votes"], r["control_votes"]), r["reason_codes"]) for r in rows
    ]
    assert got == [tuple(want) for _, *want in cases]


def test_winner_rules_and_missing_kpis(spark):
    frame, _ = pairs(spark, {"x": 0.0, "y": 0.0}, {"x": 0.3})
    (row,) = as_dicts(decision.ab_winner(frame, primary_kpis=("x", "y"), min_uplift=0.2, min_support_kpis=1))
    assert (row["winner"], row["confidence"]) == ("testing", "medium")
    comparisons = as_dicts(decision.ab_comparisons(frame, primary_kpis=("x", "y")), "kpi")
    assert [c["decision"] for c in comparisons] == ["testing", "insufficient_data"]


def test_drivers(spark):
    frame, _ = pairs(spark, {"a": 0.1, "b": -0.4, "c": None, "d": 0.1, "e": 0.02}, {"a": 0.3, "z": 1.0})
    rows = as_dicts(decision.kpi_drivers(frame, top_n=2, min_abs_value=0.05), "source", "ranking", "position")

    def listed(source, ranking):
        return [(r["kpi"], r["value"]) for r in rows if r["source"] == source and r["ranking"] == ranking]

    assert listed("control_group_drivers", "top_positive") == [("a", 0.1), ("d", 0.1)]
    # The n smallest, whatever their sign.
    assert listed("control_group_drivers", "top_negative") == [("b", -0.4), ("a", 0.1)]
    assert listed("control_group_drivers", "top_absolute") == [("b", -0.4), ("a", 0.1)]
    assert [k for k, _ in listed("promo_impact_drivers", "top_positive")] == ["a"]
    assert listed("testing_group_drivers", "top_absolute") == [("z", 1.0), ("a", 0.3)]


def test_payload(spark):
    frame, cfg = pairs(spark, primary(0.0, 0.1, 0.2), primary(0.1, 0.1, 0.1), descriptions={"Group 3": "offer"})
    (row,) = decision.payload_json(decision.report_payload(frame, cfg)).collect()
    payload = json.loads(row["payload"])
    assert payload["meta"]["control_group"] == {"name": "Group 1", "description": "", "store_codes": ["0001"]}
    assert payload["meta"]["testing_group"]["description"] == "offer"
    assert payload["meta"]["baseline_dates"] == ["2024-01-01", "2024-01-02"]
    assert [k["kpi"] for k in payload["kpis"]["control_funnel"]] == ["total revenue", "total PC1", "margin"]
    assert payload["kpis"]["promo_impact"][0]["testing_minus_control_pct_diff"] == 0.1
    assert payload["winner_assessment"]["vote_count"] == {"testing": 1, "control": 1}
    assert payload["phase1_driver_analysis"]["testing_group_drivers"]["top_positive"][0]["kpi"] == "total revenue"


def full(revenue, absorption, orders, aov, quantity, price, existing, rp):
    return {
        "total revenue": revenue,
        "store absorption rate": absorption,
        "total orders": orders,
        "AOV": aov,
        "total quantity": quantity,
        "price per item": price,
        "existing revenue": existing,
        "RP revenue": rp,
    }


UP, DOWN, FLAT = (100.0, 110.0), (100.0, 80.0), (100.0, 100.0)


def codes(spark, cases, mechanism="BOTH"):
    frame, cfg = many_pairs(spark, [(full(*kpis), full(*kpis)) for kpis in cases], promo_mechanism=mechanism)
    rows = [r for r in as_dicts(narrative.driver_insights(frame, cfg)) if r["role"] == "control"]
    return in_case_order(rows)


def test_customer_codes(spark):
    cases = [
        ((50.0, 60.0), (100.0, 105.0), "CANNIBALISATION"),
        ((50.0, 60.0), (100.0, 120.0), "SYNERGY"),
        ((50.0, 40.0), (100.0, 80.0), "CONTRACTION"),
        ((50.0, 40.0), (100.0, 120.0), "ACQUISITION"),
        ((50.0, 50.0), (100.0, 120.0), "SHIFTING"),
        ((100.0, 90.0), (100.0, 120.0), "SHIFTING"),  # nobody else bought in the baseline: no percentage
    ]
    rows = codes(spark, [(revenue, UP, UP, UP, UP, UP, existing, (10.0, 10.0)) for existing, revenue, _ in cases])
    assert [r["customer_code"] for r in rows] == [code for *_, code in cases]


@pytest.mark.parametrize(
    ("mechanism", "cases"),
    [
        (
            "BOTH",
            [
                ((10.0, 20.0), (100.0, 120.0), "BOTH_UP_RP"),
                ((10.0, 11.0), (100.0, 150.0), "BOTH_UP_BP"),
                ((10.0, 5.0), (100.0, 120.0), "TRADED_UP"),
                ((10.0, 50.0), (100.0, 120.0), "DEEP_DISCOUNT"),
                ((10.0, 10.0), (100.0, 100.0), "BOTH_DOWN"),
            ],
        ),
        (
            "bp_only",
            [
                ((10.0, 5.0), (100.0, 120.0), "BP_SHIFT"),
                ((10.0, 20.0), (100.0, 120.0), "BP_HALO"),
                ((10.0, 20.0), (100.0, 90.0), "BP_FAILED"),
                ((10.0, 10.0), (100.0, 120.0), "NONE"),
            ],
        ),
        (
            "RP_ONLY",
            [
                ((10.0, 20.0), (100.0, 90.0), "RP_CANNIBALISED"),
                ((10.0, 20.0), (100.0, 120.0), "RP_SYNERGY"),
                ((10.0, 5.0), (100.0, 120.0), "RP_FAILED"),
                ((0.0, 5.0), (100.0, 120.0), "NONE"),  # a zero base is no change
            ],
        ),
    ],
)
def test_price_mix_codes(spark, mechanism, cases):
    rows = codes(spark, [(revenue, UP, UP, UP, UP, UP, (50.0, 50.0), rp) for rp, revenue, _ in cases], mechanism)
    assert [r["price_mix_code"] for r in rows] == [code for *_, code in cases]


def test_funnel_codes(spark):
    rest = ((50.0, 50.0), (10.0, 10.0))
    cases = [
        (UP, UP, UP, UP, UP, (100.0, 105.0), *rest),
        (UP, UP, DOWN, UP, UP, (100.0, 150.0), *rest),
        (UP, FLAT, UP, FLAT, UP, DOWN, *rest),
        (UP, FLAT, UP, FLAT, DOWN, UP, *rest),
    ]
    got = [(r["order_code"], r["aov_code"], r["item_code"]) for r in codes(spark, cases)]
    assert got == [
        ("ABSORPTION_SAME", "AMPLIFIED", "QUANTITY_THEN_PRICE"),
        ("ABSORPTION_DIVERGES", "OFFSET", "PRICE_THEN_QUANTITY"),
        ("ORDERS_ONLY", "ACCOMPANIED", "QUANTITY_OFFSET_BY_PRICE"),
        ("ORDERS_ONLY", "ACCOMPANIED", "PRICE_MITIGATES_QUANTITY"),
    ]


def test_summary_text(spark):
    kpis = full((1000.0, 1250.0), (0.2, 0.3), UP, UP, DOWN, UP, (400.0, 500.0), (100.0, 50.0))
    frame, cfg = pairs(spark, kpis, kpis)
    (row,) = narrative.driver_summary(frame, cfg).collect()
    lines = row["summary"].split("\n")
    assert lines[:5] == [
        "# Campaign Post-Mortem Summary (Phase 1)",
        "",
        "- **Baseline Period:** 2024-01-01, 2024-01-02",
        "- **Promo Period:** 2024-01-06, 2024-01-07",
        "",
    ]
    assert lines[5] == "## Group A Performance Drivers (Promo vs. Baseline)"
    assert lines[6] == "**Overall:** Group A (Group 1) total revenue increased by **25.00%** compared to the baseline period."
    assert lines[8] == (
        "* **Order-Level Funnel:** A notable tailwind was a 50.00% increase in store absorption rate, which drove a 10.00% "
        "increase in total orders. This volume impact was further amplified by a 10.00% increase in Average Order Value (AOV)."
    )
    assert lines[9] == (
        "* **Item-Level Funnel:** The revenue growth was primarily driven by a 10.00% increase in price per item, "
        "mitigating the 20.00% decline in total item quantity."
    )
    assert lines[10] == (
        "* **Price-Type Mix-Shift:** Black Price (BP) revenue increased by 33.33% (Abs: 300). Concurrently, Red Price (RP) "
        "revenue decreased by 50.00% (Abs: -50). Despite a store-wide offer, shoppers clearly traded up to Black Price "
        "merchandise, leaving Red Price volume to contract."
    )
    assert lines[11] == (
        "* **Customer Mix-Shift:** Existing insider revenue increased by 25.00% (Abs: 100). Meanwhile, new and non-insider "
        "revenue increased by 25.00% (Abs: 150), demonstrating broad-based synergistic growth across both customer cohorts."
    )
    assert lines[13] == "## Group B Performance Drivers (Promo vs. Baseline)"
    assert lines[14].startswith("**Overall:** Group B (Group 3) total revenue")
    assert lines[-2:] == ["---", "> *Note: This summary is generated from deterministic KPI rules and dynamic templates.*"]


def test_missing_kpis_are_said_to_be_missing(spark):
    frame, cfg = pairs(spark, {"total revenue": 0.1}, {"total revenue": 0.1})
    (row,) = narrative.driver_summary(frame, cfg).collect()
    assert "split data is unavailable." in row["summary"] and "attribution is not reliable" in row["summary"]
    assert "Total orders remained flat by N/A. This was accompanied by a N/A change" in row["summary"]


def test_number_texts_match_python(spark):
    values = [0.0, -0.0, 0.5, 1.5, 2.5, -0.3, 1234567.5, -1234.5, 0.00125, 0.125, 12.3456789, -0.00004, 1e12]
    frame = spark.createDataFrame([(v,) for v in values], "v double").select(
        "v", formats.percent(F.col("v")).alias("pct"), formats.thousands(F.col("v")).alias("num")
    )
    for row in frame.collect():
        assert row["num"] == f"{row['v']:,.0f}"
        assert row["pct"] == f"{row['v']:.2%}"


def test_kpi_texts(spark):
    rows = [("margin", 0.123456), (" RP Margin (selected categories)", 0.5), ("AOV", 1234.5), ("AOV", None), ("existing revenue share", None)]
    frame = spark.createDataFrame(rows, "kpi string, v double")
    texts = [r[0] for r in frame.select(formats.kpi_text(F.col("kpi"), F.col("v"))).collect()]
    assert texts == ["12.35%", "50.00%", "1,234", "-", "-"]
