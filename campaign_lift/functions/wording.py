"""The sentences of the summary text, as templates with named holes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Headings and frame.
TITLE = "# Campaign Post-Mortem Summary (Phase 1)"
BASELINE_LINE = "- **Baseline Period:** {dates}"
PROMO_LINE = "- **Promo Period:** {dates}"
RULE = "---"
NOTE = "> *Note: This summary is generated from deterministic KPI rules and dynamic templates.*"
GROUP_HEADING = "## {label} Performance Drivers (Promo vs. Baseline)"
OVERALL = "**Overall:** {label} ({group}) total revenue {verb} by **{pct}** compared to the baseline period."

# Directions.
VERBS = {"flat": "remained flat", "up": "increased", "down": "decreased"}
NOUNS = {"flat": "change", "up": "increase", "down": "decline"}

# Order-level funnel.
ORDERS_ONLY = "* **Order-Level Funnel:** Total orders {order_verb} by {order_pct}. {aov}"
ORDERS_WITH_ABSORPTION = (
    "* **Order-Level Funnel:** A notable {wind} was a {absorb_pct} {absorb_noun} in store absorption rate, {link}. {aov}"
)
TAILWIND = "tailwind"
HEADWIND = "headwind"
LINK_SAME = "which drove a {order_pct} {order_noun} in total orders"
LINK_DIVERGE = "however, total orders {order_verb} by {order_pct}"
AOV_AMPLIFIED = "This volume impact was further amplified by a {aov_pct} {aov_noun} in Average Order Value (AOV)."
AOV_OFFSET = "This volume impact was partially offset by a {aov_pct} {aov_noun} in Average Order Value (AOV)."
AOV_ACCOMPANIED = "This was accompanied by a {aov_pct} {aov_noun} in Average Order Value (AOV)."

# Item-level funnel.
ITEM_LEAD = "* **Item-Level Funnel:** The revenue {movement} was primarily driven by a {first_pct} {first_noun} in {first}"
ITEM_SAME = ITEM_LEAD + ", and further {pull} by a {second_pct} {second_noun} in {second}."
ITEM_OFFSET = ITEM_LEAD + ", which was partially offset by a {second_pct} {second_noun} in {second}."
ITEM_MITIGATED = ITEM_LEAD + ", mitigating the {second_pct} {second_noun} in {second}."
QUANTITY_NAME = "total item quantity"
ITEM_PRICE_NAME = "price per item"
GROWTH = "growth"
DECLINE = "decline"
BOOSTED = "boosted"
DRAGGED = "dragged down"

# Price mix.
PRICE_MIX_MISSING = "* **Price-Type Mix-Shift:** Red Price (RP) and Black Price (BP) split data is unavailable."
PRICE_MIX = (
    "* **Price-Type Mix-Shift:** Black Price (BP) revenue {bp_verb} by {bp_pct} (Abs: {bp_abs}). "
    "Concurrently, Red Price (RP) revenue {rp_verb} by {rp_pct} (Abs: {rp_abs}). {insight}"
)
PRICE_MIX_INSIGHTS = {
    "BP_SHIFT": "The BP-targeted promotion successfully shifted shopper focus toward regular assortment, temporarily suppressing clearance (RP) sales.",
    "BP_HALO": "The BP-targeted promotion not only drove regular assortment sales but also generated a strong halo effect, boosting clearance (RP) sales alongside it.",
    "BP_FAILED": "Unexpectedly, the BP-targeted promotion failed to stimulate Black Price sales, indicating potential issues with offer attractiveness or merchandise.",
    "RP_CANNIBALISED": "The RP-targeted promotion effectively accelerated clearance but resulted in cannibalization, drawing volume away from Black Price (BP) merchandise.",
    "RP_SYNERGY": "The clearance event (RP) successfully drove traffic that crossed over to Black Price items, yielding synergistic growth across both price types.",
    "RP_FAILED": "Despite the targeted discount, Red Price revenue declined, suggesting clearance inventory might be depleted or lacking appeal.",
    "BOTH_UP_BP": "The broad promotion lifted both segments, with BP acting as the primary growth engine, driving the overall mix.",
    "BOTH_UP_RP": "The broad promotion lifted both segments, with RP acting as the primary growth engine, driving the overall mix.",
    "TRADED_UP": "Despite a store-wide offer, shoppers clearly traded up to Black Price merchandise, leaving Red Price volume to contract.",
    "DEEP_DISCOUNT": "Despite a store-wide offer, shoppers exhibited deep-discount seeking behavior, driving Red Price growth at the expense of Black Price volume.",
    "BOTH_DOWN": "Both Black Price and Red Price segments experienced contraction despite the promotion.",
    "NONE": "",
}

# Customer mix.
CUSTOMER_MISSING = (
    "* **Customer Mix-Shift:** Existing-insider vs new/non-insider split is unavailable, "
    "so structural source attribution is not reliable for this group."
)
CUSTOMER_MIX = (
    "* **Customer Mix-Shift:** Existing insider revenue {existing_verb} by {existing_pct} (Abs: {existing_abs}). "
    "Meanwhile, new and non-insider revenue {new_verb} by {new_pct} (Abs: {new_abs}), {insight}"
)
CUSTOMER_INSIGHTS = {
    "CANNIBALISATION": "indicating strong cannibalization, as the promotion largely shifted existing engagement rather than acquiring new volume.",
    "SYNERGY": "demonstrating broad-based synergistic growth across both customer cohorts.",
    "CONTRACTION": "reflecting an across-the-board contraction in both customer segments.",
    "ACQUISITION": "suggesting that new customer acquisition partially offset the churn or decline in existing insider engagement.",
    "SHIFTING": "highlighting the shifting dynamics between customer cohorts.",
}


def fill(template: str, **holes: Column) -> Column:
    """The template with its holes filled by columns."""
    parts = [
        holes[part[1:-1]] if part.startswith("{") else F.lit(part) for part in re.split(r"(\{\w+\})", template) if part
    ]
    return F.concat(*parts)


def lookup(code: Column, texts: dict[str, str]) -> Column:
    """The text of a code."""
    chain = F
    for key, text in texts.items():
        chain = chain.when(code == key, F.lit(text))
    return chain
