"""Rule-based reading of a group's funnel: codes first, sentences from the codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campaign_lift.config import PROMO_MECHANISMS, CampaignConfig
from campaign_lift.functions import wording as W
from campaign_lift.functions.formats import abs_percent_or_na, number_or_na
from campaign_lift.operators.decision import PAIR

ROLE_LABELS = {"control": "Group A", "testing": "Group B"}  # fixed value


def direction(value: Column) -> Column:
    """"up", "down", or "flat" for no change and for a missing value."""
    return F.when(value > 0, "up").when(value < 0, "down").otherwise("flat")


def _is(name: str, way: str) -> Column:
    return F.col(name) == way


def group_facts(pairs: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    """One row per pair and role with the changes that the rules read. ``keys`` are the columns that name a pair."""
    sides = F.array(
        *[
            F.struct(
                F.lit(role).alias("role"),
                F.lit(label).alias("label"),
                F.col(f"{role}_group").alias("grp"),
                F.col(f"{role}_by_kpi").alias("by_kpi"),
            )
            for role, label in ROLE_LABELS.items()
        ]
    )
    rows = pairs.select(*keys, F.inline(sides))

    def read_kpi(kpi: str, field: str) -> Column:
        return F.col("by_kpi")[kpi][field]

    def pct(kpi: str) -> Column:
        return read_kpi(kpi, "pct_diff")

    read = {
        "revenue_pct": pct("total revenue"),
        "absorb_pct": pct("store absorption rate"),
        "order_pct": pct("total orders"),
        "aov_pct": pct("AOV"),
        "qty_pct": pct("total quantity"),
        "ppi_pct": pct("price per item"),
        "existing_pct": pct("existing revenue"),
        "total_abs": read_kpi("total revenue", "abs_diff"),
        "existing_abs": read_kpi("existing revenue", "abs_diff"),
    }
    for name, kpi in (("total", "total revenue"), ("existing", "existing revenue"), ("rp", "RP revenue")):
        read[f"{name}_b"] = read_kpi(kpi, "baseline_value")
        read[f"{name}_p"] = read_kpi(kpi, "promo_value")
    rows = rows.withColumns(read)

    new_b, new_p = F.col("total_b") - F.col("existing_b"), F.col("total_p") - F.col("existing_p")
    bp_b, bp_p = F.col("total_b") - F.col("rp_b"), F.col("total_p") - F.col("rp_p")
    rp_b, rp_p = F.col("rp_b"), F.col("rp_p")
    return rows.withColumns(
        {
            "new_abs": F.coalesce(new_p - new_b, F.col("total_abs") - F.col("existing_abs")),
            "new_pct": F.try_divide(new_p - new_b, new_b),
            "bp_abs": bp_p - bp_b,
            "bp_pct": F.when(bp_b == 0, F.lit(0.0)).otherwise(F.try_divide(bp_p - bp_b, bp_b)),
            "rp_abs": rp_p - rp_b,
            "rp_pct": F.when(rp_b == 0, F.lit(0.0)).otherwise(F.try_divide(rp_p - rp_b, rp_b)),
        }
    ).withColumns(
        {
            f"{name}_dir": direction(F.col(f"{name}_pct"))
            for name in ("revenue", "absorb", "order", "aov", "qty", "ppi", "existing", "new", "bp", "rp")
        }
    )


def driver_codes(pairs: DataFrame, mechanism: str | Column, keys: Sequence[str] = PAIR) -> DataFrame:
    """Facts of each pair and role with the outcome of every rule as a code. The mechanism is one of PROMO_MECHANISMS, or a
    column of them among the keys."""
    if isinstance(mechanism, str):
        price_mix = _price_mix_code(mechanism.upper())
    else:
        price_mix = F.coalesce(*[F.when(F.upper(mechanism) == m, _price_mix_code(m)) for m in PROMO_MECHANISMS])
    return group_facts(pairs, keys).withColumns(
        {
            "aov_code": _aov_code(),
            "order_code": _order_code(),
            "item_code": _item_code(),
            "price_mix_code": price_mix,
            "customer_code": _customer_code(),
        }
    )


def _aov_code() -> Column:
    order, aov = F.col("order_dir"), F.col("aov_dir")
    return F.when((order == "flat") | (aov == "flat"), "ACCOMPANIED").when(order == aov, "AMPLIFIED").otherwise("OFFSET")


def _order_code() -> Column:
    absorb, order = F.col("absorb_dir"), F.col("order_dir")
    return F.when(absorb == "flat", "ORDERS_ONLY").when(absorb == order, "ABSORPTION_SAME").otherwise("ABSORPTION_DIVERGES")


def _item_code() -> Column:
    size_qty, size_ppi = (F.abs(F.coalesce(F.col(c), F.lit(0.0))) for c in ("qty_pct", "ppi_pct"))
    same = F.col("qty_dir") == F.col("ppi_dir")
    return (
        F.when(same & (size_qty >= size_ppi), "QUANTITY_THEN_PRICE")
        .when(same, "PRICE_THEN_QUANTITY")
        .when(F.col("qty_dir") == F.col("revenue_dir"), "QUANTITY_OFFSET_BY_PRICE")
        .otherwise("PRICE_MITIGATES_QUANTITY")
    )


def _price_mix_code(mechanism: str) -> Column:
    bp_up, bp_down, rp_up, rp_down = _is("bp_dir", "up"), _is("bp_dir", "down"), _is("rp_dir", "up"), _is("rp_dir", "down")
    if mechanism == "BP_ONLY":
        code = F.when(bp_up & rp_down, "BP_SHIFT").when(bp_up & rp_up, "BP_HALO").when(bp_down, "BP_FAILED").otherwise("NONE")
    elif mechanism == "RP_ONLY":
        code = F.when(rp_up & bp_down, "RP_CANNIBALISED").when(rp_up & bp_up, "RP_SYNERGY").when(rp_down, "RP_FAILED").otherwise("NONE")
    else:
        code = (
            F.when(bp_up & rp_up & (F.col("bp_pct") > F.col("rp_pct")), "BOTH_UP_BP")
            .when(bp_up & rp_up, "BOTH_UP_RP")
            .when(bp_up & rp_down, "TRADED_UP")
            .when(rp_up & bp_down, "DEEP_DISCOUNT")
            .otherwise("BOTH_DOWN")
        )
    return F.when(F.col("rp_abs").isNull() | F.col("bp_abs").isNull(), "UNAVAILABLE").otherwise(code)


def _customer_code() -> Column:
    old_up, old_down = _is("existing_dir", "up"), _is("existing_dir", "down")
    new_up, new_down = _is("new_dir", "up"), _is("new_dir", "down")
    return (
        F.when(F.col("existing_abs").isNull() | F.col("new_abs").isNull(), "UNAVAILABLE")
        .when(old_up & new_down, "CANNIBALISATION")
        .when(old_up & new_up, "SYNERGY")
        .when(old_down & new_down, "CONTRACTION")
        .when(old_down & new_up, "ACQUISITION")
        .otherwise("SHIFTING")
    )


def _holes(name: str) -> dict[str, Column]:
    """Percent, verb and noun of one change."""
    way = F.col(f"{name}_dir")
    return {
        f"{name}_pct": abs_percent_or_na(F.col(f"{name}_pct")),
        f"{name}_verb": W.lookup(way, W.VERBS),
        f"{name}_noun": W.lookup(way, W.NOUNS),
    }


def _order_sentence() -> Column:
    order, aov, absorb = _holes("order"), _holes("aov"), _holes("absorb")
    aov_text = (
        F.when(F.col("aov_code") == "AMPLIFIED", W.fill(W.AOV_AMPLIFIED, **aov))
        .when(F.col("aov_code") == "OFFSET", W.fill(W.AOV_OFFSET, **aov))
        .otherwise(W.fill(W.AOV_ACCOMPANIED, **aov))
    )
    code = F.col("order_code")
    link = F.when(code == "ABSORPTION_SAME", W.fill(W.LINK_SAME, **order)).otherwise(W.fill(W.LINK_DIVERGE, **order))
    wind = F.when(_is("absorb_dir", "up"), W.TAILWIND).otherwise(W.HEADWIND)
    return F.when(code == "ORDERS_ONLY", W.fill(W.ORDERS_ONLY, aov=aov_text, **order)).otherwise(
        W.fill(W.ORDERS_WITH_ABSORPTION, wind=wind, link=link, aov=aov_text, **absorb)
    )


def _item_sentence() -> Column:
    up = _is("revenue_dir", "up")
    frame = {
        "movement": F.when(up, W.GROWTH).otherwise(W.DECLINE),
        "pull": F.when(up, W.BOOSTED).otherwise(W.DRAGGED),
    }
    names = {"qty": W.QUANTITY_NAME, "ppi": W.ITEM_PRICE_NAME}

    def sentence(template: str, first: str, second: str) -> Column:
        holes = dict(frame)
        for place, metric in (("first", first), ("second", second)):
            change = _holes(metric)
            holes |= {
                place: F.lit(names[metric]),
                f"{place}_pct": change[f"{metric}_pct"],
                f"{place}_noun": change[f"{metric}_noun"],
            }
        return W.fill(template, **holes)

    code = F.col("item_code")
    return (
        F.when(code == "QUANTITY_THEN_PRICE", sentence(W.ITEM_SAME, "qty", "ppi"))
        .when(code == "PRICE_THEN_QUANTITY", sentence(W.ITEM_SAME, "ppi", "qty"))
        .when(code == "QUANTITY_OFFSET_BY_PRICE", sentence(W.ITEM_OFFSET, "qty", "ppi"))
        .otherwise(sentence(W.ITEM_MITIGATED, "ppi", "qty"))
    )


def _price_mix_sentence() -> Column:
    code = F.col("price_mix_code")
    text = W.fill(
        W.PRICE_MIX,
        bp_abs=number_or_na(F.col("bp_abs")),
        rp_abs=number_or_na(F.col("rp_abs")),
        insight=W.lookup(code, W.PRICE_MIX_INSIGHTS),
        **_holes("bp"),
        **_holes("rp"),
    )
    return F.when(code == "UNAVAILABLE", W.PRICE_MIX_MISSING).otherwise(text)


def _customer_sentence() -> Column:
    code = F.col("customer_code")
    text = W.fill(
        W.CUSTOMER_MIX,
        existing_abs=number_or_na(F.col("existing_abs")),
        new_abs=number_or_na(F.col("new_abs")),
        insight=W.lookup(code, W.CUSTOMER_INSIGHTS),
        **_holes("existing"),
        **_holes("new"),
    )
    return F.when(code == "UNAVAILABLE", W.CUSTOMER_MISSING).otherwise(text)


def driver_sentences(codes: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    """The five sentences of each pair and role, from ``driver_codes``."""
    revenue = _holes("revenue")
    overall = W.fill(
        W.OVERALL, label=F.col("label"), group=F.col("grp"), verb=revenue["revenue_verb"], pct=revenue["revenue_pct"]
    )
    return codes.select(
        *keys,
        "role",
        "label",
        "grp",
        overall.alias("overall"),
        _order_sentence().alias("order_level"),
        _item_sentence().alias("item_level"),
        _price_mix_sentence().alias("price_mix"),
        _customer_sentence().alias("customer_mix"),
    )


def driver_insights(pairs: DataFrame, cfg: CampaignConfig) -> DataFrame:
    """Rule outcomes per pair and role."""
    return insights_of(driver_codes(pairs, cfg.promo_mechanism))


def insights_of(codes: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    return codes.select(
        *keys,
        "role",
        "grp",
        "revenue_dir",
        "new_pct",
        "new_abs",
        "bp_pct",
        "bp_abs",
        "rp_pct",
        "rp_abs",
        "order_code",
        "aov_code",
        "item_code",
        "price_mix_code",
        "customer_code",
    )


def driver_summary(pairs: DataFrame, cfg: CampaignConfig) -> DataFrame:
    """(control_group, testing_group, summary): the whole text of each pair."""
    baseline, promo = (F.lit(", ".join(map(str, days))) for days in (cfg.baseline_dates, cfg.promo_dates))
    return summary_of(driver_codes(pairs, cfg.promo_mechanism), baseline, promo)


def summary_of(codes: DataFrame, baseline: Column, promo: Column, keys: Sequence[str] = PAIR) -> DataFrame:
    """Keys and summary of each pair, from ``driver_codes`` and the dates of both periods as text, made of the keys."""
    sentences = driver_sentences(codes, keys)
    block = F.concat_ws(
        "\n",
        W.fill(W.GROUP_HEADING, label=F.col("label")),
        "overall",
        F.lit(""),
        "order_level",
        "item_level",
        "price_mix",
        "customer_mix",
        F.lit(""),
    )
    blocks = (
        sentences.select(*keys, "role", block.alias("block"))
        .groupBy(*keys)
        .agg(*[F.max(F.when(F.col("role") == role, F.col("block"))).alias(role) for role in ROLE_LABELS])
    )
    summary = F.concat_ws(
        "\n",
        F.lit(W.TITLE),
        F.lit(""),
        W.fill(W.BASELINE_LINE, dates=baseline),
        W.fill(W.PROMO_LINE, dates=promo),
        F.lit(""),
        "control",
        "testing",
        F.lit(W.RULE),
        F.lit(W.NOTE),
    )
    return blocks.select(*keys, summary.alias("summary"))
