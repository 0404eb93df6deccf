"""Drivers, winner and report record of each compared pair.

A funnel has a fixed number of KPIs (26 or 22), so the KPI rows of one pair are packed into
arrays: drivers, winner and report then all come from one pass over the funnel.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campaign_lift.config import CampaignConfig, Selection, as_selection

PRIMARY_KPIS = ("total revenue", "total PC1", "margin")  # fixed value
RANKINGS = ("top_positive", "top_negative", "top_absolute")
PAIR = ("control_group", "testing_group")
FUNNEL_FIELDS = ("kpi_seq", "kpi", "baseline_value", "promo_value", "pct_diff", "abs_diff")


def pair_tables(funnel: DataFrame, cfg: CampaignConfig) -> DataFrame:
    """One row per pair with the funnel rows of both groups and their impact rows.

    Arrays keep the KPI order; the maps find a row by its KPI.
    """
    return pairs_of_roles(funnel, cfg.role_frame(funnel.sparkSession))


def pairs_of_roles(funnel: DataFrame, roles: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``pair_tables`` by a table of roles. ``keys`` are further keys of funnel and roles, such as the campaign."""
    row = F.struct(*FUNNEL_FIELDS)
    packed = (
        funnel.join(roles, [*keys, "grp"])
        .groupBy(*keys, *PAIR)
        .agg(
            F.array_sort(F.collect_list(F.when(F.col("role") == "control", row))).alias("control_funnel"),
            F.array_sort(F.collect_list(F.when(F.col("role") == "testing", row))).alias("testing_funnel"),
        )
    )
    by_kpi = {
        f"{role}_by_kpi": F.map_from_arrays(F.col(f"{role}_funnel")["kpi"], F.col(f"{role}_funnel"))
        for role in ("control", "testing")
    }
    return packed.withColumns(by_kpi).withColumn("promo_impact", _impact_rows())


def _impact_rows() -> Column:
    known = F.filter("testing_funnel", lambda t: F.map_contains_key("control_by_kpi", t["kpi"]))

    def impact(testing: Column) -> Column:
        control = F.col("control_by_kpi")[testing["kpi"]]
        return F.struct(
            testing["kpi_seq"].alias("kpi_seq"),
            testing["kpi"].alias("kpi"),
            testing["pct_diff"].alias("testing_pct_diff"),
            testing["abs_diff"].alias("testing_abs_diff"),
            control["pct_diff"].alias("control_pct_diff"),
            control["abs_diff"].alias("control_abs_diff"),
            (testing["pct_diff"] - control["pct_diff"]).alias("testing_minus_control_pct_diff"),
            (testing["abs_diff"] - control["abs_diff"]).alias("testing_minus_control_abs_diff"),
        )

    return F.transform(known, impact)


def top_drivers(rows: Column | str, value: str, top_n: int = 5, min_abs_value: float = 0.0) -> Column:
    """Struct with the n largest, n smallest and n largest absolute values of an array of KPI rows.

    "Positive" and "negative" name the end of the order and not the sign. Equal values keep
    the KPI order.
    """
    kept = F.filter(rows, lambda r: r[value].isNotNull() & (F.abs(r[value]) >= float(min_abs_value)))

    def best(rank) -> Column:
        keyed = F.transform(
            kept,
            lambda r: F.struct(
                rank(r[value]).alias("rank"), r["kpi_seq"].alias("kpi_seq"), r["kpi"].alias("kpi"), r[value].alias("value")
            ),
        )
        return F.transform(F.slice(F.array_sort(keyed), 1, top_n), lambda r: F.struct(r["kpi"].alias("kpi"), r["value"].alias("value")))

    ranks = {"top_positive": lambda v: -v, "top_negative": lambda v: v, "top_absolute": lambda v: -F.abs(v)}
    return F.struct(*[best(ranks[name]).alias(name) for name in RANKINGS])


def kpi_drivers(pairs: DataFrame, top_n: int = 5, min_abs_value: float = 0.0, keys: Sequence[str] = PAIR) -> DataFrame:
    """(control_group, testing_group, source, ranking, position, kpi, value) for all three tables of a pair."""
    sources = {
        "control_group_drivers": top_drivers("control_funnel", "pct_diff", top_n, min_abs_value),
        "testing_group_drivers": top_drivers("testing_funnel", "pct_diff", top_n, min_abs_value),
        "promo_impact_drivers": top_drivers("promo_impact", "testing_minus_control_pct_diff", top_n, min_abs_value),
    }
    ranked = pairs.select(*keys, *[column.alias(name) for name, column in sources.items()])
    lists = [
        F.struct(F.lit(source).alias("source"), F.lit(ranking).alias("ranking"), F.col(source)[ranking].alias("entries"))
        for source in sources
        for ranking in RANKINGS
    ]
    rows = ranked.select(*keys, F.inline(F.array(*lists)))
    return rows.select(*keys, "source", "ranking", F.posexplode("entries").alias("place", "entry")).select(
        *keys,
        "source",
        "ranking",
        (F.col("place") + 1).alias("position"),
        F.col("entry")["kpi"].alias("kpi"),
        F.col("entry")["value"].alias("value"),
    )


def winner_struct(
    primary_kpis: Sequence[str] = PRIMARY_KPIS, min_uplift: float = 0.01, min_support_kpis: int = 2
) -> Column:
    """Vote of the primary KPIs on a ``pair_tables`` row."""

    def comparison(kpi: str) -> Column:
        testing = F.col("testing_by_kpi")[kpi]["pct_diff"]
        control = F.col("control_by_kpi")[kpi]["pct_diff"]
        uplift = testing - control
        decision = (
            F.when(uplift.isNull(), "insufficient_data")
            .when(uplift >= min_uplift, "testing")
            .when(uplift <= -min_uplift, "control")
            .otherwise("tie")
        )
        return F.struct(
            F.lit(kpi).alias("kpi"),
            testing.alias("testing_pct_diff"),
            control.alias("control_pct_diff"),
            uplift.alias("uplift"),
            decision.alias("decision"),
        )

    comparisons = F.array(*[comparison(kpi) for kpi in primary_kpis])

    def votes(side: str) -> Column:
        return F.size(F.filter(comparisons, lambda c: c["decision"] == side))

    testing, control = votes("testing"), votes("control")
    winner = F.when(testing > control, "testing").when(control > testing, "control").otherwise("tie")
    most = F.greatest(testing, control)
    confidence = (
        F.when((testing == control) | (most < min_support_kpis), "low")
        .when(most == len(primary_kpis), "high")
        .otherwise("medium")
    )
    reasons = F.transform(F.filter(comparisons, lambda c: c["decision"] == winner), lambda c: c["kpi"])
    return F.struct(
        winner.alias("winner"),
        confidence.alias("confidence"),
        F.lit(float(min_uplift)).alias("min_uplift"),
        F.lit(min_support_kpis).alias("min_support_kpis"),
        comparisons.alias("comparisons"),
        reasons.alias("reason_codes"),
        F.struct(testing.alias("testing"), control.alias("control")).alias("vote_count"),
    )


def ab_winner(pairs: DataFrame, keys: Sequence[str] = PAIR, **rules) -> DataFrame:
    """Winner, confidence, votes and reasons per pair."""
    rows = pairs.select(*keys, winner_struct(**rules).alias("w"))
    return rows.select(
        *keys,
        F.col("w")["winner"].alias("winner"),
        F.col("w")["confidence"].alias("confidence"),
        F.col("w")["vote_count"]["testing"].alias("testing_votes"),
        F.col("w")["vote_count"]["control"].alias("control_votes"),
        F.col("w")["comparisons"].alias("comparisons"),
        F.col("w")["reason_codes"].alias("reason_codes"),
    )


def ab_comparisons(pairs: DataFrame, keys: Sequence[str] = PAIR, **rules) -> DataFrame:
    """The KPI-by-KPI decisions behind the winner."""
    return ab_winner(pairs, keys, **rules).select(*keys, F.inline("comparisons"))


def report_payload(pairs: DataFrame, cfg: CampaignConfig, top_n: int = 5) -> DataFrame:
    """One record per pair: run settings, KPI tables, winner and drivers, as nested columns."""

    listed = {grp: members for grp, members in cfg.groups.items() if grp not in cfg.open_groups}
    for side in ("control", "testing"):
        pairs = _with_members(pairs, cfg, side)

    def group(side: str) -> Column:
        name, opened = F.col(f"{side}_group"), F.col(f"{side}_members")
        codes = [F.when(name == grp, F.array(*map(F.lit, members)).cast("array<string>")) for grp, members in listed.items()]
        notes = F.create_map(*[F.lit(part) for grp in cfg.groups for part in (grp, cfg.descriptions.get(grp, ""))])
        return F.struct(name.alias("name"), notes[name].alias("description"), F.coalesce(*codes, opened, F.array().cast("array<string>")).alias("store_codes"))

    meta = F.struct(
        F.lit(cfg.traffic_business_unit).alias("traffic_business_unit"),
        F.lit(cfg.traffic_country).alias("traffic_country"),
        F.lit(cfg.order_company_name_short).alias("order_company_name_short"),
        F.lit(cfg.order_channel).alias("order_channel"),
        F.lit(cfg.order_country).alias("order_country"),
        F.array(*[F.lit(str(d)) for d in cfg.baseline_dates]).cast("array<string>").alias("baseline_dates"),
        F.array(*[F.lit(str(d)) for d in cfg.promo_dates]).cast("array<string>").alias("promo_dates"),
        F.lit(cfg.promo_mechanism).alias("promo_mechanism"),
        group("control").alias("control_group"),
        group("testing").alias("testing_group"),
    )
    return pairs.select(
        "control_group",
        "testing_group",
        meta.alias("meta"),
        F.struct("control_funnel", "testing_funnel", "promo_impact").alias("kpis"),
        winner_struct().alias("winner_assessment"),
        F.struct(
            top_drivers("control_funnel", "pct_diff", top_n).alias("control_group_drivers"),
            top_drivers("testing_funnel", "pct_diff", top_n).alias("testing_group_drivers"),
            top_drivers("promo_impact", "testing_minus_control_pct_diff", top_n).alias("promo_impact_drivers"),
        ).alias("phase1_driver_analysis"),
    )


def _with_members(pairs: DataFrame, cfg: CampaignConfig, side: str) -> DataFrame:
    """Pairs with the sorted stores of a group that the data decide about; no such list is longer than the store options."""
    if not cfg.open_groups:
        return pairs.withColumn(f"{side}_members", F.lit(None).cast("array<string>"))
    opened = cfg.member_frame(pairs.sparkSession).where(F.col("grp").isin(list(cfg.open_groups)))
    lists = opened.groupBy(F.col("grp").alias(f"{side}_group")).agg(F.sort_array(F.collect_set("store_code")).alias(f"{side}_members"))
    return pairs.join(lists, f"{side}_group", "left")


def payload_json(payload: DataFrame) -> DataFrame:
    record = F.struct("meta", "kpis", "winner_assessment", "phase1_driver_analysis")
    return payload.select("control_group", "testing_group", F.to_json(record, {"ignoreNullFields": "false"}).alias("payload"))


def selection_record(cfg: CampaignConfig, include_sunday: bool = False) -> dict:
    """The run settings, with every choice as it was made: select all, include or except."""
    chosen = cfg.category

    def choice(name: str, made: Selection | Sequence[str], empty_is_all: bool) -> dict:
        made = as_selection(made)
        everything = made.mode == "all" or empty_is_all and made == Selection("include")
        return {name: everything} | ({} if everything else made.record)

    dimensions = {
        "article_section_group": chosen.article_section_groups,
        "article_section": chosen.article_sections,
        "article_season": chosen.article_seasons,
        "article_brand_group": chosen.article_brand_groups,
        "insider_customer_type": chosen.insider_customer_types,
    }
    return {
        "traffic_business_unit": cfg.traffic_business_unit,
        "traffic_country": cfg.traffic_country,
        "order_company_name_short": cfg.order_company_name_short,
        "order_channel": cfg.order_channel,
        "order_country": cfg.order_country,
        "vat": cfg.vat,
        "baseline_coefficient": cfg.baseline_coefficient,
        "groups": {name: choice("select all stores", made, empty_is_all=False) for name, made in cfg.groups.items()},
        "group_descriptions": {name: cfg.descriptions.get(name, "") for name in cfg.groups},
        "baseline_dates": [str(d) for d in cfg.baseline_dates],
        "promo_dates": [str(d) for d in cfg.promo_dates],
        **{f"{name}s": choice(f"select all {name}", made, empty_is_all=True) for name, made in dimensions.items()},
        "category_store_codes": list(chosen.store_codes),
        "price_types": list(chosen.price_types or ("RP", "BP")),
        "promo_checks": list(chosen.promo_checks or ("promo", "non-promo")),
        "pairs": [{"control_group": control, "testing_group": testing} for control, testing in cfg.pairs],
        "promo_mechanism": cfg.promo_mechanism,
        "include_sunday": include_sunday,
    }


def selection_json(cfg: CampaignConfig, include_sunday: bool = False) -> str:
    """The run settings as JSON text, to be kept beside the outputs."""
    return json.dumps(selection_record(cfg, include_sunday), ensure_ascii=False, indent=2)
