"""Bridges: what leads from one total to another, step by step.

Every bridge is a long frame (grp, bridge, step_seq, step, value, type) where type is "total"
or "delta" and step_seq gives the order of the steps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from campaign_lift.config import BASELINE, PERIODS, PROMO, CampaignConfig
from campaign_lift.functions.columns import or_unknown, ratio_or_zero, sum_where, to_number
from campaign_lift.operators.metrics import kpi_rows, periods_side_by_side
from campaign_lift.operators.subsets import group_period_subset

# Split rules of the category fact and the wording of their steps.
SPLITS = {
    "rp": ("price_type", "RP", "RP {metric} change", "BP {metric} change"),
    "promo": ("promo_check", "promo", "Promo {metric} change", "Non promo {metric} change"),
    "existing": (
        "insider_customer_type",
        "EXISTING",
        "Existing insider {metric} change",
        "New + non insider {metric} change",
    ),
}
METRICS = {"revenue": "total_revenue", "quantity": "total_quantity", "PC1": "total_PC1"}


def _step(seq: int | Column, step: str | Column, value: Column, kind: str) -> Column:
    name = step if isinstance(step, Column) else F.lit(step)
    number = seq if isinstance(seq, Column) else F.lit(seq)
    return F.struct(number.alias("step_seq"), name.alias("step"), value.alias("value"), F.lit(kind).alias("type"))


def _steps(rows: DataFrame, bridge: str | Column, *steps: Column) -> DataFrame:
    label = bridge if isinstance(bridge, Column) else F.lit(bridge)
    return rows.select("grp", label.alias("bridge"), F.inline(F.array(*steps)))


# ---------------------------------------------------------------- discounts of the store fact


def _discount_stages(vat: float) -> dict[str, Column]:
    """PC1 before discounts, after red prices and after promotions, of a ``group_sums`` row."""
    full, cost = F.col("total_full_price_revenue"), F.col("total_cost")
    red, promo = F.col("total_RP_discount_euro"), F.col("total_promo_discount_euro")
    tax = F.lit(float(vat))
    return {
        "quantity": F.col("total_quantity"),
        "cost": cost,
        "red": red,
        "promo": promo,
        "full_revenue": full,
        "full_pc1": ratio_or_zero(full, tax) - cost,
        "red_revenue": full - red,
        "red_pc1": ratio_or_zero(full - red, tax) - cost,
        "final_revenue": full - red - promo,
        "final_pc1": ratio_or_zero(full - red - promo, tax) - cost,
    }


def discount_metrics(vat: float) -> dict[str, Column]:
    """Thirteen discount metrics of a ``group_sums`` row; the keys are fixed values."""
    s = _discount_stages(vat)
    return {
        "Total quantity sold": s["quantity"],
        "Black Price, EUR (before all discounts and reductions)": ratio_or_zero(s["full_revenue"], s["quantity"]),
        "Total Full Price Revenue": s["full_revenue"],
        "COGs": s["cost"],
        "Total Full Price PC1 Margin, %%": ratio_or_zero(s["full_pc1"], s["full_revenue"]) * vat,
        "Total Full Price PC1, EUR": s["full_pc1"],
        "Total Red Price discount granted, EUR": s["red"],
        "PC1 Margin after RP discounts, %%": ratio_or_zero(s["red_pc1"], s["red_revenue"]) * vat,
        "PC1 after RP discounts, EUR": s["red_pc1"],
        "Total Promo discount granted, EUR": s["promo"],
        "Final PC1 Margin, %%": ratio_or_zero(s["final_pc1"], s["final_revenue"]) * vat,
        "Final PC1, EUR": s["final_pc1"],
        "PC1 after Promo discounts, EUR": s["final_pc1"] - s["red_pc1"],
    }


NOT_SHOWN = "PC1 after Promo discounts, EUR"


def discount_breakdown(sums: DataFrame, cfg: CampaignConfig) -> DataFrame:
    """The twelve shown discount metrics of every group, baseline against promo."""
    shown = {name: value for name, value in discount_metrics(cfg.vat).items() if name != NOT_SHOWN}
    return kpi_rows(sums, shown, zero_base=0.0, nothing=[0.0] * len(shown))


def pc1_bridge_period(sums: DataFrame, cfg: CampaignConfig, periods: Sequence[str] = PERIODS) -> DataFrame:
    """Full-price PC1 to final PC1 inside one period; ``bridge`` is the period name."""
    s = _discount_stages(cfg.vat)
    return _steps(
        sums.where(F.col("period").isin(*periods)),
        F.col("period"),
        _step(1, "Total Full Price PC1", s["full_pc1"], "total"),
        _step(2, "RP discount impact", s["red_pc1"] - s["full_pc1"], "delta"),
        _step(3, "Promo discount impact", s["final_pc1"] - s["red_pc1"], "delta"),
        _step(4, "Final PC1", s["final_pc1"], "total"),
    )


def pc1_bridge_baseline_to_promo(sums: DataFrame, cfg: CampaignConfig, show_full_price: bool = False) -> DataFrame:
    """Final PC1 of the baseline to final PC1 of the promo period.

    Only the change of the two discount impacts is shown, so the steps do not add up to the
    last total unless ``show_full_price`` adds the change of full-price PC1.
    """
    stages = ["full_pc1", "red_pc1", "final_pc1"]
    values = _discount_stages(cfg.vat)
    rows = sums.select("grp", "period", *[values[name].alias(name) for name in stages])
    base, promo = F.col("baseline"), F.col("promo")

    def change(upper: str, lower: str) -> Column:
        return (promo[upper] - promo[lower]) - (base[upper] - base[lower])

    steps = [_step(1, "Baseline Final PC1", base["final_pc1"], "total")]
    if show_full_price:
        steps.append(_step(2, "Full price PC1 change", promo["full_pc1"] - base["full_pc1"], "delta"))
    n = len(steps)
    steps += [
        _step(n + 1, "RP discount impact change", change("red_pc1", "full_pc1"), "delta"),
        _step(n + 2, "Promo discount impact change", change("final_pc1", "red_pc1"), "delta"),
        _step(n + 3, "Promo Final PC1", promo["final_pc1"], "total"),
    ]
    return _steps(periods_side_by_side(rows, ["grp"], stages), "Baseline to Promo", *steps)


# ---------------------------------------------------------------- category bridges


def split_bridges(
    facts: DataFrame,
    cfg: CampaignConfig,
    splits: Sequence[str] = tuple(SPLITS),
    metrics: Sequence[str] = tuple(METRICS),
) -> DataFrame:
    """Two-way bridges of the category fact: all asked splits and metrics in one aggregation.

    A NULL on the split column belongs to the second part. ``bridge`` is "<split> <metric>".
    """
    in_period = {"b": F.col("period") == BASELINE, "p": F.col("period") == PROMO}
    sums = []
    for metric in metrics:
        column = F.col(METRICS[metric])
        for side, when in in_period.items():
            sums.append(sum_where(when, column).alias(f"{side}_{metric}"))
            for split in splits:
                name, value = SPLITS[split][:2]
                first = F.col(name).eqNullSafe(value)
                sums.append(sum_where(when & first, column).alias(f"{side}_{metric}_{split}_1"))
                sums.append(sum_where(when & ~first, column).alias(f"{side}_{metric}_{split}_2"))
    wide = group_period_subset(facts, cfg).groupBy("grp").agg(*sums)

    bridges = []
    for split in splits:
        first_label, second_label = SPLITS[split][2:]
        for metric in metrics:
            first, second = (
                F.col(f"p_{metric}_{split}_{part}") - F.col(f"b_{metric}_{split}_{part}") for part in (1, 2)
            )
            bridges.append(
                F.struct(
                    F.lit(f"{split} {metric}").alias("bridge"),
                    F.array(
                        _step(1, f"Baseline {metric}", F.col(f"b_{metric}"), "total"),
                        _step(2, first_label.format(metric=metric), first, "delta"),
                        _step(3, second_label.format(metric=metric), second, "delta"),
                        _step(4, f"Promo period {metric}", F.col(f"p_{metric}"), "total"),
                    ).alias("steps"),
                )
            )
    return wide.select("grp", F.inline(F.array(*bridges))).select("grp", "bridge", F.inline("steps"))


def dimension_bridge(
    facts: DataFrame, cfg: CampaignConfig, dimension: str, metric: str, selected: Sequence[str] = (), **rules
) -> DataFrame:
    """The bridge of one dimension and metric."""
    return dimension_bridges(facts, cfg, [(dimension, metric, selected)], **rules)


def dimension_bridges(
    facts: DataFrame,
    cfg: CampaignConfig,
    specs: Sequence[tuple[str, str, Sequence[str]]],
    show_all_threshold: int = 3,
    one_sided: str = "zero",
    shown: int = 3,
) -> DataFrame:
    """Which values of an article dimension carry the change of a metric, for each (dimension, metric, selected values).

    Up to ``show_all_threshold`` selected values are all shown, largest change first. Otherwise
    the three largest gains are shown and the rest is summed up as "Other" (left out when 0).
    A value that only one period has counts as 0; ``one_sided="value"`` counts its amount.

    All bridges come from one aggregation by group and dimension value. The values shown are few,
    so their ranking keeps the first of each task before anything is shuffled.
    """
    if one_sided not in ("zero", "value"):
        raise ValueError(f"unknown one_sided rule {one_sided!r}")
    metrics = list(dict.fromkeys(metric for _, metric, _ in specs))
    dimensions = list(dict.fromkeys(dimension for dimension, _, _ in specs))
    chosen = [list(dict.fromkeys(str(v) for v in selected if str(v))) for _, _, selected in specs]
    every = [0 < len(values) <= show_all_threshold for values in chosen]

    opened = F.array(*[F.struct(F.lit(d).alias("dimension"), or_unknown(F.col(d)).alias("dim")) for d in dimensions])
    rows = group_period_subset(facts, cfg).select("grp", "period", *[METRICS[m] for m in metrics], F.inline(opened))
    sums = [
        sum_where(F.col("period") == period, F.col(METRICS[m])).alias(f"{side}_{m}")
        for m in metrics
        for side, period in (("b", BASELINE), ("p", PROMO))
    ]
    per_dim = rows.groupBy("grp", "dimension", "dim").agg(*sums)

    def entry(i: int) -> Column:
        dimension, metric, _ = specs[i]
        in_scope = F.col("dim").isin(chosen[i]) if chosen[i] else F.lit(True)
        fields = F.struct(
            F.lit(i).alias("spec"), F.col(f"b_{metric}").alias("b"), F.col(f"p_{metric}").alias("p"),
            in_scope.alias("in_scope"), F.lit(every[i]).alias("every"),
        )
        return F.when(F.col("dimension") == dimension, fields)

    entries = F.filter(F.array(*[entry(i) for i in range(len(specs))]), lambda x: x.isNotNull())
    per_value = per_dim.select("grp", "dim", F.inline(entries))
    if one_sided == "zero":
        change = F.coalesce(F.col("p") - F.col("b"), F.lit(0.0))
    else:
        change = F.coalesce("p", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))
    per_value = per_value.withColumn("change", change)

    zero = F.lit(0.0)
    totals = per_value.groupBy("grp", "spec").agg(
        F.sum("b").alias("b"), F.sum("p").alias("p"), F.coalesce(sum_where(F.col("in_scope"), F.col("change")), zero).alias("all_changes")
    )
    order = Window.partitionBy("grp", "spec").orderBy(F.desc("change"), "dim")
    candidates = per_value.where("in_scope AND (every OR change > 0)").withColumn("place", F.row_number().over(order))
    most = max(shown, show_all_threshold)
    top = (
        candidates.where((F.col("place") <= most) & (F.col("every") | (F.col("place") <= shown)))
        .groupBy("grp", "spec")
        .agg(
            F.collect_list(F.struct((zero - F.col("change")).alias("rank"), "dim")).alias("top"),
            F.sum("change").alias("top_changes"),
        )
    )
    wide = totals.join(top, ["grp", "spec"], "left")

    # Chosen values that have no rows show as 0. Largest change first, equal changes by name.
    none = F.array().cast("array<struct<rank:double,dim:string>>")
    asked = _by_spec([F.array(*[F.struct(zero.alias("rank"), F.lit(v).alias("dim")) for v in c]) if e else none for c, e in zip(chosen, every)])
    found = F.coalesce("top", none)
    absent = F.filter(asked, lambda x: ~F.exists(found, lambda y: y["dim"] == x["dim"]))
    wide = wide.withColumn("ranked", F.array_sort(F.concat(found, absent)))
    show_all = _by_spec([F.lit(e) for e in every])
    other = F.when(show_all, zero).otherwise(F.col("all_changes") - F.coalesce("top_changes", zero))
    wide = wide.withColumn("other", other).withColumn("n", F.size("ranked"))
    metric = _by_spec([F.lit(m) for _, m, _ in specs])
    deltas = F.transform("ranked", lambda x, i: _step(i + 2, x["dim"], zero - x["rank"], "delta"))
    has_other = F.col("other") != 0
    steps = F.concat(
        F.array(_step(1, F.concat(F.lit("Baseline "), metric), F.col("b"), "total")),
        deltas,
        F.when(has_other, F.array(_step(F.col("n") + 2, F.lit("Other"), F.col("other"), "delta"))).otherwise(
            F.array().cast("array<struct<step_seq:int,step:string,value:double,type:string>>")
        ),
        F.array(_step(F.col("n") + 2 + has_other.cast("int"), F.concat(F.lit("Promo period "), metric), F.col("p"), "total")),
    )
    label = _by_spec([F.lit(f"{d} {m}") for d, m, _ in specs])
    return wide.select("grp", label.alias("bridge"), F.inline(steps))


def _by_spec(values: list[Column]) -> Column:
    """The value of the row's ``spec``, which counts from 0."""
    return F.element_at(F.array(*values), F.col("spec") + 1)


# ---------------------------------------------------------------- chart coordinates


def waterfall_coordinates(bridges: DataFrame) -> DataFrame:
    """Bar ends of each step. A total starts at 0; a delta starts where the step before ended.

    Each total opens a segment, and inside a segment the end is a running sum. A bridge has a
    handful of steps, so the windows are small.
    """
    value = F.coalesce(F.rint(to_number(F.col("value"))), F.lit(0.0))
    total = F.col("type") == "total"
    in_order = Window.partitionBy("grp", "bridge").orderBy("step_seq")
    in_segment = Window.partitionBy("grp", "bridge", "segment").orderBy("step_seq")
    ends = (
        bridges.withColumn("value", value)
        .withColumn("segment", F.count_if(total).over(in_order))
        .withColumn("end", F.sum("value").over(in_segment))
        .withColumn("start", F.when(total, F.lit(0.0)).otherwise(F.col("end") - F.col("value")))
    )
    return ends.select(
        "grp",
        "bridge",
        "step_seq",
        "step",
        "value",
        "type",
        "start",
        "end",
        F.least("start", "end").alias("lower"),
        F.greatest("start", "end").alias("upper"),
        F.when(total, "total").when(F.col("value") >= 0, "increase").otherwise("decrease").alias("color_type"),
    )
