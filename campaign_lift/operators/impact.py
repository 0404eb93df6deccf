"""Test against control: the promo impact of one group over another."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campaign_lift.config import CampaignConfig


def promo_impact(funnel: DataFrame, cfg: CampaignConfig) -> DataFrame:
    """Change of the testing group minus change of the control group, per configured pair and KPI.

    The funnel is read once: its rows take their role in each pair by a join on the group and
    meet again in one small aggregation. KPIs that only one side has drop out.
    """
    return impact_of_roles(funnel, cfg.role_frame(funnel.sparkSession))


def impact_of_roles(funnel: DataFrame, roles: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``promo_impact`` by a table of roles. ``keys`` are further keys of funnel and roles, such as the campaign."""
    changes = F.struct("pct_diff", "abs_diff")
    sides = (
        funnel.join(roles, [*keys, "grp"])
        .groupBy(*keys, "control_group", "testing_group", "kpi_seq", "kpi")
        .agg(
            F.max(F.when(F.col("role") == "control", changes)).alias("control"),
            F.max(F.when(F.col("role") == "testing", changes)).alias("testing"),
        )
        .where(F.col("control").isNotNull() & F.col("testing").isNotNull())
    )
    control, testing = F.col("control"), F.col("testing")
    return sides.select(
        *keys,
        "control_group",
        "testing_group",
        "kpi_seq",
        "kpi",
        testing["pct_diff"].alias("testing_pct_diff"),
        testing["abs_diff"].alias("testing_abs_diff"),
        control["pct_diff"].alias("control_pct_diff"),
        control["abs_diff"].alias("control_abs_diff"),
        (testing["pct_diff"] - control["pct_diff"]).alias("testing_minus_control_pct_diff"),
        (testing["abs_diff"] - control["abs_diff"]).alias("testing_minus_control_abs_diff"),
    )


def impact_headings(control: str, testing: str) -> dict[str, str]:
    """Display headings of one pair (the patterns are fixed values).

    The last two headings read "A - B" while the values are testing minus control.
    """
    if control == testing:
        control, testing = f"{control} (Control)", f"{testing} (Testing)"
    return {
        "kpi": "KPI",
        "testing_pct_diff": f"{testing} % Diff (Promo vs Baseline)",
        "testing_abs_diff": f"{testing} Abs Diff (Promo vs Baseline)",
        "control_pct_diff": f"{control} % Diff (Promo vs Baseline)",
        "control_abs_diff": f"{control} Abs Diff (Promo vs Baseline)",
        "testing_minus_control_pct_diff": "Promo Impact (Group A %Diff - Group B %Diff )",
        "testing_minus_control_abs_diff": "Promo Impact (Group A Abs Diff - Group B Abs Diff )",
    }


def impact_for_display(impact: DataFrame, control: str, testing: str) -> DataFrame:
    """One pair with the group names in its column headings, in KPI order."""
    headings = impact_headings(control, testing)
    rows = impact.where((F.col("control_group") == control) & (F.col("testing_group") == testing))
    return rows.orderBy("kpi_seq").select(*[F.col(name).alias(heading) for name, heading in headings.items()])
