"""What one campaign analysis is about: filters, store groups, periods, pairs to compare.

The lists here are typed in by an analyst, so they are small. They reach Spark as local
relations, whose exact size the planner knows: it broadcasts them below
``spark.sql.autoBroadcastJoinThreshold`` and shuffles them above it.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

BASELINE = "Baseline Period"
PROMO = "Promo Period"
PERIODS = (BASELINE, PROMO)
PROMO_MECHANISMS = ("BOTH", "BP_ONLY", "RP_ONLY")
DEFAULT_PAIR = ("Group 1", "Group 3")
STORE_CODE_WIDTH = 4


def expand_dates(start: date | None, end: date | None) -> tuple[date, ...]:
    """Every day from start to end, both included, in either order. A missing end gives no day."""
    if start is None or end is None:
        return ()
    first, last = min(start, end), max(start, end)
    return tuple(first + timedelta(days=n) for n in range((last - first).days + 1))


def normalise_store_codes(codes: Iterable[object]) -> tuple[str, ...]:
    """Zero-padded codes without blanks and duplicates, in the given order. Longer codes stay whole."""
    padded = []
    for code in codes:
        text = "" if code is None else str(code)
        if text:
            padded.append(text.zfill(STORE_CODE_WIDTH))
    return tuple(dict.fromkeys(padded))


def resolve_selection(options: Sequence[str], mode: str, chosen: Sequence[str] = ()) -> tuple[str, ...]:
    """"all", "include" or "except" over an option list, keeping the order of the list used.

    "except" of every option leaves an empty list, which the filters read as "no filter".
    """
    if mode == "all":
        return tuple(options)
    if mode == "include":
        return tuple(chosen)
    if mode == "except":
        excluded = set(chosen)
        return tuple(option for option in options if option not in excluded)
    raise ValueError(f"unknown selection mode {mode!r}")


@dataclass(frozen=True)
class Selection:
    """A choice from an option list that only the data know: all options, or all except some.

    It is resolved where the work runs; no option list is collected. ``Selection("include", ...)`` is the plain list.
    """

    mode: str
    values: tuple[str, ...] = ()

    def __post_init__(self):
        if self.mode not in ("all", "include", "except"):
            raise ValueError(f"unknown selection mode {self.mode!r}")
        object.__setattr__(self, "values", tuple(dict.fromkeys(self.values)) if self.mode != "all" else ())

    @property
    def record(self) -> dict:
        """The choice as the selection record holds it, without the "select all" flag."""
        return {} if self.mode == "all" else {self.mode: list(self.values)}


def as_selection(choice: Selection | Sequence[str]) -> Selection:
    """A plain list is an include list."""
    return choice if isinstance(choice, Selection) else Selection("include", tuple(choice))


def local_table(spark: SparkSession, columns: Mapping[str, tuple[pa.DataType, Sequence]]) -> DataFrame:
    """A small driver-side table as a local relation (the planner sees its real size)."""
    schema = pa.schema([(name, kind) for name, (kind, _) in columns.items()])
    return spark.createDataFrame(pa.table({name: list(values) for name, (_, values) in columns.items()}, schema=schema))


@dataclass(frozen=True)
class CategoryFilter:
    """Optional value lists on item rows. An empty list means no filter; the four article dimensions also take a
    ``Selection``."""

    store_codes: tuple[str, ...] = ()
    article_section_groups: tuple[str, ...] | Selection = ()
    article_sections: tuple[str, ...] | Selection = ()
    article_seasons: tuple[str, ...] | Selection = ()
    article_brand_groups: tuple[str, ...] | Selection = ()
    insider_customer_types: tuple[str, ...] = ()
    price_types: tuple[str, ...] = ()
    promo_checks: tuple[str, ...] = ()

    def _by_column(self) -> dict[str, Selection]:
        choices = {
            "article_section_group": self.article_section_groups,
            "article_section": self.article_sections,
            "article_season": self.article_seasons,
            "article_brand_group": self.article_brand_groups,
            "price_type": self.price_types,
            "promo_check": self.promo_checks,
        }
        return {name: as_selection(choice) for name, choice in choices.items()}

    def item_lists(self) -> dict[str, tuple[str, ...]]:
        """The include lists in use that are tested on the item, by the column they test."""
        return {name: c.values for name, c in self._by_column().items() if c.mode == "include" and c.values}

    def item_excepts(self) -> dict[str, tuple[str, ...]]:
        """The except lists in use, by column. "Except" of nothing leaves every option, which filters nothing."""
        return {name: c.values for name, c in self._by_column().items() if c.mode == "except" and c.values}

    def tested(self) -> list[str]:
        """The item columns that any list tests."""
        return [*self.item_lists(), *self.item_excepts()]


@dataclass(frozen=True)
class CampaignConfig:
    traffic_business_unit: str
    traffic_country: str
    order_company_name_short: str
    order_channel: str
    order_country: str
    groups: Mapping[str, Sequence[str] | Selection]
    baseline_dates: Sequence[date]
    promo_dates: Sequence[date]
    vat: float = 1.19
    baseline_coefficient: float = 1.0
    descriptions: Mapping[str, str] = field(default_factory=dict)
    pairs: Sequence[tuple[str, str]] | None = None  # (control, testing); DEFAULT_PAIR where both groups exist
    promo_mechanism: str = "BOTH"  # one of PROMO_MECHANISMS; read by the price-mix rules
    category: CategoryFilter = field(default_factory=CategoryFilter)
    member_table: DataFrame | None = field(default=None, compare=False, repr=False)  # (grp, store_code), for groups that the data decide

    def __post_init__(self):
        chosen = {name: as_selection(choice) for name, choice in self.groups.items()}
        chosen = {name: replace(c, values=normalise_store_codes(c.values)) for name, c in chosen.items()}
        object.__setattr__(self, "groups", {name: c.values if c.mode == "include" else c for name, c in chosen.items()})
        object.__setattr__(self, "baseline_dates", tuple(dict.fromkeys(self.baseline_dates)))
        object.__setattr__(self, "promo_dates", tuple(dict.fromkeys(self.promo_dates)))
        pairs = self.pairs
        if pairs is None:
            pairs = [DEFAULT_PAIR] if set(DEFAULT_PAIR) <= set(self.groups) else []
        object.__setattr__(self, "pairs", tuple(dict.fromkeys(tuple(pair) for pair in pairs)))
        object.__setattr__(
            self, "category", replace(self.category, store_codes=normalise_store_codes(self.category.store_codes))
        )
        if self.promo_mechanism.upper() not in PROMO_MECHANISMS:
            raise ValueError(f"unknown promo mechanism {self.promo_mechanism!r}")
        if not self.selected_dates:
            raise ValueError("select at least one date in the baseline or promo period")
        if self.known_store_codes == ():
            raise ValueError("select at least one store code in any group")
        unknown = {name for pair in self.pairs for name in pair} - set(self.groups)
        if unknown:
            raise ValueError(f"pairs name unknown groups: {sorted(unknown)}")

    @property
    def selected_dates(self) -> tuple[date, ...]:
        return tuple(sorted(set(self.baseline_dates) | set(self.promo_dates)))

    @property
    def open_groups(self) -> dict[str, Selection]:
        """Groups of all stores, or of all except some: their members are known where the work runs."""
        return {name: choice for name, choice in self.groups.items() if isinstance(choice, Selection)}

    @property
    def known_store_codes(self) -> tuple[str, ...] | None:
        """The codes of all groups, or None if the data decide about some."""
        if self.open_groups:
            return None
        return tuple(sorted({code for codes in self.groups.values() for code in codes}))

    @property
    def all_store_codes(self) -> tuple[str, ...]:
        if self.known_store_codes is None:
            raise ValueError("groups of all stores, or all except some, have no list of codes")
        return self.known_store_codes

    def group_label(self, group: str) -> str:
        note = self.descriptions.get(group, "").strip()
        return f"{group} ({note})" if note else group

    def group_frame(self, spark: SparkSession) -> DataFrame:
        """(grp, grp_label): every configured group, also those without stores."""
        names = list(self.groups)
        return local_table(
            spark, {"grp": (pa.string(), names), "grp_label": (pa.string(), [self.group_label(n) for n in names])}
        )

    def grid_frame(self, spark: SparkSession) -> DataFrame:
        """(grp, grp_label, period): every configured group with both periods."""
        rows = [(grp, self.group_label(grp), period) for grp in self.groups for period in PERIODS]
        names = ("grp", "grp_label", "period")
        return local_table(spark, {n: (pa.string(), [r[i] for r in rows]) for i, n in enumerate(names)})

    def member_frame(self, spark: SparkSession) -> DataFrame:
        """(grp, store_code). A store may be in several groups."""
        if self.open_groups:
            if self.member_table is None:
                raise ValueError("groups of all stores, or all except some, need the table of members")
            return self.member_table
        return self.listed_members(spark)

    def listed_members(self, spark: SparkSession) -> DataFrame:
        """(grp, store_code) of the groups that are given as lists."""
        rows = [(grp, code) for grp, codes in self.groups.items() if not isinstance(codes, Selection) for code in codes]
        return local_table(
            spark, {"grp": (pa.string(), [r[0] for r in rows]), "store_code": (pa.string(), [r[1] for r in rows])}
        )

    def period_frame(self, spark: SparkSession) -> DataFrame:
        """(period, ordered_date). A date may be in both periods."""
        rows = [(BASELINE, d) for d in self.baseline_dates] + [(PROMO, d) for d in self.promo_dates]
        return local_table(
            spark, {"period": (pa.string(), [r[0] for r in rows]), "ordered_date": (pa.date32(), [r[1] for r in rows])}
        )

    def role_frame(self, spark: SparkSession) -> DataFrame:
        """(control_group, testing_group, role, grp): two rows for each pair to compare."""
        rows = [
            (control, testing, role, grp)
            for control, testing in self.pairs
            for role, grp in (("control", control), ("testing", testing))
        ]
        names = ("control_group", "testing_group", "role", "grp")
        return local_table(spark, {n: (pa.string(), [r[i] for r in rows]) for i, n in enumerate(names)})
