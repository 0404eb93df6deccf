"""The named queries as SQL over the raw sample tables, written apart from the Spark code.

Each statement is a chain of common table expressions; only the texts of the summary (fixed
values) are shared with the library.
"""

from __future__ import annotations

import re

from campaign_lift.functions import wording as W

VAT = "1.19::DOUBLE"

ITEMS = """
lines AS (
  SELECT l_orderkey, l_linenumber, l_linestatus, l_tax, p_type, p_brand, p_size,
    CAST(floor(l_extendedprice / l_quantity) AS DOUBLE) AS black,
    CASE WHEN l_discount > 0.055 THEN CAST(floor(l_extendedprice / l_quantity * (1 - l_discount)) AS DOUBLE) END AS red,
    CASE WHEN l_discount > 0.085 THEN CAST(floor(l_extendedprice / l_quantity * 0.5) AS DOUBLE) END AS green,
    CASE WHEN l_linestatus = 'F' THEN CAST(floor(l_extendedprice / l_quantity * l_tax) AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS promo,
    CASE WHEN l_returnflag = 'R' THEN CAST(0 AS DOUBLE) ELSE l_quantity END AS qty,
    CAST(floor(l_extendedprice / l_quantity * 0.4) AS DOUBLE) AS cost
  FROM lineitem JOIN part ON l_partkey = p_partkey
),
items AS (
  SELECT
    CAST(o_orderkey AS VARCHAR) AS order_id,
    CAST(DATE '2024-01-01' + CAST(o_orderkey % 30 AS INT) AS TIMESTAMP) + to_hours(CAST(o_custkey % 24 AS INTEGER)) AS ordered_at,
    CASE WHEN o_custkey % 5 = 4 THEN 'ALTA' ELSE 'NOVA' END AS company_name_short,
    CASE WHEN o_orderpriority = '5-LOW' THEN 'ONLINE' ELSE 'STATIONARY' END AS channel,
    CASE WHEN o_orderstatus = 'P' THEN 'AT' ELSE 'DE' END AS country,
    CAST(o_custkey % 8 AS INT) AS tenant,
    concat('STORE_', CAST(o_custkey % 8 AS VARCHAR)) AS store_name,
    CASE o_custkey % 3 WHEN 0 THEN 'EXISTING' WHEN 1 THEN 'NEW' END AS insider,
    l_linenumber AS item_no, black, red, green, cost, promo, qty,
    qty * (coalesce(red, black) - promo) AS revenue,
    CAST(floor(CAST(qty * (coalesce(red, black) - promo) AS DOUBLE) / CAST(1.19 AS DOUBLE)) AS DOUBLE) - cost * qty AS pc1,
    l_linestatus = 'F' AS has_promotion,
    CASE WHEN l_linestatus = 'F' AND l_tax > 0.065 THEN 'PROMO_B,PROMO_A' WHEN l_linestatus = 'F' AND l_tax > 0.045 THEN 'PROMO_B'
         WHEN l_linestatus = 'F' THEN 'PROMO_A' END AS promotion_ids,
    p_type AS section_group, p_brand AS section,
    CASE p_size % 4 WHEN 0 THEN 'SS' WHEN 1 THEN 'FW' WHEN 2 THEN 'NOS' END AS season,
    CASE WHEN p_size % 3 = 0 THEN 'OWN' WHEN p_size % 3 = 1 THEN 'BRAND' END AS brand_group
  FROM orders LEFT JOIN lines ON l_orderkey = o_orderkey
)"""

# The same items with all amounts in eighths of a euro, so that halves of a cent occur.
EIGHTHS = re.sub(
    r"CAST\(floor\((.+?)\) AS DOUBLE\)(?= AS| END| ELSE| -)", r"CAST(floor((\1) * 8) AS DOUBLE) / CAST(8 AS DOUBLE)", ITEMS
)

SOLD = """
sold AS (
  SELECT *, CAST(ordered_at AS DATE) AS ordered_date, lpad(CAST(tenant AS VARCHAR), 4, '0') AS store_code
  FROM items
  WHERE channel = 'STATIONARY' AND company_name_short = 'NOVA' AND country = 'DE'
    AND CAST(ordered_at AS DATE) IN (SELECT d FROM periods)
)"""

CONFIG = """
grps(grp, grp_label) AS (
  VALUES ('Group 1', 'Group 1 (no offer)'), ('Group 2', 'Group 2'), ('Group 3', 'Group 3 (offer)'), ('Group 4', 'Group 4')
),
members(grp, store_code) AS (
  VALUES ('Group 1', '0000'), ('Group 1', '0001'), ('Group 1', '0002'), ('Group 2', '0002'), ('Group 2', '0003'),
         ('Group 3', '0004'), ('Group 3', '0005'), ('Group 3', '0006'), ('Group 3', '0007')
),
periods AS (
  SELECT 'Baseline Period' AS period, CAST(DATE '2024-01-01' + i AS DATE) AS d FROM (SELECT CAST(range AS INT) AS i FROM range(14))
  UNION ALL
  SELECT 'Promo Period', CAST(DATE '2024-01-15' + i AS DATE) FROM (SELECT CAST(range AS INT) AS i FROM range(14)) WHERE i <> 2
),
pairs(control_group, testing_group) AS (
  VALUES ('Group 1', 'Group 3'), ('Group 1', 'Group 2'), ('Group 2', 'Group 4'), ('Group 3', 'Group 3')
)"""

# The same settings with one group of all stores and one of all except some: the stores are those of the seller's orders.
OPEN_CONFIG = re.sub(
    r"members\(grp, store_code\) AS \(.*?\),\nperiods",
    """members AS (
  SELECT g.grp, s.store_code
  FROM (VALUES ('Group 1'), ('Group 2')) AS g(grp), (
    SELECT DISTINCT lpad(CAST(o_custkey % 8 AS VARCHAR), 4, '0') AS store_code FROM orders
    WHERE o_custkey % 5 <> 4 AND o_orderpriority <> '5-LOW' AND o_orderstatus <> 'P'
  ) s WHERE g.grp = 'Group 1' OR s.store_code NOT IN ('0001', '0003')
  UNION ALL SELECT 'Group 3', store_code FROM (VALUES ('0004'), ('0005'), ('0006'), ('0007')) AS v(store_code)
),
periods""",
    CONFIG,
    flags=re.DOTALL,
)

TRAFFIC_DAY = """
visits AS (
  SELECT CAST(ts AS DATE) AS visited_on, CAST(user_id % 8 AS INT) AS store,
    CASE WHEN user_id % 8 = 7 OR event_type = 'error' THEN NULL
         WHEN event_type = 'signup' THEN 0
         ELSE CAST(floor(value) AS BIGINT) END AS footfall,
    CASE WHEN event_type IN ('view', 'click', 'signup') THEN CAST(floor(value / 4) AS BIGINT) END AS visitors,
    CASE WHEN event_type = 'purchase' THEN 1 END AS tills
  FROM events
),
traffic_day AS (
  SELECT visited_on AS ordered_date, 'DE' AS country, 'NOVA DE' AS business_unit,
    lpad(CAST(store AS VARCHAR), 4, '0') AS store_code, concat('STORE_', CAST(store AS VARCHAR)) AS store_name,
    CAST(sum(footfall) AS BIGINT) AS pedestrian_footfall,
    CAST(coalesce(sum(CASE WHEN footfall > 0 THEN visitors ELSE 0 END), 0) AS DOUBLE)
      / nullif(sum(CASE WHEN footfall > 0 THEN footfall ELSE 0 END), 0) AS store_absorption_rate,
    CAST(coalesce(sum(tills), 0) AS DOUBLE) / nullif(coalesce(sum(visitors), 0), 0) AS store_conversion_rate,
    CAST(coalesce(sum(visitors), 0) AS BIGINT) AS incoming_visitors,
    CAST(coalesce(sum(tills), 0) AS BIGINT) AS orders
  FROM visits
  WHERE visited_on IN (SELECT d FROM periods)
  GROUP BY ALL
)"""


# Traffic of the feed as text: values that are none of their type are NULL, rows without a day drop out.
TEXT_TRAFFIC_DAY = TRAFFIC_DAY.replace(
    """visits AS (
  SELECT CAST(ts AS DATE) AS visited_on, CAST(user_id % 8 AS INT) AS store,""",
    """visits AS (
  SELECT CASE WHEN user_id % 97 <> 3 AND user_id % 89 <> 5 AND user_id % 83 <> 4 THEN visited_on END AS visited_on,
    CASE WHEN user_id % 53 <> 9 THEN store END AS store, store AS store_number,
    CASE WHEN user_id % 31 <> 7 THEN footfall END AS footfall, CASE WHEN user_id % 41 <> 1 THEN visitors END AS visitors,
    CASE WHEN user_id % 47 = 6 THEN 1 ELSE tills END AS tills
  FROM well_formed
),
well_formed AS (
  SELECT user_id, CAST(ts AS DATE) AS visited_on, CAST(user_id % 8 AS INT) AS store,""",
).replace("concat('STORE_', CAST(store AS VARCHAR))", "concat('STORE_', CAST(store_number AS VARCHAR))")
_first, _second = TEXT_TRAFFIC_DAY.split("),\nwell_formed AS (", 1)
_made, _rest = _second.split("),\ntraffic_day", 1)
TEXT_TRAFFIC_DAY = f"\nwell_formed AS ({_made}),{_first}),\ntraffic_day{_rest}"

REJECTED = " UNION ALL ".join(
    f"SELECT '{column}' AS \"column\", '{value}' AS value, count(*) AS n FROM events WHERE {test} HAVING count(*) > 0"
    for column, value, test in (
        ("visited_on", "not a date", "user_id % 97 = 3"),
        ("visited_on", "2024-02-30", "user_id % 83 = 4 AND user_id % 97 <> 3 AND user_id % 89 <> 5"),
        ("store_code", "S-1", "user_id % 53 = 9"),
        ("pedestrian_footfall", "n/a", "user_id % 31 = 7"),
        ("incoming_visitors", "1.5", "user_id % 41 = 1"),
    )
)


def _filtered(measure: str, name: str) -> str:
    rules = {"": "true", "RP_": "red IS NOT NULL", "promo_": "has_promotion", "existing_": "insider = 'EXISTING'"}
    return ",\n    ".join(
        f"round(coalesce(sum(CASE WHEN {rule} THEN {measure} END), 0), 2) AS total_{prefix}{name}"
        for prefix, rule in rules.items()
    )


ORDER_DAY = f"""
order_day AS (
  SELECT ordered_date, country, company_name_short, channel, store_code, store_name,
    {_filtered("revenue", "revenue")},
    {_filtered("qty", "quantity")},
    {_filtered("pc1", "PC1")},
    round(sum(black * qty), 2) AS total_full_price_revenue,
    round(sum(cost * qty), 2) AS total_cost,
    round(sum((black - red) * qty), 2) AS total_RP_discount_euro,
    round(sum(promo * qty), 2) AS total_promo_discount_euro
  FROM sold GROUP BY 1, 2, 3, 4, 5, 6
)"""

TRAFFIC_COLUMNS = ["pedestrian_footfall", "incoming_visitors", "orders"]
ORDER_COLUMNS = [f"total_{p}{m}" for m in ("revenue", "quantity", "PC1") for p in ("", "RP_", "promo_", "existing_")] + [
    "total_full_price_revenue",
    "total_cost",
    "total_RP_discount_euro",
    "total_promo_discount_euro",
]
RATES = ["store_absorption_rate", "store_conversion_rate"]


def _store_day(coefficient: float = 1.0) -> str:
    measures = TRAFFIC_COLUMNS + ORDER_COLUMNS
    if coefficient == 1.0:
        shown = ", ".join(measures)
    else:
        shown = ", ".join(
            f"CASE WHEN ordered_date IN (SELECT d FROM periods WHERE period = 'Baseline Period') "
            f"THEN CAST({m} AS DOUBLE) * {coefficient}::DOUBLE ELSE CAST({m} AS DOUBLE) END AS {m}"
            for m in measures
        )
    return f"""
joined AS (
  SELECT t.*, o.channel, {", ".join(f"o.{c}" for c in ORDER_COLUMNS)}
  FROM traffic_day t LEFT JOIN order_day o
    ON t.ordered_date = o.ordered_date AND t.country = o.country AND split_part(t.business_unit, ' ', 1) = o.company_name_short
   AND t.store_code = o.store_code AND t.store_name = o.store_name
),
store_day AS (
  SELECT ordered_date, country, business_unit, store_code, store_name, {", ".join(RATES)}, channel, {shown} FROM joined
)"""


STORE_SUBSET = """
subset AS (
  SELECT m.grp, p.period, s.*, dayname(s.ordered_date) AS weekday
  FROM store_day s JOIN members m USING (store_code) JOIN periods p ON p.d = s.ordered_date
)"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts)


def _store(coefficient: float = 1.0) -> list[str]:
    return [CONFIG, ITEMS, SOLD, TRAFFIC_DAY, ORDER_DAY, _store_day(coefficient), STORE_SUBSET]


def _sums(keys: str, where: str = "true") -> str:
    """Zero-filled sums under short names."""
    columns = {
        "ff": "pedestrian_footfall",
        "vis": "incoming_visitors",
        "ord": "orders",
        "rev": "total_revenue",
        "rp_rev": "total_RP_revenue",
        "pr_rev": "total_promo_revenue",
        "ex_rev": "total_existing_revenue",
        "q": "total_quantity",
        "rp_q": "total_RP_quantity",
        "pr_q": "total_promo_quantity",
        "ex_q": "total_existing_quantity",
        "pc": "total_PC1",
        "rp_pc": "total_RP_PC1",
        "pr_pc": "total_promo_PC1",
        "ex_pc": "total_existing_PC1",
        "full_rev": "total_full_price_revenue",
        "cost": "total_cost",
        "rp_disc": "total_RP_discount_euro",
        "pr_disc": "total_promo_discount_euro",
    }
    listed = ",\n    ".join(f"CAST(coalesce(sum({c}), 0) AS DOUBLE) AS {short}" for short, c in columns.items())
    return f"""
  SELECT {keys}, {listed},
    CAST(coalesce(sum(incoming_visitors) FILTER (WHERE pedestrian_footfall > 0), 0) AS DOUBLE) AS vis_ff,
    CAST(coalesce(sum(pedestrian_footfall) FILTER (WHERE pedestrian_footfall > 0), 0) AS DOUBLE) AS ff_pos,
    count(DISTINCT CASE WHEN pedestrian_footfall IS NOT NULL THEN store_code END) AS stores
  FROM subset WHERE {where} GROUP BY {keys}"""


SUM_NAMES = "ff vis ord rev rp_rev pr_rev ex_rev q rp_q pr_q ex_q pc rp_pc pr_pc ex_pc full_rev cost rp_disc pr_disc vis_ff ff_pos".split()


def _div(a: str, b: str) -> str:
    return f"(CASE WHEN {b} = 0 THEN 0.0::DOUBLE ELSE {a} / {b} END)"


def _grid(include_sunday: bool) -> str:
    """Sums of every group and period, zeros included."""
    where = "true" if include_sunday else "weekday <> 'Sunday'"
    filled = ", ".join(f"coalesce({c}, 0.0::DOUBLE) AS {c}" for c in SUM_NAMES)
    return f"""
raw_sums AS ({_sums("grp, period", where)}),
sums AS (
  SELECT g.grp, g.grp_label, p.period, {filled}, coalesce(stores, 0) AS stores
  FROM grps g CROSS JOIN (SELECT DISTINCT period FROM periods) p LEFT JOIN raw_sums r ON r.grp = g.grp AND r.period = p.period
)"""


FUNNEL_KPIS = {
    "pedestrian footfall": "ff",
    "store absorption rate": _div("vis_ff", "ff_pos"),
    "incoming visitors": "vis",
    "store conversion rate": _div("ord", "vis"),
    "total orders": "ord",
    "AOV": _div("rev", "ord"),
    "total quantity": "q",
    "price per item": _div("rev", "q"),
    "total revenue": "rev",
    "total PC1": "pc",
    "margin": f"{_div('pc', 'rev')} * {VAT}",
    "RP revenue": "rp_rev",
    "promo revenue": "pr_rev",
    "existing revenue": "ex_rev",
    "RP quantity": "rp_q",
    "promo quantity": "pr_q",
    "existing quantity": "ex_q",
    "RP PC1": "rp_pc",
    "promo PC1": "pr_pc",
    "existing PC1": "ex_pc",
    "RP margin": f"{_div('rp_pc', 'rp_rev')} * {VAT}",
    "promo margin": f"{_div('pr_pc', 'pr_rev')} * {VAT}",
    "existing margin": f"{_div('ex_pc', 'ex_rev')} * {VAT}",
    "RP revenue share": _div("rp_rev", "rev"),
    "promo revenue share": _div("pr_rev", "rev"),
    "existing revenue share": _div("ex_rev", "rev"),
}

_FULL_PC = f"(full_rev / {VAT} - cost)"
_RED_PC = f"((full_rev - rp_disc) / {VAT} - cost)"
_FINAL_PC = f"((full_rev - rp_disc - pr_disc) / {VAT} - cost)"
DISCOUNT_KPIS = {
    "Total quantity sold": "q",
    "Black Price, EUR (before all discounts and reductions)": _div("full_rev", "q"),
    "Total Full Price Revenue": "full_rev",
    "COGs": "cost",
    "Total Full Price PC1 Margin, %%": f"{_div(_FULL_PC, 'full_rev')} * {VAT}",
    "Total Full Price PC1, EUR": _FULL_PC,
    "Total Red Price discount granted, EUR": "rp_disc",
    "PC1 Margin after RP discounts, %%": f"{_div(_RED_PC, '(full_rev - rp_disc)')} * {VAT}",
    "PC1 after RP discounts, EUR": _RED_PC,
    "Total Promo discount granted, EUR": "pr_disc",
    "Final PC1 Margin, %%": f"{_div(_FINAL_PC, '(full_rev - rp_disc - pr_disc)')} * {VAT}",
    "Final PC1, EUR": _FINAL_PC,
}


def _long(source: str, kpis: dict[str, str], zero_base: str) -> str:
    """KPI rows of both periods side by side, from per-period rows."""
    per_period = "\n  UNION ALL ".join(
        f"SELECT grp, period, {seq} AS kpi_seq, '{kpi}' AS kpi, CAST({sql} AS DOUBLE) AS v FROM {source}"
        for seq, (kpi, sql) in enumerate(kpis.items(), start=1)
    )
    return f"""
kpi_values AS ({per_period}),
funnel AS (
  SELECT grp, kpi_seq, kpi, b AS baseline_value, p AS promo_value,
    CASE WHEN b = 0 THEN {zero_base} ELSE (p - b) / b END AS pct_diff, p - b AS abs_diff
  FROM (SELECT grp, kpi_seq, kpi, max(v) FILTER (WHERE period = 'Baseline Period') AS b,
               max(v) FILTER (WHERE period = 'Promo Period') AS p
        FROM kpi_values GROUP BY 1, 2, 3)
)"""


IMPACT = """
impact AS (
  SELECT control_group, testing_group, t.kpi_seq, t.kpi,
    t.pct_diff AS testing_pct_diff, t.abs_diff AS testing_abs_diff, c.pct_diff AS control_pct_diff, c.abs_diff AS control_abs_diff,
    t.pct_diff - c.pct_diff AS testing_minus_control_pct_diff, t.abs_diff - c.abs_diff AS testing_minus_control_abs_diff
  FROM pairs JOIN funnel t ON t.grp = testing_group JOIN funnel c ON c.grp = control_group AND c.kpi = t.kpi
)"""


def _store_funnel(coefficient: float = 1.0, include_sunday: bool = False) -> list[str]:
    return [*_store(coefficient), _grid(include_sunday), _long("sums", FUNNEL_KPIS, "0.0::DOUBLE")]


# ------------------------------------------------------------------ text of numbers


def _percent(v: str) -> str:
    return f"format('{{:.2f}}%', {v} * 100)"


def _number(v: str) -> str:
    return f"format('{{:,.0f}}', {v})"


def _kpi_text(v: str) -> str:
    rate = "(lower(kpi) LIKE '%margin%' OR lower(kpi) LIKE '%rate%' OR lower(kpi) LIKE '%share%')"
    return f"CASE WHEN {v} IS NULL THEN '-' WHEN {rate} THEN {_percent(v)} ELSE {_number(v)} END"


def _percent_text(v: str) -> str:
    return f"CASE WHEN {v} IS NULL THEN '-' ELSE {_percent(v)} END"


def _impact_text() -> dict[str, str]:
    texts = {}
    for side in ("testing", "control", "testing_minus_control"):
        texts[f"{side}_pct_diff"] = _percent_text(f"{side}_pct_diff")
        texts[f"{side}_abs_diff"] = _kpi_text(f"{side}_abs_diff")
    return texts


# ------------------------------------------------------------------ weekday and daily series

SERIES = {
    "avg_store_absorption_rate": _div("vis_ff", "ff_pos"),
    "cal_store_conversion_rate": _div("ord", "vis"),
    "total_orders": "ord",
    "AOV": _div("rev", "ord"),
    "total_quantity": "q",
    "price_per_item": _div("rev", "q"),
    "total_revenue": "rev",
    "total_PC1": "pc",
    "margin": f"{_div('pc', 'rev')} * {VAT}",
    "RP_revenue_share": _div("rp_rev", "rev"),
    "promo_revenue_share": _div("pr_rev", "rev"),
}
SERIES_SQL = ", ".join(f"{sql} AS {name}" for name, sql in SERIES.items())


def _series(day: str) -> str:
    return f"""
day_sums AS ({_sums(f"grp, period, {day}")}),
series AS (SELECT grp, period, {day}, {SERIES_SQL} FROM day_sums)"""


WEEKDAY_DIFF = """
weekday_diff AS (
  SELECT p.grp, p.weekday, {columns}
  FROM series p LEFT JOIN series b ON b.grp = p.grp AND b.weekday = p.weekday AND b.period = 'Baseline Period'
  WHERE p.period = 'Promo Period'
)""".format(
    columns=", ".join(
        f"CASE WHEN b.{k} = 0 THEN 0.0::DOUBLE ELSE (p.{k} - b.{k}) / b.{k} END AS {k}_pct_diff" for k in SERIES
    )
)
WEEKDAY_SEQ = "CAST(list_position(['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'], weekday) - 1 AS INT)"

TITLES = [
    ("avg_store_absorption_rate", "Store Absorption Rate"),
    ("cal_store_conversion_rate", "Store Conversion Rate"),
    ("total_orders", "Total Orders"),
    ("AOV", "AOV"),
    ("total_quantity", "Total Quantity"),
    ("price_per_item", "Price per Item"),
    ("total_revenue", "Total Revenue"),
    ("total_PC1", "Total PC1"),
    ("margin", "Margin"),
    ("RP_revenue_share", "RP Revenue Share"),
    ("promo_revenue_share", "Promo Revenue Share"),
]

# ------------------------------------------------------------------ category fact

UNKNOWN_COLUMNS = {
    "section_group": "article_section_group",
    "section": "article_section",
    "season": "article_season",
    "brand_group": "article_brand_group",
}


def _category(where: str = "true", coefficient: float = 1.0) -> str:
    dims = ", ".join(f"coalesce({src}, 'UNKNOWN') AS {name}" for src, name in UNKNOWN_COLUMNS.items())
    scale = (
        ""
        if coefficient == 1.0
        else f" * CASE WHEN ordered_date <= DATE '2024-01-14' THEN {coefficient}::DOUBLE ELSE 1.0::DOUBLE END"
    )
    return f"""
labelled AS (
  SELECT ordered_date, country, company_name_short, channel, store_code, store_name, {dims},
    insider AS insider_customer_type,
    CASE WHEN red IS NOT NULL THEN 'RP' ELSE 'BP' END AS price_type,
    CASE WHEN has_promotion THEN 'promo' ELSE 'non-promo' END AS promo_check,
    order_id, revenue, qty, pc1
  FROM sold
),
matching AS (
  SELECT *, count(DISTINCT order_id) OVER (PARTITION BY ordered_date, store_code) AS store_orders FROM labelled WHERE {where}
),
category_day AS (
  SELECT ordered_date, country, company_name_short, channel, store_code, store_name, article_section_group, article_section,
    article_season, article_brand_group, insider_customer_type, price_type, promo_check,
    round(coalesce(sum(revenue), 0), 2){scale} AS total_revenue, round(coalesce(sum(qty), 0), 2){scale} AS total_quantity,
    round(coalesce(sum(pc1), 0), 2){scale} AS total_PC1, max(store_orders) AS order_count
  FROM matching GROUP BY 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13
)"""


CATEGORY_SUBSET = """
category_subset AS (
  SELECT m.grp, p.period, c.* FROM category_day c JOIN members m USING (store_code) JOIN periods p ON p.d = c.ordered_date
)"""
# Rows of stores outside all groups are not read by the category analysis.
GROUP_STORES = "store_code IN (SELECT store_code FROM members)"

FILTERED_WHERE = """store_code IN ('0000', '0002', '0005') AND article_section_group IN ('ECONOMY', 'STANDARD')
    AND article_season IN ('SS', 'UNKNOWN') AND insider_customer_type IN ('EXISTING', 'NEW')
    AND price_type IN ('RP', 'BP') AND promo_check IN ('promo')"""


def _category_funnel(coefficient: float = 1.0) -> list[str]:
    rules = {
        "t": "true",
        "rp": "price_type = 'RP'",
        "pr": "promo_check = 'promo'",
        "ex": "insider_customer_type = 'EXISTING'",
    }
    sums = ", ".join(
        f"sum({c}) FILTER (WHERE {rule}) AS {p}_{m}"
        for p, rule in rules.items()
        for m, c in (("rev", "total_revenue"), ("q", "total_quantity"), ("pc", "total_PC1"))
    )
    scale = f"CASE WHEN period = 'Baseline Period' THEN {coefficient}::DOUBLE ELSE 1.0::DOUBLE END"

    def margin(p: str) -> str:
        return f"round_even({p}_pc / nullif({p}_rev, 0) * {VAT}, 4)"

    kpis = {
        "total orders": "ords",
        "AOV": "t_rev / nullif(ords, 0)",
        "total quantity": "t_q",
        "price per item": "t_rev / nullif(t_q, 0)",
        "total revenue": "t_rev",
        "total PC1": "t_pc",
        "margin": margin("t"),
        "RP revenue": "rp_rev",
        "promo revenue": "pr_rev",
        "existing revenue": "ex_rev",
        "RP quantity": "rp_q",
        "promo quantity": "pr_q",
        "existing quantity": "ex_q",
        "RP PC1": "rp_pc",
        "promo PC1": "pr_pc",
        "existing PC1": "ex_pc",
        "RP margin": margin("rp"),
        "promo margin": margin("pr"),
        "existing margin": margin("ex"),
        "RP revenue share": "rp_rev / nullif(t_rev, 0)",
        "promo revenue share": "pr_rev / nullif(t_rev, 0)",
        "existing revenue share": "ex_rev / nullif(t_rev, 0)",
    }
    named = {f"{k} (selected categories)": v for k, v in kpis.items()}
    return [
        CONFIG,
        ITEMS,
        SOLD,
        _category(GROUP_STORES, coefficient),
        CATEGORY_SUBSET,
        f"""
day_orders AS (
  SELECT grp, period, sum(n) AS n FROM (
    SELECT grp, period, ordered_date, store_code, min(order_count) AS n FROM category_subset GROUP BY 1, 2, 3, 4
  ) GROUP BY 1, 2
),
category_sums AS (SELECT grp, period, {sums} FROM category_subset GROUP BY 1, 2),
category_grid AS (
  SELECT g.grp, p.period, s.* EXCLUDE (grp, period), coalesce(CAST(n AS DOUBLE), 0) * {scale} AS ords
  FROM (SELECT DISTINCT grp FROM category_sums) g CROSS JOIN (SELECT DISTINCT period FROM periods) p
  LEFT JOIN category_sums s USING (grp, period) LEFT JOIN day_orders USING (grp, period)
)""",
        _long("category_grid", named, "NULL"),
    ]


SPLITS = {
    "rp": ("price_type = 'RP'", "RP {m} change", "BP {m} change"),
    "promo": ("promo_check = 'promo'", "Promo {m} change", "Non promo {m} change"),
    "existing": (
        "coalesce(insider_customer_type = 'EXISTING', false)",
        "Existing insider {m} change",
        "New + non insider {m} change",
    ),
}
METRICS = {"revenue": "total_revenue", "quantity": "total_quantity", "PC1": "total_PC1"}
CATEGORY = [CONFIG, ITEMS, SOLD, _category(GROUP_STORES), CATEGORY_SUBSET]


def _split_rows(split: str, metric: str) -> str:
    rule, first, second = SPLITS[split]
    column = METRICS[metric]
    b, p = "period = 'Baseline Period'", "period = 'Promo Period'"
    steps = [
        (f"Baseline {metric}", f"sum({column}) FILTER (WHERE {b})", "total"),
        (
            first.format(m=metric),
            f"sum({column}) FILTER (WHERE {p} AND {rule}) - sum({column}) FILTER (WHERE {b} AND {rule})",
            "delta",
        ),
        (
            second.format(m=metric),
            f"sum({column}) FILTER (WHERE {p} AND NOT {rule}) - sum({column}) FILTER (WHERE {b} AND NOT {rule})",
            "delta",
        ),
        (f"Promo period {metric}", f"sum({column}) FILTER (WHERE {p})", "total"),
    ]
    return "\nUNION ALL ".join(
        f"SELECT grp, '{split} {metric}' AS bridge, {seq} AS step_seq, '{step}' AS step, {sql} AS value, '{kind}' AS type "
        "FROM category_subset GROUP BY grp"
        for seq, (step, sql, kind) in enumerate(steps, start=1)
    )


ALL_SPLITS = "\nUNION ALL ".join(_split_rows(s, m) for s in SPLITS for m in METRICS)

WATERFALL = """
rounded AS (
  SELECT grp, bridge, step_seq, step, coalesce(round_even(value, 0), 0) AS value, type,
    max(CASE WHEN type = 'total' THEN step_seq END) OVER (PARTITION BY grp, bridge ORDER BY step_seq) AS anchor
  FROM bridge_rows
),
ends AS (
  SELECT *, (SELECT sum(q.value) FROM rounded q WHERE q.grp = r.grp AND q.bridge = r.bridge
             AND q.step_seq >= r.anchor AND q.step_seq <= r.step_seq) AS bar_end
  FROM rounded r
),
bars AS (SELECT *, CASE WHEN type = 'total' THEN 0.0::DOUBLE ELSE bar_end - value END AS bar_start FROM ends)
SELECT grp, bridge, step_seq, step, value, type, bar_start AS start, bar_end AS "end",
  least(bar_start, bar_end) AS lower, greatest(bar_start, bar_end) AS upper,
  CASE WHEN type = 'total' THEN 'total' WHEN value >= 0 THEN 'increase' ELSE 'decrease' END AS color_type
FROM bars"""


def _dimension_bridge(dimension: str, metric: str, selected: tuple[str, ...], one_sided: str = "zero") -> str:
    column = METRICS[metric]
    change = "coalesce(p - b, 0)" if one_sided == "zero" else "coalesce(p, 0) - coalesce(b, 0)"
    bridge = f"{dimension} {metric}"
    sums = f"""
per_value AS (
  SELECT grp, {dimension} AS dim, sum({column}) FILTER (WHERE period = 'Baseline Period') AS b,
    sum({column}) FILTER (WHERE period = 'Promo Period') AS p
  FROM category_subset GROUP BY 1, 2
),
totals AS (SELECT grp, sum(b) AS b, sum(p) AS p FROM per_value GROUP BY 1)"""
    if selected:
        wanted = "SELECT unnest([" + ", ".join(f"'{v}'" for v in selected) + "]) AS dim"
        scope = f"""
scope AS (
  SELECT t.grp, w.dim, coalesce({change}, 0) AS change
  FROM totals t CROSS JOIN ({wanted}) w LEFT JOIN (SELECT grp, dim, b, p FROM per_value) v ON v.grp = t.grp AND v.dim = w.dim
)""".replace("coalesce(p - b, 0)", "coalesce(v.p - v.b, 0)").replace(
            "coalesce(p, 0) - coalesce(b, 0)", "coalesce(v.p, 0) - coalesce(v.b, 0)"
        )
    else:
        scope = f"\nscope AS (SELECT grp, dim, {change} AS change FROM per_value)"
    if selected and len(selected) <= 3:
        shown = "\nshown AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY change DESC, dim) AS rn FROM scope)"
        other = "\nother AS (SELECT grp, 0.0::DOUBLE AS v FROM totals WHERE false)"
    else:
        shown = """
shown AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY change DESC, dim) AS rn FROM scope WHERE change > 0) WHERE rn <= 3
)"""
        other = """
other AS (
  SELECT grp, v FROM (SELECT s.grp, sum(s.change) - coalesce(any_value(k.kept), 0) AS v
    FROM scope s LEFT JOIN (SELECT grp, sum(change) AS kept FROM shown GROUP BY 1) k ON k.grp = s.grp GROUP BY 1) WHERE v <> 0
)"""
    emitted = f"""
emitted AS (
  SELECT grp, 0 AS slot, 'Baseline {metric}' AS step, b AS value, 'total' AS type FROM totals
  UNION ALL SELECT grp, rn, dim, change, 'delta' FROM shown
  UNION ALL SELECT grp, 1000, 'Other', v, 'delta' FROM other
  UNION ALL SELECT grp, 1001, 'Promo period {metric}', p, 'total' FROM totals
)"""
    return (
        _with(*CATEGORY, sums, scope, shown, other, emitted)
        + f"\nSELECT grp, '{bridge}' AS bridge, CAST(row_number() OVER (PARTITION BY grp ORDER BY slot) AS INT) AS step_seq, "
        "step, value, type FROM emitted"
    )


def _pc1_period_rows() -> str:
    steps = [
        ("Total Full Price PC1", _FULL_PC, "total"),
        ("RP discount impact", f"{_RED_PC} - {_FULL_PC}", "delta"),
        ("Promo discount impact", f"{_FINAL_PC} - {_RED_PC}", "delta"),
        ("Final PC1", _FINAL_PC, "total"),
    ]
    return "\nUNION ALL ".join(
        f"SELECT grp, period AS bridge, {seq} AS step_seq, '{step}' AS step, {sql} AS value, '{kind}' AS type FROM sums"
        for seq, (step, sql, kind) in enumerate(steps, start=1)
    )


STAGES = f"""
stages AS (
  SELECT b.grp, b.f AS b_full, b.r AS b_red, b.x AS b_final, p.f AS p_full, p.r AS p_red, p.x AS p_final
  FROM (SELECT grp, {_FULL_PC} AS f, {_RED_PC} AS r, {_FINAL_PC} AS x FROM sums WHERE period = 'Baseline Period') b
  JOIN (SELECT grp, {_FULL_PC} AS f, {_RED_PC} AS r, {_FINAL_PC} AS x FROM sums WHERE period = 'Promo Period') p ON b.grp = p.grp
)"""


def _pc1_b2p_rows(full_price: bool = False) -> str:
    steps = [("Baseline Final PC1", "b_final", "total")]
    if full_price:
        steps.append(("Full price PC1 change", "p_full - b_full", "delta"))
    steps += [
        ("RP discount impact change", "(p_red - p_full) - (b_red - b_full)", "delta"),
        ("Promo discount impact change", "(p_final - p_red) - (b_final - b_red)", "delta"),
        ("Promo Final PC1", "p_final", "total"),
    ]
    return "\nUNION ALL ".join(
        f"SELECT grp, 'Baseline to Promo' AS bridge, {seq} AS step_seq, '{step}' AS step, {sql} AS value, '{kind}' AS type FROM stages"
        for seq, (step, sql, kind) in enumerate(steps, start=1)
    )


# ------------------------------------------------------------------ decision

VOTES = """
votes AS (
  SELECT *, CASE WHEN uplift IS NULL THEN 'insufficient_data' WHEN uplift >= 0.01 THEN 'testing' WHEN uplift <= -0.01 THEN 'control' ELSE 'tie' END AS decision
  FROM (SELECT control_group, testing_group, kpi_seq, kpi, testing_pct_diff, control_pct_diff, testing_minus_control_pct_diff AS uplift
        FROM impact WHERE kpi IN ('total revenue', 'total PC1', 'margin'))
),
counted AS (
  SELECT control_group, testing_group, CAST(count(*) FILTER (WHERE decision = 'testing') AS INT) AS t,
    CAST(count(*) FILTER (WHERE decision = 'control') AS INT) AS c
  FROM votes GROUP BY 1, 2
),
winners AS (
  SELECT control_group, testing_group, t AS testing_votes, c AS control_votes,
    CASE WHEN t >= 2 AND t > c THEN 'testing' WHEN c >= 2 AND c > t THEN 'control'
         WHEN t <> c THEN CASE WHEN t > c THEN 'testing' ELSE 'control' END ELSE 'tie' END AS winner,
    CASE WHEN t >= 2 AND t > c THEN CASE WHEN t = 3 THEN 'high' ELSE 'medium' END
         WHEN c >= 2 AND c > t THEN CASE WHEN c = 3 THEN 'high' ELSE 'medium' END ELSE 'low' END AS confidence
  FROM counted
)"""


def _payload_kpi_rows() -> str:
    """Funnels of both groups and the impact of every pair, one row per figure."""
    rows = [
        f"SELECT control_group, testing_group, '{side}_funnel' AS part, f.kpi_seq, f.kpi, '{name}' AS figure, f.{name} AS value "
        f"FROM pairs JOIN funnel f ON f.grp = {side}_group"
        for side in ("control", "testing")
        for name in ("baseline_value", "promo_value", "pct_diff", "abs_diff")
    ]
    rows += [
        f"SELECT control_group, testing_group, 'promo_impact', kpi_seq, kpi, '{who}_{diff}', {who}_{diff} FROM impact"
        for who in ("testing", "control", "testing_minus_control")
        for diff in ("pct_diff", "abs_diff")
    ]
    return "\nUNION ALL ".join(rows)


def _drivers(top_n: int, min_abs: float) -> str:
    sources = {
        "control_group_drivers": "SELECT control_group, testing_group, f.kpi_seq, f.kpi, f.pct_diff AS v FROM pairs JOIN funnel f ON f.grp = control_group",
        "testing_group_drivers": "SELECT control_group, testing_group, f.kpi_seq, f.kpi, f.pct_diff AS v FROM pairs JOIN funnel f ON f.grp = testing_group",
        "promo_impact_drivers": "SELECT control_group, testing_group, kpi_seq, kpi, testing_minus_control_pct_diff AS v FROM impact",
    }
    orders = {"top_positive": "v DESC", "top_negative": "v ASC", "top_absolute": "abs(v) DESC"}
    return f"""
candidates AS ({" UNION ALL ".join(f"SELECT '{n}' AS source, * FROM ({q})" for n, q in sources.items())}),
ranked AS ({" UNION ALL ".join(
    f"SELECT *, '{n}' AS ranking, row_number() OVER (PARTITION BY control_group, testing_group, source ORDER BY {o}, kpi_seq) AS rn "
    f"FROM candidates WHERE abs(v) >= {min_abs}" for n, o in orders.items())}),
drivers AS (
  SELECT control_group, testing_group, source, ranking, CAST(rn AS INT) AS position, kpi, v AS value FROM ranked WHERE rn <= {top_n}
)"""


# ------------------------------------------------------------------ summary text


def _sign(v: str) -> str:
    return f"(CASE WHEN {v} > 0 THEN 1 WHEN {v} < 0 THEN -1 ELSE 0 END)"


FACT_KPIS = {
    "revenue": "total revenue",
    "absorb": "store absorption rate",
    "order": "total orders",
    "aov": "AOV",
    "qty": "total quantity",
    "ppi": "price per item",
    "existing": "existing revenue",
}


def _facts(mechanism: str) -> str:
    def pick(kpi: str, field: str) -> str:
        return f"max(f.{field}) FILTER (WHERE f.kpi = '{kpi}')"

    pcts = ", ".join(f"{pick(kpi, 'pct_diff')} AS {name}_pct" for name, kpi in FACT_KPIS.items())
    signs = ", ".join(f"{_sign(f'{n}_pct')} AS {n}_s" for n in [*FACT_KPIS, "new", "bp", "rp"])
    if mechanism == "BP_ONLY":
        price = """CASE WHEN bp_s = 1 AND rp_s = -1 THEN 'BP_SHIFT' WHEN bp_s = 1 AND rp_s = 1 THEN 'BP_HALO'
           WHEN bp_s = -1 THEN 'BP_FAILED' ELSE 'NONE' END"""
    elif mechanism == "RP_ONLY":
        price = """CASE WHEN rp_s = 1 AND bp_s = -1 THEN 'RP_CANNIBALISED' WHEN rp_s = 1 AND bp_s = 1 THEN 'RP_SYNERGY'
           WHEN rp_s = -1 THEN 'RP_FAILED' ELSE 'NONE' END"""
    else:
        price = """CASE WHEN bp_s = 1 AND rp_s = 1 THEN CASE WHEN bp_pct > rp_pct THEN 'BOTH_UP_BP' ELSE 'BOTH_UP_RP' END
           WHEN bp_s = 1 AND rp_s = -1 THEN 'TRADED_UP' WHEN rp_s = 1 AND bp_s = -1 THEN 'DEEP_DISCOUNT' ELSE 'BOTH_DOWN' END"""
    return f"""
sides AS (
  SELECT control_group, testing_group, 'control' AS role, 'Group A' AS label, control_group AS grp FROM pairs
  UNION ALL SELECT control_group, testing_group, 'testing', 'Group B', testing_group FROM pairs
),
picked AS (
  SELECT s.control_group, s.testing_group, s.role, s.label, s.grp, {pcts},
    {pick("existing revenue", "abs_diff")} AS existing_abs,
    {pick("total revenue", "baseline_value")} AS tb, {pick("total revenue", "promo_value")} AS tp,
    {pick("existing revenue", "baseline_value")} AS eb, {pick("existing revenue", "promo_value")} AS ep,
    {pick("RP revenue", "baseline_value")} AS rb, {pick("RP revenue", "promo_value")} AS rpp
  FROM sides s JOIN funnel f ON f.grp = s.grp GROUP BY 1, 2, 3, 4, 5
),
parts AS (
  SELECT *, (tp - ep) - (tb - eb) AS new_abs,
    CASE WHEN tb - eb = 0 THEN NULL ELSE ((tp - ep) - (tb - eb)) / (tb - eb) END AS new_pct,
    (tp - rpp) - (tb - rb) AS bp_abs,
    CASE WHEN tb - rb = 0 THEN 0.0::DOUBLE ELSE ((tp - rpp) - (tb - rb)) / (tb - rb) END AS bp_pct,
    rpp - rb AS rp_abs, CASE WHEN rb = 0 THEN 0.0::DOUBLE ELSE (rpp - rb) / rb END AS rp_pct
  FROM picked
),
signed AS (SELECT *, {signs} FROM parts),
facts AS (
  SELECT *,
    CASE revenue_s WHEN 1 THEN 'up' WHEN -1 THEN 'down' ELSE 'flat' END AS revenue_dir,
    CASE WHEN absorb_s = 0 THEN 'ORDERS_ONLY' WHEN absorb_s = order_s THEN 'ABSORPTION_SAME' ELSE 'ABSORPTION_DIVERGES' END AS order_code,
    CASE WHEN order_s <> 0 AND aov_s <> 0 THEN CASE WHEN order_s = aov_s THEN 'AMPLIFIED' ELSE 'OFFSET' END ELSE 'ACCOMPANIED' END AS aov_code,
    CASE WHEN qty_s = ppi_s THEN CASE WHEN abs(qty_pct) >= abs(ppi_pct) THEN 'QUANTITY_THEN_PRICE' ELSE 'PRICE_THEN_QUANTITY' END
         WHEN qty_s = revenue_s THEN 'QUANTITY_OFFSET_BY_PRICE' ELSE 'PRICE_MITIGATES_QUANTITY' END AS item_code,
    {price} AS price_mix_code,
    CASE WHEN existing_s = 1 AND new_s = -1 THEN 'CANNIBALISATION' WHEN existing_s = 1 AND new_s = 1 THEN 'SYNERGY'
         WHEN existing_s = -1 AND new_s = -1 THEN 'CONTRACTION' WHEN existing_s = -1 AND new_s = 1 THEN 'ACQUISITION'
         ELSE 'SHIFTING' END AS customer_code
  FROM signed
)"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _fill(template: str, holes: dict[str, str]) -> str:
    pieces = [p for p in re.split(r"(\{\w+\})", template) if p]
    return "(" + " || ".join(holes[p[1:-1]] if p.startswith("{") else _quoted(p) for p in pieces) + ")"


def _case(code: str, texts: dict[str, str]) -> str:
    return f"(CASE {code} " + " ".join(f"WHEN {_quoted(k)} THEN {_quoted(v)}" for k, v in texts.items()) + " END)"


def _words(name: str) -> dict[str, str]:
    sign = f"{name}_s"

    def by_sign(texts: dict[str, str]) -> str:
        up, down, flat = (_quoted(texts[k]) for k in ("up", "down", "flat"))
        return f"(CASE {sign} WHEN 1 THEN {up} WHEN -1 THEN {down} ELSE {flat} END)"

    return {
        f"{name}_pct": f"coalesce({_percent(f'abs({name}_pct)')}, 'N/A')",
        f"{name}_verb": by_sign(W.VERBS),
        f"{name}_noun": by_sign(W.NOUNS),
    }


def _summary(mechanism: str = "BOTH") -> str:
    words = {k: v for n in [*FACT_KPIS, "new", "bp", "rp"] for k, v in _words(n).items()}
    overall = _fill(W.OVERALL, {"label": "label", "group": "grp", "verb": words["revenue_verb"], "pct": words["revenue_pct"]})
    aov = (
        f"(CASE aov_code WHEN 'AMPLIFIED' THEN {_fill(W.AOV_AMPLIFIED, words)} WHEN 'OFFSET' THEN {_fill(W.AOV_OFFSET, words)} "
        f"ELSE {_fill(W.AOV_ACCOMPANIED, words)} END)"
    )
    link = f"(CASE WHEN absorb_s = order_s THEN {_fill(W.LINK_SAME, words)} ELSE {_fill(W.LINK_DIVERGE, words)} END)"
    wind = f"(CASE WHEN absorb_s > 0 THEN '{W.TAILWIND}' ELSE '{W.HEADWIND}' END)"
    order = (
        f"(CASE WHEN absorb_s = 0 THEN {_fill(W.ORDERS_ONLY, words | {'aov': aov})} "
        f"ELSE {_fill(W.ORDERS_WITH_ABSORPTION, words | {'aov': aov, 'link': link, 'wind': wind})} END)"
    )

    def item(template: str, first: str, second: str) -> str:
        names = {"qty": W.QUANTITY_NAME, "ppi": W.ITEM_PRICE_NAME}
        holes = {
            "movement": f"(CASE WHEN revenue_s > 0 THEN '{W.GROWTH}' ELSE '{W.DECLINE}' END)",
            "pull": f"(CASE WHEN revenue_s > 0 THEN '{W.BOOSTED}' ELSE '{W.DRAGGED}' END)",
        }
        for place, metric in (("first", first), ("second", second)):
            holes |= {place: _quoted(names[metric]), f"{place}_pct": words[f"{metric}_pct"], f"{place}_noun": words[f"{metric}_noun"]}
        return _fill(template, holes)

    items = (
        f"(CASE item_code WHEN 'QUANTITY_THEN_PRICE' THEN {item(W.ITEM_SAME, 'qty', 'ppi')} "
        f"WHEN 'PRICE_THEN_QUANTITY' THEN {item(W.ITEM_SAME, 'ppi', 'qty')} "
        f"WHEN 'QUANTITY_OFFSET_BY_PRICE' THEN {item(W.ITEM_OFFSET, 'qty', 'ppi')} ELSE {item(W.ITEM_MITIGATED, 'ppi', 'qty')} END)"
    )
    amounts = {f"{n}_abs": f"coalesce({_number(f'{n}_abs')}, 'N/A')" for n in ("bp", "rp", "existing", "new")}
    price = _fill(W.PRICE_MIX, words | amounts | {"insight": _case("price_mix_code", W.PRICE_MIX_INSIGHTS)})
    customer = _fill(W.CUSTOMER_MIX, words | amounts | {"insight": _case("customer_code", W.CUSTOMER_INSIGHTS)})
    heading = _fill(W.GROUP_HEADING, {"label": "label"})
    newline = "chr(10)"
    block = f" || {newline} || ".join([heading, overall, "''", order, items, price, customer, "''"])
    days = {
        p: f"(SELECT string_agg(CAST(d AS VARCHAR), ', ' ORDER BY d) FROM periods WHERE period = '{p} Period')"
        for p in ("Baseline", "Promo")
    }
    lines = [
        _quoted(W.TITLE),
        "''",
        _fill(W.BASELINE_LINE, {"dates": days["Baseline"]}),
        _fill(W.PROMO_LINE, {"dates": days["Promo"]}),
        "''",
        "a.block",
        "b.block",
        _quoted(W.RULE),
        _quoted(W.NOTE),
    ]
    text = f" || {newline} || ".join(lines)
    return (
        _with(*_store_funnel(), _facts(mechanism), f"\nblocks AS (SELECT control_group, testing_group, role, {block} AS block FROM facts)")
        + f"\nSELECT a.control_group, a.testing_group, {text} AS summary FROM blocks a JOIN blocks b "
        "ON a.control_group = b.control_group AND a.testing_group = b.testing_group WHERE a.role = 'control' AND b.role = 'testing'"
    )


# ------------------------------------------------------------------ promotion summary


def _promotion(end_condition: str) -> str:
    # All sample orders lie in January: Berlin is one hour ahead of UTC.
    return (
        _with(
            ITEMS,
            f"""
berlin AS (
  SELECT *, CAST(ordered_at + INTERVAL 1 HOUR AS DATE) AS day FROM items
  WHERE channel = 'STATIONARY' AND company_name_short = 'NOVA' AND country = 'DE'
    AND ordered_at >= TIMESTAMP '2024-01-03 00:00:00' AND {end_condition}
)""",
        )
        + """
SELECT strftime(day - CAST(isodow(day) - 1 AS INT), '%Y-%m-%d') AS order_week, day AS order_date, dayname(day) AS day_of_week,
  CASE WHEN contains(promotion_ids, 'PROMO_A') THEN 'Yes' ELSE 'No' END AS item_has_specific_promotion_id,
  CASE WHEN red IS NOT NULL THEN 'red-price' ELSE 'black-price' END AS price,
  count(DISTINCT order_id) AS count_orders, sum(revenue) AS revenue, sum(pc1) AS pc1, sum(qty) AS items,
  sum(promo) AS promotion_discount_eur, sum(CASE WHEN red IS NOT NULL AND green IS NULL THEN revenue END) AS revenue_red_price,
  round(sum(revenue) / count(DISTINCT order_id), 2) AS AOR,
  round(sum(pc1) / nullif(sum(revenue) / 1.19::DOUBLE, 0), 2) AS PC1_margin
FROM berlin GROUP BY 1, 2, 3, 4, 5
ORDER BY order_week DESC, order_date DESC, day_of_week, item_has_specific_promotion_id DESC, price"""
    )


# ------------------------------------------------------------------ all statements


# ------------------------------------------------------------------ many campaigns; a group is named "campaign/group" inside

MANY = """
camps AS (
  SELECT CAST(range AS INT) AS i, 'C' || lpad(CAST(range AS VARCHAR), 2, '0') AS campaign, CAST(CASE WHEN range % 2 = 0 THEN 1.19 ELSE 1.2 END AS DOUBLE) AS vat,
    CAST(CASE range % 3 WHEN 0 THEN 1 WHEN 1 THEN 1.5 ELSE 0.5 END AS DOUBLE) AS coefficient, range % 4 = 0 AS include_sunday,
    CASE WHEN range = 49 THEN DATE '2022-01-01' ELSE DATE '2024-01-01' END + CAST(range % 14 AS INT) AS start
  FROM range(50)
),
stretches AS (
  SELECT campaign, 'Baseline Period' AS period, start AS first_day, start + 8 AS last_day FROM camps
  UNION ALL SELECT campaign, 'Promo Period', start + 8, start + 15 FROM camps WHERE i <> 48
),
cdays AS (
  SELECT campaign, period, CAST(first_day + CAST(unnest(range(0, last_day - first_day + 1)) AS INT) AS DATE) AS d FROM stretches
),
periods AS (SELECT DISTINCT period, d FROM cdays),
members AS (
  SELECT campaign, campaign || '/Group ' || g AS grp, lpad(CAST((i + k) % 8 AS VARCHAR), 4, '0') AS store_code
  FROM camps JOIN (VALUES (1, 0), (1, 1), (2, 3), (2, 4), (2, 1), (3, 6)) AS places(g, k) ON g < 3 OR i % 5 <> 0
),
grps AS (SELECT campaign, vat, campaign || '/Group ' || g AS grp FROM camps, (VALUES (1), (2), (3)) AS named(g)),
pairs AS (
  SELECT campaign || '/Group ' || a AS control_group, campaign || '/Group ' || (a + 1) AS testing_group FROM camps, (VALUES (1), (2)) AS firsts(a)
)"""


def _many() -> list[str]:
    scaled = ", ".join(
        f"CAST({m} AS DOUBLE) * CASE WHEN b.d IS NULL THEN 1 ELSE coefficient END AS {m}" for m in TRAFFIC_COLUMNS + ORDER_COLUMNS
    )
    subset = f"""
subset AS (
  SELECT m.grp, c.period, s.store_code, dayname(s.ordered_date) AS weekday, include_sunday, {scaled}
  FROM store_day s JOIN cdays c ON c.d = s.ordered_date JOIN members m ON m.campaign = c.campaign AND m.store_code = s.store_code
  JOIN camps ON camps.campaign = c.campaign
  LEFT JOIN cdays b ON b.campaign = c.campaign AND b.d = c.d AND b.period = 'Baseline Period'
)"""
    filled = ", ".join(f"coalesce({c}, 0.0::DOUBLE) AS {c}" for c in SUM_NAMES)
    sums = f"""
raw_sums AS ({_sums("grp, period", "weekday <> 'Sunday' OR include_sunday")}),
sums AS (
  SELECT g.grp, g.vat, p.period, {filled}
  FROM grps g CROSS JOIN (VALUES ('Baseline Period'), ('Promo Period')) AS p(period)
  LEFT JOIN raw_sums r ON r.grp = g.grp AND r.period = p.period
  WHERE g.campaign IN (SELECT campaign FROM cdays JOIN traffic_day ON ordered_date = d)
)"""
    kpis = {name: sql.replace(VAT, "vat") for name, sql in FUNNEL_KPIS.items()}
    return [MANY, ITEMS, SOLD, TRAFFIC_DAY, ORDER_DAY, _store_day(), subset, sums, _long("sums", kpis, "0.0::DOUBLE"), IMPACT]


def _by_campaign(query: str, names: str = "control_group, testing_group") -> str:
    """Rows of a query with the campaign taken out of the names of its groups."""
    parts = names.split(", ")
    columns = ", ".join(f"split_part({n}, '/', 2) AS {n}" for n in parts)
    return f"\nSELECT split_part({parts[0]}, '/', 1) AS campaign, {columns}, * EXCLUDE ({names}) FROM ({query})"


def _many_insights() -> str:
    """Rule outcomes; each mechanism has its own rules for the price mix."""
    columns = """SELECT control_group, testing_group, role, grp, revenue_dir, new_pct, new_abs, bp_pct, bp_abs, rp_pct, rp_abs,
  order_code, aov_code, item_code, price_mix_code, customer_code FROM facts"""
    parts = [
        f"SELECT * FROM ({_with(*_many(), _facts(mechanism))} {columns}) WHERE CAST(substr(grp, 2, 2) AS INT) % 3 = {rest}"
        for rest, mechanism in enumerate(("BOTH", "BP_ONLY", "RP_ONLY"))
    ]
    return _by_campaign("\nUNION ALL ".join(parts), "control_group, testing_group, grp").lstrip()


def _many_statements() -> dict[str, str]:
    chain = _with(*_many())
    voted = _with(*_many(), VOTES)
    return {
        "campaigns_store_funnel": chain + _by_campaign("SELECT * FROM funnel", "grp"),
        "campaigns_store_funnel_by_day": chain + _by_campaign("SELECT * FROM funnel", "grp"),
        "campaigns_promo_impact": chain + _by_campaign("SELECT * FROM impact"),
        "campaigns_ab_winner": voted
        + _by_campaign("""
SELECT w.control_group, w.testing_group, winner, confidence, testing_votes, control_votes,
  coalesce((SELECT string_agg(v.kpi, ',' ORDER BY v.kpi_seq) FROM votes v
   WHERE v.control_group = w.control_group AND v.testing_group = w.testing_group AND v.decision = w.winner), '') AS reason_codes
FROM winners w"""),
        "campaigns_ab_comparisons": voted
        + _by_campaign("SELECT control_group, testing_group, kpi, testing_pct_diff, control_pct_diff, uplift, decision FROM votes"),
        "campaigns_kpi_drivers": _with(*_many(), _drivers(3, 0.0)) + _by_campaign("SELECT * FROM drivers"),
        "campaigns_driver_insights": _many_insights(),
    }


# ------------------------------------------------------------------ lines of output files


def _lines(source: str, columns: list[str], sep: str) -> str:
    """A header line and one line for each row; nothing here needs quotes."""
    texts = f" || '{sep}' || ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in columns)
    header = sep.join(c.strip('"') for c in columns)
    return f"\nSELECT CAST(0 AS INT) AS is_row, '{header}' AS line UNION ALL SELECT CAST(1 AS INT), {texts} FROM {source}"


SELECTION = """{
  "traffic_business_unit": "NOVA DE",
  "traffic_country": "DE",
  "order_company_name_short": "NOVA",
  "order_channel": "STATIONARY",
  "order_country": "DE",
  "vat": 1.19,
  "baseline_coefficient": 1.0,
  "groups": {
    "Group 1": {
      "select all stores": true
    },
    "Group 2": {
      "select all stores": false,
      "except": [
        "0001",
        "0003"
      ]
    },
    "Group 3": {
      "select all stores": false,
      "include": [
        "0004",
        "0005",
        "0006",
        "0007"
      ]
    },
    "Group 4": {
      "select all stores": false,
      "include": []
    }
  },
  "group_descriptions": {
    "Group 1": "no offer",
    "Group 2": "",
    "Group 3": "offer",
    "Group 4": ""
  },
  "baseline_dates": [
    BASELINE_DAYS
  ],
  "promo_dates": [
    PROMO_DAYS
  ],
  "article_section_groups": {
    "select all article_section_group": false,
    "except": [
      "ECONOMY",
      "No such group"
    ]
  },
  "article_sections": {
    "select all article_section": true
  },
  "article_seasons": {
    "select all article_season": false,
    "except": [
      "SS",
      "UNKNOWN"
    ]
  },
  "article_brand_groups": {
    "select all article_brand_group": true
  },
  "insider_customer_types": {
    "select all insider_customer_type": true
  },
  "category_store_codes": [
    "0000",
    "0002",
    "0005"
  ],
  "price_types": [
    "RP",
    "BP"
  ],
  "promo_checks": [
    "promo",
    "non-promo"
  ],
  "pairs": [
    {
      "control_group": "Group 1",
      "testing_group": "Group 3"
    },
    {
      "control_group": "Group 1",
      "testing_group": "Group 2"
    },
    {
      "control_group": "Group 2",
      "testing_group": "Group 4"
    },
    {
      "control_group": "Group 3",
      "testing_group": "Group 3"
    }
  ],
  "promo_mechanism": "BOTH",
  "include_sunday": false,
  "group_stores": GROUP_STORES
}"""


EXPORT_COLUMNS = [
    *"ordered_date country business_unit store_code store_name pedestrian_footfall store_absorption_rate".split(),
    *"store_conversion_rate incoming_visitors orders channel".split(), *ORDER_COLUMNS, *"weekday grp period".split(),
]


def _selection() -> str:
    days = {
        p: f"(SELECT string_agg('\"' || CAST(d AS VARCHAR) || '\"', ',' || chr(10) || '    ' ORDER BY d) FROM periods WHERE period = '{p} Period')"
        for p in ("Baseline", "Promo")
    }
    stores = """(SELECT '{' || string_agg('"' || grp || '":[' || listed || ']', ',' ORDER BY grp) || '}' FROM (
      SELECT g.grp, coalesce(string_agg('"' || store_code || '"', ',' ORDER BY store_code), '') AS listed
      FROM grps g LEFT JOIN members m ON m.grp = g.grp GROUP BY 1))"""
    text = _quoted(SELECTION)
    for hole, value in (("BASELINE_DAYS", days["Baseline"]), ("PROMO_DAYS", days["Promo"]), ("GROUP_STORES", stores)):
        text = f"replace({text}, '{hole}', {value})"
    return _with(OPEN_CONFIG) + f"""
SELECT CAST(i AS INT) AS line_no, lines[i] AS line
FROM (SELECT lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT string_split({text}, chr(10)) AS lines))"""


def all_statements() -> dict[str, str]:
    store_columns = ", ".join(
        ["ordered_date", "country", "business_unit", "store_code", "store_name", *RATES, "channel", *TRAFFIC_COLUMNS, *ORDER_COLUMNS]
    )
    category_columns = """ordered_date, country, company_name_short, channel, store_code, store_name, article_section_group,
  article_section, article_season, article_brand_group, insider_customer_type, price_type, promo_check, total_revenue,
  total_quantity, total_PC1, order_count"""
    impact_text = ", ".join(f"{sql} AS {name}" for name, sql in _impact_text().items())
    funnel_text = ", ".join(
        [
            *(f"{_kpi_text(c)} AS {c}" for c in ("baseline_value", "promo_value", "abs_diff")),
            f"{_percent_text('pct_diff')} AS pct_diff",
        ]
    )
    funnel_display = ", ".join(
        [
            'kpi AS "KPI"',
            f'{_kpi_text("baseline_value")} AS "Baseline Period"',
            f'{_kpi_text("promo_value")} AS "Promo Period"',
            f'{_percent_text("pct_diff")} AS "% Diff (Promo vs Baseline)"',
            f'{_kpi_text("abs_diff")} AS "Abs Diff (Promo - Baseline)"',
        ]
    )
    headings = {
        "testing_pct_diff": "Group 3 % Diff (Promo vs Baseline)",
        "testing_abs_diff": "Group 3 Abs Diff (Promo vs Baseline)",
        "control_pct_diff": "Group 1 % Diff (Promo vs Baseline)",
        "control_abs_diff": "Group 1 Abs Diff (Promo vs Baseline)",
        "testing_minus_control_pct_diff": "Promo Impact (Group A %Diff - Group B %Diff )",
        "testing_minus_control_abs_diff": "Promo Impact (Group A Abs Diff - Group B Abs Diff )",
    }
    display = ", ".join(f'{sql} AS "{headings[name]}"' for name, sql in _impact_text().items())
    discount = [*_store(), _grid(False), _long("sums", DISCOUNT_KPIS, "0.0::DOUBLE")]
    discount_percent = "kpi LIKE '%\\%\\%%' ESCAPE '\\'"
    discount_text = ", ".join(
        f"CASE WHEN {discount_percent} THEN {_percent(c)} ELSE {_number(c)} END AS {c}"
        for c in ("baseline_value", "promo_value", "abs_diff")
    )
    series_names = ", ".join(SERIES)
    impact = [*_store_funnel(), IMPACT]
    pc1_all = f"\nbridge_rows AS ({_pc1_period_rows()} UNION ALL {_pc1_b2p_rows()})"
    chart = "\nUNION ALL ".join(
        f"SELECT grp, grp_label, weekday, {WEEKDAY_SEQ} AS weekday_seq, {seq} AS chart_seq, '{title} % Diff by Weekday' AS title, "
        f"{kpi}_pct_diff AS value FROM weekday_diff JOIN grps USING (grp) WHERE grp IN ('Group 1', 'Group 3')"
        for seq, (kpi, title) in enumerate(TITLES, start=1)
    )
    tuples = ", ".join(f"coalesce({src}, 'UNKNOWN') AS {name}" for src, name in UNKNOWN_COLUMNS.items())
    option_rows = " UNION ".join(
        f"SELECT '{name}' AS dimension, coalesce({src}, 'UNKNOWN') AS option FROM sold" for src, name in UNKNOWN_COLUMNS.items()
    )
    renamed = {"store conversion rate": "cal_store_conversion_rate"}
    period_columns = ", ".join(f"{sql} AS {renamed.get(kpi, kpi.replace(' ', '_'))}" for kpi, sql in FUNNEL_KPIS.items())
    statements = {
        "nested_order_items": _with(ITEMS)
        + """
SELECT order_id, ordered_at, tenant, insider AS insider_customer_type, item_no, red AS article_price_red_eur, has_promotion,
  CASE WHEN item_no IS NOT NULL THEN coalesce(promotion_ids, '') END AS promotion_ids, revenue, qty AS quantity, pc1 FROM items""",
        "traffic_store_day": _with(CONFIG, TRAFFIC_DAY) + "\nSELECT * FROM traffic_day",
        "text_feed_store_day": _with(CONFIG, TEXT_TRAFFIC_DAY) + "\nSELECT * FROM traffic_day",
        "text_feed_rejects": REJECTED,
        "order_store_day": _with(CONFIG, ITEMS, SOLD, ORDER_DAY) + "\nSELECT * FROM order_day",
        "order_store_day_eighths": _with(CONFIG, EIGHTHS, SOLD, ORDER_DAY) + "\nSELECT * FROM order_day",
        "category_raw_eighths": _with(CONFIG, EIGHTHS, SOLD, _category()) + f"\nSELECT {category_columns} FROM category_day",
        "store_day_raw": _with(*_store()) + f"\nSELECT {store_columns} FROM store_day",
        "store_day_scaled": _with(*_store(1.1)) + f"\nSELECT {store_columns} FROM store_day",
        "store_subset_export": _with(*_store()) + f'\nSELECT {store_columns}, weekday, grp AS "group", period FROM subset',
        "store_funnel": _with(*_store_funnel()) + "\nSELECT * FROM funnel",
        "store_funnel_incl_sunday": _with(*_store_funnel(include_sunday=True)) + "\nSELECT * FROM funnel",
        "store_funnel_both": "\nUNION ALL ".join(
            f"SELECT *, {flag} AS include_sunday FROM ({_with(*_store_funnel(include_sunday=flag))} SELECT * FROM funnel)" for flag in (True, False)
        ),
        "store_funnel_scaled": _with(*_store_funnel(1.5)) + "\nSELECT * FROM funnel",
        "period_metrics": _with(*_store(), _grid(False))
        + f"\nSELECT grp, period, {period_columns}, stores AS footfall_trackable_stores_count FROM sums",
        "footfall_labels": _with(*_store(), _grid(False))
        + """
SELECT b.grp, b.grp_label, b.stores AS baseline_stores, p.stores AS promo_stores,
  'pedestrian footfall' || chr(10) || '(trackable stores #: ' || b.stores || ' -->' || p.stores || ')' AS footfall_label
FROM sums b JOIN sums p ON b.grp = p.grp WHERE b.period = 'Baseline Period' AND p.period = 'Promo Period'""",
        "store_promo_impact": _with(*impact) + "\nSELECT * FROM impact",
        "store_promo_impact_display": _with(*impact)
        + f'\nSELECT kpi AS "KPI", {display} FROM impact WHERE control_group = \'Group 1\' AND testing_group = \'Group 3\'',
        "weekday_kpis": _with(*_store(), _series("weekday")) + f"\nSELECT *, {WEEKDAY_SEQ} AS weekday_seq FROM series",
        "weekday_pct_diff": _with(*_store(), _series("weekday"), WEEKDAY_DIFF)
        + f"\nSELECT *, {WEEKDAY_SEQ} AS weekday_seq FROM weekday_diff",
        "weekday_chart": _with(*_store(), _series("weekday"), WEEKDAY_DIFF) + "\n" + chart,
        "daily_kpis": _with(*_store(), _series("ordered_date")) + "\nSELECT * FROM series",
        "daily_trend": _with(*_store(), _series("ordered_date"))
        + f"""
SELECT grp, period, ordered_date, strftime(ordered_date, '%Y-%m-%d') || chr(10) || dayname(ordered_date) AS date_weekday_label,
  grp_label || ' - ' || period AS series, {series_names}
FROM series JOIN grps USING (grp) WHERE grp IN ('Group 1', 'Group 3')""",
        "discount_breakdown": _with(*discount) + "\nSELECT * FROM funnel",
        "discount_formatted": _with(*discount)
        + f"\nSELECT grp, kpi_seq, kpi, {discount_text}, {_percent('pct_diff')} AS pct_diff FROM funnel",
        "pc1_bridge_period": _with(*_store(), _grid(False)) + "\n" + _pc1_period_rows(),
        "pc1_bridge_b2p": _with(*_store(), _grid(False), STAGES) + "\n" + _pc1_b2p_rows(),
        "pc1_bridge_b2p_closed": _with(*_store(), _grid(True), STAGES) + "\n" + _pc1_b2p_rows(full_price=True),
        "category_raw": _with(CONFIG, ITEMS, SOLD, _category()) + f"\nSELECT {category_columns} FROM category_day",
        "category_raw_filtered": _with(CONFIG, ITEMS, SOLD, _category(FILTERED_WHERE))
        + f"\nSELECT {category_columns} FROM category_day",
        "category_raw_except": _with(
            CONFIG, ITEMS, SOLD,
            _category("""store_code IN ('0000', '0002', '0005') AND article_section_group NOT IN ('ECONOMY', 'No such group')
    AND article_season NOT IN ('SS', 'UNKNOWN')"""),
        ) + f"\nSELECT {category_columns} FROM category_day",
        "category_raw_except_all": _with(CONFIG, ITEMS, SOLD, _category("article_section NOT IN ('Brand#1', 'Brand#2')"))
        + f"\nSELECT {category_columns} FROM category_day",
        "store_funnel_open_groups": _with(OPEN_CONFIG, *_store_funnel()[1:]) + "\nSELECT * FROM funnel",
        "category_funnel_open_groups": _with(OPEN_CONFIG, *_category_funnel()[1:]) + "\nSELECT * FROM funnel",
        "group_members": _with(OPEN_CONFIG) + "\nSELECT grp, store_code FROM members",
        "category_funnel": _with(*_category_funnel()) + "\nSELECT * FROM funnel",
        "category_funnel_scaled": _with(*_category_funnel(1.5)) + "\nSELECT * FROM funnel",
        "category_promo_impact": _with(*_category_funnel(), IMPACT) + "\nSELECT * FROM impact",
        "bridges_split_all": _with(*CATEGORY) + "\n" + ALL_SPLITS,
        "waterfall_coords": _with(*_store(), _grid(False), STAGES, pc1_all, WATERFALL),
        "waterfall_coords_category": _with(*CATEGORY, f"\nbridge_rows AS ({ALL_SPLITS})", WATERFALL),
        "promotion_summary": _promotion("ordered_at <= TIMESTAMP '2024-01-24 00:00:00'"),
        "promotion_summary_nested": _promotion("ordered_at < TIMESTAMP '2024-01-25 00:00:00'"),
        "store_options": _with(ITEMS)
        + """
SELECT DISTINCT lpad(CAST(tenant AS VARCHAR), 4, '0') AS store_code FROM items
WHERE channel = 'STATIONARY' AND company_name_short = 'NOVA' AND country = 'DE' ORDER BY store_code""",
        "category_option_tuples": _with(CONFIG, ITEMS, SOLD) + f"\nSELECT DISTINCT {tuples} FROM sold",
        "category_options": _with(CONFIG, ITEMS, SOLD) + "\n" + option_rows + "\nORDER BY 1, 2",
        "include_except_selection": _with(CONFIG, ITEMS, SOLD)
        + """
SELECT article_section, CASE WHEN article_section IN ('Brand#1', 'Brand#2', 'Brand#3', 'No such brand') THEN 'include' ELSE 'except' END AS mode
FROM (SELECT DISTINCT coalesce(section, 'UNKNOWN') AS article_section FROM sold)""",
        "date_set": """
WITH windows(a, b) AS (
  VALUES (DATE '2024-01-14', DATE '2024-01-01'), (DATE '2024-01-10', DATE '2024-01-20'), (CAST(NULL AS DATE), DATE '2024-01-30')
),
days AS (
  SELECT DISTINCT CAST(unnest(generate_series(least(a, b), greatest(a, b), INTERVAL 1 DAY)) AS DATE) AS d
  FROM windows WHERE a IS NOT NULL AND b IS NOT NULL
)
SELECT d AS ordered_date, count(*) AS n_orders
FROM (SELECT CAST(DATE '2024-01-01' + CAST(o_orderkey % 30 AS INT) AS DATE) AS d FROM orders) JOIN days USING (d)
GROUP BY 1 ORDER BY 1""",
        "kpi_drivers": _with(*impact, _drivers(5, 0.0)) + "\nSELECT * FROM drivers",
        "kpi_drivers_min_abs": _with(*impact, _drivers(3, 0.05)) + "\nSELECT * FROM drivers",
        "ab_comparisons": _with(*impact, VOTES)
        + "\nSELECT control_group, testing_group, kpi, testing_pct_diff, control_pct_diff, uplift, decision FROM votes",
        "ab_winner": _with(*impact, VOTES)
        + """
SELECT w.control_group, w.testing_group, winner, confidence, testing_votes, control_votes,
  coalesce((SELECT string_agg(v.kpi, ',' ORDER BY v.kpi_seq) FROM votes v
   WHERE v.control_group = w.control_group AND v.testing_group = w.testing_group AND v.decision = w.winner), '') AS reason_codes
FROM winners w""",
        "report_payload": _with(*impact, VOTES, _drivers(5, 0.0))
        + """
SELECT w.control_group, w.testing_group, 'BOTH' AS promo_mechanism, 14 AS n_baseline_dates, 13 AS n_promo_dates,
  CASE w.control_group WHEN 'Group 1' THEN 'no offer' WHEN 'Group 3' THEN 'offer' ELSE '' END AS control_description,
  coalesce((SELECT string_agg(store_code, ',' ORDER BY store_code) FROM members WHERE grp = w.control_group), '') AS control_store_codes,
  coalesce((SELECT string_agg(store_code, ',' ORDER BY store_code) FROM members WHERE grp = w.testing_group), '') AS testing_store_codes,
  (SELECT CAST(count(*) AS INT) FROM funnel f WHERE f.grp = w.control_group) AS n_control_kpis,
  (SELECT CAST(count(*) AS INT) FROM impact i WHERE i.control_group = w.control_group AND i.testing_group = w.testing_group) AS n_impact_kpis,
  winner, confidence,
  (SELECT max(kpi) FROM drivers d WHERE d.control_group = w.control_group AND d.testing_group = w.testing_group
     AND source = 'testing_group_drivers' AND ranking = 'top_positive' AND position = 1) AS best_testing_kpi,
  (SELECT max(value) FROM drivers d WHERE d.control_group = w.control_group AND d.testing_group = w.testing_group
     AND source = 'promo_impact_drivers' AND ranking = 'top_absolute' AND position = 1) AS largest_impact
FROM winners w""",
        "report_payload_kpis": _with(*impact) + "\n" + _payload_kpi_rows(),
        "report_payload_drivers": _with(*impact, _drivers(5, 0.0)) + "\nSELECT * FROM drivers",
        "report_payload_votes": _with(*impact, VOTES)
        + """
SELECT w.control_group, w.testing_group, winner, confidence, testing_votes, control_votes,
  coalesce((SELECT string_agg(r.kpi, ',' ORDER BY r.kpi_seq) FROM votes r
   WHERE r.control_group = w.control_group AND r.testing_group = w.testing_group AND r.decision = w.winner), '') AS reason_codes,
  v.kpi, v.testing_pct_diff, v.control_pct_diff, v.uplift, v.decision
FROM winners w JOIN votes v ON v.control_group = w.control_group AND v.testing_group = w.testing_group""",
        "driver_insights": _with(*_store_funnel(), _facts("BOTH"))
        + """
SELECT control_group, testing_group, role, grp, revenue_dir, new_pct, new_abs, bp_pct, bp_abs, rp_pct, rp_abs,
  order_code, aov_code, item_code, price_mix_code, customer_code FROM facts""",
        "driver_summary": _summary(),
        "driver_summary_bp_only": _summary("BP_ONLY"),
        "driver_summary_rp_only": _summary("RP_ONLY"),
        "sink_csv": _with(*_store()) + _lines("subset", EXPORT_COLUMNS, ",").replace(",grp,", ",group,"),
        "sink_csv_category": _with(CONFIG, ITEMS, SOLD, _category(GROUP_STORES))
        + _lines("category_day", [c.strip() for c in category_columns.split(",")], ","),
        "sink_tsv": _with(*_store_funnel(), f"shown AS (SELECT grp, kpi_seq, kpi, {funnel_text} FROM funnel)")
        + _lines("shown", ["grp", "kpi_seq", "kpi", "baseline_value", "promo_value", "pct_diff", "abs_diff"], "\t"),
        "sink_summary": f"""
SELECT control_group, testing_group, CAST(i AS INT) AS line_no, lines[i] AS line
FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i
      FROM (SELECT control_group, testing_group, string_split(summary, chr(10)) AS lines FROM ({_summary()})))""",
        "sink_payload": _with(*impact) + "\n" + _payload_kpi_rows(),
        "sink_selection": _selection(),
        "funnel_formatted": _with(*_store_funnel()) + f"\nSELECT grp, kpi_seq, kpi, {funnel_text} FROM funnel",
        "store_funnel_display": _with(*_store_funnel()) + f"\nSELECT {funnel_display} FROM funnel WHERE grp = 'Group 1'",
        "impact_formatted": _with(*impact) + f"\nSELECT control_group, testing_group, kpi_seq, kpi, {impact_text} FROM impact",
    }
    statements |= _many_statements()
    for split in SPLITS:
        for metric in METRICS:
            statements[f"bridge_{split}_{metric.lower()}"] = _with(*CATEGORY) + "\n" + _split_rows(split, metric)
    dimensions = {
        "section_group": ("article_section_group", ("ECONOMY", "STANDARD")),
        "section": ("article_section", ()),
        "brand": ("article_brand_group", ("OWN", "BRAND", "UNKNOWN", "LICENSED")),
    }
    for name, (dimension, selected) in dimensions.items():
        for metric in METRICS:
            statements[f"bridge_dim_{name}_{metric.lower()}"] = _dimension_bridge(dimension, metric, selected)
    statements["bridges_dim_all"] = "\nUNION ALL ".join(
        f"SELECT * FROM ({_dimension_bridge(d, metric, selected)})" for d, selected in dimensions.values() for metric in METRICS
    )
    statements["bridge_dim_section_group_value"] = _dimension_bridge("article_section_group", "revenue", (), "value")
    return statements
