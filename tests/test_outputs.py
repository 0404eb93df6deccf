import csv
import io
import json
from datetime import date, datetime
from pathlib import Path

import pytest

from __spark_entry__ import queries
from campaign_lift import sinks
from campaign_lift.plans.campaign import Campaign
from tests.conftest import config, item, order, order_tables, traffic_frame, visit


def read_parts(folder: Path) -> list[str]:
    return [line for part in sorted(folder.glob("part-*")) for line in part.read_text().splitlines()]


@pytest.fixture(scope="module")
def report(spark, tmp_path_factory) -> Path:
    folder = tmp_path_factory.mktemp("report")
    days = [date(2024, 1, 1), date(2024, 1, 6)]
    traffic = traffic_frame(spark, [visit(d, s, 100, 30, 3) for d in days for s in (1, 2)])
    orders = order_tables(
        spark,
        [order(10 * d.day + s, datetime(d.year, d.month, d.day), s, [item(revenue=50.0 * d.day, pc1=9.0)]) for d in days for s in (1, 2)],
    )
    Campaign(traffic, orders, config(descriptions={"Group 3": "tést"})).write_report(str(folder))
    return folder


def test_every_output_is_written(report):
    names = {p.name for p in report.iterdir()}
    assert names == {
        "store_level_all_categories",
        "selected_categories",
        "store_funnel",
        "store_funnel_both",
        "store_promo_impact",
        "discount_breakdown",
        "category_funnel",
        "category_promo_impact",
        "pc1_bridges",
        "category_bridges",
        "period_metrics",
        "weekday_pct_diff",
        "weekday_kpis",
        "weekday_chart",
        "footfall_labels",
        "store_options",
        "category_options",
        "dimension_bridges",
        "daily_trend",
        "summary",
        "payload",
        "selection",
    }
    assert all((report / n / "_SUCCESS").exists() for n in names)


def test_csv_export_is_sorted_with_header(report):
    lines = read_parts(report / "store_level_all_categories")
    rows = list(csv.DictReader(lines))
    keys = [(r["group"], r["period"], r["ordered_date"], r["store_code"]) for r in rows]
    assert len(rows) == 8 and keys == sorted(keys)
    assert rows[0]["store_code"] == "0001" and rows[0]["weekday"] == "Monday"


def test_lines_quote_what_needs_it_and_number_parts_make_one_file(spark, tmp_path):
    values = [(3, 'a,"b"', 1e9 + 0.25), (1, None, 12345678.0), (2, " x ", -1.5e-5), (4, "two\nlines", None), (5, "", 1e300)]
    rows = spark.createDataFrame(values * 20, "n int, `t.x` string, v double").repartition(7)
    sinks.write_csv(rows, str(tmp_path / "out"), ["n"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    got = list(csv.reader(io.StringIO(text)))
    assert got[0] == ["n", "t.x", "v"] and len(got) == 101
    assert got[1:21] == [["1", "", "12345678.0"]] * 20 and got[21] == ["2", " x ", "-0.000015"]
    assert got[41] == ["3", 'a,"b"', "1000000000.25"] and got[61] == ["4", "two\nlines", ""] and float(got[81][2]) == 1e300


def test_report_files_are_the_checked_frames(spark, report):
    lines = queries()["sink_tsv"](spark, "/root/testdata/sf0.001").orderBy("is_row", "line").collect()
    assert [r.is_row for r in lines] == [0] + [1] * 104 and lines[0].line.split("\t")[2] == "kpi"
    assert read_parts(report / "store_funnel")[0] == lines[0].line


def test_tables_are_tab_separated_text(report):
    lines = read_parts(report / "store_funnel")
    assert lines[0].split("\t")[:3] == ["grp", "kpi_seq", "kpi"]
    revenue = next(line for line in lines if line.startswith("Group 1\t9\t"))
    assert revenue.split("\t") == ["Group 1", "9", "total revenue", "50", "300", "500.00%", "250"]


def test_text_payload_and_selection(report):
    assert read_parts(report / "summary")[0] == "# Campaign Post-Mortem Summary (Phase 1)"
    payload = json.loads(read_parts(report / "payload")[0])
    assert payload["winner_assessment"]["winner"] == "tie" and len(payload["kpis"]["control_funnel"]) == 26
    selection = json.loads("\n".join(read_parts(report / "selection")))
    assert selection["groups"]["Group 2"] == {"select all stores": False, "include": ["0001", "0002"]}
    assert selection["group_descriptions"]["Group 3"] == "tést"
    assert selection["vat"] == 1.2 and selection["article_sections"] == {"select all article_section": True}
