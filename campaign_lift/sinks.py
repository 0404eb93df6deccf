"""Files written by a run. Each is a folder of numbered part files, written by the tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from campaign_lift.operators.render import csv_lines


def write_lines(lines: DataFrame, path: str) -> None:
    """The column ``line`` of a frame in file order. The parts, one after the other, are the file."""
    lines.select("line").write.mode("overwrite").text(path)


def write_csv(rows: DataFrame, path: str, order: Sequence[str], sep: str = ",") -> None:
    """Any rows as CSV with one header line, sorted."""
    write_lines(csv_lines(rows, order, sep), path)
