"""Exports: CSV, JSON lines and ordered text."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").json(path)


def write_lines(rows: DataFrame, path: str) -> None:
    """The ``line`` column as text, in any order."""
    rows.select("line").write.mode("errorifexists").text(path)


def write_ordered_lines(rows: DataFrame, path: str, *order: str) -> None:
    """The ``line`` column as text, ordered across files by name.

    Range partitioning on all order columns splits one long report over many tasks.
    """
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    spread.select("line").write.mode("errorifexists").text(path)
