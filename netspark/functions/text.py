"""Text formatting as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(number: Column, digits: int) -> Column:
    """Decimal text with a fixed number of digits, exact ties to even, no grouping."""
    return F.call_function("format_number", number.cast("double"), F.lit("0." + "0" * digits if digits else "0"))


def float_text(number: Column) -> Column:
    return number.cast("double").cast("string")


def utc_text(ts_us: Column) -> Column:
    """``2024-01-31 09:05:00 UTC`` from epoch microseconds, whatever the session zone."""
    seconds = F.floor(ts_us / F.lit(1_000_000)).cast("bigint")
    days = F.floor(seconds / F.lit(86_400)).cast("int")
    in_day = F.pmod(seconds, F.lit(86_400))

    def two(value: Column) -> Column:
        return F.lpad(value.cast("int").cast("string"), 2, "0")

    clock = F.concat_ws(
        ":",
        two(F.floor(in_day / 3600)),
        two(F.floor(F.pmod(in_day, F.lit(3600)) / 60)),
        two(F.pmod(in_day, F.lit(60))),
    )
    date = F.date_add(F.lit("1970-01-01").cast("date"), days).cast("string")
    return F.concat(date, F.lit(" "), clock, F.lit(" UTC"))


def pad(text: Column, width: int) -> Column:
    """Left-aligned, at least ``width`` wide, never cut."""
    return F.rpad(text, F.greatest(F.length(text), F.lit(width)), F.lit(" "))


def cef_header(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))


def cef_value(text: Column) -> Column:
    text = text.cast("string")
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("="), F.lit("\\="))


def cef_extension(fields: dict[str, Column]) -> Column:
    """``key=value`` pairs separated by blanks; a null value drops its key."""
    pairs = [F.concat(F.lit(f"{key}="), cef_value(value)) for key, value in fields.items()]
    return F.concat_ws(" ", *pairs)


def when_chain(cases: list[tuple[Column, object]], default: object = None) -> Column:
    chain = None
    for test, value in cases:
        value = value if isinstance(value, Column) else F.lit(value)
        chain = F.when(test, value) if chain is None else chain.when(test, value)
    return chain.otherwise(default if isinstance(default, Column) else F.lit(default))
