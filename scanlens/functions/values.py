"""Column helpers for single values: finiteness, missingness, numbers, texts, times and keys. All of them are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands between the parts of a canonical key text.
PART = "\x1f"


def finite(value: Column) -> Column:
    """True for numbers that are neither null, NaN nor infinite."""
    x = value.cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def finite_or_null(value: Column) -> Column:
    """The value as a double, null where it isn't finite."""
    return F.when(finite(value), value.cast("double"))


def missing(value: Column, kind: str = "string") -> Column:
    """Null, or empty where the column is a string."""
    return value.isNull() | (value == "") if kind == "string" else value.isNull()


def present(value: Column) -> Column:
    return value.isNotNull() & (value != "")


def fraction(part: Column, whole: Column) -> Column:
    """part / whole, 0 for an empty whole."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def identity_text(value: Column) -> Column:
    """White space made single blanks, trimmed, lower case; empty is null."""
    return F.nullif(F.lower(F.trim(F.regexp_replace(value, r"\s+", " "))), F.lit(""))


def identity_number(value: Column) -> Column:
    """A number with 12 significant digits, whatever its type (64 and 64.0 are the same)."""
    x = value.cast("double")
    return F.when(finite(x), F.format_string("%.11e", x).cast("double").cast("string")).when(x.isNotNull(), x.cast("string"))


def series_key(fields: list[tuple[Column, str]], *also: str) -> Column:
    """SHA-256 of the normalised identity fields, given as (column, kind); missing and empty are the same. `also`: constant parts."""
    parts = [identity_text(c) if kind == "S" else identity_number(c) if kind in "DIL" else c.cast("string") for c, kind in fields]
    return F.sha2(F.concat_ws(PART, *[F.lit(x) for x in also], *[F.coalesce(p, F.lit("\x00")) for p in parts]), 256)


def parse_datetime(text: Column) -> Column:
    """A timestamp from ISO 8601 or an HTTP date (its weekday is not looked at); null if it's neither."""
    http = F.try_to_timestamp(F.regexp_replace(text, r"^\s*[A-Za-z]{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss z"))
    return F.coalesce(F.try_to_timestamp(text), http)


def whole_number(text: Column) -> Column:
    """An integer from the text of a number; null if it isn't integral."""
    x = text.try_cast("double")
    return F.when(finite(x) & (x == F.floor(x)) & (F.abs(x) < float(2**31)), x.cast("int"))


def strict_number(text: Column) -> Column:
    """The finite number that a CSV cell holds, null for blank cells and anything else (hexadecimal, 1d, NaN, Infinity)."""
    x = text.try_cast("double")  # the cast trims by itself, and what matches is never NaN
    return F.when(text.rlike(r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$") & (F.abs(x) != float("inf")), x)


def page_number(path: Column) -> Column:
    """The number in page-000123.json; an error for any other name."""
    found = F.regexp_extract(path, r"page-(\d+)\.json$", 1)
    return F.when(found != "", found.cast("int")).otherwise(F.raise_error(F.concat(F.lit("not a page file: "), path)).cast("int"))


def item_number(path: Column) -> Column:
    """N of a lineage path <file>#item=N, null without it."""
    return F.regexp_extract(path, r"#item=([0-9]+)$", 1).try_cast("int")


def snake(key: Column) -> Column:
    """The column name of a source key: EchoTime to echo_time."""
    return F.lower(F.regexp_replace(F.regexp_replace(key, r"^MR(?=[A-Z])", "MR_"), r"([a-z0-9])([A-Z])", "$1_$2"))


def day_boundary(date: Column, zone: str, end: bool = False) -> Column:
    """The first or last second of a local date in a time zone."""
    return F.to_utc_timestamp(F.to_timestamp(F.concat(date, F.lit(" 23:59:59" if end else " 00:00:00"))), zone)
