"""Scalar functions whose semantics differ from Spark's own of the same name, and thin names for the rest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bucket units in seconds.
UNIT_SECONDS = {
    "s": 1, "sec": 1, "second": 1, "seconds": 1,
    "m": 60, "min": 60, "minute": 60, "minutes": 60,
    "h": 3600, "hour": 3600, "hours": 3600,
    "d": 86400, "day": 86400, "days": 86400,
}


def as_text(value: Column, kind: str) -> Column:
    """Text form for concatenation: booleans become 1 and 0."""
    return value.cast("int").cast("string") if kind == "boolean" else value.cast("string")


def substr(text: Column, start: Column | int, length: Column | int | None = None) -> Column:
    """1-based; 0 counts as 1; a negative start counts from the end and is clamped to the first character."""
    start = start if isinstance(start, Column) else F.lit(start)
    clamped = F.greatest(start, -F.char_length(text))
    clamped = F.when(clamped == 0, F.lit(1)).otherwise(clamped)
    if length is None:
        length = F.char_length(text)
    elif not isinstance(length, Column):
        length = F.lit(length)
    return F.substr(text, clamped.cast("int"), length.cast("int"))


def trim(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def ltrim(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+", "")


def rtrim(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+$", "")


def left_str(text: Column, n: int) -> Column:
    return F.left(text, F.lit(max(n, 0)))


def right_str(text: Column, n: int) -> Column:
    return F.right(text, F.lit(max(n, 0)))


def repeat(text: Column, n: int, most: int = 1_000_000) -> Column:
    if n > most:
        raise ValueError(f"repeat count {n} is over {most}")
    return F.repeat(text, F.lit(max(n, 0)))


def sqrt(x: Column) -> Column:
    """Null for negatives."""
    return F.when(x >= 0, F.sqrt(x))


def log10(x: Column) -> Column:
    return F.log10(x)


def sign(x: Column) -> Column:
    return F.signum(x).cast("bigint")


def int_div(a: Column, b: Column) -> Column:
    """Truncating division of integers."""
    return F.call_function("div", a, b)


def iff(condition: Column, yes: Column, no: Column) -> Column:
    """A null condition takes the second branch."""
    return F.when(condition, yes).otherwise(no)


def to_micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(n: Column) -> Column:
    return F.timestamp_micros(n).cast("timestamp_ntz")


def from_millis(n: Column) -> Column:
    return F.timestamp_millis(n).cast("timestamp_ntz")


def from_secs(n: Column) -> Column:
    return F.timestamp_seconds(n).cast("timestamp_ntz")


def day_of_week(ts: Column) -> Column:
    """1 is Monday, 7 is Sunday."""
    return F.weekday(ts) + 1


def date_add_seconds(ts: Column, seconds: Column | int) -> Column:
    seconds = seconds if isinstance(seconds, Column) else F.lit(seconds)
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def date_diff_seconds(a: Column, b: Column) -> Column:
    """Whole seconds of a - b, truncated toward zero."""
    return F.call_function("div", to_micros(a) - to_micros(b), F.lit(1_000_000).cast("bigint"))


def bucket_seconds(width: str) -> int:
    """'5m' -> 300; a bare number is in seconds."""
    width = width.strip().lower()
    digits = width.rstrip("abcdefghijklmnopqrstuvwxyz ")
    unit = width[len(digits) :].strip() or "s"
    if not digits.isdigit() or int(digits) < 1 or unit not in UNIT_SECONDS:
        raise ValueError(f"bad bucket width {width!r}")
    return int(digits) * UNIT_SECONDS[unit]


def time_bucket(width: str, ts: Column) -> Column:
    """Start of the epoch-aligned bucket; times before 1970 floor downwards."""
    return F.window(ts, f"{bucket_seconds(width)} seconds")["start"]
