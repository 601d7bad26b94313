"""Checks of arguments, made where a call enters; nothing is checked row by row that the caller can state."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.errors import InvalidArgument
from tidemark.schema import LONG_MAX, LONG_MIN


def whole(value: object, name: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or not LONG_MIN <= value <= LONG_MAX:
        raise InvalidArgument(f"{name} must be a 64-bit integer, not {value!r}")
    return value


def bounds(lower: int, upper: int, *, empty: bool = False) -> tuple[int, int]:
    """A half-open range of partition keys; ``empty`` allows equal bounds (the public range call does, storage doesn't)."""
    whole(lower, "lower"), whole(upper, "upper")
    if lower > upper or lower == upper and not empty:
        raise InvalidArgument(f"the range [{lower}, {upper}) is reversed or empty")
    return lower, upper


def timestamp(value: int) -> int:
    """Microseconds, given by the caller; 0 is valid."""
    if whole(value, "timestamp") < 0:
        raise InvalidArgument("timestamp must not be negative")
    return value


def name(value: str | None, what: str) -> str:
    if not isinstance(value, str) or not value.strip():
        raise InvalidArgument(f"{what} must not be blank")
    return value


def history(start_ms: int, end_ms: int) -> tuple[int, int]:
    if whole(start_ms, "start_ms") >= whole(end_ms, "end_ms"):
        raise InvalidArgument("start_ms must be before end_ms")
    return start_ms, end_ms


def sampled(label: Column | str = "partition_id") -> Column:
    """Whether a label counts: null and empty both mean unsampled."""
    label = F.col(label) if isinstance(label, str) else label
    return label.isNotNull() & (label != "")


def valid_statistics(label: Column, position_sum: Column) -> Column:
    """Fails on rows whose label is missing or empty, or whose sum isn't a whole number; true otherwise."""
    return F.when(~F.coalesce(sampled(label), F.lit(False)), F.raise_error(F.lit("telemetry without partition id")).cast("boolean")).otherwise(position_sum.cast("decimal(38,0)").isNotNull())
