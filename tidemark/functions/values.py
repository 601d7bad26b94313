"""Small expressions that several operators share."""

from __future__ import annotations

import random

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.errors import InvalidArgument


def payload_bytes(data: Column | str = "data") -> Column:
    """Bytes of a payload (not characters)."""
    return F.octet_length(data)


def payload_json(data: Column | str = "data") -> Column:
    """The payload as a JSON value; fails on bytes that are no JSON."""
    return F.parse_json(F.decode(data, "UTF-8"))


def record_json() -> Column:
    """A record as the public interface shows it: keys, decoded payload and timestamp, without the label."""
    return F.to_json(F.struct("table_id", "partition_key", "secondary_key", payload_json().alias("data"), "timestamp"))


def trimmed_url(url: Column | str = "url") -> Column:
    """An address without slashes at its end."""
    return F.rtrim(url, F.lit("/"))


def truncated_average(total: Column, n: Column) -> Column:
    """Whole average of a wide sum, truncated toward zero; null if n is 0."""
    return F.when(n > 0, F.call_function("div", total, n.cast("decimal(20,0)")))


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone is."""
    since = F.col(ts) if isinstance(ts, str) else ts
    since = since.cast("timestamp_ntz") - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    part = lambda unit: F.date_part(F.lit(unit), since)
    return ((part("DAY") * 86_400 + part("HOUR") * 3_600 + part("MINUTE") * 60).cast("long") * 1_000_000 + (part("SECOND") * 1_000_000).cast("long")).cast("long")


def share(total: int, parts: int) -> list[int]:
    """A total in parts that differ by at most one, the larger first."""
    if parts < 1:
        raise InvalidArgument("parts must be positive")
    return [total // parts + (i < total % parts) for i in range(parts)]


def new_partition_id(seed: int | None = None) -> str:
    """32 random hexadecimal digits."""
    return f"{random.Random(seed).getrandbits(128):032x}"


def decrypted(secret_key_id: int | None) -> None:
    """Payloads are stored as they are; tables with a key can't be read or written."""
    if secret_key_id is not None:
        raise InvalidArgument("encrypted tables aren't supported")
