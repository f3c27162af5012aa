"""ISO-8601 text and epoch milliseconds; the session time zone must be UTC."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def parse_iso(text: Column) -> Column:
    """Epoch milliseconds of ``YYYY-MM-DDTHH:MM:SS[.frac][Z|+hh:mm|+hhmm]``; no zone is UTC; null where invalid."""
    shaped = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})?$")
    zoned = F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2")
    cut = F.regexp_replace(zoned, r"(\.\d{3})\d+", "$1")
    return F.when(shaped, F.unix_millis(F.try_to_timestamp(cut)))


def format_ms(ms: Column) -> Column:
    """``…T….SSSZ`` of epoch milliseconds; negative ones as ``<n>ms``."""
    return F.when(ms < 0, F.concat(ms.cast("string"), F.lit("ms"))).otherwise(F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
