"""Time expressions for timestamps with and without a zone (taken as the session's)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds(a: Column | str, b: Column | str) -> Column:
    """From a to b."""
    one, two = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return (F.unix_micros(two.cast("timestamp")) - F.unix_micros(one.cast("timestamp"))) / 1e6


def hours(a: Column | str, b: Column | str) -> Column:
    return seconds(a, b) / 3600.0
