"""Expressions on timestamps that don't depend on the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def epoch_seconds(col: Column, kind: T.DataType) -> Column:
    """Whole seconds since 1970; a TIMESTAMP_NTZ counts as UTC."""
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_date(col.cast("date")).cast("bigint") * 86_400 + F.hour(col) * 3_600 + F.minute(col) * 60 + F.second(col)
    if isinstance(kind, T.TimestampType):
        return F.unix_seconds(col)
    return col.cast("bigint")
