"""Event-time helpers that stay inside whole-stage codegen.

Timestamps are handled as epoch microseconds.  For ``timestamp_ntz`` columns the
conversion uses ``timestampdiff``/``timestampadd`` against the NTZ epoch, so the
result does not depend on the session time zone; ``timestamp`` (LTZ) columns use
``unix_micros``/``timestamp_micros``.
"""

from __future__ import annotations

import datetime as _dt
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"

_UNITS_US = {
    "microsecond": 1,
    "millisecond": 1_000,
    "ms": 1_000,
    "second": 1_000_000,
    "sec": 1_000_000,
    "s": 1_000_000,
    "minute": 60_000_000,
    "min": 60_000_000,
    "m": 60_000_000,
    "hour": 3_600_000_000,
    "h": 3_600_000_000,
    "day": 86_400_000_000,
    "d": 86_400_000_000,
    "week": 7 * 86_400_000_000,
}


def duration_us(d) -> int:
    """'60 minutes', '5 s', '1 hour', timedelta, or a number of seconds -> microseconds."""
    if isinstance(d, _dt.timedelta):
        return int(round(d.total_seconds() * 1_000_000))
    if isinstance(d, (int, float)):
        return int(round(d * 1_000_000))
    total = 0
    parts = re.findall(r"(-?\d+(?:\.\d+)?)\s*([a-zA-Z]+)", str(d))
    if not parts:
        raise ValueError(f"cannot parse duration {d!r}")
    for num, unit in parts:
        u = unit.lower()
        if u not in _UNITS_US and u.endswith("s"):
            u = u[:-1]
        if u not in _UNITS_US:
            raise ValueError(f"unknown unit {unit!r} in {d!r}")
        total += int(round(float(num) * _UNITS_US[u]))
    return total


def _dtype(df: DataFrame, name: str):
    return df.schema[name].dataType


def to_micros(df: DataFrame, ts: str) -> Column:
    """Epoch microseconds of column ``ts`` (timestamp_ntz, timestamp, or epoch-second long)."""
    dt = _dtype(df, ts)
    if isinstance(dt, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, {EPOCH_NTZ}, `{ts}`)")
    if isinstance(dt, T.TimestampType):
        return F.unix_micros(F.col(ts))
    if isinstance(dt, (T.LongType, T.IntegerType)):
        return F.col(ts).cast("long") * F.lit(1_000_000)
    raise TypeError(f"column {ts} has unsupported type {dt}")


def micros_to_ts(us: Column, like: T.DataType | None = None) -> Column:
    """Inverse of :func:`to_micros`; returns the same timestamp flavour as ``like``."""
    if isinstance(like, T.TimestampType):
        return F.timestamp_micros(us)
    return _ntz_from_micros(us)


def _ntz_from_micros(us: Column) -> Column:
    # timestampadd(unit, n, ts) keeps the NTZ type and is zone-free.
    return F.timestamp_add("MICROSECOND", us, F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))


def ts_type(df: DataFrame, ts: str) -> T.DataType:
    dt = _dtype(df, ts)
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return dt
    return T.TimestampNTZType()


def ifloor(c: Column, d: int) -> Column:
    """Integer floor division, exact for negative values too."""
    return idiv(c - F.pmod(c, F.lit(d)), d)


def idiv(c: Column, d) -> Column:
    """Long division truncating toward zero (SQL ``div``), exact for all longs."""
    return F.call_function("div", c, d if isinstance(d, Column) else F.lit(d))


def as_event_time(df: DataFrame, ts: str, out: str = "ts") -> DataFrame:
    """Event time as ``timestamp`` (LTZ) for streaming watermarks.

    A parquet ``timestamp_ntz`` is read as a UTC wall clock (through epoch
    microseconds), so windows align the same way as in the batch operators
    whatever the session time zone is.
    """
    dt = _dtype(df, ts)
    if isinstance(dt, T.TimestampNTZType):
        return df.withColumn(out, F.timestamp_micros(to_micros(df, ts)))
    if isinstance(dt, (T.LongType, T.IntegerType)):
        return df.withColumn(out, F.timestamp_seconds(F.col(ts)))
    return df if out == ts else df.withColumn(out, F.col(ts))


def to_ntz(c: Column) -> Column:
    """LTZ timestamp -> ``timestamp_ntz`` with the UTC wall clock (inverse of ``as_event_time``)."""
    return _ntz_from_micros(F.unix_micros(c))
