"""Column expressions over trip attributes."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Lower edges of the second and third fare band, and the accepted month text.
BAND_EDGES = (10.0, 25.0)
MONTH_PATTERN = r"^20[0-9]{2}-(0[1-9]|1[0-2])\z"

EPOCH = datetime(1970, 1, 1)


def without_nan(value: Column) -> Column:
    """NaN becomes NULL, so that aggregates skip it and comparisons reject it."""
    return F.nanvl(value, F.lit(None).cast("double"))


def angular_value(
    start_lon: str = "start_lon",
    start_lat: str = "start_lat",
    end_lon: str = "end_lon",
    end_lat: str = "end_lat",
) -> Column:
    """Angular arithmetic workload over the two trip ends.

    The cosines take the longitudes. That is the established definition of this workload and it
    is kept: the value is not a distance.
    """
    half_lon = (F.radians(end_lon) - F.radians(start_lon)) / 2
    half_lat = (F.radians(end_lat) - F.radians(start_lat)) / 2
    cosines = F.cos(F.radians(start_lon)) * F.cos(F.radians(end_lon))
    share = F.pow(F.sin(half_lon), 2) + cosines * F.pow(F.sin(half_lat), 2)
    return without_nan(2 * F.atan2(F.sqrt(share), F.sqrt(1 - share)))


def fare_band(fare: Column, edges: Sequence[float] = BAND_EDGES) -> Column:
    """Number of ``edges`` the fare reaches: an edge value belongs to the upper band."""
    return reduce(add, [(fare >= F.lit(float(edge))).cast("int") for edge in edges])


def pickup_hour(moment: str = "pickup_datetime") -> Column:
    return F.hour(moment)


def pickup_weekday(moment: str = "pickup_datetime") -> Column:
    """Monday is 0."""
    return F.weekday(moment)


def valid_month(text: Column) -> Column:
    return text.rlike(MONTH_PATTERN)


def axis_value(column: str, kind: T.DataType) -> Column:
    """Number that orders like ``column``: microseconds for timestamps, the value otherwise."""
    if isinstance(kind, T.TimestampNTZType):
        since = F.col(column) - F.lit("1970-01-01").cast("timestamp_ntz")
        return (since.cast("interval second").cast("decimal(24,6)") * 1_000_000).cast("bigint")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column)
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("bigint")
    if isinstance(kind, T.IntegralType):
        return F.col(column).cast("bigint")
    if isinstance(kind, T.FractionalType):
        return without_nan(F.col(column).cast("double"))
    raise TypeError(f"no order axis for {kind.simpleString()}")


def axis_literal(value: int | float, kind: T.DataType) -> Column:
    """Literal of type ``kind`` for a number made by :func:`axis_value`."""
    if isinstance(kind, T.TimestampNTZType):
        moment = EPOCH + timedelta(microseconds=value)
        return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(F.lit(value))
    if isinstance(kind, T.DateType):
        return F.date_from_unix_date(F.lit(value).cast("int"))
    if isinstance(kind, T.IntegralType):
        return F.lit(value).cast("bigint")
    return F.lit(float(value))
