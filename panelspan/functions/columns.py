"""Coercion and small column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
DATELIKE = (T.DateType, T.TimestampType, T.TimestampNTZType)


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(dtype_of(df, name), NUMERIC)


def as_double(df: DataFrame, name: str) -> Column:
    """Coerce to double; what cannot be read as a number becomes NULL. Times become epoch seconds."""
    kind = dtype_of(df, name)
    if isinstance(kind, T.TimestampNTZType):     # no time zone: seconds since 1970-01-01 on its own clock
        start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return F.timestamp_diff("MICROSECOND", start, F.col(name)) / F.lit(1e6)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(name) / F.lit(1e6)
    if isinstance(kind, T.DateType):
        return F.unix_date(name).cast("double")
    return F.col(name).try_cast("double")


def finite(c: Column | str) -> Column:
    """True for real numbers: false for NULL, NaN and the infinities (NaN sorts above infinity)."""
    return F.abs(c) < F.lit(float("inf"))


def clean_numeric(df: DataFrame, columns: dict[str, str], by: Sequence[str] = (),
                  keep: Sequence[str] = ()) -> DataFrame:
    """Select ``by`` + ``keep`` and the coerced ``alias: column`` values; drop incomplete rows."""
    keys = [*by, *keep]
    out = df.select(*keys, *[as_double(df, c).alias(a) for a, c in columns.items()])
    for k in keys:
        out = out.where(F.col(k).isNotNull())
    for a in columns:
        out = out.where(finite(a))
    return out


def ratio(a: Column, b: Column) -> Column:
    """Division that is NULL where the divisor is zero."""
    return F.try_divide(a, b)


def positive_part(c: Column) -> Column:
    return F.greatest(c, F.lit(0.0))
