"""The canonical event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ordering and arithmetic use integer nanoseconds; `seq` breaks ties, so every order is total.
SYMBOL, TS, SEQ = "symbol", "ts_ns", "seq"
NS = 1_000_000_000
#: Canonical event types: market, limit and cancel orders by side (fixed values).
EVENT_TYPES = ("MO+", "MO-", "LO+", "LO-", "CX+", "CX-")

EVENT_SCHEMA = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("venue", T.StringType()),
    T.StructField("ts_ns", T.LongType()),
    T.StructField("seq", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("size", T.DoubleType()),
    T.StructField("level", T.IntegerType()),
    T.StructField("side", T.StringType()),
])
EXTRA_SCHEMA = T.StructType([
    *EVENT_SCHEMA.fields,
    T.StructField("trading_state", T.StringType()),
    T.StructField("state_reason", T.LongType()),
    T.StructField("halted", T.BooleanType()),
    T.StructField("token", T.StringType()),
    T.StructField("token_orig", T.StringType()),
    T.StructField("token_new", T.StringType()),
    T.StructField("match", T.LongType()),
    T.StructField("reason", T.StringType()),
])


def no_nan(c: Column) -> Column:
    """NaN as null: in Spark NaN would compare greatest."""
    return F.when(F.isnan(c), None).otherwise(c)


def conform(df: DataFrame, schema: T.StructType = EVENT_SCHEMA) -> DataFrame:
    """df with the columns of schema first (missing ones null, NaN as null), others kept after them."""
    have = set(df.columns)
    cols = []
    for f in schema.fields:
        c = F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
        cols.append((no_nan(c) if f.dataType == T.DoubleType() else c).alias(f.name))
    return df.select(*cols, *[F.col(c) for c in df.columns if c not in schema.fieldNames()])


def require(df: DataFrame, *names: str) -> DataFrame:
    """df, or a ValueError that names the missing columns."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def floor_div(c: Column, n: int) -> Column:
    """Whole quotient, rounded down, exact for nanosecond times: these are beyond what a double holds."""
    return F.round((c - F.pmod(c, F.lit(n))) / n).cast("long")


def instant(ts: Column) -> Column:
    """Timestamp of a time in nanoseconds."""
    return F.timestamp_micros(floor_div(ts, 1000))
