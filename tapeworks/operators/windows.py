"""Window specifications over the event order, and windows over time chunks for instruments too large for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeworks.schema import SEQ, SYMBOL, TS, floor_div


def in_order(*by: str) -> WindowSpec:
    """Rows of an instrument in event order."""
    return W.partitionBy(*(by or (SYMBOL,))).orderBy(TS, SEQ)


def so_far(*by: str) -> WindowSpec:
    return in_order(*by).rowsBetween(W.unboundedPreceding, W.currentRow)


def before(width_ns: int, *by: str) -> WindowSpec:
    """Rows at least width_ns older than the current one."""
    return W.partitionBy(*(by or (SYMBOL,))).orderBy(TS).rangeBetween(W.unboundedPreceding, -width_ns)


def from_now(width_ns: int, *by: str) -> WindowSpec:
    """Rows at least width_ns later. The order is reversed so that the frame only grows."""
    return W.partitionBy(*(by or (SYMBOL,))).orderBy(-F.col(TS)).rangeBetween(W.unboundedPreceding, -width_ns)


def whole(*by: str) -> WindowSpec:
    return in_order(*by).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)


def chunked(df: DataFrame, chunk_ns: int, back_ns: int = 0, ahead_ns: int = 0) -> DataFrame:
    """Rows dealt to (symbol, chunk), each chunk with copies of the rows up to back_ns before and ahead_ns after it.

    Operators with a bounded reach in time then work chunk by chunk (`by=("symbol", "chunk")`) and one instrument is no
    longer one task; drop the copies with `own`. A row is copied to (back_ns + ahead_ns) / chunk_ns + 1 chunks at most.
    """
    ts = F.col(TS)
    df = df.withColumn("chunk", F.explode(F.sequence(floor_div(ts - ahead_ns, chunk_ns), floor_div(ts + back_ns, chunk_ns))))
    return df.withColumn("own", F.col("chunk") == floor_div(ts, chunk_ns))


def nz(c: Column, value: float = 0.0) -> Column:
    return F.coalesce(c, F.lit(value))
