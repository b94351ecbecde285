"""Forward-looking stability labels and as-of joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeworks.functions.ranks import quantiles
from tapeworks.operators.windows import from_now, in_order, whole
from tapeworks.schema import NS, SEQ, SYMBOL, TS


def forward_as_of(value: str, horizon_ns: int, *, by: tuple[str, ...] = (SYMBOL,)) -> Column:
    """Value of the first row at or after t + horizon; of the last row if there is none."""
    first = F.min(F.struct(TS, SEQ, value)).over(from_now(horizon_ns, *by))
    return F.when(first.isNotNull(), first[value]).otherwise(F.last(value).over(whole(*by)))


def clock_label(df: DataFrame, horizon_s: float, *, eta: float = 0.0, mid: str = "mid", by: tuple[str, ...] = (SYMBOL,), drop_tail: bool = False) -> DataFrame:
    """instability_s_<h>: 1 where the mid at t + h differs from the mid at t by more than eta."""
    name, h = f"instability_s_{horizon_s:g}", int(horizon_s * NS)
    moved = F.abs(forward_as_of(mid, h, by=by) - F.col(mid)) > eta
    df = df.withColumn(name, F.coalesce(moved, F.lit(False)).cast("int"))
    if drop_tail:
        df = df.withColumn("__end", F.max(TS).over(W.partitionBy(*by))).where(F.col(TS) + h <= F.col("__end")).drop("__end")
    return df


def event_label(df: DataFrame, horizon: int, *, eta: float = 0.0, mid: str = "mid", by: tuple[str, ...] = (SYMBOL,)) -> DataFrame:
    """instability_e_<k>: the same with the mid k rows on, or of the last row."""
    w = in_order(*by)
    later = F.when(F.lead(F.lit(1), horizon).over(w).isNotNull(), F.lead(mid, horizon).over(w)).otherwise(F.last(mid).over(whole(*by)))
    return df.withColumn(f"instability_e_{horizon}", F.coalesce(F.abs(later - F.col(mid)) > eta, F.lit(False)).cast("int"))


def instability_labels(df: DataFrame, *, seconds: Sequence[float] = (1, 5, 10), events: Sequence[int] = (100, 500), eta: float = 0.0, mid: str = "mid") -> DataFrame:
    for h in seconds:
        df = clock_label(df, h, eta=eta, mid=mid)
    for k in events:
        df = event_label(df, k, eta=eta, mid=mid)
    return df


def with_mid(df: DataFrame) -> DataFrame:
    """mid of the best bid and ask, or the price where there is no book."""
    if {"bid_price_1", "ask_price_1"} <= set(df.columns):
        return df.withColumn("mid", (F.col("bid_price_1") + F.col("ask_price_1")) / 2)
    return df.withColumn("mid", F.col("price"))


def fill_both_ways(df: DataFrame, column: str, *, by: tuple[str, ...] = (SYMBOL,)) -> DataFrame:
    """Nulls take the last value before them, or else the first after them."""
    w = in_order(*by)
    back = F.last(column, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    # Before the first value, the next value is the first of all: no shrinking frame is needed.
    return df.withColumn(column, F.coalesce(back, F.first(column, ignorenulls=True).over(whole(*by))))


def backward_as_of(events: DataFrame, snapshots: DataFrame, values: Sequence[str], *, by: tuple[str, ...] = (SYMBOL,)) -> DataFrame:
    """Events with the values of the latest snapshot not after them (the first one for events before all).

    One union and one pass in order instead of a range join: a snapshot sorts before events of the same time.
    """
    keys = [*by, TS]
    packed = F.struct(*[F.col(v) for v in values])
    left = events.select("*", F.lit(1).alias("__side"), F.lit(None).cast(snapshots.select(packed.alias("x")).schema["x"].dataType).alias("__book"))
    right = snapshots.select(*keys, F.lit(0).alias("__side"), packed.alias("__book"), F.col(SEQ).alias("__tie") if SEQ in snapshots.columns else F.lit(0).alias("__tie"))
    both = left.withColumn("__tie", F.col(SEQ)).unionByName(right, allowMissingColumns=True)
    w = W.partitionBy(*by).orderBy(TS, "__side", "__tie")
    latest = F.last("__book", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    first = F.first("__book", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    both = both.withColumn("__book", F.coalesce(latest, first)).where(F.col("__side") == 1)
    return both.select(*events.columns, *[F.col(f"__book.{v}").alias(v) for v in values])


def largest_moves(df: DataFrame, k: int, *, mid: str = "mid", horizon_s: float = 1.0) -> DataFrame:
    """The k rows with the largest change of mid over the horizon (ties: earliest)."""
    moved = df.withColumn("abs_dmid", F.abs(forward_as_of(mid, int(horizon_s * NS)) - F.col(mid)))
    return moved.orderBy(F.col("abs_dmid").desc_nulls_last(), TS, SEQ).limit(k)


def moves_above(df: DataFrame, q: float, *, mid: str = "mid", horizon_s: float = 1.0) -> DataFrame:
    """Rows whose change of mid is at least its q-quantile."""
    moved = df.withColumn("abs_dmid", F.abs(forward_as_of(mid, int(horizon_s * NS)) - F.col(mid)))
    bound = quantiles(moved, F.col("abs_dmid"), [q]).select(F.get("q", F.lit(0)).alias("__bound"))
    return moved.join(F.broadcast(bound)).where(F.col("abs_dmid") >= F.col("__bound")).drop("__bound")
