"""Liquidity panels: deciles, match groups, session hours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def deciles_by_value(panel: DataFrame, column: str = "median_daily_notional", q: int = 10) -> DataFrame:
    """liq_decile 1..q by quantile edges; equal edges are one, bins are closed on the right."""
    cuts = panel.agg(F.array_distinct(F.percentile(column, F.array(*[F.lit(i / q) for i in range(q + 1)]))).alias("__cuts"))
    rank = F.greatest(F.size(F.filter("__cuts", lambda c: c < F.col(column))), F.lit(1))
    return panel.join(F.broadcast(cuts)).withColumn("liq_decile", F.when(F.col(column).isNotNull(), rank)).drop("__cuts")


def deciles_by_rank(panel: DataFrame, column: str = "median_daily_notional", *, by: Sequence[str] = (), order: Sequence[str] = ("symbol",)) -> DataFrame:
    """liq_decile 0..9 by position, over all or within `by`."""
    value = F.when(F.isnan(F.col(column)) | F.col(column).isNull(), 0.0).otherwise(F.col(column))
    part = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    at = F.row_number().over(part.orderBy(value, *order)) - 1
    return panel.withColumn("liq_decile", F.floor(at * 10 / F.count(F.lit(1)).over(part)).cast("int"))


def quantised_tick(panel: DataFrame, quantum: float) -> DataFrame:
    return panel.withColumn("tick_size", F.round(F.col("tick_size") / quantum) * quantum)


def match_groups(panel: DataFrame, by: Sequence[str] = ("liq_decile", "tick_size")) -> DataFrame:
    """match_group: dense id of the key in sorted order, nulls last."""
    keys = panel.select(*[F.col(c).alias(f"__{c}") for c in by]).distinct()
    order = W.partitionBy(F.lit(0)).orderBy(*[F.col(f"__{c}").asc_nulls_last() for c in by])
    ids = keys.withColumn("match_group", (F.dense_rank().over(order) - 1).cast("int"))
    cond = F.lit(True)
    for c in by:
        cond = cond & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return panel.join(ids, cond).drop(*[f"__{c}" for c in by])


def match_groups_first_seen(panel: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """match_group in the order in which keys turn up; the tick is compared with eight decimals."""
    key = F.concat_ws("|", *[F.format_string("%.8f", F.col(c)) if c == "tick_size" else F.col(c).cast("string") for c in by])
    rows = panel.withColumn("__key", key)
    ids = rows.groupBy("__key").agg(F.min(order).alias("__at"))
    ids = ids.withColumn("match_group", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("__at")) - 1).drop("__at")
    return rows.join(ids, "__key").drop("__key")


def with_session_hours(panel: DataFrame, hours: DataFrame, *, most: int = 100_000) -> DataFrame:
    """Panel with session_start and session_end of its market; few markets are broadcast."""
    return panel.join(F.broadcast(hours) if hours.count() <= most else hours, "market", "left")


def instrument_stats(daily: DataFrame) -> DataFrame:
    """market, symbol, median_daily_notional and tick_size from daily notionals."""
    return daily.groupBy("market", "symbol").agg(F.percentile("notional", 0.5).alias("median_daily_notional"), F.min("tick_size").alias("tick_size"))
