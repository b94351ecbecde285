"""Corporate actions: price adjustment by day and symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.schema import SYMBOL, TS, instant

#: Actions up to this many rows are broadcast; larger tables are joined by shuffling.
SMALL_TABLE = 100_000


def adjust_corporate_actions(events: DataFrame, actions: DataFrame, *, mode: str = "divide", prices: list[str] | None = None) -> DataFrame:
    """Prices divided (or multiplied) by adj_factor of the UTC day and symbol (or the day alone); 1 where there is none.

    A factor of 0 counts as 1 when dividing. Several factors for one key are an error, not a multiplied join.
    """
    if mode not in ("divide", "multiply"):
        raise ValueError(f"mode must be divide or multiply, not {mode!r}")
    keys = ["date", SYMBOL] if SYMBOL in actions.columns else ["date"]
    once = actions.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.first("adj_factor").alias("__f"))
    once = once.withColumn("__f", F.when(F.col("__n") > 1, F.raise_error(F.lit("several corporate actions for one date and symbol")).cast("double")).otherwise(F.col("__f")))
    once = once.select(*[F.col(k).alias(f"__{k}") for k in keys], "__f")
    if actions.count() <= SMALL_TABLE:
        once = F.broadcast(once)
    day = F.to_date(instant(F.col(TS)))
    on = day == F.col("__date")
    if SYMBOL in keys:
        on = on & (F.col(SYMBOL) == F.col(f"__{SYMBOL}"))
    factor = F.coalesce(F.when((F.col("__f") == 0) & F.lit(mode == "divide"), 1.0).otherwise(F.col("__f")), F.lit(1.0))
    df = events.join(once, on, "left").withColumn("adj_factor", factor).drop(*[f"__{k}" for k in keys], "__f")
    names = prices or [c for c in events.columns if c == "price" or c.startswith(("bid_price_", "ask_price_"))]
    return df.withColumns({c: F.col(c) / F.col("adj_factor") if mode == "divide" else F.col(c) * F.col("adj_factor") for c in names})


def preview_summary(adjusted: DataFrame) -> DataFrame:
    """One row: rows, rows that are adjusted, least and greatest factor."""
    return adjusted.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("adj_factor") != 1).alias("n_adjusted"), F.min("adj_factor").alias("min_factor"), F.max("adj_factor").alias("max_factor"))


def sample_before_after(events: DataFrame, adjusted: DataFrame, n: int) -> DataFrame:
    """The first n rows in time with price before and after."""
    both = events.select(SYMBOL, TS, "seq", F.col("price").alias("price_before")).join(adjusted.select(SYMBOL, TS, "seq", F.col("price").alias("price_after"), "adj_factor"), [SYMBOL, TS, "seq"])
    return both.orderBy(TS, SYMBOL, "seq").limit(n)
