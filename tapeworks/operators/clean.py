"""Cleaning: timestamps, prices, event types, sessions, halts, quality, order and duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeworks.operators.windows import in_order
from tapeworks.schema import EVENT_TYPES, NS, SEQ, SYMBOL, TS, instant

#: Raw tokens and their canonical event types (fixed values).
RAW_TYPES = {"TRADE": "MO+", "BUY": "MO+", "EXECUTE": "MO+", "SELL": "MO-", "ADD": "LO+", "NEW": "LO+", "CANCEL": "CX-", "DELETE": "CX-"}


def to_epoch_ns(raw: Column, tz: str = "UTC") -> Column:
    """Nanoseconds since 1970 of a time written as text or a number; null if it can't be read.

    Numbers are taken as seconds, milliseconds, microseconds or nanoseconds by their magnitude, row by row. Text without
    a zone is local time of tz.
    """
    text = F.trim(raw.cast("string"))
    number = text.try_cast("double")
    whole = text.try_cast("long")
    size = F.abs(number)
    times = lambda k: F.coalesce(whole * k, (number * k).cast("long"))  # noqa: E731  whole numbers stay exact
    scaled = F.when(size >= 1e17, times(1)).when(size >= 1e14, times(1_000)).when(size >= 1e11, times(1_000_000)).otherwise(times(NS))
    stamp = F.try_to_timestamp(text)
    if tz != "UTC":
        stamp = F.when(text.rlike(r"[0-9]:[0-9.]+ *([A-Za-z]|[+-][0-9])"), stamp).otherwise(F.to_utc_timestamp(stamp, tz))
    # Spark keeps microseconds; the digits behind them are read from the text.
    rest = F.rpad(F.regexp_extract(text, r"\.[0-9]{6}([0-9]{1,3})", 1), 3, "0").try_cast("long")
    return F.when(number.isNotNull(), scaled).otherwise(F.unix_micros(stamp) * 1000 + F.coalesce(rest, F.lit(0)))


def round_to_tick(price: Column, tick: float, *, half: str = "even") -> Column:
    """Price on the tick grid; halves go to the even multiple, or away from zero."""
    return (F.rint(price / tick) if half == "even" else F.round(price / tick)) * tick


def normalise_price(price: Column, *, tick: float | None = None, scale: float = 1.0) -> Column:
    value = price.try_cast("double") * scale
    return round_to_tick(value, tick) if tick and tick > 0 else value


def round_price_columns(df: DataFrame, tick: float) -> DataFrame:
    """All price columns (price, bid_price_*, ask_price_*) on the tick grid."""
    names = [c for c in df.columns if c == "price" or c.startswith(("bid_price_", "ask_price_"))]
    return df.withColumns({c: round_to_tick(F.col(c), tick) for c in names})


def canonical_type(raw: Column) -> Column:
    """Canonical event type of a raw token; unknown tokens stay, in upper case."""
    upper = F.upper(raw.cast("string"))
    table = F.create_map(*[F.lit(x) for pair in RAW_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, upper), upper)


def canonical_events(df: DataFrame, *, symbol: str | None = None, tick: float | None = None, scale: float = 1.0) -> DataFrame:
    """Canonical type, price and size of raw rows; a constant symbol where there is none."""
    if SYMBOL not in df.columns:
        df = df.withColumn(SYMBOL, F.lit(symbol))
    return df.withColumns({"event_type": canonical_type(F.col("event_type")), "price": normalise_price(F.col("price"), tick=tick, scale=scale), "size": F.col("size").try_cast("double")})


def session_filter(df: DataFrame, *, start: str = "09:30", end: str = "16:00", tz: str = "America/New_York") -> DataFrame:
    """Rows within the session, local time; the end minute counts whole."""
    local = F.from_utc_timestamp(instant(F.col(TS)), tz)
    minute = F.hour(local) * 60 + F.minute(local)
    at = lambda x: int(x[:2]) * 60 + int(x[3:5])
    return df.where(minute.between(at(start), at(end)))


def explicit_halt_filter(df: DataFrame) -> DataFrame:
    """Rows whose trading state doesn't contain H; no state counts as trading."""
    return df.where(~F.coalesce(F.upper("trading_state").contains("H"), F.lit(False)))


def halt_gap_filter(df: DataFrame, *, gap_s: float = 120.0, tz: str = "America/New_York", by: tuple[str, ...] = (SYMBOL,)) -> DataFrame:
    """Drops both rows beside a gap of more than gap_s within one local day; instruments of under three rows stay."""
    w = in_order(*by)
    day = F.to_date(F.from_utc_timestamp(instant(F.col(TS)), tz))
    df = df.withColumns({"__day": day, "__n": F.count(F.lit(1)).over(W.partitionBy(*by))})
    gap = lambda a, b, da, db: F.coalesce((b - a > int(gap_s * NS)) & (da == db), F.lit(False))
    behind = gap(F.lag(TS).over(w), F.col(TS), F.lag("__day").over(w), F.col("__day"))
    ahead = gap(F.col(TS), F.lead(TS).over(w), F.col("__day"), F.lead("__day").over(w))
    return df.withColumn("__gap", (behind | ahead) & (F.col("__n") >= 3)).where(~F.col("__gap")).drop("__day", "__n", "__gap")


def quality_filter(df: DataFrame, *, min_price: float = 0.0, min_size: float = 0.0) -> DataFrame:
    """Rows with a time, and with price and size at least the minimum (missing ones are dropped)."""
    return df.where(F.col(TS).isNotNull() & (F.col("price") >= min_price) & (F.col("size") >= min_size))


def monotonic_filter(df: DataFrame, *, arrival: str, by: tuple[str, ...] = (SYMBOL,)) -> DataFrame:
    """In order of arrival, drops rows older than the newest one accepted so far, which is the newest seen so far."""
    w = W.partitionBy(*by).orderBy(arrival).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("__newest", F.max(TS).over(w)).where(F.col("__newest").isNull() | (F.col(TS) >= F.col("__newest"))).drop("__newest")


def first_of_duplicates(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each value of keys, the first in order; map-side combined, so many equal rows are no hot task."""
    rest = [c for c in df.columns if c not in keys]
    packed = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest if c not in order])
    firsts = df.groupBy(*keys).agg(F.min_by(packed, F.struct(*order)).alias("__row"))
    return firsts.select(*[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns])


def filter_preview(df: DataFrame, *, symbol: str | int | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows of a symbol and a range of times (the end is the midnight that begins that day)."""
    at = lambda x: F.unix_micros(F.to_timestamp(F.lit(x))) * 1000
    if symbol is not None:
        df = df.where(F.col(SYMBOL) == symbol)
    if start is not None:
        df = df.where(F.col(TS) >= at(start))
    return df.where(F.col(TS) <= at(end)) if end is not None else df


def type_dictionary(df: DataFrame, column: str = "event_type") -> DataFrame:
    """event_type -> dense id in sorted order; the distinct types are few and combined map-side."""
    types = df.select(column).where(F.col(column).isNotNull()).distinct()
    ids = types.agg(F.array_sort(F.collect_set(column)).alias("__all"))
    return ids.select(F.posexplode("__all").alias("type_id", column)).select(column, "type_id")


def encode_types(df: DataFrame, column: str = "event_type") -> DataFrame:
    """type_id of each row. No broadcast is asked for: types are usually few, but nothing bounds them (types by level)."""
    return df.join(type_dictionary(df, column), column, "left")


def collapse_types(type_id: Column, types: int) -> Column:
    """Ids of the six event types in fewer types: 4 puts cancels with limits of their side, 2 tells sides, others are by remainder."""
    if types == 6:
        return type_id
    if types == 4:
        return F.when(type_id.isin(4, 5), type_id - 2).otherwise(F.pmod(type_id, F.lit(4)))
    return F.pmod(type_id, F.lit(max(1, types)))


def type_by_level(event_type: Column, level: Column) -> Column:
    """Limit and cancel types with their book level, as LO+@3; others as they are."""
    expands = event_type.isin(*[t for t in EVENT_TYPES if t[:2] in ("LO", "CX")])
    return F.when(expands & (level >= 1), F.concat(event_type, F.lit("@"), level.cast("int").cast("string"))).otherwise(event_type)


def clean_size(size: Column) -> Column:
    value = size.try_cast("double")
    return F.when(value.isNull() | F.isnan(value), 0.0).otherwise(value)


def union_frames(*frames: DataFrame) -> DataFrame:
    """All rows of frames with different columns; missing values are null."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def resolve_slice(total: int, *, rows: int | None = None, cap: int | None = None, offset: int = 0, step: int | None = None, index: int = 0) -> tuple[int, int]:
    """Bounds [start, stop) of a window of rows that ends `offset` rows (and `index` steps) before the last one."""
    size = min(x for x in (rows, cap, total) if x is not None)
    stop = max(0, total - offset - index * (step or size or 1))
    return max(0, stop - size), stop


def slice_rows(df: DataFrame, start: int, stop: int, *, by: tuple[str, ...] = (SYMBOL,)) -> DataFrame:
    """Rows start to stop (from 0) of each instrument in event order; negative bounds count from its end."""
    df = df.withColumn("__rn", F.row_number().over(in_order(*by)) - 1)
    if min(start, stop) < 0:
        df = df.withColumn("__n", F.count(F.lit(1)).over(W.partitionBy(*by)))
    bound = lambda at: F.col("__n") + at if at < 0 else F.lit(at)
    return df.where((F.col("__rn") >= bound(start)) & (F.col("__rn") < bound(stop))).drop("__rn", "__n")


def event_order(df: DataFrame) -> DataFrame:
    """Each instrument's rows together and in order; files written from this need no global sort."""
    return df.repartition(SYMBOL).sortWithinPartitions(SYMBOL, TS, SEQ)
