"""Message and book CSV pairs without headers, matched by row position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.operators.clean import round_to_tick, to_epoch_ns
from tapeworks.operators.labels import backward_as_of
from tapeworks.schema import NS

DAY_S = 86_400


def numbered_lines(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """stem (of the file, up to `message` or `orderbook`), row and line. A file is cut into rows by one task, then spread."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True)
    name = F.lower(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    folder = F.regexp_extract(F.col("_metadata.file_path"), "^(.*)/[^/]*$", 1)
    stem = F.concat_ws("/", folder, F.regexp_replace(F.substring_index(F.substring_index(name, "message", 1), "orderbook", 1), "[_-]+$", ""))
    lines = files.select(stem.alias("stem"), F.posexplode(F.split("value", "\r?\n")).alias("row", "line"))
    return lines.where(F.trim("line") != "")


def _fields(line: Column, n: int) -> list[Column]:
    parts = F.split(line, ",")
    return [F.get(parts, F.lit(i)).try_cast("double") for i in range(n)]


def message_type(kind: Column, direction: Column, *, side_aware: bool = False) -> Column:
    """1 and 2 are orders, 3 and 6 cancels, 4, 5 and 7 trades, others orders; signed by direction only if side_aware."""
    base = F.when(kind.isin(3, 6), "CX").when(kind.isin(4, 5, 7), "MO").otherwise("LO")
    return F.concat(base, F.when(F.lit(side_aware) & (direction == -1), "-").otherwise("+"))


def level_of(price: Column, side: Column, levels: int, tick: float | None) -> Column:
    """The first level of the row's own side whose price is within half a tick; null if none is."""
    near = (tick / 2 if tick else 0.0) + 1e-9
    find = lambda n: F.array_position(F.array(*[F.coalesce(F.abs(F.col(f"{n}_price_{i}") - price) <= near, F.lit(False)) for i in range(1, levels + 1)]), True)
    at = F.when(side == "B", find("bid")).otherwise(find("ask"))
    return F.when(at > 0, at.cast("int"))


def read_pairs(messages: DataFrame, books: DataFrame, levels: int, *, symbol: str | None = None, tick: float | None = None, price_scale: float = 1.0, session_date: str | None = None, tz_offset_s: int = 0, side_aware: bool = False, layout: str = "blocked") -> DataFrame:
    """Events with their book from numbered lines of both files, joined on file and row.

    layout: blocked (all ask prices, ask sizes, bid prices, bid sizes) or interleaved (ask, size, bid, size of a level).
    Prices of both files are scaled alike. Times are seconds of the day if a session date is given.
    """
    t, kind, order, size, price, direction = _fields(F.col("line"), 6)
    msg = messages.select("stem", "row", t.alias("t"), kind.cast("int").alias("kind"), order.cast("long").alias("order_id"), size.alias("size"), price.alias("price"), direction.cast("int").alias("direction"))
    cells = _fields(F.col("line"), 4 * levels)
    at = (lambda j, i: cells[j * levels + i]) if layout == "blocked" else (lambda j, i: cells[4 * i + j])
    names = [(j, i, f"{n}_{what}_{i + 1}", what) for j, (n, what) in enumerate((("ask", "price"), ("ask", "size"), ("bid", "price"), ("bid", "size"))) for i in range(levels)]
    book = books.select("stem", "row", *[(at(j, i) * price_scale if what == "price" else at(j, i)).alias(name) for j, i, name, what in names])
    both = msg.join(book, ["stem", "row"])
    scaled = F.col("price") * price_scale
    both = both.withColumn("price", round_to_tick(scaled, tick) if tick else scaled)
    if session_date:
        start = F.unix_micros(F.to_timestamp(F.lit(session_date))) * 1000 - tz_offset_s * NS
        ns = F.when(F.col("t") < DAY_S, start + F.round(F.col("t") * 1e9).cast("long")).otherwise(to_epoch_ns(F.col("t")))
    else:
        ns = F.round(F.col("t") * 1e9).cast("long")
    side = F.when(F.col("direction") == 1, "B").when(F.col("direction") == -1, "S")
    out = both.withColumns({"ts_ns": ns, "side": side, "event_type": message_type(F.col("kind"), F.col("direction"), side_aware=side_aware), "size": F.greatest("size", F.lit(0.0)), "symbol": F.lit(symbol) if symbol else F.element_at(F.split("stem", "/"), -1), "venue": F.lit("LOBSTER"), "seq": F.col("row").cast("long")})
    return out.withColumn("level", level_of(F.col("price"), F.col("side"), levels, tick)).drop("t", "kind", "direction", "stem", "row")


def discover(spark: SparkSession, path: str, levels: int, **options) -> DataFrame:
    """All pairs under a folder: files whose names agree up to `message` and `orderbook`."""
    return read_pairs(numbered_lines(spark, path, "*message*.csv"), numbered_lines(spark, path, "*orderbook*.csv"), levels, **options)


def merge_by_time(messages: DataFrame, books: DataFrame, levels: int, *, tick: float | None = None) -> DataFrame:
    """Messages with the latest book not after them (the first for earlier ones) and the inferred level."""
    names = [f"{n}_{w}_{i}" for n in ("bid", "ask") for w in ("price", "size") for i in range(1, levels + 1) if f"{n}_{w}_{i}" in books.columns]
    out = backward_as_of(messages, books, names)
    missing = [f"{n}_price_{i}" for n in ("bid", "ask") for i in range(1, levels + 1) if f"{n}_price_{i}" not in names]
    out = out.withColumns({c: F.lit(None).cast("double") for c in missing}) if missing else out
    return out.withColumn("level", level_of(F.col("price"), F.col("side"), levels, tick)).drop(*missing)
