"""Vendor feeds to canonical rows: crypto venues, equity depth, snapshot tables, and tagged-union messages.

Each takes rows with one JSON text and is one projection and at most one explode; lines that aren't JSON give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.operators.clean import to_epoch_ns
from tapeworks.schema import conform

BUY, SELL = "B", "S"


def _rows(df: DataFrame, events: Column, venue: str) -> DataFrame:
    """events: an array of (event_type, price, size, level, side) for each row with ts_ns and symbol."""
    out = df.select("symbol", F.lit(venue).alias("venue"), "ts_ns", F.posexplode(events).alias("part", "e"), *[c for c in ("seq",) if c in df.columns])
    return conform(out.select("symbol", "venue", "ts_ns", *[c for c in ("seq",) if c in df.columns], "part", "e.*"))


def _event(kind: str | Column, price: Column, size: Column, level: int | None, side: str | Column | None) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(kind).cast("string").alias("event_type"), price.try_cast("double").alias("price"), size.try_cast("double").alias("size"), F.lit(level).cast("int").alias("level"), lit(side).cast("string").alias("side"))


def _levels(array: Column, kind: str, side: str) -> Column:
    """Events of an array of [price, size]; elements that are no numbers are left out."""
    made = F.transform(array, lambda x: _event(kind, F.get(x, F.lit(0)), F.get(x, F.lit(1)), None, side))
    return F.coalesce(F.filter(made, lambda e: e["price"].isNotNull() & e["size"].isNotNull()), F.array().cast("array<struct<event_type:string,price:double,size:double,level:int,side:string>>"))


def _parsed(df: DataFrame, text: str, schema: str, times: list[str], symbols: list[str], default: str | None) -> DataFrame:
    df = df.withColumn("j", F.from_json(text, schema)).where(F.col("j").isNotNull())
    ts = to_epoch_ns(F.coalesce(*[F.col(f"j.{t}") for t in times]))
    symbol = F.coalesce(*[F.col(f"j.{s}") for s in symbols], F.lit(default))
    return df.withColumns({"ts_ns": ts, "symbol": symbol.cast("string")})


def binance(df: DataFrame, text: str = "value", *, symbol: str | None = None, venue: str = "BINANCE") -> DataFrame:
    """Trades become market orders, book tickers two level-1 orders, depth updates one order a level."""
    # Keys differ in case only, so they are read by path; b and a are text or arrays.
    key = lambda k: F.get_json_object(text, f"$.{k}")
    df = df.withColumns({"ts_ns": to_epoch_ns(F.coalesce(key("E"), key("T"), key("timestamp"))), "symbol": F.coalesce(key("s"), key("symbol"), F.lit(symbol)), "kind": F.coalesce(key("e"), key("event"))})
    trade = F.array(_event("MO+", F.coalesce(key("p"), key("price"), F.lit("0")), F.coalesce(key("q"), key("qty"), F.lit("0")), None, None))
    ticker = F.array(_event("LO+", key("b"), key("B"), 1, BUY), _event("LO-", key("a"), key("A"), 1, SELL))
    levels = lambda k: F.from_json(key(k), "array<array<string>>")
    depth = F.concat(_levels(levels("b"), "LO+", BUY), _levels(levels("a"), "LO-", SELL))
    events = F.when(F.col("kind").isin("aggTrade", "trade"), trade).when((F.col("kind") == "bookTicker") & F.forall(ticker, lambda e: e["price"].isNotNull() & e["size"].isNotNull()), ticker).when(F.col("kind") == "depthUpdate", depth)
    return _rows(df, events, venue)


def coinbase(df: DataFrame, text: str = "value", *, symbol: str | None = None, venue: str = "COINBASE") -> DataFrame:
    """Matches become market orders, level-2 changes orders by side."""
    df = _parsed(df, text, "type string, time string, E string, timestamp string, product_id string, symbol string, price string, size string, changes array<array<string>>", ["time", "E", "timestamp"], ["product_id", "symbol"], symbol)
    match = F.array(_event("MO+", F.coalesce("j.price", F.lit("0")), F.coalesce("j.size", F.lit("0")), None, None))
    buy = lambda x: F.get(x, F.lit(0)) == "buy"
    change = F.transform("j.changes", lambda x: _event(F.when(buy(x), "LO+").otherwise("LO-"), F.get(x, F.lit(1)), F.get(x, F.lit(2)), None, F.when(buy(x), BUY).otherwise(SELL)))
    changes = F.filter(change, lambda e: e["price"].isNotNull() & e["size"].isNotNull())
    return _rows(df, F.when(F.col("j.type") == "match", match).when(F.col("j.type") == "l2update", changes), venue)


def coinbase_trades(df: DataFrame, product: str, text: str = "value") -> DataFrame:
    """Trades of the REST interface: buys are MO+, others MO-."""
    df = _parsed(df, text, "time string, side string, price string, size string", ["time"], [], product)
    buy = F.col("j.side") == "buy"
    return _rows(df, F.array(_event(F.when(buy, "MO+").otherwise("MO-"), F.col("j.price"), F.col("j.size"), None, F.when(buy, BUY).otherwise(SELL))), "COINBASE")


def iex(df: DataFrame, text: str = "value", *, symbol: str | None = None, venue: str = "IEX") -> DataFrame:
    """Books become one order a level, trades market orders."""
    df = _parsed(df, text, "type string, msgType string, timestamp string, ts string, symbol string, price string, size string, bids array<array<string>>, asks array<array<string>>", ["timestamp", "ts"], ["symbol"], symbol)
    kind = F.lower(F.coalesce("j.type", "j.msgType"))
    trade = F.filter(F.array(_event("MO+", F.col("j.price"), F.col("j.size"), None, None)), lambda e: e["price"].isNotNull() & e["size"].isNotNull())
    return _rows(df, F.when(kind == "book", F.concat(_levels(F.col("j.bids"), "LO+", BUY), _levels(F.col("j.asks"), "LO-", SELL))).when(kind == "trade", trade), venue)


def snapshots(df: DataFrame, *, symbol: str, dt_ns: int = 1_000_000, row: str = "row") -> DataFrame:
    """Two level-1 orders of each snapshot row; times are the row number times dt_ns."""
    df = df.select(F.lit(symbol).alias("symbol"), (F.col(row) * dt_ns).alias("ts_ns"), F.col(row).alias("seq"), "bid_price_1", "bid_size_1", "ask_price_1", "ask_size_1")
    return _rows(df, F.array(_event("LO+", F.col("bid_price_1"), F.col("bid_size_1"), 1, BUY), _event("LO-", F.col("ask_price_1"), F.col("ask_size_1"), 1, SELL)), "FI2010")


def aggregate_trades(df: DataFrame, *, symbol: str) -> DataFrame:
    """Rows of a trade archive without header: price, quantity and milliseconds are columns 1, 2 and 5."""
    c = df.columns
    rows = df.select(F.lit(symbol).alias("symbol"), F.lit("BINANCE").alias("venue"), to_epoch_ns(F.col(c[5])).alias("ts_ns"), F.lit("MO+").alias("event_type"), F.col(c[1]).try_cast("double").alias("price"), F.col(c[2]).try_cast("double").alias("size"))
    return conform(rows.where(F.col("price").isNotNull() & F.col("size").isNotNull()))


#: Message type -> canonical type before the sign (fixed values).
NORMALISED = {"itch": {"A": "LO", "F": "LO", "U": "LO", "E": "MO", "X": "CX"}, "ouch": {"O": "LO", "U": "LO", "C": "CX", "E": "MO"}}


def tagged(df: DataFrame, family: str, text: str = "value", *, fail: bool = True) -> DataFrame:
    """Messages as JSON with msg_type, side, price, shares and stock. An unknown side gives no sign.

    A payload that can't be read is an error, or with fail=False a row with `bad` true.
    """
    df = df.withColumn("j", F.from_json(text, "msg_type string, timestamp string, side string, price double, shares double, stock string, level int"))
    table = F.create_map(*[F.lit(x) for kv in NORMALISED[family].items() for x in kv])
    base = F.try_element_at(table, F.col("j.msg_type"))
    side = F.upper("j.side")
    sign = F.when(side.isin("B", "BUY", "BID"), "+").when(side.isin("S", "SELL", "ASK"), "-").otherwise("")
    bad = base.isNull()
    if fail:
        base = F.when(bad, F.raise_error(F.concat(F.lit("bad message: "), F.col(text)))).otherwise(base)
    out = df.select(F.col("j.stock").alias("symbol"), to_epoch_ns(F.col("j.timestamp")).alias("ts_ns"), F.concat(base, sign).alias("event_type"), F.col("j.price").alias("price"), F.coalesce("j.shares", F.lit(0.0)).alias("size"), F.col("j.level").alias("level"), F.col("j.side").alias("side"), bad.alias("bad"))
    return conform(out)
