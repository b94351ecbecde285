"""Event, book, prediction and intensity tables derived from the driver tables, in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.schema import NS

LEVELS = 3
TYPES = ("signup", "error", "click", "view", "purchase")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts_ns, seq, event_type, price, size."""
    ev = read(spark, sf_dir, "events")
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    size = F.get_json_object("props", "$.k").try_cast("double")
    return ev.select(F.col("user_id").alias("symbol"), ns.alias("ts_ns"), F.col("event_id").alias("seq"), "event_type", F.col("value").alias("price"), size.alias("size"))


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with a book of LEVELS levels."""
    ev = events(spark, sf_dir)
    cols = {}
    for i in range(1, LEVELS + 1):
        cols |= {f"bid_price_{i}": F.floor("price") - i + 1.0, f"ask_price_{i}": F.floor("price") + F.lit(float(i)), f"bid_size_{i}": ((F.col("seq") * i) % 97).cast("double"), f"ask_size_{i}": ((F.col("seq") * (i + 3)) % 89).cast("double")}
    return ev.withColumns(cols).withColumn("mid", (F.col("bid_price_1") + F.col("ask_price_1")) / 2)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """idx, etype, pred, pred2, label, ret; predictions have ties."""
    ev = events(spark, sf_dir)
    of = lambda a, m: ((F.col("seq") * a) % m) / float(m)
    return ev.select(F.col("seq").alias("idx"), F.col("event_type").alias("etype"), F.col("symbol"), of(7919, 1009).alias("pred"), of(104729, 1013).alias("pred2"), (F.col("price") > 50).cast("int").alias("label"), ((F.col("price") - 49.6) / 1000).alias("ret"))


def intensities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rn, lam (one of each type), m, dt, in the order of events."""
    from tapeworks.functions.ranks import running_totals

    ev = events(spark, sf_dir)
    m = F.array_position(F.array(*[F.lit(t) for t in sorted(TYPES)]), F.col("event_type")).cast("int") - 1
    lam = F.array(*[1.0 / (1 + (F.col("seq") * (k + 2)) % 17) for k in range(len(TYPES))])
    # One series over all symbols: rows are numbered range by range, and each meets the row before by number.
    rows = running_totals(ev.withColumn("one", F.lit(1).cast("long")), ["ts_ns", "seq"], ["one"])
    ts = rows.select((F.col("before_one") + 1).alias("rn"), F.col("ts_ns").alias("__was"))
    rows = rows.select(F.col("before_one").alias("rn"), lam.alias("lam"), m.alias("m"), "ts_ns").join(ts, "rn", "left")
    return rows.select("rn", "lam", "m", F.coalesce((F.col("ts_ns") - F.col("__was")) / NS, F.lit(0.0)).alias("dt"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """market, symbol, median_daily_notional, tick_size."""
    from tapeworks.operators.panel import instrument_stats

    li, su = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "supplier")
    daily = li.groupBy("l_suppkey", "l_shipdate").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("notional"))
    rows = daily.join(su, F.col("l_suppkey") == F.col("s_suppkey"))
    return instrument_stats(rows.select(F.col("s_nationkey").alias("market"), F.col("s_suppkey").alias("symbol"), "notional", (F.lit(0.01) * (1 + F.col("s_suppkey") % 3)).alias("tick_size")))


def sql(body: str, *needs: str) -> str:
    """body with the common table expressions that it needs in front."""
    order = ["ev", "bk", "pr", "tp0", "tp", "pn"]
    wanted = set(needs)
    if wanted & {"bk", "pr", "tp", "tp0"}:
        wanted.add("ev")
    if "tp" in wanted:
        wanted.add("tp0")
    return "WITH " + ",\n".join(f"{n} AS ({CTE[n]})" for n in order if n in wanted) + ("," if body.lstrip().startswith("_") else "") + "\n" + body


_LEVEL = ", ".join(f"floor(price) - {i} + 1 AS bid_price_{i}, floor(price) + {i} AS ask_price_{i}, CAST((seq * {i}) % 97 AS DOUBLE) AS bid_size_{i}, CAST((seq * {i + 3}) % 89 AS DOUBLE) AS ask_size_{i}" for i in range(1, LEVELS + 1))
CTE = {
    "ev": "SELECT user_id AS symbol, epoch_us(ts) * 1000 AS ts_ns, event_id AS seq, event_type, value AS price, CAST(regexp_extract(props, '\"k\": *([0-9.]+)', 1) AS DOUBLE) AS size FROM events",
    "bk": f"SELECT *, (bid_price_1 + ask_price_1) / 2 AS mid FROM (SELECT *, {_LEVEL} FROM ev)",
    "pr": "SELECT seq AS idx, event_type AS etype, symbol, ((seq * 7919) % 1009) / 1009.0 AS pred, ((seq * 104729) % 1013) / 1013.0 AS pred2, CAST(price > 50 AS INTEGER) AS label, (price - 49.6) / 1000 AS ret FROM (SELECT seq, event_type, symbol, price FROM ev)",
    "tp0": "SELECT row_number() OVER (ORDER BY ts_ns, seq) - 1 AS rn, [" + ", ".join(f"CAST(1.0 AS DOUBLE) / (1 + (seq * {k + 2}) % 17)" for k in range(5)) + "] AS lam, list_position(['click','error','purchase','signup','view'], event_type) - 1 AS m, coalesce((ts_ns - lag(ts_ns) OVER (ORDER BY ts_ns, seq)) / 1e9, 0) AS dt FROM ev",
    "tp": "SELECT *, list_sum(lam) AS tot FROM tp0",
    "pn": "SELECT s_nationkey AS market, s_suppkey AS symbol, quantile_cont(notional, 0.5) AS median_daily_notional, min(CAST(0.01 AS DOUBLE) * (1 + s_suppkey % 3)) AS tick_size FROM (SELECT l_suppkey, l_shipdate, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS notional FROM lineitem GROUP BY ALL) d JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL",
}
