"""Queries: cleaning, joins, labels and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeworks.operators import actions, clean, features, labels, splits
from tapeworks.plans.tables import TYPES, book, events, read, sql
from tapeworks.registry import Catalog
from tapeworks.schema import NS, floor_div, instant

catalog = Catalog()
query = catalog.query
HOUR = 3600
r6 = lambda c: F.round(c, 6)

RAW = "CASE event_type WHEN 'purchase' THEN 'trade' WHEN 'click' THEN 'Add' WHEN 'error' THEN 'cancel' WHEN 'signup' THEN 'sell' ELSE event_type END"
CANON = "CASE upper(raw) WHEN 'TRADE' THEN 'MO+' WHEN 'BUY' THEN 'MO+' WHEN 'EXECUTE' THEN 'MO+' WHEN 'SELL' THEN 'MO-' WHEN 'ADD' THEN 'LO+' WHEN 'NEW' THEN 'LO+' WHEN 'CANCEL' THEN 'CX-' WHEN 'DELETE' THEN 'CX-' ELSE upper(raw) END"


def raw_events(spark, d):
    raw = F.create_map(*[F.lit(x) for x in ("purchase", "trade", "click", "Add", "error", "cancel", "signup", "sell")])
    return events(spark, d).withColumn("event_type", F.coalesce(F.try_element_at(raw, F.col("event_type")), F.col("event_type")))


@query("canonical_events", sql(f"SELECT symbol, seq, {CANON} AS event_type, round(price, 6) AS price, size FROM (SELECT *, {RAW} AS raw FROM ev)", "ev"))
def canonical_events(spark, d):
    return clean.canonical_events(raw_events(spark, d)).select("symbol", "seq", "event_type", r6("price").alias("price"), "size")


@query("epoch_units", sql("SELECT seq, ts_ns AS from_ns, (ts_ns // 1000) * 1000 AS from_us, (ts_ns // 1000000) * 1000000 AS from_ms, (ts_ns // 1000000000) * 1000000000 AS from_s, (ts_ns // 1000) * 1000 AS from_text FROM ev", "ev"))
def epoch_units(spark, d):
    ev = events(spark, d)
    unit = lambda n: clean.to_epoch_ns(floor_div(F.col("ts_ns"), n).cast("string"))
    text = F.date_format(instant(F.col("ts_ns")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return ev.select("seq", clean.to_epoch_ns(F.col("ts_ns").cast("string")).alias("from_ns"), unit(1000).alias("from_us"), unit(1_000_000).alias("from_ms"), unit(NS).alias("from_s"), clean.to_epoch_ns(text).alias("from_text"))


@query("price_tick_round", sql("SELECT seq, round(round_even(price / 0.25, 0) * 0.25, 6) AS price, round(round(price / 0.25) * 0.25, 6) AS price_away FROM ev", "ev"))
def price_tick_round(spark, d):
    return events(spark, d).select("seq", r6(clean.round_to_tick(F.col("price"), 0.25)).alias("price"), r6(clean.round_to_tick(F.col("price"), 0.25, half="away")).alias("price_away"))


def _session(tz: str, start: int, end: int) -> str:
    local = f"(make_timestamp(ts_ns // 1000) AT TIME ZONE 'UTC' AT TIME ZONE '{tz}')"
    return sql(f"SELECT symbol, seq, event_type FROM ev WHERE hour({local}) * 60 + minute({local}) BETWEEN {start} AND {end}", "ev")


@query("session_filter_ny", _session("America/New_York", 570, 960))
def session_filter_ny(spark, d):
    return clean.session_filter(events(spark, d)).select("symbol", "seq", "event_type")


@query("session_filter_london", _session("Europe/London", 480, 990))
def session_filter_london(spark, d):
    return clean.session_filter(events(spark, d), start="08:00", end="16:30", tz="Europe/London").select("symbol", "seq", "event_type")


@query("explicit_halt_filter", sql("SELECT seq, event_type FROM ev WHERE event_type NOT LIKE '%h%'", "ev"))
def explicit_halt_filter(spark, d):
    ev = events(spark, d).withColumn("trading_state", F.when(F.col("seq") % 5 > 0, F.col("event_type")))
    ev = ev.withColumn("trading_state", F.coalesce("trading_state", "event_type"))
    return clean.explicit_halt_filter(ev).select("seq", "event_type")


@query("halt_gap_filter", sql("""
SELECT symbol, seq FROM (SELECT *, ts_ns - lag(ts_ns) OVER w > 3600000000000 AND date_trunc('day', make_timestamp(lag(ts_ns) OVER w // 1000)) = date_trunc('day', make_timestamp(ts_ns // 1000)) AS b,
 lead(ts_ns) OVER w - ts_ns > 3600000000000 AND date_trunc('day', make_timestamp(lead(ts_ns) OVER w // 1000)) = date_trunc('day', make_timestamp(ts_ns // 1000)) AS a, count(*) OVER (PARTITION BY symbol) AS n
 FROM ev WINDOW w AS (PARTITION BY symbol ORDER BY ts_ns, seq)) WHERE n < 3 OR NOT (coalesce(a, false) OR coalesce(b, false))""", "ev"))
def halt_gap_filter(spark, d):
    return clean.halt_gap_filter(events(spark, d), gap_s=HOUR, tz="UTC").select("symbol", "seq")


@query("quality_filter", sql("SELECT symbol, seq, round(price, 6) AS price, size FROM ev WHERE price >= 5 AND size >= 10", "ev"))
def quality_filter(spark, d):
    return clean.quality_filter(events(spark, d), min_price=5, min_size=10).select("symbol", "seq", r6("price").alias("price"), "size")


@query("dedupe_first", "SELECT l_suppkey, l_shipdate, l_returnflag, min(l_orderkey * 10 + l_linenumber) AS first_key FROM lineitem GROUP BY ALL")
def dedupe_first(spark, d):
    li = read(spark, d, "lineitem").select("l_suppkey", "l_shipdate", "l_returnflag", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first_key"))
    return clean.first_of_duplicates(li, ["l_suppkey", "l_shipdate", "l_returnflag"], ["first_key"])


@query("monotonic_drop", sql("SELECT symbol, seq FROM (SELECT *, max(ts_ns) OVER (PARTITION BY symbol ORDER BY (seq * 7919) % 10007, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM ev) WHERE newest IS NULL OR ts_ns >= newest", "ev"))
def monotonic_drop(spark, d):
    ev = events(spark, d).withColumn("arrival", F.struct((F.col("seq") * 7919) % 10007, "seq"))
    return clean.monotonic_filter(ev, arrival="arrival").select("symbol", "seq")


@query("preview_filter", sql("SELECT symbol, seq FROM ev WHERE symbol = 7 AND ts_ns >= epoch_us(TIMESTAMP '2024-01-05') * 1000 AND ts_ns <= epoch_us(TIMESTAMP '2024-01-20') * 1000", "ev"))
def preview_filter(spark, d):
    return clean.filter_preview(events(spark, d), symbol=7, start="2024-01-05", end="2024-01-20").select("symbol", "seq")


@query("json_props_extract", sql("SELECT seq, size, CAST(size AS BIGINT) % 7 AS k7 FROM ev", "ev"))
def json_props_extract(spark, d):
    props = F.from_json("props", "k DOUBLE")
    return read(spark, d, "events").select(F.col("event_id").alias("seq"), props["k"].alias("size"), (props["k"].cast("long") % 7).alias("k7"))


@query("explode_levels", sql("SELECT seq, 'bid' AS side, UNNEST([1, 2, 3]) AS level, UNNEST([bid_price_1, bid_price_2, bid_price_3]) AS price, UNNEST([bid_size_1, bid_size_2, bid_size_3]) AS size FROM bk UNION ALL SELECT seq, 'ask', UNNEST([1, 2, 3]), UNNEST([ask_price_1, ask_price_2, ask_price_3]), UNNEST([ask_size_1, ask_size_2, ask_size_3]) FROM bk", "bk"))
def explode_levels(spark, d):
    level = lambda n, i: F.struct(F.lit(n).alias("side"), F.lit(i).alias("level"), F.col(f"{n}_price_{i}").alias("price"), F.col(f"{n}_size_{i}").alias("size"))
    return book(spark, d).select("seq", F.inline(F.array(*[level(n, i) for n in ("bid", "ask") for i in (1, 2, 3)])))


@query("etype_dictionary", sql("SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INTEGER) AS type_id FROM (SELECT DISTINCT event_type FROM ev)", "ev"))
def etype_dictionary(spark, d):
    return clean.type_dictionary(events(spark, d))


@query("etype_encoded", sql("SELECT seq, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS type_id FROM ev", "ev"))
def etype_encoded(spark, d):
    return clean.encode_types(events(spark, d)).select("seq", "type_id")


@query("etype_collapsed", sql("_t AS (SELECT seq, dense_rank() OVER (ORDER BY event_type) - 1 + seq % 2 AS t FROM ev) SELECT seq, CAST(t AS INTEGER) AS six, CAST(CASE t WHEN 4 THEN 2 WHEN 5 THEN 3 ELSE t END AS INTEGER) AS four, CAST(t % 3 AS INTEGER) AS three, CAST(t % 2 AS INTEGER) AS two FROM _t", "ev"))
def etype_collapsed(spark, d):
    t = (F.col("type_id") + F.col("seq") % 2).cast("int")
    return clean.encode_types(events(spark, d)).select("seq", *[clean.collapse_types(t, n).cast("int").alias(name) for name, n in (("six", 6), ("four", 4), ("three", 3), ("two", 2))])


@query("etype_by_level", sql(f"SELECT seq, CASE WHEN t IN ('LO+', 'CX-') AND seq % 4 >= 1 THEN t || '@' || (seq % 4) ELSE t END AS event_type FROM (SELECT seq, {CANON} AS t FROM (SELECT *, {RAW} AS raw FROM ev))", "ev"))
def etype_by_level(spark, d):
    ev = clean.canonical_events(raw_events(spark, d))
    return ev.select("seq", clean.type_by_level(F.col("event_type"), F.col("seq") % 4).alias("event_type"))


@query("size_sanitise", sql("SELECT seq, CASE WHEN seq % 3 = 0 THEN 0 ELSE size END AS size FROM ev", "ev"))
def size_sanitise(spark, d):
    return events(spark, d).select("seq", clean.clean_size(F.when(F.col("seq") % 3 == 0, F.lit("n/a")).otherwise(F.col("size").cast("string"))).alias("size"))


@query("union_frames", "SELECT o_orderkey AS id, o_totalprice AS price, o_orderpriority AS note, NULL::DOUBLE AS value FROM orders UNION ALL SELECT event_id, NULL, event_type, value FROM events")
def union_frames(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("note"))
    e = read(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("note"), "value")
    return clean.union_frames(o, e).select("id", "price", "note", "value")


@query("row_slice", sql("SELECT symbol, seq FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_ns, seq) - 1 AS rn FROM ev) WHERE rn >= 10 AND rn < 30", "ev"))
def row_slice(spark, d):
    return clean.slice_rows(events(spark, d), 10, 30).select("symbol", "seq")


@query("row_count", "SELECT count(*) AS n_rows FROM events")
def row_count(spark, d):
    return read(spark, d, "events").agg(F.count(F.lit(1)).alias("n_rows"))


@query("instrument_discovery", "SELECT DISTINCT user_id AS symbol FROM events")
def instrument_discovery(spark, d):
    return read(spark, d, "events").select(F.col("user_id").alias("symbol")).distinct()


ACTIONS = "_ca AS (SELECT p_partkey AS symbol, DATE '2024-01-01' + CAST(p_partkey % 30 AS INTEGER) AS date, CAST(CASE WHEN p_partkey % 10 = 0 THEN 0 ELSE 1 + p_partkey % 4 END AS DOUBLE) AS adj_factor FROM part),\n_adj AS (SELECT ev.*, CASE WHEN adj_factor IS NULL OR adj_factor = 0 THEN 1 ELSE adj_factor END AS f FROM ev LEFT JOIN _ca ON ev.symbol = _ca.symbol AND CAST(make_timestamp(ts_ns // 1000) AS DATE) = date)\n"


def _adjusted(spark, d):
    part = read(spark, d, "part")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("p_partkey") % 30).cast("int"))
    ca = part.select(F.col("p_partkey").alias("symbol"), day.alias("date"), F.when(F.col("p_partkey") % 10 == 0, 0.0).otherwise(1.0 + F.col("p_partkey") % 4).alias("adj_factor"))
    return actions.adjust_corporate_actions(events(spark, d), ca)


@query("corporate_actions_adjust", sql(ACTIONS + "SELECT symbol, seq, f AS adj_factor, round(price / f, 6) AS price FROM _adj", "ev"))
def corporate_actions_adjust(spark, d):
    return _adjusted(spark, d).select("symbol", "seq", "adj_factor", r6("price").alias("price"))


@query("ca_preview_summary", sql(ACTIONS + "SELECT count(*) AS n_rows, count(*) FILTER (f <> 1) AS n_adjusted, min(f) AS min_factor, max(f) AS max_factor FROM _adj", "ev"))
def ca_preview_summary(spark, d):
    return actions.preview_summary(_adjusted(spark, d))


@query("ca_sample", sql(ACTIONS + "SELECT symbol, ts_ns, seq, round(price, 6) AS price_before, round(price / f, 6) AS price_after, f AS adj_factor FROM _adj ORDER BY ts_ns, symbol, seq LIMIT 20", "ev"))
def ca_sample(spark, d):
    out = actions.sample_before_after(events(spark, d), _adjusted(spark, d), 20)
    return out.withColumns({c: r6(c) for c in ("price_before", "price_after")})


def _asof(h: int, eta: str = "10") -> str:
    return sql(f"""_f AS (SELECT a.symbol, a.seq, a.price, arg_min(b.price, (b.ts_ns, b.seq)) AS later FROM ev a LEFT JOIN (SELECT * FROM ev) b ON a.symbol = b.symbol AND b.ts_ns >= a.ts_ns + {h * NS} GROUP BY ALL),
_l AS (SELECT symbol, arg_max(price, (ts_ns, seq)) AS last FROM ev GROUP BY ALL)
SELECT symbol, seq, CAST(abs(coalesce(later, last) - price) > {eta} AS INTEGER) AS instability_s_{h} FROM _f JOIN _l USING (symbol)""", "ev")


for _name, _h in (("1h", HOUR), ("6h", 6 * HOUR), ("1d", 24 * HOUR)):

    def _label(spark, d, h=_h):
        return labels.clock_label(events(spark, d), h, eta=10, mid="price").select("symbol", "seq", f"instability_s_{h}")

    query(f"asof_forward_label_{_name}", _asof(_h))(_label)

for _k in (5, 20):

    def _elabel(spark, d, k=_k):
        return labels.event_label(events(spark, d), k, eta=10, mid="price").select("symbol", "seq", f"instability_e_{k}")

    query(f"event_horizon_label_{_k}", sql(f"SELECT symbol, seq, CAST(abs(coalesce(lead(price, {_k}) OVER w, last_value(price) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) - price) > 10 AS INTEGER) AS instability_e_{_k} FROM ev WINDOW w AS (PARTITION BY symbol ORDER BY ts_ns, seq)", "ev"))(_elabel)


@query("label_rate_by_symbol", sql(f"""_f AS (SELECT a.symbol, a.seq, a.price, arg_min(b.price, (b.ts_ns, b.seq)) AS later FROM ev a LEFT JOIN (SELECT * FROM ev) b ON a.symbol = b.symbol AND b.ts_ns >= a.ts_ns + {6 * HOUR * NS} GROUP BY ALL),
_l AS (SELECT symbol, arg_max(price, (ts_ns, seq)) AS last FROM ev GROUP BY ALL),
_d AS (SELECT symbol, seq, coalesce((ts_ns - lag(ts_ns) OVER w) / 1e9, 0) AS dt, coalesce(ln(greatest(price, 1e-6)) - lag(ln(greatest(price, 1e-6))) OVER w, 0) AS ret FROM ev WINDOW w AS (PARTITION BY symbol ORDER BY ts_ns, seq))
SELECT symbol, count(*) AS n_events, round(avg(CAST(abs(coalesce(later, last) - _f.price) > 10 AS DOUBLE)), 6) AS label_rate, round(avg(dt), 3) AS mean_dt, round(avg(abs(ret)), 6) AS mean_abs_ret FROM _f JOIN _l USING (symbol) JOIN _d USING (symbol, seq) GROUP BY symbol""", "ev"))
def label_rate_by_symbol(spark, d):
    ev = labels.clock_label(events(spark, d), 6 * HOUR, eta=10, mid="price")
    ev = features.inter_event_dt(features.causal_returns(ev, [1], mid="price"))
    return ev.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_events"), r6(F.avg(f"instability_s_{6 * HOUR}")).alias("label_rate"), F.round(F.avg("dt"), 3).alias("mean_dt"), r6(F.avg(F.abs("ret_1"))).alias("mean_abs_ret"))


@query("asof_backward_book", sql("""_s AS (SELECT symbol, ts_ns, seq, price AS book_price FROM ev WHERE seq % 7 = 0), _f AS (SELECT symbol, arg_min(book_price, (ts_ns, seq)) AS first_price FROM _s GROUP BY ALL)
SELECT e.symbol, e.seq, round(coalesce(s.book_price, first_price), 6) AS book_price FROM ev e ASOF LEFT JOIN _s s ON e.symbol = s.symbol AND e.ts_ns >= s.ts_ns LEFT JOIN _f ON e.symbol = _f.symbol""", "ev"))
def asof_backward_book(spark, d):
    ev = events(spark, d)
    snaps = ev.where(F.col("seq") % 7 == 0).select("symbol", "ts_ns", "seq", F.col("price").alias("book_price"))
    return labels.backward_as_of(ev, snaps, ["book_price"]).select("symbol", "seq", r6("book_price").alias("book_price"))


@query("ffill_bfill_mid", sql("SELECT symbol, seq, round(coalesce(last_value(m IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(m IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS mid FROM (SELECT *, CASE WHEN seq % 3 = 0 THEN NULL ELSE price END AS m FROM ev) WINDOW w AS (PARTITION BY symbol ORDER BY ts_ns, seq)", "ev"))
def ffill_bfill_mid(spark, d):
    ev = events(spark, d).withColumn("mid", F.when(F.col("seq") % 3 != 0, F.col("price")))
    return labels.fill_both_ways(ev, "mid").select("symbol", "seq", r6("mid").alias("mid"))


@query("topk_abs_dmid", _asof(HOUR).replace("CAST(abs(coalesce(later, last) - price) > 10 AS INTEGER) AS instability_s_3600", "round(abs(coalesce(later, last) - price), 6) AS abs_dmid") + " ORDER BY abs(coalesce(later, last) - price) DESC, seq LIMIT 25")
def topk_abs_dmid(spark, d):
    ev = events(spark, d)
    return labels.largest_moves(ev, 25, mid="price", horizon_s=HOUR).select("symbol", "seq", r6("abs_dmid").alias("abs_dmid"))


@query("depth_imbalance", sql("SELECT seq, bid_size_1 AS cdb_1, ask_size_1 AS cda_1, bid_size_1 + bid_size_2 + bid_size_3 AS cdb_3, ask_size_1 + ask_size_2 + ask_size_3 AS cda_3, round((bid_size_1 - ask_size_1) / (bid_size_1 + ask_size_1 + 1e-6), 6) AS imb_1, round((bid_size_1 + bid_size_2 + bid_size_3 - ask_size_1 - ask_size_2 - ask_size_3) / (bid_size_1 + bid_size_2 + bid_size_3 + ask_size_1 + ask_size_2 + ask_size_3 + 1e-6), 6) AS imb_3 FROM bk", "bk"))
def depth_imbalance(spark, d):
    out = features.cumulative_depth(book(spark, d), [1, 3], 3)
    return out.select("seq", "cdb_1", "cda_1", "cdb_3", "cda_3", r6("imb_1").alias("imb_1"), r6("imb_3").alias("imb_3"))


@query("base_depths", sql("SELECT seq, " + ", ".join(f"{n}_size_{i} AS {n[0]}size_{i}" for n in ("bid", "ask") for i in (1, 2, 3)) + " FROM bk", "bk"))
def base_depths(spark, d):
    return features.depths(book(spark, d), 3).select("seq", *[f"{n}size_{i}" for n in "ba" for i in (1, 2, 3)])


@query("spread_mid", sql("SELECT seq, ask_price_1 - bid_price_1 AS spread, mid FROM bk", "bk"))
def spread_mid(spark, d):
    return features.spread_and_mid(book(spark, d)).select("seq", "spread", "mid")


@query("causal_returns", sql("SELECT seq, " + ", ".join(f"round(coalesce(ln(greatest(price, 1e-6)) - lag(ln(greatest(price, 1e-6)), {h}) OVER w, 0), 6) AS ret_{h}" for h in (1, 5, 10)) + " FROM ev WINDOW w AS (PARTITION BY symbol ORDER BY ts_ns, seq)", "ev"))
def causal_returns(spark, d):
    return features.causal_returns(events(spark, d), mid="price").select("seq", *[r6(f"ret_{h}").alias(f"ret_{h}") for h in (1, 5, 10)])


@query("inter_event_dt", sql("SELECT seq, round(coalesce((ts_ns - lag(ts_ns) OVER (PARTITION BY symbol ORDER BY ts_ns, seq)) / 1e9, 0), 6) AS dt FROM ev", "ev"))
def inter_event_dt(spark, d):
    return features.inter_event_dt(events(spark, d)).select("seq", r6("dt").alias("dt"))


def _counts(w: int) -> str:
    run, old = "(PARTITION BY symbol ORDER BY ts_ns, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", f"(PARTITION BY symbol ORDER BY ts_ns RANGE BETWEEN UNBOUNDED PRECEDING AND {w * NS} PRECEDING)"
    one = lambda t: f"count(*) FILTER (event_type = '{t}') OVER" if t else "count(*) OVER"
    return ", ".join(f"{one(t)} {run} - {one(t)} {old} AS cnt_{t or 'all'}_{w}" for t in ("click", "view", ""))


@query("rolling_type_counts", sql(f"SELECT seq, {_counts(6 * HOUR)}, {_counts(24 * HOUR)} FROM ev", "ev"))
def rolling_type_counts(spark, d):
    out = features.rolling_counts(events(spark, d), ["click", "view"], [6 * HOUR, 24 * HOUR])
    return out.select("seq", *[c for c in out.columns if c.startswith("cnt_")])


@query("rolling_counts_ties", "SELECT k, count(*) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - count(*) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 30 DAY PRECEDING) AS n_30d FROM (SELECT l_suppkey, l_shipdate, l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS k FROM lineitem)")
def rolling_counts_ties(spark, d):
    li = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("symbol"), (F.unix_micros(F.col("l_shipdate").cast("timestamp")) * 1000).alias("ts_ns"), (F.col("l_orderkey") * 1_000_000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("seq"))
    out = features.rolling_counts(li, [], [30 * 86_400], column="symbol")
    return out.select(F.col("seq").alias("k"), F.col(f"cnt_all_{30 * 86_400}").alias("n_30d"))


@query("rolling_counts_chunked", sql(f"SELECT seq, {_counts(6 * HOUR)} FROM ev", "ev"))
def rolling_counts_chunked(spark, d):
    """The same counts over chunks of a day with a halo, for instruments too large for one task."""
    from tapeworks.operators.windows import chunked

    ev = chunked(events(spark, d), 86_400 * NS, back_ns=6 * HOUR * NS)
    out = features.rolling_counts(ev, ["click", "view"], [6 * HOUR], by=("symbol", "chunk")).where("own")
    return out.select("seq", *[c for c in out.columns if c.startswith("cnt_")])


@query("ewma_counts", sql(f"""SELECT a.seq, round(sum(CASE WHEN b.event_type = 'click' THEN exp((b.ts_ns - a.ts_ns) / {HOUR * NS}.0) ELSE 0 END), 6) AS ewm_click, round(sum(exp((b.ts_ns - a.ts_ns) / {HOUR * NS}.0)), 6) AS ewm_all
FROM ev a JOIN (SELECT * FROM ev) b ON a.symbol = b.symbol AND (b.ts_ns < a.ts_ns OR (b.ts_ns = a.ts_ns AND b.seq <= a.seq)) AND b.ts_ns > a.ts_ns - {60 * HOUR * NS} GROUP BY a.seq""", "ev"))
def ewma_counts(spark, d):
    out = features.ewma_counts(events(spark, d), ["click"], [HOUR])
    return out.select("seq", r6(f"ewm_click_{HOUR}").alias("ewm_click"), r6(f"ewm_all_{HOUR}").alias("ewm_all"))


@query("time_covariates", sql("""_t AS (SELECT seq, (ts_ns // 1000000000) % 86400 AS s, (ts_ns // 86400000000000 + 3) % 7 AS w FROM ev)
SELECT seq, round(sin(s * (2 * pi() / 86400)), 6) + 0 AS tod_sin, round(cos(s * (2 * pi() / 86400)), 6) + 0 AS tod_cos, round(s / 86400, 8) AS tod_progress, round(sin(w * (2 * pi() / 7)), 6) + 0 AS dow_sin, round(cos(w * (2 * pi() / 7)), 6) + 0 AS dow_cos FROM _t""", "ev"))
def time_covariates(spark, d):
    out = features.time_covariates(events(spark, d))
    return out.select("seq", *[(r6(c) + 0.0).alias(c) for c in ("tod_sin", "tod_cos", "dow_sin", "dow_cos")], F.round("tod_progress", 8).alias("tod_progress"))


ISLAND = """_c AS (SELECT *, {extra} CASE WHEN bid_size_1 IS DISTINCT FROM lag(bid_size_1) OVER w OR bid_price_1 IS DISTINCT FROM lag(bid_price_1) OVER w {more} THEN 1 ELSE 0 END AS r FROM (SELECT * REPLACE (CAST((seq // 5 * 3) % 7 AS DOUBLE) AS bid_size_1, floor(price / 60) AS bid_price_1) FROM bk) WINDOW w AS (PARTITION BY symbol ORDER BY ts_ns, seq)),
_i AS (SELECT *, sum(r) OVER (PARTITION BY symbol ORDER BY ts_ns, seq ROWS UNBOUNDED PRECEDING) AS island FROM _c)
SELECT symbol, seq, round((ts_ns - min(ts_ns) OVER (PARTITION BY symbol, island)) / 1e9, 6) AS qage_b_1 FROM _i"""


def slow_book(spark, d):
    """A book whose best bid stays for several events."""
    return book(spark, d).withColumns({"bid_size_1": ((F.floor(F.col("seq") / 5) * 3) % 7).cast("double"), "bid_price_1": F.floor(F.col("price") / 60).cast("double")})


@query("queue_age", sql(ISLAND.format(extra="", more=""), "bk"))
def queue_age(spark, d):
    return features.queue_age(slow_book(spark, d), "bid", 1).select("symbol", "seq", r6("qage_b_1").alias("qage_b_1"))


@query("queue_age_event_aware", sql(ISLAND.format(extra="", more="OR event_type = 'error' OR (event_type = 'click' AND seq % 2 = 1)"), "bk"))
def queue_age_event_aware(spark, d):
    bk = slow_book(spark, d)
    kind = F.when(F.col("event_type") == "error", "MO-").when(F.col("event_type") == "click", "LO+").otherwise("MO+")
    bk = bk.withColumns({"event_type": kind, "level": (2 - F.col("seq") % 2).cast("int"), "side": F.lit("bid")})
    return features.queue_age(bk, "bid", 1, extra=features.event_resets("bid", 1)).select("symbol", "seq", r6("qage_b_1").alias("qage_b_1"))


@query("queue_age_last_update", sql(ISLAND.format(extra="", more="").replace("round((ts_ns - min(ts_ns) OVER (PARTITION BY symbol, island)) / 1e9, 6)", "round(CASE WHEN seq % 4 > 0 THEN (seq % 10) ELSE (ts_ns - min(ts_ns) OVER (PARTITION BY symbol, island)) / 1e9 END, 6)"), "bk"))
def queue_age_last_update(spark, d):
    bk = slow_book(spark, d).withColumn("last_update_bid_1", F.when(F.col("seq") % 4 > 0, F.col("ts_ns") - (F.col("seq") % 10) * NS))
    return features.age_from_last_update(bk, "bid").select("symbol", "seq", r6("qage_b_1").alias("qage_b_1"))


@query("feature_block")
def feature_block(spark, d):
    return features.feature_block(book(spark, d), ks=(1, 3), types=TYPES, windows_s=[6 * HOUR], taus_s=[HOUR])


@query("one_hot_types", sql("SELECT seq, CAST(event_type = 'click' AS INTEGER) AS is_click, CAST(event_type = 'view' AS INTEGER) AS is_view FROM ev", "ev"))
def one_hot_types(spark, d):
    return features.one_hot(events(spark, d), ["click", "view"]).select("seq", "is_click", "is_view")


@query("liquidity_surface", sql("SELECT seq, " + ", ".join(f"round((bid_size_{i} - ask_size_{i}) / (bid_size_{i} + ask_size_{i} + 1e-6), 6) AS level_{i}" for i in (1, 2, 3)) + " FROM bk", "bk"))
def liquidity_surface(spark, d):
    return features.liquidity_surface(book(spark, d), 3).select("seq", *[r6(F.get("surface", F.lit(i - 1))).alias(f"level_{i}") for i in (1, 2, 3)])


@query("rolling_quantiles", sql("SELECT symbol, seq, " + ", ".join(f"round(quantile_cont(price, {q}) OVER w, 6) AS price_q{n}" for q, n in ((0.2, 20), (0.6, 60), (1.0, 100))) + " FROM ev WINDOW w AS (PARTITION BY symbol ORDER BY ts_ns, seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)", "ev"))
def rolling_quantiles(spark, d):
    out = features.rolling_quantiles(events(spark, d), "price", 20)
    return out.select("symbol", "seq", *[r6(f"price_q{n}").alias(f"price_q{n}") for n in (20, 60, 100)])


SPLIT = "_n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_ns, seq) - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS t FROM ev),\n_s AS (SELECT *, CASE WHEN rn < floor(t * 0.6::DOUBLE) THEN 'train' WHEN rn < floor(t * (0.6::DOUBLE + 0.2::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM _n)\n"


@query("chrono_split", sql(SPLIT + "SELECT symbol, seq, split FROM _s", "ev"))
def chrono_split(spark, d):
    return splits.chronological_split(events(spark, d)).select("symbol", "seq", "split")


@query("walkforward_splits", sql(SPLIT + """, _w AS (SELECT *, floor(t * 0.6::DOUBLE) AS base, greatest(1, floor((t - floor(t * 0.6::DOUBLE)) / 3)) AS seg, unnest([0, 1, 2]) AS fold FROM _n), _v AS (SELECT *, base + fold * seg AS a FROM _w)
SELECT symbol, seq, fold, CASE WHEN rn < a THEN 'train' WHEN rn < a + floor(seg / 2) THEN 'val' ELSE 'test' END AS split FROM _v WHERE rn < least(a + seg, t)""", "ev"))
def walkforward_splits(spark, d):
    return splits.walk_forward_splits(events(spark, d), 3).select("symbol", "seq", "fold", "split")


@query("standard_scale_train", sql(SPLIT + ", _m AS (SELECT avg(price) AS m, stddev_pop(price) AS s FROM _s WHERE split = 'train')\nSELECT seq, split, round((price - m) / s, 6) AS price FROM _s, _m", "ev"))
def standard_scale_train(spark, d):
    df = splits.chronological_split(events(spark, d))
    scaler = splits.fit_scaler(df.where(F.col("split") == "train"), ["price"])
    return splits.scale(df, scaler, ["price"]).select("seq", "split", r6("price").alias("price"))


@query("pooled_scaler", sql(SPLIT + "SELECT count(*) AS n, round(avg(price), 6) AS mean_price, round(stddev_pop(price), 6) AS std_price, round(avg(size), 6) AS mean_size, round(stddev_pop(size), 6) AS std_size FROM _s WHERE split = 'train'", "ev"))
def pooled_scaler(spark, d):
    train = splits.chronological_split(events(spark, d)).where(F.col("split") == "train")
    s = splits.fit_scaler(train, ["price", "size"])
    return train.agg(F.count(F.lit(1)).alias("n")).join(s).select("n", *[r6(c).alias(c) for c in ("mean_price", "std_price", "mean_size", "std_size")])


@query("sequence_windows", sql("SELECT symbol, seq, CAST(sum(size) OVER w AS DOUBLE) AS total, first_value(seq) OVER w AS first_seq FROM ev WINDOW w AS (PARTITION BY symbol ORDER BY ts_ns, seq ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) QUALIFY count(*) OVER w = 8", "ev"))
def sequence_windows(spark, d):
    out = splits.sequence_windows(events(spark, d), ["seq", "size"], 8)
    return out.select("symbol", "seq", F.aggregate("window", F.lit(0.0), lambda a, x: a + x["size"]).alias("total"), F.get("window", F.lit(0))["seq"].alias("first_seq"))


@query("stride_sample", sql("SELECT symbol, seq, rn FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_ns, seq) - 1 AS rn FROM ev) WHERE rn % 5 = 0", "ev"))
def stride_sample(spark, d):
    return splits.stride_sample(events(spark, d), 5).select("symbol", "seq", "rn")


@query("lomo_holdout", "SELECT n_name, 'train' AS part FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT n_name, 'held' FROM nation WHERE n_regionkey = 2")
def lomo_holdout(spark, d):
    nation, region = read(spark, d, "nation"), read(spark, d, "region").where("r_regionkey = 2").withColumnRenamed("r_regionkey", "n_regionkey")
    rest, held = splits.leave_one_out(nation, region, "n_regionkey")
    return rest.select("n_name", F.lit("train").alias("part")).union(held.select("n_name", F.lit("held").alias("part")))


@query("balanced_batch")
def balanced_batch(spark, d):
    ev = events(spark, d).withColumn("label", (F.col("price") > 50).cast("int"))
    return splits.balanced_sample(ev, "label", 64).select("seq", "label", "copy")


@query("column_permutation")
def column_permutation(spark, d):
    return splits.permuted(events(spark, d), ["price"]).select("seq", "price")


@query("sorted_head", sql("SELECT symbol, seq, ts_ns FROM ev ORDER BY ts_ns, seq LIMIT 50", "ev"))
def sorted_head(spark, d):
    return events(spark, d).select("symbol", "seq", "ts_ns").orderBy("ts_ns", "seq").limit(50)


