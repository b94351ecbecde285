"""Queries: feeds decoded from events that are encoded first, topology, resampling, models, streams."""

from __future__ import annotations

from functools import partial

import pandas as pd
from pyspark.sql import functions as F

from tapeworks.operators import bootstrap, labels, metrics, models, splits, topology
from tapeworks.plans.core import HOUR, ISLAND, r6, slow_book
from tapeworks.plans.evaluation import rounded
from tapeworks.plans.tables import TYPES, book, events, intensities, predictions, read, sql
from tapeworks.registry import Catalog
from tapeworks.schema import NS, floor_div, instant
from tapeworks.session import scratch, ship
from tapeworks.sources import binary, lobster, synthetic, vendors
from tapeworks.streaming import events as live

catalog = Catalog()
query = catalog.query


# binary feeds: every symbol's events become one file's bytes, which are decoded again
def _encode(layout: str, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["ts_ns", "seq"], kind="stable")
    rows = []
    for kind, ts, seq, price, size in zip(pdf["event_type"], pdf["ts_ns"], pdf["seq"], pdf["price"], pdf["size"], strict=True):
        f = {"id": int(seq), "side": "BS"[int(seq) % 2], "shares": int(size), "price": int(round(price * 100)) * 100, "new": int(seq) + 1, "match": int(seq), "stock": "X", "token": f"T{seq}", "token_orig": f"T{seq}", "token_new": f"N{seq}", "reason": "R", "printable": "Y"}
        types = {"itch-minimal": "APXEU", "itch-5.0": "APXEU", "ouch-minimal": "OEXDU", "ouch-4.2": "ATXCU"}[layout]
        day = int(ts) % 86_400_000_000_000
        rows.append((types[sorted(TYPES).index(kind)], int(ts) if "minimal" in layout else day, f))
    return pd.DataFrame({"symbol": [str(pdf["symbol"].iat[0])], "content": [binary.encode(rows, layout)]})


def _round_trip(spark, d, layout: str, **options):
    ship(spark)
    files = events(spark, d).groupBy("symbol").applyInPandas(partial(_encode, layout), "symbol string, content binary")
    out = binary.decode(files, layout, **options)
    return out.select("symbol", "seq", "ts_ns", "event_type", r6("price").alias("price"), "size", "side")


def _wire(types: dict[str, str], price: str, size: str, side: str, ts: str | None) -> str:
    """SQL for decoded rows; types: kind -> canonical type, with ± by the side."""
    sign = "CASE WHEN seq % 2 = 1 THEN '-' ELSE '+' END"
    kinds = " ".join(f"WHEN '{k}' THEN " + (f"'{v[:-1]}' || {sign}" if v.endswith("±") else f"'{v}'") for k, v in types.items())
    return sql(f"SELECT CAST(symbol AS VARCHAR) AS symbol, row_number() OVER (PARTITION BY symbol ORDER BY ts_ns, seq) - 1 AS seq, {f'{ts} AS ts_ns, ' if ts else ''}CASE event_type {kinds} END AS event_type, {price} AS price, {size} AS size, {side} AS side FROM ev", "ev")


PX = "round(round(price * 100) / 100, 6)"
SIDE = "CASE WHEN seq % 2 = 1 THEN 'S' ELSE 'B' END"
DAY = "ts_ns % 86400000000000"


@query("itch_minimal_roundtrip", _wire({"click": "LO±", "error": "MO+", "purchase": "CX+", "signup": "MO+", "view": "LO+"}, f"CASE WHEN event_type IN ('purchase', 'signup') THEN NULL ELSE {PX} END", "size", f"CASE WHEN event_type IN ('click', 'error') THEN {SIDE} END", "ts_ns"))
def itch_minimal_roundtrip(spark, d):
    return _round_trip(spark, d, "itch-minimal")


@query("itch_nasdaq_roundtrip", _wire({"click": "LO±", "error": "MO+", "purchase": "CX+", "signup": "MO+", "view": "LO+"}, f"CASE WHEN event_type IN ('purchase', 'signup') THEN NULL ELSE {PX} END", "size", f"CASE WHEN event_type IN ('click', 'error') THEN {SIDE} END", f"epoch_us(TIMESTAMP '2024-01-02') * 1000 + {DAY}"))
def itch_nasdaq_roundtrip(spark, d):
    return _round_trip(spark, d, "itch-5.0", session_date="2024-01-02")


@query("ouch_minimal_roundtrip", _wire({"click": "LO±", "error": "MO+", "purchase": "CX+", "signup": "CX+", "view": "LO+"}, f"CASE WHEN event_type IN ('click', 'view') THEN {PX} END", "CASE WHEN event_type = 'signup' THEN 0 ELSE size END", f"CASE WHEN event_type = 'click' THEN {SIDE} END", "ts_ns"))
def ouch_minimal_roundtrip(spark, d):
    return _round_trip(spark, d, "ouch-minimal")


@query("ouch_nasdaq_roundtrip", _wire({"click": "LO±", "error": "MO+", "purchase": "CX+", "signup": "CX+", "view": "LO+"}, f"CASE WHEN event_type IN ('click', 'error', 'view') THEN {PX} END", "size", f"CASE WHEN event_type = 'click' THEN {SIDE} END", None))
def ouch_nasdaq_roundtrip(spark, d):
    return _round_trip(spark, d, "ouch-4.2").drop("ts_ns")  # these files hold no times


# vendor feeds
def _vendor(df):
    return df.select("symbol", "venue", "seq", "ts_ns", "event_type", r6("price").alias("price"), "size", "level", "side")


_MS = "(ts_ns // 1000000) * 1000000"


@query("binance_feed", sql(f"""SELECT 'S' || symbol AS symbol, 'BINANCE' AS venue, seq, {_MS} AS ts_ns, 'MO+' AS event_type, round(price, 6) AS price, size, NULL::INTEGER AS level, NULL::VARCHAR AS side FROM bk WHERE seq % 3 = 0
UNION ALL SELECT 'S' || symbol, 'BINANCE', seq, {_MS}, UNNEST(['LO+', 'LO-']), UNNEST([bid_price_1, ask_price_1]), UNNEST([bid_size_1, ask_size_1]), 1, UNNEST(['B', 'S']) FROM bk WHERE seq % 3 = 1
UNION ALL SELECT 'S' || symbol, 'BINANCE', seq, {_MS}, UNNEST(['LO+', 'LO+', 'LO-']), UNNEST([bid_price_1, bid_price_2, ask_price_1]), UNNEST([bid_size_1, bid_size_2, ask_size_1]), NULL, UNNEST(['B', 'B', 'S']) FROM bk WHERE seq % 3 = 2""", "bk"))
def binance_feed(spark, d):
    bk, s = book(spark, d), lambda c: F.col(c).cast("string")
    head = lambda e: [F.lit(e).alias("e"), floor_div(F.col("ts_ns"), 1_000_000).alias("E"), F.concat(F.lit("S"), s("symbol")).alias("s")]
    trade = F.to_json(F.struct(*head("aggTrade"), s("price").alias("p"), s("size").alias("q")))
    ticker = F.concat(F.lit('{"e":"bookTicker","E":'), floor_div(F.col("ts_ns"), 1_000_000).cast("string"), F.lit(',"s":"S'), s("symbol"), F.lit('","b":"'), s("bid_price_1"), F.lit('","B":"'), s("bid_size_1"), F.lit('","a":"'), s("ask_price_1"), F.lit('","A":"'), s("ask_size_1"), F.lit('"}'))
    depth = F.to_json(F.struct(*head("depthUpdate"), F.array(*[F.array(s(f"bid_price_{i}"), s(f"bid_size_{i}")) for i in (1, 2)]).alias("b"), F.array(F.array(s("ask_price_1"), s("ask_size_1"))).alias("a")))
    return _vendor(vendors.binance(bk.select("seq", F.when(F.col("seq") % 3 == 0, trade).when(F.col("seq") % 3 == 1, ticker).otherwise(depth).alias("value"))))


@query("coinbase_feed", sql("""SELECT 'P' || symbol AS symbol, 'COINBASE' AS venue, seq, ts_ns, 'MO+' AS event_type, round(price, 6) AS price, size, NULL::INTEGER AS level, NULL::VARCHAR AS side FROM bk WHERE seq % 2 = 0
UNION ALL SELECT 'P' || symbol, 'COINBASE', seq, ts_ns, UNNEST(['LO+', 'LO-']), UNNEST([bid_price_1, ask_price_1]), UNNEST([bid_size_1, ask_size_1]), NULL, UNNEST(['B', 'S']) FROM bk WHERE seq % 2 = 1""", "bk"))
def coinbase_feed(spark, d):
    bk, s = book(spark, d), lambda c: F.col(c).cast("string")
    time = F.date_format(instant(F.col("ts_ns")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    match = F.to_json(F.struct(F.lit("match").alias("type"), time.alias("time"), F.concat(F.lit("P"), s("symbol")).alias("product_id"), s("price").alias("price"), s("size").alias("size")))
    change = F.to_json(F.struct(F.lit("l2update").alias("type"), time.alias("time"), F.concat(F.lit("P"), s("symbol")).alias("product_id"), F.array(F.array(F.lit("buy"), s("bid_price_1"), s("bid_size_1")), F.array(F.lit("sell"), s("ask_price_1"), s("ask_size_1"))).alias("changes")))
    return _vendor(vendors.coinbase(bk.select("seq", F.when(F.col("seq") % 2 == 0, match).otherwise(change).alias("value"))))


@query("iex_feed", sql("""SELECT 'E' || symbol AS symbol, 'IEX' AS venue, seq, ts_ns, UNNEST(['LO+', 'LO-']) AS event_type, UNNEST([bid_price_1, ask_price_1]) AS price, UNNEST([bid_size_1, ask_size_1]) AS size, NULL::INTEGER AS level, UNNEST(['B', 'S']) AS side FROM bk WHERE seq % 2 = 0
UNION ALL SELECT 'E' || symbol, 'IEX', seq, ts_ns, 'MO+', round(price, 6), size, NULL, NULL FROM bk WHERE seq % 2 = 1""", "bk"))
def iex_feed(spark, d):
    bk = book(spark, d)
    head = [F.col("ts_ns").alias("timestamp"), F.concat(F.lit("E"), F.col("symbol").cast("string")).alias("symbol")]
    one = lambda n: F.array(F.array(f"{n}_price_1", f"{n}_size_1"))
    deep = F.to_json(F.struct(F.lit("book").alias("type"), *head, one("bid").alias("bids"), one("ask").alias("asks")))
    trade = F.to_json(F.struct(F.lit("trade").alias("type"), *head, "price", "size"))
    return _vendor(vendors.iex(bk.select("seq", F.when(F.col("seq") % 2 == 0, deep).otherwise(trade).alias("value"))))


@query("snapshot_feed", sql("SELECT 'F' AS symbol, 'FI2010' AS venue, seq, seq * 1000000 AS ts_ns, UNNEST(['LO+', 'LO-']) AS event_type, UNNEST([bid_price_1, ask_price_1]) AS price, UNNEST([bid_size_1, ask_size_1]) AS size, 1 AS level, UNNEST(['B', 'S']) AS side FROM bk", "bk"))
def snapshot_feed(spark, d):
    return _vendor(vendors.snapshots(book(spark, d).withColumnRenamed("seq", "row"), symbol="F"))


@query("aggregate_trades_csv", sql(f"SELECT 'BTC' AS symbol, {_MS} AS ts_ns, 'MO+' AS event_type, round(price, 6) AS price, size FROM ev", "ev"))
def aggregate_trades_csv(spark, d):
    ev = events(spark, d)
    rows = ev.select(F.col("seq").cast("string").alias("_c0"), F.col("price").cast("string").alias("_c1"), F.col("size").cast("string").alias("_c2"), F.lit("0").alias("_c3"), F.lit("0").alias("_c4"), F.expr("ts_ns div 1000000").cast("string").alias("_c5"))
    return vendors.aggregate_trades(rows, symbol="BTC").select("symbol", "ts_ns", "event_type", r6("price").alias("price"), "size")


@query("tagged_messages", sql("SELECT CAST(symbol AS VARCHAR) AS symbol, ts_ns, CASE event_type WHEN 'click' THEN 'LO' WHEN 'view' THEN 'LO' WHEN 'error' THEN 'MO' WHEN 'purchase' THEN 'CX' ELSE 'LO' END || CASE seq % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE '' END AS event_type, round(price, 6) AS price, size FROM ev", "ev"))
def tagged_messages(spark, d):
    ev = events(spark, d)
    kind = F.when(F.col("event_type") == "click", "A").when(F.col("event_type") == "view", "F").when(F.col("event_type") == "error", "E").when(F.col("event_type") == "purchase", "X").otherwise("U")
    side = F.when(F.col("seq") % 3 == 0, "buy").when(F.col("seq") % 3 == 1, "S").otherwise("?")
    msg = F.to_json(F.struct(kind.alias("msg_type"), F.col("ts_ns").cast("string").alias("timestamp"), side.alias("side"), "price", F.col("size").alias("shares"), F.col("symbol").cast("string").alias("stock")))
    return vendors.tagged(ev.select(msg.alias("value")), "itch").select("symbol", "ts_ns", "event_type", r6("price").alias("price"), "size")


@query("lobster_pair", sql("""_t AS (SELECT *, seq % 7 + 1 AS kind, CASE WHEN seq % 2 = 0 THEN 1 ELSE -1 END AS dir FROM bk)
SELECT CAST(symbol AS VARCHAR) AS symbol, seq, ts_ns % 86400000000000 // 1000000000 * 1000000000 AS ts_ns, CASE WHEN kind IN (3, 6) THEN 'CX' WHEN kind IN (4, 5, 7) THEN 'MO' ELSE 'LO' END || CASE WHEN dir = -1 THEN '-' ELSE '+' END AS event_type, floor(price) AS price, size, CASE dir WHEN 1 THEN 'B' ELSE 'S' END AS side,
CASE WHEN dir = 1 THEN 1 END AS level FROM _t""", "bk"))
def lobster_pair(spark, d):
    bk, s = book(spark, d), lambda c: F.col(c).cast("string")
    kind, direction = F.col("seq") % 7 + 1, F.when(F.col("seq") % 2 == 0, 1).otherwise(-1)
    second = F.expr("(ts_ns % 86400000000000) div 1000000000")
    line = F.concat_ws(",", second.cast("string"), kind.cast("string"), s("seq"), s("size"), F.floor("price").cast("string"), direction.cast("string"))
    cells = [s(f"{n}_{w}_{i}") for n, w in (("ask", "price"), ("ask", "size"), ("bid", "price"), ("bid", "size")) for i in (1, 2, 3)]
    out = lobster.read_pairs(bk.select(s("symbol").alias("stem"), F.col("seq").alias("row"), line.alias("line")), bk.select(s("symbol").alias("stem"), F.col("seq").alias("row"), F.concat_ws(",", *cells).alias("line")), 3, tick=1.0, side_aware=True)
    return out.select("symbol", "seq", "ts_ns", "event_type", "price", "size", "side", "level")


# topology
DIAG = "_d AS (SELECT symbol, ts_ns // 86400000000000 AS day, min(price) AS birth, max(price) - min(price) AS pers FROM ev GROUP BY ALL HAVING count(*) > 1)\n"


def _diagrams(spark, d):
    day = events(spark, d).groupBy("symbol", F.expr("ts_ns div 86400000000000").alias("day")).agg(F.min("price").alias("birth"), (F.max("price") - F.min("price")).alias("pers"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return day.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("birth", "pers"))).alias("diagram"))


@query("landscape_sql", sql(DIAG + """, _p AS (SELECT * FROM _d WHERE pers > 0), _r AS (SELECT symbol, min(birth) AS lo, max(birth + pers) AS hi FROM _p GROUP BY symbol), _x AS (SELECT symbol, i, lo + i * (hi - lo) / 15 AS x FROM _r, range(0, 16) t(i)), _h AS (SELECT symbol, i, greatest(least(x - birth, birth + pers - x), 0) AS h, row_number() OVER (PARTITION BY symbol, i ORDER BY greatest(least(x - birth, birth + pers - x), 0) DESC) AS k FROM _x JOIN _p USING (symbol))
SELECT symbol, """ + ", ".join(f"round(coalesce(sum(h) FILTER (k = {k}), 0) / 16, 6) AS level_{k}" for k in (1, 2, 3)) + " FROM _h GROUP BY symbol", "ev"))
def landscape_sql(spark, d):
    out = _diagrams(spark, d).withColumn("l", topology.landscape(F.col("diagram"), 3, 16))
    return out.where(F.exists("diagram", lambda p: p["pers"] > 0)).select("symbol", *[r6(F.get("l", F.lit(k - 1))).alias(f"level_{k}") for k in (1, 2, 3)])


@query("image_sql", sql(DIAG + ", _g AS (SELECT i FROM range(0, 16) t(i)) SELECT symbol, CAST(i AS INTEGER) AS cell, round(sum(exp(-(power((i % 4) * (100 / 3.0::DOUBLE) - birth, 2) + power((i // 4) * (400 / 3.0::DOUBLE) - pers, 2)) / (2 * 40 * 40)) * pers), 5) AS value FROM _d, _g GROUP BY symbol, i", "ev"))
def image_sql(spark, d):
    img = topology.image(F.col("diagram"), 4, 40.0, (0.0, 100.0), (0.0, 400.0))
    return _diagrams(spark, d).select("symbol", F.posexplode(img).alias("cell", "value")).withColumn("value", F.round("value", 5))


@query("image_ranges", sql(DIAG + "SELECT round(quantile_cont(birth, 0.01), 6) AS birth_lo, round(quantile_cont(birth, 0.99), 6) AS birth_hi, round(quantile_cont(pers, 0.01), 6) AS pers_lo, round(quantile_cont(pers, 0.99), 6) AS pers_hi FROM _d", "ev"))
def image_ranges(spark, d):
    return rounded(topology.fitted_ranges(_diagrams(spark, d)))


@query("pairwise_l2", "SELECT a.vec_id AS a, b.vec_id AS b, round(sqrt(list_sum([power(x[1]::DOUBLE - x[2]::DOUBLE, 2) FOR x IN list_zip(a.embedding, b.embedding)])), 5) AS l2 FROM embeddings a JOIN embeddings b ON a.vec_id // 50 = b.vec_id // 50 AND a.vec_id < b.vec_id")
def pairwise_l2(spark, d):
    """All vectors, in windows of fifty."""
    vectors = read(spark, d, "embeddings")
    return topology.pairwise_l2(vectors, "vec_id", "embedding", F.floor(F.col("vec_id") / 50)).withColumn("l2", F.round("l2", 5))


@query("rolling_ph_landscape")
def rolling_ph_landscape(spark, d):
    from tapeworks.operators.features import liquidity_surface

    cfg = topology.Topology(windows_s=(6.0 * HOUR, 24.0 * HOUR), levels=3, grid=32)
    return topology.rolling(liquidity_surface(book(spark, d), 3), cfg, chunk_s=10 * 24 * HOUR)


@query("rolling_ph_rips")
def rolling_ph_rips(spark, d):
    from tapeworks.operators.features import liquidity_surface

    cfg = topology.Topology(windows_s=(24.0 * HOUR,), complex="rips", vector="image", size=4, sigma=0.3)
    return topology.rolling(liquidity_surface(book(spark, d), 3), cfg, chunk_s=10 * 24 * HOUR)


@query("vr_epsilon_lcc")
def vr_epsilon_lcc(spark, d):
    bk = book(spark, d).groupBy("symbol", F.expr("ts_ns div 864000000000000").alias("decade")).agg(F.collect_list(F.array("bid_size_1", "ask_size_1")).alias("points"))
    return topology.epsilons(bk).select("symbol", "decade", r6("eps_quantile").alias("eps_quantile"), r6("eps_share").alias("eps_share"))


# resampling and models
@query("bootstrap_auroc_ci")
def bootstrap_auroc_ci(spark, d):
    return bootstrap.auroc_interval(predictions(spark, d), 40)


@query("bootstrap_mean_ci")
def bootstrap_mean_ci(spark, d):
    return bootstrap.mean_interval(predictions(spark, d), "ret", 100)


@query("block_bootstrap_metrics")
def block_bootstrap_metrics(spark, d):
    return bootstrap.block_metric_intervals(predictions(spark, d), 20.0, 40)


@query("block_bootstrap_var_es")
def block_bootstrap_var_es(spark, d):
    return bootstrap.block_var_es_intervals(predictions(spark, d), 50.0, 40)


def _labelled(spark, d):
    ev = labels.event_label(labels.clock_label(events(spark, d), 6 * HOUR, eta=10, mid="price"), 5, eta=10, mid="price")
    ev = ev.withColumns({"x1": F.col("price") / 100, "x2": F.col("size") / 100, "idx": F.col("seq")})
    return splits.chronological_split(ev)


@query("logistic_baseline")
def logistic_baseline(spark, d):
    df = _labelled(spark, d)
    model = models.fit_logistic(df.where("split = 'train'"), ["x1", "x2"], f"instability_s_{6 * HOUR}")
    test = models.predict(model, df.where("split = 'test'"), ["x1", "x2"])
    return rounded(metrics.classification_report(test.select("idx", "pred", F.col(f"instability_s_{6 * HOUR}").alias("label"))))


@query("multi_horizon_report")
def multi_horizon_report(spark, d):
    df = _labelled(spark, d)
    return rounded(models.multi_horizon(df.where("split = 'train'"), df.where("split = 'test'"), ["x1", "x2"], [f"instability_s_{6 * HOUR}", "instability_e_5"]))


@query("permutation_importance")
def permutation_importance(spark, d):
    df = _labelled(spark, d).withColumn("label", F.col("instability_e_5"))
    model = models.fit_logistic(df.where("split = 'train'"), ["x1", "x2"])
    return rounded(models.permutation_importance(model, df.where("split = 'test'"), ["x1", "x2"]))


@query("temperature_scale")
def temperature_scale(spark, d):
    pr = predictions(spark, d)
    t = models.temperature(pr)
    return rounded(models.with_temperature(pr, t).agg(F.avg("pred").alias("mean_pred"), F.lit(t).alias("temperature")))


@query("smoothness", sql("_l AS (SELECT rn, k, l - lag(l) OVER (PARTITION BY k ORDER BY rn) AS d FROM (SELECT rn, unnest(range(0, 5)) AS k, unnest(lam) AS l FROM tp)) SELECT round(sum(d * d), 4) AS smoothness FROM _l", "tp"))
def smoothness(spark, d):
    return rounded(models.smoothness(intensities(spark, d)), 4)


@query("mark_nll", sql("SELECT event_type, round(avg(ln(greatest(size, 1e-6)) + 0.5 + 0.9189385332046727 + power(ln(greatest(size, 1e-6)) - 3, 2) / (2 * exp(1))), 6) AS mark_nll FROM ev GROUP BY event_type", "ev"))
def mark_nll(spark, d):
    ev = events(spark, d).withColumns({"mu": F.lit(3.0), "log_sigma": F.lit(0.5)})
    return rounded(models.mark_nll(ev, by=["event_type"]))


@query("joint_loss", sql("""_j AS (SELECT tp.rn, lam, m, dt, tot, label, least(greatest(pred, 1e-7), 1 - 1e-7) AS p FROM tp JOIN pr ON pr.idx = tp.rn), _l AS (SELECT l - lag(l) OVER (PARTITION BY k ORDER BY rn) AS d FROM (SELECT rn, unnest(range(0, 5)) AS k, unnest(lam) AS l FROM _j)), _s AS (SELECT sum(d * d) AS sm FROM _l),
_a AS (SELECT (-sum(ln(greatest(lam[m + 1], 1e-12))) + sum(tot * dt)) / count(*) AS nll, avg(-ln(CASE WHEN label = 1 THEN p ELSE 1 - p END)) AS cls FROM _j)
SELECT round(nll, 4) AS nll, round(cls, 4) AS cls, round(sm, 4) AS smoothness, round(nll + cls + 1e-3 * sm, 4) AS loss FROM _a, _s""", "tp", "pr"))
def joint_loss(spark, d):
    pr = predictions(spark, d).select(F.col("idx").alias("rn"), "pred", "label")
    return rounded(models.joint_loss(intensities(spark, d).join(pr, "rn"), weight_smooth=1e-3), 4)


@query("joint_loss_marks", sql("""_j AS (SELECT tp.rn, lam, m, dt, tot, label, least(greatest(pred, 1e-7), 1 - 1e-7) AS p, ln(greatest(size, 1e-6)) AS x FROM tp JOIN pr ON pr.idx = tp.rn JOIN ev ON ev.seq = tp.rn), _l AS (SELECT l - lag(l) OVER (PARTITION BY k ORDER BY rn) AS d FROM (SELECT rn, unnest(range(0, 5)) AS k, unnest(lam) AS l FROM _j)), _s AS (SELECT sum(d * d) AS sm FROM _l),
_a AS (SELECT (-sum(ln(greatest(lam[m + 1], 1e-12))) + sum(tot * dt)) / count(*) AS nll, avg(CASE WHEN label = 1 THEN -3 * ln(p) ELSE -ln(1 - p) END) AS cls, avg(x + 0.5 + 0.9189385332046727 + power(x - 3, 2) / (2 * exp(1))) AS mk FROM _j)
SELECT round(nll, 4) AS nll, round(cls, 4) AS cls, round(sm, 4) AS smoothness, round(mk, 4) AS mark_nll, round(nll + cls + 1e-3 * sm + mk + 0.01 * 1.25, 4) AS loss FROM _a, _s""", "tp", "pr"))
def joint_loss_marks(spark, d):
    pr = predictions(spark, d).select(F.col("idx").alias("rn"), "pred", "label")
    size = events(spark, d).select(F.col("seq").alias("rn"), "size", F.lit(3.0).alias("mu"), F.lit(0.5).alias("log_sigma"))
    df = intensities(spark, d).join(pr, "rn").join(size, "rn")
    return rounded(models.joint_loss(df, weight_smooth=1e-3, pos_weight=3.0, marks=True, weight_l2=0.01, parameters=[1.0, 0.5]), 4)


@query("smoothness_norms", sql("""_r AS (SELECT tp.rn, lam, symbol FROM tp JOIN pr ON pr.idx = tp.rn), _l AS (SELECT symbol, l - lag(l) OVER (PARTITION BY symbol, k ORDER BY rn) AS d FROM (SELECT symbol, rn, unnest(range(0, 5)) AS k, unnest(lam) AS l FROM _r)), _s AS (SELECT symbol, coalesce(sum(d * d), 0) AS s, count(d) AS c FROM _l GROUP BY symbol)
SELECT round(sum(s), 4) AS total, round(avg(s), 4) AS by_sequence, round(avg(s / greatest(c, 1)), 4) AS by_change FROM _s""", "tp", "pr"))
def smoothness_norms(spark, d):
    df = intensities(spark, d).join(predictions(spark, d).select(F.col("idx").alias("rn"), "symbol"), "rn")
    norm = lambda name, to: models.smoothness(df, by=["symbol"], norm=name).withColumnRenamed("smoothness", to)
    return rounded(norm("none", "total").join(norm("global", "by_sequence")).join(norm("per_seq", "by_change")), 4)


@query("fuse_features", sql("SELECT seq, round(2 * bid_size_1 + 0.5 * (ask_size_1 + ask_size_2) / 2, 6) AS f1, round(2 * bid_size_2 + 0.5 * (ask_size_1 + ask_size_2) / 2, 6) AS f2, round(2 * bid_size_3 + 0.5 * (ask_size_1 + ask_size_2) / 2, 6) AS f3 FROM bk", "bk"))
def fuse_features(spark, d):
    f = models.fuse(F.array("bid_size_1", "bid_size_2", "bid_size_3"), F.array("ask_size_1", "ask_size_2"), 2.0, 0.5)
    return book(spark, d).select("seq", *[r6(F.get(f, F.lit(i))).alias(f"f{i + 1}") for i in range(3)])


@query("ctmc_sequences")
def ctmc_sequences(spark, d):
    n = read(spark, d, "nation").count()
    return synthetic.sequences(spark, n).groupBy("sequence", "event_type").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("dt")).alias("mean_dt"))


@query("ar1_returns")
def ar1_returns(spark, d):
    return synthetic.with_returns(predictions(spark, d).drop("ret"), group="symbol")


@query("training_batch")
def training_batch(spark, d):
    return synthetic.training_batch(spark, 16, 20, 4, 2)


@query("cross_market_lomo")
def cross_market_lomo(spark, d):
    df = _labelled(spark, d).withColumn("market", F.col("event_type"))
    return rounded(models.cross_market(df, ["x1", "x2"], "instability_e_5"))


@query("topology_search")
def topology_search(spark, d):
    from tapeworks.operators.features import liquidity_surface

    df = liquidity_surface(labels.event_label(book(spark, d), 5, eta=10), 3)
    grid = [c for c in topology.search_grid([(12.0 * HOUR,)], levels=(2,), grids=(16,), sizes=(3,), sigmas=(0.5,))]
    return rounded(models.topology_search(splits.chronological_split(df), grid, "instability_e_5", chunk_s=20 * 24 * HOUR))


@query("rips_udtf")
def rips_udtf(spark, d):
    """Features of every instrument's clouds, summed over the time chunks that bound a cloud."""
    from tapeworks.functions.sql import register

    register(spark)
    pts = topology.clouds(events(spark, d), F.array("price", "size"))
    # Few bytes mean much work here, so clouds are dealt by number, not by size.
    pts = pts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "symbol", "chunk")
    pts.createOrReplaceTempView("tapeworks_points")
    return spark.sql("SELECT symbol, dim, count(*) AS n, round(sum(pers), 4) AS total FROM tapeworks_points, LATERAL rips_diagram(points) GROUP BY symbol, dim")


# streams: the events as files, read to their end
def _stream(spark, d, *, end_s: float | None = None, rows=None):
    path = scratch(spark, "stream-in")
    rows = events(spark, d) if rows is None else rows
    (live.with_end(rows, end_s) if end_s else rows).write.parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def _drain(spark, stream, mode: str = "append"):
    out, held = scratch(spark, "stream-out"), scratch(spark, "stream-state")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", held).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("stream_monotonic", sql("SELECT symbol, seq FROM (SELECT *, max(t) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM (SELECT symbol, seq, ts_ns + (seq * 7919) % 1009 * 3600000000000 AS t FROM ev)) WHERE newest IS NULL OR t >= newest", "ev"))
def stream_monotonic(spark, d):
    late = _stream(spark, d).withColumn("ts_ns", F.col("ts_ns") + (F.col("seq") * 7919) % 1009 * (HOUR * NS))
    return _drain(spark, live.monotonic(late)).select("symbol", "seq")


@query("stream_live_features", sql(f"""SELECT a.symbol, a.seq, round(coalesce((max(a.ts_ns) - max(b.ts_ns) FILTER (b.seq <> a.seq)) / 1e9, 0), 6) AS dt, count(*) AS n, round(sum(CASE WHEN b.ts_ns > a.ts_ns - {60 * HOUR * NS} THEN exp((b.ts_ns - a.ts_ns) / {HOUR * NS}.0) ELSE 0 END), 6) AS ewm_all
FROM ev a JOIN (SELECT * FROM ev) b ON a.symbol = b.symbol AND (b.ts_ns < a.ts_ns OR (b.ts_ns = a.ts_ns AND b.seq <= a.seq)) GROUP BY a.symbol, a.seq""", "ev"))
def stream_live_features(spark, d):
    out = _drain(spark, live.live_features(_stream(spark, d), ("click",), HOUR))
    return out.select("symbol", "seq", r6("dt").alias("dt"), "n", r6("ewm_all").alias("ewm_all"))


LIVE_BOOK = ISLAND.format(extra="", more="").replace("SELECT symbol, seq, round", "SELECT symbol, seq, (bid_price_1 + ask_price_1) / 2 AS mid, round(coalesce(ln(greatest((bid_price_1 + ask_price_1) / 2, 1e-6)) - lag(ln(greatest((bid_price_1 + ask_price_1) / 2, 1e-6))) OVER (PARTITION BY symbol ORDER BY ts_ns, seq), 0), 6) + 0 AS ret_1, round")


@query("stream_live_book", sql(LIVE_BOOK, "bk"))
def stream_live_book(spark, d):
    out = _drain(spark, live.live_book(_stream(spark, d, rows=slow_book(spark, d)), 1))
    return out.select("symbol", "seq", "mid", (r6("ret_1") + 0.0).alias("ret_1"), r6("qage_b_1").alias("qage_b_1"))


DAY_NS = 24 * HOUR * NS


@query("stream_windowed_counts", sql(f"SELECT symbol, event_type, ts_ns // {DAY_NS} * {DAY_NS} AS start_ns, (ts_ns // {DAY_NS} + 1) * {DAY_NS} AS end_ns, count(*) AS n FROM ev GROUP BY ALL", "ev"))
def stream_windowed_counts(spark, d):
    return _bounds(_drain(spark, live.windowed_counts(_stream(spark, d, end_s=48 * HOUR), "1 day")))


@query("stream_sessions", sql(f"""_f AS (SELECT symbol, ts_ns, seq, CASE WHEN ts_ns - lag(ts_ns) OVER (PARTITION BY symbol ORDER BY ts_ns, seq) <= {6 * HOUR * NS} THEN 0 ELSE 1 END AS fresh FROM ev), _s AS (SELECT *, sum(fresh) OVER (PARTITION BY symbol ORDER BY ts_ns, seq) AS s FROM _f)
SELECT symbol, min(ts_ns) AS start_ns, max(ts_ns) + {6 * HOUR * NS} AS end_ns, count(*) AS n FROM _s GROUP BY symbol, s""", "ev"))
def stream_sessions(spark, d):
    return _bounds(_drain(spark, live.session_counts(_stream(spark, d, end_s=48 * HOUR), "6 hours")))


def _bounds(df):
    """Times as epoch nanoseconds; the row that only ends the stream has no symbol."""
    ns = [(F.unix_micros(c) * 1000).alias(f"{c}_ns") for c in ("start", "end")]
    return df.where(F.col("symbol").isNotNull()).select(*[c for c in df.columns if c not in ("start", "end")], *ns)
