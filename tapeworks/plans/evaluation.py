"""Queries: panels, prediction metrics, tail risk, point processes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeworks.operators import metrics, panel, risk, tpp
from tapeworks.plans.tables import intensities, predictions, read, sql
from tapeworks.plans.tables import panel as instruments
from tapeworks.registry import Catalog

catalog = Catalog()
query = catalog.query
r6 = lambda c: F.round(c, 6)


def rounded(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


# panels
@query("instrument_panel", sql("SELECT market, symbol, round(median_daily_notional, 4) AS median_daily_notional, round(tick_size, 6) AS tick_size FROM pn", "pn"))
def instrument_panel(spark, d):
    return instruments(spark, d).select("market", "symbol", F.round("median_daily_notional", 4).alias("median_daily_notional"), r6("tick_size").alias("tick_size"))


@query("liq_decile_qcut", sql("_c AS (SELECT list_distinct(quantile_cont(median_daily_notional, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS cuts FROM pn) SELECT symbol, CAST(greatest(len(list_filter(cuts, lambda c: c < median_daily_notional)), 1) AS INTEGER) AS liq_decile FROM pn, _c", "pn"))
def liq_decile_qcut(spark, d):
    return panel.deciles_by_value(instruments(spark, d)).select("symbol", "liq_decile")


RANKED = "_r AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY market ORDER BY median_daily_notional, symbol) - 1) * 10 / count(*) OVER (PARTITION BY market)) AS INTEGER) AS in_market, CAST(floor((row_number() OVER (ORDER BY median_daily_notional, symbol) - 1) * 10 / count(*) OVER ()) AS INTEGER) AS liq_decile FROM pn)\n"


@query("liq_decile_rank", sql(RANKED + "SELECT symbol, liq_decile, in_market FROM _r", "pn"))
def liq_decile_rank(spark, d):
    pn = instruments(spark, d)
    a = panel.deciles_by_rank(pn).select("symbol", "liq_decile")
    b = panel.deciles_by_rank(pn, by=["market"]).select("symbol", F.col("liq_decile").alias("in_market"))
    return a.join(b, "symbol")


@query("match_groups", sql(RANKED + "SELECT symbol, CAST(dense_rank() OVER (ORDER BY liq_decile, round(tick_size, 6)) - 1 AS INTEGER) AS match_group FROM _r", "pn"))
def match_groups(spark, d):
    pn = panel.deciles_by_rank(instruments(spark, d)).withColumn("tick_size", r6("tick_size"))
    return panel.match_groups(pn).select("symbol", "match_group")


@query("match_groups_first_seen", sql(RANKED + ", _k AS (SELECT liq_decile, round(tick_size, 6) AS t, min(symbol) AS s FROM _r GROUP BY ALL), _n AS (SELECT *, row_number() OVER (ORDER BY s) - 1 AS g FROM _k) SELECT symbol, CAST(g AS INTEGER) AS match_group FROM _r JOIN _n ON _r.liq_decile = _n.liq_decile AND round(tick_size, 6) = t", "pn"))
def match_groups_first_seen(spark, d):
    pn = panel.deciles_by_rank(instruments(spark, d))
    return panel.match_groups_first_seen(pn, ["liq_decile", "tick_size"], "symbol").select("symbol", "match_group")


@query("panel_session_hours", sql("_h AS (SELECT n_nationkey AS market, CASE n_regionkey WHEN 1 THEN '09:30' WHEN 3 THEN '08:00' END AS session_start FROM nation WHERE n_regionkey < 4) SELECT symbol, session_start FROM pn LEFT JOIN _h USING (market)", "pn"))
def panel_session_hours(spark, d):
    n = read(spark, d, "nation").where("n_regionkey < 4")
    hours = n.select(F.col("n_nationkey").alias("market"), F.when(F.col("n_regionkey") == 1, "09:30").when(F.col("n_regionkey") == 3, "08:00").alias("session_start"))
    return panel.with_session_hours(instruments(spark, d), hours).select("symbol", "session_start")


@query("tick_quantise", sql("SELECT symbol, round(round(tick_size / 0.02) * 0.02, 6) AS tick_size FROM pn", "pn"))
def tick_quantise(spark, d):
    return panel.quantised_tick(instruments(spark, d), 0.02).select("symbol", r6("tick_size").alias("tick_size"))


# predictions
@query("brier", sql("SELECT round(avg(power(pred - label, 2)), 6) AS brier FROM pr", "pr"))
def brier(spark, d):
    return rounded(metrics.brier(predictions(spark, d)))


BINS = "_b AS (SELECT ntile(15) OVER (ORDER BY pred, idx) AS bin, pred, label FROM pr), _r AS (SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, avg(pred) AS confidence, avg(CAST(label AS DOUBLE)) AS accuracy FROM _b GROUP BY bin)\n"


@query("reliability_bins", sql(BINS + "SELECT bin, n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy FROM _r", "pr"))
def reliability_bins(spark, d):
    return rounded(metrics.reliability_bins(predictions(spark, d)))


@query("brier_ece", sql(BINS + "SELECT (SELECT round(avg(power(pred - label, 2)), 6) FROM pr) AS brier, round(sum(abs(accuracy - confidence) * n) / sum(n), 6) AS ece FROM _r", "pr"))
def brier_ece(spark, d):
    pr = predictions(spark, d)
    return rounded(metrics.brier(pr).join(metrics.ece(metrics.reliability_bins(pr))))


RANKS = "_k AS (SELECT *, rank() OVER (ORDER BY pred) + (count(*) OVER (PARTITION BY pred) - 1) / 2.0 AS mid FROM pr), _a AS (SELECT sum(label) AS p, count(*) - sum(label) AS q FROM pr)\n"


@query("auroc", sql(RANKS + "SELECT round((sum(mid) FILTER (label = 1) - any_value(p) * (any_value(p) + 1) / 2.0) / (any_value(p) * any_value(q)), 6) AS auroc FROM _k, _a", "pr"))
def auroc(spark, d):
    return rounded(metrics.auroc(predictions(spark, d)))


@query("auroc_by_type", sql("_k AS (SELECT *, rank() OVER (PARTITION BY etype ORDER BY pred) + (count(*) OVER (PARTITION BY etype, pred) - 1) / 2.0 AS mid FROM pr) SELECT etype, round((sum(mid) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))), 6) AS auroc FROM _k GROUP BY etype", "pr"))
def auroc_by_type(spark, d):
    return rounded(metrics.auroc(predictions(spark, d), "etype"))


@query("auprc_step", sql("_c AS (SELECT pred, sum(label) AS p, count(*) AS n FROM pr GROUP BY pred), _d AS (SELECT p, sum(p) OVER w AS tp, sum(n) OVER w AS k FROM _c WINDOW w AS (ORDER BY pred DESC ROWS UNBOUNDED PRECEDING)) SELECT round(sum(p * (tp / CAST(k AS DOUBLE))) / sum(p), 6) AS auprc FROM _d", "pr"))
def auprc_step(spark, d):
    return rounded(metrics.average_precision(predictions(spark, d)))


@query("auprc_trap", sql("_c AS (SELECT row_number() OVER w AS k, sum(label) OVER (w ROWS UNBOUNDED PRECEDING) AS tp FROM pr WINDOW w AS (ORDER BY pred DESC, idx)), _e AS (SELECT k, tp / CAST(k AS DOUBLE) AS prec, tp / (SELECT sum(label) FROM pr) AS rec FROM _c), _f AS (SELECT *, lag(prec) OVER (ORDER BY k) AS p0, lag(rec) OVER (ORDER BY k) AS r0 FROM _e) SELECT round(sum((rec - r0) * (prec + p0) / 2), 6) AS auprc FROM _f", "pr"))
def auprc_trap(spark, d):
    return rounded(metrics.auprc_trapezoid(predictions(spark, d)))


def _placed(pred: str) -> str:
    return f"SELECT idx, label, CASE WHEN label = 1 THEN (mall - mcls) / q ELSE 1 - (mall - mcls) / p END AS v FROM (SELECT idx, label, rank() OVER (ORDER BY {pred}) + (count(*) OVER (PARTITION BY {pred}) - 1) / CAST(2 AS DOUBLE) AS mall, rank() OVER (PARTITION BY label ORDER BY {pred}) + (count(*) OVER (PARTITION BY label, {pred}) - 1) / CAST(2 AS DOUBLE) AS mcls, (SELECT sum(label) FROM pr) AS p, (SELECT count(*) - sum(label) FROM pr) AS q FROM pr)"


DELONG = f"_v AS ({_placed('pred')}), _s AS (SELECT avg(v) FILTER (label = 1) AS auroc, var_samp(v) FILTER (label = 1) / count(*) FILTER (label = 1) + var_samp(v) FILTER (label = 0) / count(*) FILTER (label = 0) AS var FROM _v)\n"


@query("delong_ci", sql(DELONG + "SELECT round(auroc, 6) AS auroc, round(greatest(0, auroc - 1.959963984540054 * sqrt(var)), 6) AS lo, round(least(1, auroc + 1.959963984540054 * sqrt(var)), 6) AS hi FROM _s", "pr"))
def delong_ci(spark, d):
    return rounded(metrics.delong_ci(predictions(spark, d)))


@query("delong_paired", sql(f"""_j AS (SELECT a.label, a.v AS a, b.v AS b FROM ({_placed('pred')}) a JOIN ({_placed('pred2')}) b USING (idx)),
_g AS (SELECT label, avg(a) AS ma, avg(b) AS mb, (var_samp(a) + var_samp(b) - 2 * covar_samp(a, b)) / count(*) AS v FROM _j GROUP BY label)
SELECT round(max(ma - mb) FILTER (label = 1), 6) AS delta, round(max(ma - mb) FILTER (label = 1) / sqrt(sum(v)), 5) AS z FROM _g""", "pr"))
def delong_paired(spark, d):
    return metrics.delong_paired(predictions(spark, d)).select(r6("delta").alias("delta"), F.round("z", 5).alias("z"))


@query("paired_predictions_join", sql("SELECT a.idx, a.label, round(a.pred, 6) AS pred, round(b.pred2, 6) AS pred2 FROM pr a JOIN (SELECT * FROM pr WHERE idx % 3 <> 0) b ON a.idx = b.idx AND a.label = b.label", "pr"))
def paired_predictions_join(spark, d):
    pr = predictions(spark, d)
    return rounded(metrics.paired(pr, pr.where("idx % 3 <> 0").select("idx", "label", F.col("pred2").alias("pred"))))


@query("metrics_by_group_rollup", sql("SELECT etype, count(*) AS n, round(avg(CAST(label AS DOUBLE)), 6) AS base_rate, round(avg(power(pred - label, 2)), 6) AS brier, CAST(grouping(etype) AS INTEGER) AS pooled FROM pr GROUP BY GROUPING SETS ((etype), ())", "pr"))
def metrics_by_group_rollup(spark, d):
    return rounded(metrics.metrics_by_group(predictions(spark, d), "etype"))


@query("macro_micro", sql("_g AS (SELECT symbol, avg(power(pred - label, 2)) AS b, count(*) AS n FROM pr GROUP BY symbol) SELECT round(avg(b), 6) AS macro, round(sum(n * b) / (sum(n) + 1e-12), 6) AS micro FROM _g", "pr"))
def macro_micro(spark, d):
    g = predictions(spark, d).groupBy("symbol").agg(F.avg(F.pow(F.col("pred") - F.col("label"), 2)).alias("b"), F.count(F.lit(1)).alias("n"))
    return rounded(metrics.micro_macro(g, "b", "n"))


@query("bh_fdr", sql("""_p AS (SELECT symbol AS key, ((symbol * 7919) % 1000 + 1) / 20000.0 AS p FROM (SELECT DISTINCT symbol FROM pr)), _r AS (SELECT *, row_number() OVER (ORDER BY p, key) AS rank, count(*) OVER () AS m FROM _p)
SELECT key, CAST(rank AS INTEGER) AS rank, round(least(1, min(m / rank * p) OVER (ORDER BY rank DESC ROWS UNBOUNDED PRECEDING)), 6) AS qvalue, coalesce(rank <= (SELECT max(rank) FROM _r WHERE p <= rank * 0.05 / m), false) AS rejected FROM _r""", "pr"))
def bh_fdr(spark, d):
    p = predictions(spark, d).select(F.col("symbol").alias("key")).distinct().withColumn("p", ((F.col("key") * 7919) % 1000 + 1) / 20000.0)
    return rounded(metrics.benjamini_hochberg(p)).select("key", "rank", "qvalue", "rejected")


ACOV = "_s AS (SELECT idx, pred - label - (SELECT avg(pred - label) FROM pr) AS s FROM pr), _l AS (SELECT unnest(range(0, 51)) AS lag), _o AS (SELECT row_number() OVER (ORDER BY idx) AS i, s FROM _s), _g AS (SELECT lag, sum(a.s * b.s) / ((SELECT count(*) FROM _o) - lag) AS acov FROM _l JOIN _o a ON true JOIN _o b ON b.i = a.i + lag GROUP BY lag)\n"


@query("autocovariances", sql(ACOV + "SELECT CAST(lag AS INTEGER) AS lag, round(acov, 6) AS acov FROM _g", "pr"))
def autocovariances(spark, d):
    return rounded(metrics.autocovariances(predictions(spark, d))).select("lag", "acov")


@query("autocov_block_length", sql(ACOV + ", _z AS (SELECT acov AS g0 FROM _g WHERE lag = 0), _u AS (SELECT * FROM _g WHERE lag > 0 AND lag <= coalesce((SELECT max(lag) FROM _g, _z WHERE lag > 0 AND abs(acov) > 0.01 * abs(g0)), 50)) SELECT round(greatest(1, power(greatest(1e-24, 4 * sum(lag * acov) / power(max(g0) + 2 * sum(acov), 2)), 1 / 3.0) * power((SELECT count(*) FROM _o), 1 / 3.0)), 5) AS block_length FROM _u, _z", "pr"))
def autocov_block_length(spark, d):
    return rounded(metrics.block_length(predictions(spark, d)), 5)


@query("threshold_sensitivity", sql("""_t AS (SELECT unnest([round(0.05 * i, 2) FOR i IN range(1, 20)])::DOUBLE AS threshold), _c AS (SELECT threshold, count(*) FILTER (pred >= threshold AND label = 1) AS tp, count(*) FILTER (pred >= threshold AND label = 0) AS fp, count(*) FILTER (label = 1) AS p FROM pr, _t GROUP BY threshold), _x AS (SELECT threshold, coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0) AS precision, coalesce(tp / CAST(nullif(p, 0) AS DOUBLE), 0) AS recall FROM _c)
SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1 FROM _x""", "pr"))
def threshold_sensitivity(spark, d):
    return rounded(metrics.threshold_sensitivity(predictions(spark, d)))


#: Report of the rows of _a (regime, idx, pred, label), for each regime.
REPORT = """, _k AS (SELECT *, rank() OVER (PARTITION BY regime ORDER BY pred) + (count(*) OVER (PARTITION BY regime, pred) - 1) / 2.0 AS mid, row_number() OVER (PARTITION BY regime ORDER BY pred, idx) - 1 AS place, count(*) OVER (PARTITION BY regime) AS n FROM _a), _g AS (SELECT regime, count(*) AS n, (sum(mid) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))) AS auroc, avg(power(pred - label, 2)) AS brier FROM _k GROUP BY regime),
_b AS (SELECT regime, CASE WHEN place < n % 15 * (n // 15 + 1) THEN place // (n // 15 + 1) ELSE n % 15 + (place - n % 15 * (n // 15 + 1)) // (n // 15) END AS bin, pred, label FROM _k), _c AS (SELECT regime, count(*) AS c, abs(avg(label) - avg(pred)) AS gap FROM _b GROUP BY regime, bin), _e AS (SELECT regime, sum(gap * c) / sum(c) AS ece FROM _c GROUP BY regime),
_t AS (SELECT regime, pred, sum(label) AS pos, count(*) AS c FROM _a GROUP BY ALL), _u AS (SELECT regime, pos, sum(pos) OVER w AS tp, sum(c) OVER w AS k FROM _t WINDOW w AS (PARTITION BY regime ORDER BY pred DESC ROWS UNBOUNDED PRECEDING)), _p AS (SELECT regime, sum(pos * tp / CAST(k AS DOUBLE)) / sum(pos) AS auprc FROM _u GROUP BY regime)
"""


@query("classification_report", sql("_a AS (SELECT 1 AS regime, idx, pred, label FROM pr WHERE label IS NOT NULL AND pred IS NOT NULL)" + REPORT + "SELECT round(auroc, 6) AS auroc, round(auprc, 6) AS auprc, round(brier, 6) AS brier, round(ece, 6) AS ece FROM _g JOIN _p USING (regime) JOIN _e USING (regime)", "pr"))
def classification_report(spark, d):
    return rounded(metrics.classification_report(metrics.valid(predictions(spark, d))))


@query("aggregate_predictions", sql("""_k AS (SELECT *, rank() OVER (PARTITION BY etype ORDER BY pred) + (count(*) OVER (PARTITION BY etype, pred) - 1) / 2.0 AS mid FROM pr), _g AS (SELECT etype, (sum(mid) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))) AS auroc, avg(power(pred - label, 2)) AS brier FROM _k GROUP BY etype), """ + DELONG.strip() + """
SELECT round((SELECT avg(auroc) FROM _g), 6) AS macro_auroc, round((SELECT avg(brier) FROM _g), 6) AS macro_brier, (SELECT count(*) FROM _g) AS n_groups, round(auroc, 6) AS micro_auroc, round(greatest(0, auroc - 1.959963984540054 * sqrt(var)), 6) AS lo, round(least(1, auroc + 1.959963984540054 * sqrt(var)), 6) AS hi, round((SELECT avg(power(pred - label, 2)) FROM pr), 6) AS micro_brier FROM _s""", "pr"))
def aggregate_predictions(spark, d):
    return rounded(metrics.aggregate_predictions(predictions(spark, d), "etype"))


@query("median_mad", sql("_m AS (SELECT etype, quantile_cont(ret, 0.5) AS m FROM pr GROUP BY etype) SELECT etype, round(max(m), 6) AS median, round(quantile_cont(abs(ret - m), 0.5), 6) AS mad FROM pr JOIN _m USING (etype) GROUP BY etype", "pr"))
def median_mad(spark, d):
    return rounded(metrics.median_mad(predictions(spark, d), "ret", "etype"))


# risk
@query("risk_threshold", sql("""_t AS (SELECT unnest(range(0, 6)) AS i, unnest(quantile_cont(pred, [0.5, 0.6, 0.7, 0.8, 0.9, 0.95])) AS t FROM pr), _p AS (SELECT i, t, -(CASE WHEN pred >= t THEN 0 ELSE ret END) AS loss FROM pr, _t), _v AS (SELECT i, t, quantile_cont(loss, 0.99) AS v FROM _p GROUP BY ALL), _s AS (SELECT i, t, avg(loss) FILTER (loss >= v) AS es, CAST(count(*) FILTER (loss > v) AS DOUBLE) AS beyond FROM _p JOIN _v USING (i, t) GROUP BY i, t)
SELECT round(t, 6) AS threshold, round(es, 6) AS score, 'es' AS objective FROM (SELECT * FROM _s ORDER BY es, i LIMIT 1) UNION ALL SELECT round(t, 6), round(beyond, 6), 'var_exceed' FROM (SELECT * FROM _s ORDER BY beyond, i LIMIT 1)""", "pr"))
def risk_threshold(spark, d):
    pr = predictions(spark, d)
    return rounded(risk.risk_threshold(pr, "es").withColumn("objective", F.lit("es")).union(risk.risk_threshold(pr, "var_exceed").withColumn("objective", F.lit("var_exceed"))))


@query("var_es", sql("_v AS (SELECT quantile_cont(-ret, 0.99) AS v FROM pr) SELECT round(max(v), 6) AS var, round(avg(-ret) FILTER (-ret >= v), 6) AS es FROM pr, _v", "pr"))
def var_es(spark, d):
    return rounded(risk.var_es(predictions(spark, d)))


EXC = "_e AS (SELECT idx, CAST(-ret > (SELECT quantile_cont(-ret, 0.95) FROM pr) AS INTEGER) AS exc FROM pr)\n"


@query("kupiec", sql(EXC + "SELECT count(*) AS n, CAST(sum(exc) AS BIGINT) AS k, 0 + round(2 * (sum(exc) * (ln(avg(exc::DOUBLE) + 1e-12) - ln(1 - 0.95::DOUBLE + 1e-12)) + (count(*) - sum(exc)) * (ln(1 - avg(exc::DOUBLE) + 1e-12) - ln(0.95::DOUBLE + 1e-12))), 6) AS lr FROM _e", "pr"))
def kupiec(spark, d):
    return rounded(risk.kupiec(risk.exceedances(predictions(spark, d), 0.95), 0.95)).withColumn("lr", F.col("lr") + 0.0)


@query("christoffersen", sql(EXC + """, _m AS (SELECT exc, lag(exc) OVER (ORDER BY idx) AS was FROM _e), _c AS (SELECT count(*) FILTER (was = 0 AND exc = 0) AS n00, count(*) FILTER (was = 0 AND exc = 1) AS n01, count(*) FILTER (was = 1 AND exc = 0) AS n10, count(*) FILTER (was = 1 AND exc = 1) AS n11 FROM _m), _p AS (SELECT *, (n01 + n11) / CAST(n00 + n01 + n10 + n11 AS DOUBLE) AS pi, n01 / CAST(n00 + n01 AS DOUBLE) AS p01, n11 / CAST(n10 + n11 AS DOUBLE) AS p11 FROM _c)
SELECT n00, n01, n10, n11, round(greatest(0, -2 * (CASE WHEN n00 + n10 > 0 THEN (n00 + n10) * ln(1 - pi) ELSE 0 END + CASE WHEN n01 + n11 > 0 THEN (n01 + n11) * ln(pi) ELSE 0 END - CASE WHEN n00 > 0 THEN n00 * ln(1 - p01) ELSE 0 END - CASE WHEN n01 > 0 THEN n01 * ln(p01) ELSE 0 END - CASE WHEN n10 > 0 THEN n10 * ln(1 - p11) ELSE 0 END - CASE WHEN n11 > 0 THEN n11 * ln(p11) ELSE 0 END)), 6) AS lr FROM _p""", "pr"))
def christoffersen(spark, d):
    return rounded(risk.christoffersen(risk.exceedances(predictions(spark, d), 0.95)))


RV = "_rv AS (SELECT *, sqrt(sum(ret * ret) OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)) AS rv FROM pr)\n"


@query("realized_vol", sql(RV + "SELECT idx, round(rv, 6) AS rv FROM _rv", "pr"))
def realized_vol(spark, d):
    return risk.realised_volatility(predictions(spark, d), by=["symbol"]).select("idx", r6("rv").alias("rv"))


@query("regime_split", sql(RV + ", _m AS (SELECT *, CASE WHEN round(rv, 9) <= (SELECT quantile_cont(round(rv, 9), 0.5) FROM _rv) THEN 'calm' ELSE 'volatile' END AS regime FROM _rv), _a AS (SELECT ret, regime FROM _m UNION ALL SELECT ret, 'all' FROM _m), _v AS (SELECT regime, quantile_cont(-ret, 0.99) AS v FROM _a GROUP BY regime) SELECT regime, count(*) AS n, round(max(v), 6) AS var, round(avg(-ret) FILTER (-ret >= v), 6) AS es FROM _a JOIN _v USING (regime) GROUP BY regime", "pr"))
def regime_split(spark, d):
    rv = risk.realised_volatility(predictions(spark, d), by=["symbol"]).withColumn("rv", F.round("rv", 9))
    return rounded(risk.regime_report(risk.regimes(rv)))


@query("regime_metrics", sql(RV + ", _m AS (SELECT *, CASE WHEN round(rv, 9) <= (SELECT quantile_cont(round(rv, 9), 0.5) FROM _rv) THEN 'calm' ELSE 'volatile' END AS regime FROM _rv), _a AS (SELECT regime, idx, pred, label FROM _m WHERE label IS NOT NULL AND pred IS NOT NULL UNION ALL SELECT 'overall', idx, pred, label FROM _m WHERE label IS NOT NULL AND pred IS NOT NULL)" + REPORT + "SELECT regime, n, round(coalesce(auroc, CASE WHEN regime <> 'overall' THEN 0.5 END), 6) AS auroc, round(auprc, 6) AS auprc, round(brier, 6) AS brier, round(ece, 6) AS ece FROM _g JOIN _p USING (regime) JOIN _e USING (regime)", "pr"))
def regime_metrics(spark, d):
    rv = risk.realised_volatility(predictions(spark, d), by=["symbol"]).withColumn("rv", F.round("rv", 9))
    return rounded(risk.regime_metrics(metrics.valid(risk.regimes(rv))))


@query("realized_vol_pooled", sql("SELECT idx, round(sqrt(sum(ret * ret) OVER (ORDER BY idx ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)), 6) AS rv FROM pr", "pr"))
def realized_vol_pooled(spark, d):
    return risk.realised_volatility(predictions(spark, d)).select("idx", r6("rv").alias("rv"))


@query("utility_threshold", sql("_t AS (SELECT pred AS t, 2 * sum(label) AS a, sum(1 - label) AS b FROM pr GROUP BY pred), _u AS (SELECT t, CAST(sum(a) OVER w - sum(b) OVER w AS DOUBLE) AS u FROM _t WINDOW w AS (ORDER BY t DESC ROWS UNBOUNDED PRECEDING)) SELECT round(t, 6) AS threshold, u AS utility FROM _u ORDER BY u DESC, t LIMIT 1", "pr"))
def utility_threshold(spark, d):
    return rounded(risk.utility_threshold(predictions(spark, d), w_pos=2.0, w_neg=1.0))


DERISK = "SELECT round(scale, 6) AS scale, round(vp, 6) AS var_protected, round((SELECT avg(-p) FROM _x WHERE -p >= vp), 6) AS es_protected, round(vb, 6) AS var_baseline, round((SELECT avg(-ret * scale) FROM _x WHERE -ret * scale >= vb), 6) AS es_baseline FROM _q"


@query("derisk_baseline", sql("_x AS (SELECT ret, CASE WHEN pred >= 0.7 THEN 0 ELSE ret END AS p FROM pr), _s AS (SELECT stddev_pop(p) / stddev_pop(ret) AS scale FROM _x), _q AS (SELECT max(scale) AS scale, quantile_cont(-p, 0.99) AS vp, quantile_cont(-ret * scale, 0.99) AS vb FROM _x, _s) " + DERISK, "pr"))
def derisk_baseline(spark, d):
    return rounded(risk.derisk(predictions(spark, d), 0.7))


@query("derisk_grid", sql("""_g AS (SELECT unnest([50, 60, 70, 80, 90, 95]) AS percentile), _h AS (SELECT percentile, (SELECT quantile_cont(pred, [0.5, 0.6, 0.7, 0.8, 0.9, 0.95]) FROM pr)[list_position([50, 60, 70, 80, 90, 95], percentile)] AS threshold FROM _g), _x AS (SELECT percentile, threshold, ret, CASE WHEN pred >= threshold THEN 0 ELSE ret END AS p FROM pr, _h), _s AS (SELECT percentile, stddev_pop(p) / stddev_pop(ret) AS scale FROM _x GROUP BY percentile), _y AS (SELECT * FROM _x JOIN _s USING (percentile)), _v AS (SELECT percentile, quantile_cont(-p, 0.99) AS vp, quantile_cont(-ret * scale, 0.99) AS vb FROM _y GROUP BY percentile)
SELECT percentile, round(max(threshold), 6) AS threshold, round(max(scale), 6) AS scale, round(max(vp), 6) AS var_protected, round(avg(-p) FILTER (-p >= vp), 6) AS es_protected, round(max(vb), 6) AS var_baseline, round(avg(-ret * scale) FILTER (-ret * scale >= vb), 6) AS es_baseline FROM _y JOIN _v USING (percentile) GROUP BY percentile""", "pr"))
def derisk_grid(spark, d):
    return rounded(risk.derisk_grid(predictions(spark, d)))


# point processes
@query("tpp_nll", sql("SELECT round((-sum(ln(greatest(lam[m + 1], 1e-12))) + sum(tot * dt)) / count(*), 6) AS nll FROM tp", "tp"))
def tpp_nll(spark, d):
    return rounded(tpp.nll_per_event(intensities(spark, d)))


@query("rescaled_times", sql("SELECT rn, round(tot * dt, 6) AS xi FROM tp", "tp"))
def rescaled_times(spark, d):
    return tpp.rescaled_times(intensities(spark, d)).select("rn", r6("xi").alias("xi"))


@query("rescaled_times_per_type", sql("""_l AS (SELECT rn, m, unnest(range(0, 5)) AS k, unnest(lam) * dt AS a FROM tp), _c AS (SELECT rn, m, k, coalesce(sum(a) OVER (PARTITION BY k ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM _l)
SELECT rn, CAST(m AS INTEGER) AS m, round(c - coalesce(lag(c) OVER (PARTITION BY m ORDER BY rn), 0), 4) AS xi FROM _c WHERE k = m""", "tp"))
def rescaled_times_per_type(spark, d):
    return rounded(tpp.rescaled_times_per_type(intensities(spark, d)), 4)


@query("type_frequencies", sql("_e AS (SELECT m, count(*) AS n FROM tp GROUP BY m), _f AS (SELECT k AS m, sum(l) AS s FROM (SELECT unnest(range(0, 5)) AS k, unnest(lam) AS l FROM tp) GROUP BY k) SELECT CAST(_f.m AS INTEGER) AS m, round(coalesce(n, 0) / (SELECT CAST(count(*) AS DOUBLE) FROM tp), 6) AS empirical, round(s / (SELECT sum(s) FROM _f), 6) AS model FROM _f LEFT JOIN _e ON _e.m = _f.m", "tp"))
def type_frequencies(spark, d):
    return rounded(tpp.type_frequencies(intensities(spark, d)))


KS = "_u AS (SELECT rn, 1 - exp(-tot * dt / 1000) AS u FROM tp), _i AS (SELECT u, row_number() OVER (ORDER BY u, rn) AS i, count(*) OVER () AS n FROM _u)\n"


@query("ks_uniform", sql(KS + "SELECT max(n) AS n, round(max(greatest(i / n - u, u - (i - 1) / n)), 6) AS ks FROM _i", "tp"))
def ks_uniform(spark, d):
    xi = tpp.rescaled_times(intensities(spark, d)).withColumn("u", 1 - F.exp(-F.col("xi") / 1000))
    return rounded(tpp.ks_uniform(xi))


@query("tpp_diagnostics", sql("""_x AS (SELECT rn, tot * dt AS xi, 1 - exp(-(tot * dt)) AS u FROM tp), _i AS (SELECT u, row_number() OVER (ORDER BY u, rn) AS i, count(*) OVER () AS n FROM _x), _e AS (SELECT m, count(*) AS n FROM tp GROUP BY m), _f AS (SELECT k AS m, sum(l) AS s FROM (SELECT unnest(range(0, 5)) AS k, unnest(lam) AS l FROM tp) GROUP BY k)
SELECT (SELECT round(avg(xi), 6) FROM _x) AS mean_xi, max(n) AS n, round(max(greatest(i / n - u, u - (i - 1) / n)), 6) AS ks, (SELECT round(sum(abs(coalesce(n, 0) / (SELECT CAST(count(*) AS DOUBLE) FROM tp) - s / (SELECT sum(s) FROM _f))), 6) FROM _f LEFT JOIN _e ON _e.m = _f.m) AS coverage_error FROM _i""", "tp"))
def tpp_diagnostics(spark, d):
    return rounded(tpp.diagnostics(intensities(spark, d)))


CONF = "_g AS (SELECT m AS actual, list_position(lam, list_max(lam)) - 1 AS predicted FROM tp)\n"


@query("tpp_confusion", sql(CONF + "SELECT CAST(actual AS INTEGER) AS actual, CAST(predicted AS INTEGER) AS predicted, count(*) AS n FROM _g GROUP BY ALL", "tp"))
def tpp_confusion(spark, d):
    return tpp.confusion(intensities(spark, d))


@query("tpp_type_scores", sql(CONF + ", _t AS (SELECT unnest(range(0, 5)) AS m), _s AS (SELECT m, count(*) FILTER (actual = m AND predicted = m) AS h, count(*) FILTER (predicted = m) AS p, count(*) FILTER (actual = m) AS a FROM _t, _g GROUP BY m), _r AS (SELECT m, coalesce(h / CAST(nullif(p, 0) AS DOUBLE), 0) AS precision, coalesce(h / CAST(nullif(a, 0) AS DOUBLE), 0) AS recall FROM _s) SELECT CAST(m AS INTEGER) AS m, round(precision, 6) AS precision, round(recall, 6) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1 FROM _r", "tp"))
def tpp_type_scores(spark, d):
    return rounded(tpp.type_scores(intensities(spark, d)))


@query("tpp_histograms", sql("_l AS (SELECT m, unnest(range(0, 5)) AS type, unnest(lam) / tot AS w FROM tp) SELECT CAST(type AS INTEGER) AS type, CAST(least(floor(w * 10), 9) AS INTEGER) AS bin, count(*) AS n, count(*) FILTER (m = type) AS n_events FROM _l GROUP BY ALL", "tp"))
def tpp_histograms(spark, d):
    return tpp.mass_histogram(intensities(spark, d))


@query("hawkes_const", sql("SELECT CAST(m AS INTEGER) AS m, round(count(*) / (SELECT sum(dt) FROM tp), 9) AS rate FROM tp GROUP BY m", "tp"))
def hawkes_const(spark, d):
    return tpp.poisson_rates(intensities(spark, d)).select("m", F.round("rate", 9).alias("rate"))


@query("hawkes_exp_design", sql("""_w AS (SELECT a.seq, sum(CASE WHEN b.event_type = 'click' THEN exp((b.ts_ns - a.ts_ns) / 3600000000000.0) ELSE 0 END) AS c, sum(exp((b.ts_ns - a.ts_ns) / 3600000000000.0)) AS t, max(CASE WHEN a.event_type = 'view' THEN 1 ELSE 0 END) AS y FROM ev a JOIN (SELECT * FROM ev) b ON a.symbol = b.symbol AND b.ts_ns <= a.ts_ns AND (b.ts_ns < a.ts_ns OR b.seq <= a.seq) AND b.ts_ns > a.ts_ns - 216000000000000 GROUP BY a.seq)
SELECT CAST(count(*) AS DOUBLE) AS xx_0_0, round(sum(c), 3) AS xx_1_0, round(sum(c * c), 3) AS xx_1_1, round(sum(t), 3) AS xx_2_0, round(sum(t * c), 3) AS xx_2_1, round(sum(t * t), 3) AS xx_2_2, CAST(sum(y) AS DOUBLE) AS xy_0, round(sum(c * y), 3) AS xy_1, round(sum(t * y), 3) AS xy_2 FROM _w""", "ev"))
def hawkes_exp_design(spark, d):
    from tapeworks.operators.features import ewma_counts
    from tapeworks.plans.tables import events

    ev = ewma_counts(events(spark, d), ["click"], [3600]).withColumn("y", (F.col("event_type") == "view").cast("double"))
    return rounded(tpp.hawkes_normal_equations(ev, ["ewm_click_3600", "ewm_all_3600"], "y"), 3)
