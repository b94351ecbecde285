"""Tail risk of returns: VaR and ES, coverage tests, volatility, utility thresholds, de-risking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeworks.functions.ranks import quantiles, running_totals
from tapeworks.operators import metrics

EPS = 1e-12


def var_es(df: DataFrame, alpha: float = 0.99, *, ret: str = "ret", by: Sequence[str] = ()) -> DataFrame:
    """var: the alpha-quantile of the loss (linear between rows); es: mean of losses not below it."""
    loss = df.select(*by, (-F.col(ret)).alias("__loss"))
    bound = quantiles(loss, F.col("__loss"), [alpha], by=by).select(*by, F.get("q", F.lit(0)).alias("var"))
    rows = loss.join(F.broadcast(bound)) if not by else loss.join(bound, list(by))
    return rows.groupBy(*by).agg(F.first("var").alias("var"), F.coalesce(F.avg(F.when(F.col("__loss") >= F.col("var"), F.col("__loss"))), F.first("var")).alias("es"))


def exceedances(df: DataFrame, alpha: float = 0.99, *, ret: str = "ret") -> DataFrame:
    """exc: 1 where the loss is beyond VaR."""
    bound = quantiles(df, -F.col(ret), [alpha]).select(F.get("q", F.lit(0)).alias("__var"))
    return df.join(F.broadcast(bound)).withColumn("exc", (-F.col(ret) > F.col("__var")).cast("int")).drop("__var")


def kupiec(df: DataFrame, alpha: float = 0.99) -> DataFrame:
    """n, k and the likelihood ratio lr of the exceedance rate (chi-square with one degree of freedom)."""
    c = df.agg(F.count(F.lit(1)).alias("n"), F.sum("exc").alias("k"))
    pi, pi0 = F.col("k") / F.col("n"), 1 - alpha
    part = lambda m, p, q: m * (F.log(p + EPS) - F.log(F.lit(q + EPS)))
    return c.withColumn("lr", 2 * (part(F.col("k"), pi, pi0) + part(F.col("n") - F.col("k"), 1 - pi, alpha)))


def christoffersen(df: DataFrame, *, order: str = "idx") -> DataFrame:
    """Transition counts n00..n11 of exceedances in order and the likelihood ratio lr of their independence (in logs).

    Rows are numbered range by range and meet their predecessor by number.
    """
    rows = running_totals(df.select(order, "exc").withColumn("one", F.lit(1).cast("long")), [order], ["one"]).select(F.col("before_one").alias("at"), "exc")
    size = 1 << 16
    dealt = rows.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("at") / size), F.floor((F.col("at") + 1) / size))))
    moves = dealt.withColumn("was", F.lag("exc").over(W.partitionBy("chunk").orderBy("at"))).where((F.floor(F.col("at") / size) == F.col("chunk")) & F.col("was").isNotNull())
    c = moves.agg(*[F.count_if((F.col("was") == a) & (F.col("exc") == b)).alias(f"n{a}{b}") for a in (0, 1) for b in (0, 1)])
    n00, n01, n10, n11 = (F.col(f"n{x}") for x in ("00", "01", "10", "11"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    term = lambda n, p: F.when(n > 0, n * F.log(F.greatest(p, F.lit(EPS)))).otherwise(0.0)
    pi, p01, p11 = share(n01 + n11, n00 + n01 + n10 + n11), share(n01, n00 + n01), share(n11, n10 + n11)
    one = term(n00 + n10, 1 - pi) + term(n01 + n11, pi)
    two = term(n00, 1 - p01) + term(n01, p01) + term(n10, 1 - p11) + term(n11, p11)
    return c.withColumn("lr", F.greatest(F.lit(0.0), -2 * (one - two)))


def realised_volatility(df: DataFrame, rows: int = 50, *, ret: str = "ret", order: str = "idx", by: Sequence[str] = ()) -> DataFrame:
    """rv: root of the sum of squared returns over the last `rows` rows of each series.

    Without series all rows are one: they are numbered range by range and dealt to chunks with a halo.
    """
    squares = lambda w: F.sqrt(F.sum(F.col(ret) * F.col(ret)).over(w.rowsBetween(-(rows - 1), 0)))
    if by:
        return df.withColumn("rv", squares(W.partitionBy(*by).orderBy(order)))
    at, size = F.col("before___one"), max(1 << 16, 10 * rows)
    numbered = running_totals(df.withColumn("__one", F.lit(1).cast("long")), [order], ["__one"])
    dealt = numbered.withColumn("__chunk", F.explode(F.sequence(F.floor(at / size), F.floor((at + rows - 1) / size))))
    dealt = dealt.withColumn("rv", squares(W.partitionBy("__chunk").orderBy("before___one")))
    return dealt.where(F.floor(at / size) == F.col("__chunk")).select(*df.columns, "rv")


def regimes(df: DataFrame) -> DataFrame:
    """regime: calm up to the median of rv, volatile above."""
    mid = quantiles(df, F.col("rv"), [0.5]).select(F.get("q", F.lit(0)).alias("__mid"))
    return df.join(F.broadcast(mid)).withColumn("regime", F.when(F.col("rv") <= F.col("__mid"), "calm").otherwise("volatile")).drop("__mid")


def regime_report(df: DataFrame, alpha: float = 0.99) -> DataFrame:
    """n, VaR and ES of each regime and of all rows (regime null): a copy of each row for `all`."""
    both = df.select("ret", F.explode(F.array(F.col("regime"), F.lit("all"))).alias("regime"))
    n = both.groupBy("regime").agg(F.count(F.lit(1)).alias("n"))
    return n.join(var_es(both, alpha, by=["regime"]), "regime")


def regime_metrics(df: DataFrame, bins: int = 15) -> DataFrame:
    """regime, n, auroc, auprc, brier and ece of each regime and of `overall`; a regime with one class has an auroc of 0.5.

    auprc is null without positives. Rows are (idx, pred, label, regime).
    """
    both = df.select("idx", "pred", "label", F.explode(F.array(F.col("regime"), F.lit("overall"))).alias("regime"))
    out = both.groupBy("regime").agg(F.count(F.lit(1)).alias("n"))
    for part in (metrics.auroc(both, "regime"), metrics.average_precision(both, "regime"), metrics.brier(both, "regime"), metrics.ece(metrics.reliability_bins(both, bins, by=["regime"]), "regime")):
        out = out.join(part, "regime")
    return out.withColumn("auroc", F.coalesce("auroc", F.when(F.col("regime") != "overall", F.lit(0.5))))


def utility_threshold(df: DataFrame, *, w_pos: float = 1.0, w_neg: float = 1.0) -> DataFrame:
    """threshold and utility: the prediction t with most w_pos * TP - w_neg * FP at pred >= t; the least of equals."""
    counts = df.groupBy("pred").agg(F.sum((F.col("label") == 1).cast("long")).alias("pos"), F.sum((F.col("label") == 0).cast("long")).alias("neg"))
    rows = running_totals(counts, ["pred"], ["pos", "neg"])
    totals = counts.agg(F.sum("pos").alias("__p"), F.sum("neg").alias("__q"))
    u = w_pos * (F.col("__p") - F.col("before_pos")) - w_neg * (F.col("__q") - F.col("before_neg"))
    best = rows.join(F.broadcast(totals)).agg(F.max(F.struct(u.cast("double").alias("utility"), (-F.col("pred")).alias("t"))).alias("b"))
    return best.select((-F.col("b.t")).alias("threshold"), F.col("b.utility").alias("utility"))


def derisk(df: DataFrame, threshold: Column | float, alpha: float = 0.99) -> DataFrame:
    """One row: VaR and ES of returns that are 0 where pred reaches the threshold, and of all returns scaled to the same volatility."""
    rows = df.withColumn("__prot", F.when(F.col("pred") >= threshold, 0.0).otherwise(F.col("ret")))
    sd = rows.agg(F.when(F.stddev_pop("ret") > 0, F.stddev_pop("__prot") / F.stddev_pop("ret")).otherwise(1.0).alias("scale"))
    rows = rows.join(F.broadcast(sd)).withColumn("__base", F.col("ret") * F.col("scale"))
    a = var_es(rows, alpha, ret="__prot").select(F.col("var").alias("var_protected"), F.col("es").alias("es_protected"))
    b = var_es(rows, alpha, ret="__base").select(F.col("var").alias("var_baseline"), F.col("es").alias("es_baseline"))
    return sd.join(a).join(b)


def derisk_grid(df: DataFrame, percents: Sequence[int] = (50, 60, 70, 80, 90, 95), alpha: float = 0.99) -> DataFrame:
    """derisk at each percentile of pred: percentile, threshold and the VaR and ES of both."""
    cuts = quantiles(df, F.col("pred"), [q / 100 for q in percents]).select(F.col("q").alias("__t"))
    grid = cuts.select(F.posexplode("__t").alias("__i", "threshold")).withColumn("percentile", F.element_at(F.array(*[F.lit(q) for q in percents]), F.col("__i") + 1)).drop("__i")
    rows = df.select("pred", "ret").join(F.broadcast(grid))
    rows = rows.withColumn("__prot", F.when(F.col("pred") >= F.col("threshold"), 0.0).otherwise(F.col("ret")))
    sd = rows.groupBy("percentile").agg(F.first("threshold").alias("threshold"), F.when(F.stddev_pop("ret") > 0, F.stddev_pop("__prot") / F.stddev_pop("ret")).otherwise(1.0).alias("scale"))
    rows = rows.drop("threshold").join(F.broadcast(sd), "percentile").withColumn("__base", F.col("ret") * F.col("scale"))
    a = var_es(rows, alpha, ret="__prot", by=["percentile"]).withColumnsRenamed({"var": "var_protected", "es": "es_protected"})
    b = var_es(rows, alpha, ret="__base", by=["percentile"]).withColumnsRenamed({"var": "var_baseline", "es": "es_baseline"})
    return sd.join(a, "percentile").join(b, "percentile")


def risk_threshold(df: DataFrame, objective: str = "es", percents: Sequence[int] = (50, 60, 70, 80, 90, 95), alpha: float = 0.99) -> DataFrame:
    """threshold and score: the percentile of pred whose protected returns have the least ES, or the fewest losses beyond VaR.

    Of equal scores the lowest percentile is taken.
    """
    if objective not in ("es", "var_exceed"):
        raise ValueError(f"objective must be es or var_exceed, not {objective!r}")
    cuts = quantiles(df, F.col("pred"), [q / 100 for q in sorted(percents)]).select(F.col("q").alias("__t"))
    rows = df.select("pred", "ret").join(F.broadcast(cuts.select(F.posexplode("__t").alias("i", "threshold"))))
    rows = rows.withColumn("__prot", F.when(F.col("pred") >= F.col("threshold"), 0.0).otherwise(F.col("ret")))
    stats = var_es(rows, alpha, ret="__prot", by=["i", "threshold"])
    if objective == "es":
        scored = stats.withColumn("score", F.col("es"))
    else:
        beyond = rows.join(F.broadcast(stats), ["i", "threshold"]).groupBy("i", "threshold").agg(F.count_if(-F.col("__prot") > F.col("var")).cast("double").alias("score"))
        scored = beyond
    best = scored.agg(F.min(F.struct("score", "i", "threshold")).alias("b"))
    return best.select("b.threshold", "b.score")
