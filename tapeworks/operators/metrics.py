"""Evaluation of predictions: ranking, calibration, tests, averages.

Rows are (idx, pred, label); ties of pred share midranks. Ranking works on counts of distinct predictions, whose running
totals are summed range by range, so it doesn't need the rows of a table in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeworks.functions.ranks import quantiles, running_totals


def valid(df: DataFrame) -> DataFrame:
    """Rows with a finite prediction and a label of 0 or 1."""
    p = F.col("pred")
    return df.where(p.isNotNull() & ~F.isnan(p) & (F.abs(p) < float("inf")) & F.col("label").isin(0, 1))


def brier(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.pow(F.col("pred") - F.col("label"), 2)).alias("brier"))


def reliability_bins(df: DataFrame, bins: int = 15, *, by: Sequence[str] = ()) -> DataFrame:
    """bin (from 1), n, confidence and accuracy of equal-frequency bins; the first n % bins hold one row more."""
    rows = running_totals(df.select(*by, "idx", "pred", "label").withColumn("one", F.lit(1).cast("long")), ["pred", "idx"], ["one"], by=by)
    total = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    rows = rows.join(total, list(by)) if by else rows.join(F.broadcast(total))
    base, more = F.floor(F.col("__n") / bins), F.col("__n") % bins
    at = F.col("before_one")
    head = more * (base + 1)
    number = F.when(at < head, F.floor(at / (base + 1))).otherwise(more + F.floor(try_ratio(at - head, base))) + 1
    return rows.withColumn("bin", number.cast("int")).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("pred").alias("confidence"), F.avg("label").alias("accuracy"))


def try_ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def ece(bins: DataFrame, *by: str) -> DataFrame:
    return bins.groupBy(*by).agg((F.sum(F.abs(F.col("accuracy") - F.col("confidence")) * F.col("n")) / F.sum("n")).alias("ece"))


def by_prediction(df: DataFrame, *by: str) -> DataFrame:
    """Positives and negatives of each distinct prediction, and how many of both have a smaller one."""
    counts = df.groupBy(*by, "pred").agg(F.sum((F.col("label") == 1).cast("long")).alias("pos"), F.sum((F.col("label") == 0).cast("long")).alias("neg"))
    return running_totals(counts, ["pred"], ["pos", "neg"], by=by)


def auroc(df: DataFrame, *by: str) -> DataFrame:
    """auroc by midranks; null where a class is missing."""
    c = by_prediction(df, *by)
    wins = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2))
    return c.groupBy(*by).agg(try_ratio(wins, (F.sum("pos") * F.sum("neg")).cast("double")).alias("auroc"))


def average_precision(df: DataFrame, *by: str) -> DataFrame:
    """auprc: sum over distinct thresholds of the gain in recall times precision."""
    c = by_prediction(df, *by)
    totals = c.groupBy(*by).agg(F.sum("pos").alias("__p"), F.sum("neg").alias("__q"))
    c = c.join(totals, list(by)) if by else c.join(F.broadcast(totals))
    tp, fp = F.col("__p") - F.col("before_pos"), F.col("__q") - F.col("before_neg")
    return c.groupBy(*by).agg(try_ratio(F.sum(F.col("pos") * tp / (tp + fp)), F.first("__p").cast("double")).alias("auprc"))


def auprc_trapezoid(df: DataFrame) -> DataFrame:
    """auprc by the trapezoid rule over rows from the highest prediction on (ties by idx)."""
    rows = df.select((-F.col("pred")).alias("__o"), "idx", (F.col("label") == 1).cast("long").alias("p"), F.lit(1).cast("long").alias("one"))
    rows = running_totals(rows, ["__o", "idx"], ["p", "one"])
    total = rows.agg(F.sum("p").alias("__p"))
    rows = rows.join(F.broadcast(total))
    tp, n = F.col("before_p") + F.col("p"), F.col("before_one") + 1
    # A step adds (recall - recall before) * (precision + precision before) / 2; recall grows at positives only.
    here, before = tp / n, F.when(F.col("before_one") > 0, F.col("before_p") / F.greatest(F.col("before_one"), F.lit(1)))
    return rows.agg(try_ratio(F.sum(F.when((F.col("p") == 1) & before.isNotNull(), (here + before) / 2)), F.first("__p").cast("double")).alias("auprc"))


def delong_parts(df: DataFrame, pred: str = "pred") -> DataFrame:
    """Each row with its DeLong component: placement among the other class, with ties half."""
    rows = df.select("idx", F.col(pred).alias("pred"), "label")
    c = by_prediction(rows)
    totals = c.agg(F.sum("pos").alias("__m"), F.sum("neg").alias("__n"))
    placed = rows.join(c, "pred").join(F.broadcast(totals))
    v10 = (F.col("before_neg") + F.col("neg") / 2) / F.col("__n")
    v01 = 1 - (F.col("before_pos") + F.col("pos") / 2) / F.col("__m")
    return placed.select("idx", "label", F.when(F.col("label") == 1, v10).otherwise(v01).alias("v"))


def delong_variance(df: DataFrame) -> DataFrame:
    """auroc and its variance, one row."""
    v = delong_parts(df)
    one, zero = F.when(F.col("label") == 1, F.col("v")), F.when(F.col("label") == 0, F.col("v"))
    return v.agg(F.avg(one).alias("auroc"), (F.var_samp(one) / F.count(one) + F.var_samp(zero) / F.count(zero)).alias("variance"))


def normal_quantile(q: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(q)


def delong_ci(df: DataFrame, alpha: float = 0.05) -> DataFrame:
    """auroc with the bounds of its confidence interval, within 0 and 1."""
    z = normal_quantile(1 - alpha / 2)
    se = F.sqrt(F.greatest(F.col("variance"), F.lit(1e-24)))
    return delong_variance(df).select("auroc", F.greatest(F.lit(0.0), F.col("auroc") - z * se).alias("lo"), F.least(F.lit(1.0), F.col("auroc") + z * se).alias("hi"))


def delong_paired(df: DataFrame, first: str = "pred", second: str = "pred2") -> DataFrame:
    """delta of both AUROCs and its z, one row; two_sided_p gives the p-value."""
    a = delong_parts(df, first).withColumnRenamed("v", "a")
    b = delong_parts(df, second).select("idx", F.col("v").alias("b"))
    j = a.join(b, "idx")
    on = lambda y, c: F.when(F.col("label") == y, F.col(c))
    part = lambda y: (F.var_samp(on(y, "a")) + F.var_samp(on(y, "b")) - 2 * F.covar_samp(on(y, "a"), on(y, "b"))) / F.count(on(y, "a"))
    d = j.agg((F.avg(on(1, "a")) - F.avg(on(1, "b"))).alias("delta"), (part(1) + part(0)).alias("variance"))
    return d.select("delta", (F.col("delta") / F.sqrt(F.greatest(F.col("variance"), F.lit(1e-24)))).alias("z"))


def two_sided_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def chi2_p(lr: float) -> float:
    """Upper tail of chi-square with one degree of freedom."""
    return math.erfc(math.sqrt(max(lr, 0.0) / 2))


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """Predictions of two models for the same rows (idx, label): pred and pred2."""
    return a.select("idx", "label", "pred").join(b.select("idx", "label", F.col("pred").alias("pred2")), ["idx", "label"])


def metrics_by_group(df: DataFrame, group: str) -> DataFrame:
    """n, base rate and Brier score of each group and, where group is null, of all rows together."""
    return df.groupingSets([[group], []], group).agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("base_rate"), F.avg(F.pow(F.col("pred") - F.col("label"), 2)).alias("brier"), F.grouping(group).cast("int").alias("pooled"))


def micro_macro(df: DataFrame, value: str, weight: str | None = None) -> DataFrame:
    """macro: mean of the values; micro: mean by weight (the same without one)."""
    macro = F.avg(value)
    micro = F.sum(F.col(weight) * F.col(value)) / (F.sum(weight) + 1e-12) if weight else macro
    return df.agg(macro.alias("macro"), micro.alias("micro"))


def benjamini_hochberg(df: DataFrame, p: str = "p", key: str = "key", alpha: float = 0.05) -> DataFrame:
    """Rows with rank, qvalue and rejected. The hypotheses of one study are one window."""
    w = W.partitionBy(F.lit(0))
    df = df.withColumns({"rank": F.row_number().over(w.orderBy(p, key)), "__m": F.count(F.lit(1)).over(w)})
    back = w.orderBy(F.col("rank").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    df = df.withColumn("qvalue", F.least(F.lit(1.0), F.min(F.col("__m") / F.col("rank") * F.col(p)).over(back)))
    last = F.max(F.when(F.col(p) <= F.col("rank") * alpha / F.col("__m"), F.col("rank"))).over(w)
    return df.withColumn("rejected", F.coalesce(F.col("rank") <= last, F.lit(False))).drop("__m")


def autocovariances(df: DataFrame, max_lag: int = 50, *, order: str = "idx") -> DataFrame:
    """lag and acov of the centred residual pred - label. Lags meet by position: rows are numbered, then joined on it."""
    s = df.select(order, (F.col("pred") - F.col("label")).cast("double").alias("s"))
    rows = running_totals(s.withColumn("one", F.lit(1).cast("long")), [order], ["one"]).select(F.col("before_one").alias("at"), "s")
    mean = rows.agg(F.avg("s").alias("__mean"), F.count(F.lit(1)).alias("__n"))
    rows = rows.join(F.broadcast(mean)).select("at", (F.col("s") - F.col("__mean")).alias("s"), "__n")
    # Chunks of positions with a halo of max_lag rows: lags never cross a task.
    size = max(10_000, 10 * max_lag)
    dealt = rows.withColumn("chunk", F.explode(F.sequence(F.floor((F.col("at") - max_lag) / size), F.floor(F.col("at") / size))))
    own = dealt.withColumn("own", F.floor(F.col("at") / size) == F.col("chunk"))
    w = W.partitionBy("chunk").orderBy("at")
    products = [(F.col("s") * F.lead("s", k).over(w)).alias(f"p{k}") if k else (F.col("s") * F.col("s")).alias("p0") for k in range(max_lag + 1)]
    sums = own.select("own", "__n", *products).where("own").agg(F.first("__n").alias("n"), *[F.sum(f"p{k}").alias(f"p{k}") for k in range(max_lag + 1)])
    return sums.select("n", F.posexplode(F.array(*[F.col(f"p{k}") for k in range(max_lag + 1)])).alias("lag", "total")).where(F.col("lag") < F.col("n")).select("lag", (F.col("total") / (F.col("n") - F.col("lag"))).alias("acov"), "n")


def block_length(df: DataFrame, max_lag: int = 50, *, order: str = "idx") -> DataFrame:
    """block_length: expected length of the stationary bootstrap's blocks, from the autocovariances; at least 1."""
    a = autocovariances(df, max_lag, order=order)
    g0 = a.where(F.col("lag") == 0).select(F.col("acov").alias("g0"), "n")
    tail = a.where(F.col("lag") > 0).select("lag", "acov").join(F.broadcast(g0))
    last = tail.agg(F.max(F.when(F.abs("acov") > 0.01 * F.abs("g0"), F.col("lag"))).alias("last"))
    used = tail.join(F.broadcast(last)).where(F.col("last").isNull() | (F.col("lag") <= F.col("last")))
    s = used.agg(F.first("g0").alias("g0"), F.first("n").alias("n"), F.sum("acov").alias("s0"), F.sum(F.col("lag") * F.col("acov")).alias("s1"))
    mu0 = F.col("g0") + 2 * F.col("s0")
    ratio = F.greatest(F.lit(1e-24), 4 * F.col("s1") / (mu0 * mu0))
    plain = F.pow(F.col("n").cast("double"), F.lit(1 / 3))
    found = F.when((F.abs("g0") < 1e-18) | (F.abs(mu0) < 1e-18), plain).otherwise(F.pow(ratio, F.lit(1 / 3)) * plain)
    return s.select(F.greatest(F.lit(1.0), found).alias("block_length"))


def classification_report(df: DataFrame) -> DataFrame:
    """One row: auroc, auprc, brier and ece."""
    return auroc(df).join(average_precision(df)).join(brier(df)).join(ece(reliability_bins(df)))


def threshold_sensitivity(df: DataFrame, grid: Sequence[float] | None = None) -> DataFrame:
    """precision, recall and f1 at each threshold of a grid; the grid is a bounded list, counted in one pass."""
    grid = list(grid) if grid is not None else [round(0.05 * i, 2) for i in range(1, 20)]
    hit = lambda t, y: F.count_if((F.col("pred") >= t) & (F.col("label") == y))
    row = df.agg(*[hit(t, 1).alias(f"tp{i}") for i, t in enumerate(grid)], *[hit(t, 0).alias(f"fp{i}") for i, t in enumerate(grid)], F.count_if(F.col("label") == 1).alias("pos"))
    out = row.select("pos", F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp")) for i, t in enumerate(grid)])).alias("x")).select("pos", "x.*")
    precision, recall = F.coalesce(try_ratio(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0)), F.coalesce(try_ratio(F.col("tp"), F.col("pos")), F.lit(0.0))
    return out.select("threshold", precision.alias("precision"), recall.alias("recall")).withColumn("f1", F.coalesce(try_ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def aggregate_predictions(df: DataFrame, group: str) -> DataFrame:
    """One row: macro AUROC and Brier score over groups, and the pooled ones with the pooled AUROC's interval."""
    each = auroc(df, group).join(brier(df, group), group)
    macro = each.agg(F.avg("auroc").alias("macro_auroc"), F.avg("brier").alias("macro_brier"), F.count("auroc").alias("n_groups"))
    pooled = delong_ci(df).select(F.col("auroc").alias("micro_auroc"), "lo", "hi").join(brier(df).withColumnRenamed("brier", "micro_brier"))
    return macro.join(pooled)


def median_mad(df: DataFrame, column: str, *by: str) -> DataFrame:
    """median and mad (median distance from it) of a column."""
    one = F.get("q", F.lit(0))
    mid = quantiles(df, F.col(column), [0.5], by=by).select(*by, one.alias("median"))
    off = df.join(mid, list(by)) if by else df.join(F.broadcast(mid))
    mad = quantiles(off, F.abs(F.col(column) - F.col("median")), [0.5], by=by).select(*by, one.alias("mad"))
    return mid.join(mad, list(by)) if by else mid.join(F.broadcast(mad))
