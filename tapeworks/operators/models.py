"""Baseline models and losses: logistic regression, temperature, importance, scoring of joint losses."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeworks.functions.ranks import running_totals
from tapeworks.operators import metrics
from tapeworks.operators.splits import permuted
from tapeworks.schema import SEQ, SYMBOL, TS
from tapeworks.session import stored

#: Numbers of one row's topology vectors that are written at once.
MOST_NUMBERS = 512


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def logit(p: Column) -> Column:
    c = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(c / (1 - c))


def fit_logistic(train: DataFrame, features: Sequence[str], label: str = "label", *, max_iter: int = 200, c: float = 1.0):
    """Logistic regression with a squared penalty of 1 / C on the sum of losses, on the features as they are."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=list(features), outputCol="features").transform(train.select(*features, F.col(label).cast("double").alias("label")))
    n = max(rows.count(), 1)
    return LogisticRegression(maxIter=max_iter, standardization=False, regParam=1.0 / (c * n)).fit(rows)


def predict(model, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """df with pred, as plain arithmetic on the columns."""
    z = F.lit(float(model.intercept))
    for name, w in zip(features, model.coefficients.toArray(), strict=True):
        z = z + float(w) * F.col(name)
    return df.withColumn("pred", sigmoid(z))


def multi_horizon(train: DataFrame, test: DataFrame, features: Sequence[str], labels: Sequence[str], *, key: str = "idx") -> DataFrame:
    """label, auroc and brier of a model for each label column."""
    out = None
    for name in labels:
        scored = predict(fit_logistic(train, features, name), test, features).select(F.col(key).alias("idx"), "pred", F.col(name).alias("label"))
        row = metrics.auroc(scored).join(metrics.brier(scored)).select(F.lit(name).alias("horizon"), "auroc", "brier")
        out = row if out is None else out.union(row)
    return out


def permutation_importance(model, test: DataFrame, features: Sequence[str], *, key: str = "seq", seed: int = 0) -> DataFrame:
    """feature and the loss of AUROC when its column is shuffled."""
    base = metrics.auroc(predict(model, test, features)).withColumnRenamed("auroc", "base")
    out = None
    for name in features:
        row = metrics.auroc(predict(model, permuted(test, [name], seed, key=key), features)).join(base).select(F.lit(name).alias("feature"), (F.col("base") - F.col("auroc")).alias("drop"))
        out = row if out is None else out.union(row)
    return out


def temperature(df: DataFrame, *, low: float = 0.05, high: float = 20.0, points: int = 33, passes: int = 3) -> float:
    """The temperature of least log loss of pred against label: each pass scores a whole grid at once, then narrows it."""
    z = logit(F.col("pred"))
    for _ in range(passes):
        grid = np.geomspace(low, high, points)
        soft = lambda x: F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
        row = df.agg(*[F.avg(soft(z / float(t)) - F.col("label") * z / float(t)).alias(f"t{i}") for i, t in enumerate(grid)]).first()
        best = int(np.argmin([row[i] if row[i] is not None else np.inf for i in range(points)]))
        low, high = grid[max(0, best - 1)], grid[min(points - 1, best + 1)]
    return float(np.sqrt(low * high))


def with_temperature(df: DataFrame, t: float) -> DataFrame:
    return df.withColumn("pred", sigmoid(logit(F.col("pred")) / t))


def smoothness(df: DataFrame, *, lam: str = "lam", order: str = "rn", by: Sequence[str] = (), norm: str | None = None) -> DataFrame:
    """smoothness: sum over types and steps of squared changes of intensity, for each sequence.

    With a norm one row for all sequences: `none` their sum, `global` their mean, `per_seq` the mean of each one's mean change.
    """
    if norm not in (None, "none", "global", "per_seq"):
        raise ValueError(f"norm must be none, global or per_seq, not {norm!r}")
    if by:
        rows = df.select(*by, F.col(lam).alias("__x"), F.lag(lam).over(W.partitionBy(*by).orderBy(order)).alias("__y"))
    else:
        # One series over all rows: they are numbered range by range, and each meets the row before by number.
        at = running_totals(df.select(order, F.col(lam).alias("__x")).withColumn("__one", F.lit(1).cast("long")), [order], ["__one"])
        last = at.select((F.col("before___one") + 1).alias("before___one"), F.col("__x").alias("__y"))
        rows = at.select("before___one", "__x").join(last, "before___one", "left")
    step = F.zip_with("__x", "__y", lambda a, b: (a - b) * (a - b))
    changes = F.when(F.col("__y").isNotNull(), F.size("__x")).otherwise(0)
    rows = rows.select(*by, F.coalesce(F.aggregate(step, F.lit(0.0), lambda s, x: s + x), F.lit(0.0)).alias("d"), changes.alias("c"))
    sums = rows.groupBy(*by).agg(F.sum("d").alias("smoothness"), F.sum("c").alias("c"))
    if norm is None:
        return sums.drop("c")
    each = F.col("smoothness") / F.greatest(F.col("c"), F.lit(1)) if norm == "per_seq" else F.col("smoothness")
    return sums.agg((F.sum if norm == "none" else F.avg)(each).alias("smoothness"))


def mark_nll(df: DataFrame, size: str = "size", mu: str = "mu", log_sigma: str = "log_sigma", *, by: Sequence[str] = ()) -> DataFrame:
    """mark_nll: mean negative log likelihood of positive sizes under log-normal marks."""
    x, sd = F.log(F.greatest(F.col(size), F.lit(1e-6))), F.exp(F.col(log_sigma))
    return df.groupBy(*by).agg(F.avg(x + F.col(log_sigma) + 0.9189385332046727 + F.pow(x - F.col(mu), 2) / (2 * sd * sd)).alias("mark_nll"))


def joint_loss(df: DataFrame, *, weight_cls: float = 1.0, weight_smooth: float = 0.0, focal: float = 0.0, pos_weight: float = 1.0, marks: bool = False, weight_l2: float = 0.0, parameters: Sequence[float] = (), by: Sequence[str] = ()) -> DataFrame:
    """nll of events, log loss of labels (focal if asked for), smoothness and their weighted sum, one row for each sequence.

    pos_weight weighs positives of the log loss, not of the focal one. With marks the sizes' mark_nll (size, mu, log_sigma)
    is added, and weight_l2 adds the squares of the parameters.
    """
    from tapeworks.operators.tpp import nll_per_event

    p = F.least(F.greatest(F.col("pred"), F.lit(1e-7)), F.lit(1 - 1e-7))
    hit = F.when(F.col("label") == 1, p).otherwise(1 - p)
    weight = F.when(F.col("label") == 1, F.lit(1.0 if focal else float(pos_weight))).otherwise(1.0)
    cls = df.groupBy(*by).agg(F.avg(-weight * F.pow(1 - hit, F.lit(focal)) * F.log(hit)).alias("cls"))
    parts = [nll_per_event(df, *by), cls, smoothness(df, by=by), *([mark_nll(df, by=by)] if marks else [])]
    out = parts[0]
    for x in parts[1:]:
        out = out.join(x, list(by)) if by else out.join(x)
    loss = F.col("nll") + weight_cls * F.col("cls") + weight_smooth * F.col("smoothness")
    loss = loss + F.col("mark_nll") if marks else loss
    return out.withColumn("loss", loss + weight_l2 * sum(float(x) ** 2 for x in parameters))


def fuse(features: Column, topology: Column, a: float = 1.0, b: float = 1.0) -> Column:
    """a * features + b * topology; a topology of another length is reduced to its mean."""
    mean = F.aggregate(topology, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(topology), F.lit(1))
    same = F.zip_with(features, topology, lambda x, y: a * x + b * y)
    return F.when(F.size(features) == F.size(topology), same).otherwise(F.transform(features, lambda x: a * x + b * mean))


def cross_market(df: DataFrame, features: Sequence[str], label: str, *, market: str = "market", key: str = "idx", split: str = "split") -> DataFrame:
    """mode, market, auroc and brier: one model of all markets, and for each market one of all others."""
    score = lambda model, rows: predict(model, rows, features).select(F.col(key).alias("idx"), "pred", F.col(label).alias("label"))
    row = lambda rows, mode, name: metrics.auroc(rows).join(metrics.brier(rows)).select(F.lit(mode).alias("mode"), F.lit(name).cast("string").alias("market"), "auroc", "brier")
    train, test = df.where(F.col(split) == "train"), df.where(F.col(split) == "test")
    out = row(score(fit_logistic(train, features, label), test), "pooled", None)
    for (name,) in df.select(market).distinct().orderBy(market).collect():  # markets are few: one model is fitted for each
        rest = fit_logistic(train.where(~F.col(market).eqNullSafe(name)), features, label)
        out = out.union(row(score(rest, test.where(F.col(market).eqNullSafe(name))), "held_out", name))
    return out


def topology_search(df: DataFrame, configs: Sequence, label: str, *, chunk_s: float | None = None, key: str = "seq") -> DataFrame:
    """config, windows, vector and auroc on the validation rows of a model of each configuration's vectors alone.

    Vectors of as many configurations as fit MOST_NUMBERS a row are worked out in one pass and written, as fitting reads them several times.
    """
    from tapeworks.operators import topology

    out, parts = None, []
    for i, cfg in enumerate(configs):
        width = cfg.width * len(cfg.windows_s)
        if not parts or sum(w for _, _, w in parts[-1]) + width > MOST_NUMBERS:
            parts.append([])
        parts[-1].append((i, cfg, width))
    rows = df.select(SYMBOL, TS, SEQ, F.col(key).alias("__idx"), F.col(label).alias("__label"), "split")
    for part in parts:
        z = topology.vectors(df, [cfg for _, cfg, _ in part], chunk_s=chunk_s)
        known = stored(rows.join(z, [SYMBOL, TS, SEQ]).select("__idx", "__label", "split", "topology"), "topology-vectors")
        start = 0
        for i, cfg, width in part:
            names = [f"z{j}" for j in range(width)]
            spread = known.withColumns({n: F.get("topology", F.lit(start + j)) for j, n in enumerate(names)})
            start += width
            model = fit_logistic(spread.where("split = 'train'"), names, "__label", max_iter=50)
            scored = predict(model, spread.where("split = 'val'"), names).select(F.col("__idx").alias("idx"), "pred", F.col("__label").alias("label"))
            row = metrics.auroc(scored).select(F.lit(i).alias("config"), F.lit(str(cfg.windows_s)).alias("windows"), F.lit(cfg.vector).alias("vector"), "auroc")
            out = row if out is None else out.union(row)
    return out


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml.classification import LogisticRegressionModel

    return LogisticRegressionModel.load(path)
