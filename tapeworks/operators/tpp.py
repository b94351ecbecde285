"""Temporal point processes: likelihood, rescaled times, goodness of fit, Hawkes baselines.

Rows are (rn, lam, m, dt): order, intensities of each type, the type that happened (from 0) and seconds since the row before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeworks.functions.ranks import running_totals


def total(lam: str = "lam"):
    return F.aggregate(lam, F.lit(0.0), lambda a, x: a + x)


def nll_per_event(df: DataFrame, *by: str) -> DataFrame:
    """nll: mean of -log intensity of what happened plus the integrated intensity."""
    here = F.greatest(F.get("lam", F.col("m")), F.lit(1e-12))
    return df.groupBy(*by).agg(((-F.sum(F.log(here)) + F.sum(total() * F.col("dt"))) / F.count(F.lit(1))).alias("nll"))


def rescaled_times(df: DataFrame) -> DataFrame:
    """xi: total intensity times dt, exponential of mean 1 under the model."""
    return df.withColumn("xi", total() * F.col("dt"))


def rescaled_times_per_type(df: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """xi: integral of the row's own type's intensity since the last row of that type (from the start for the first)."""
    wide = df.select(*by, "rn", "m", "dt", F.posexplode("lam").alias("__type", "__lam")).withColumn("__area", F.col("__lam") * F.col("dt"))
    if by:
        w = W.partitionBy(*by, "__type").orderBy("rn").rowsBetween(W.unboundedPreceding, -1)
        wide = wide.withColumn("before___area", F.coalesce(F.sum("__area").over(w), F.lit(0.0)))
    else:
        # One series: areas are summed range by range, not in one task for each type.
        wide = running_totals(wide, ["rn"], ["__area"], by=["__type"])
    area = wide.where(F.col("__type") == F.col("m"))
    if by:
        last = F.coalesce(F.lag("before___area").over(W.partitionBy(*by, "m").orderBy("rn")), F.lit(0.0))
        return area.select(*by, "rn", "m", (F.col("before___area") - last).alias("xi"))
    at = running_totals(area.select("rn", "m", "before___area").withColumn("__one", F.lit(1).cast("long")), ["rn"], ["__one"], by=["m"])
    before = at.select("m", (F.col("before___one") + 1).alias("before___one"), F.col("before___area").alias("__last"))
    return at.join(before, ["m", "before___one"], "left").select("rn", "m", (F.col("before___area") - F.coalesce("__last", F.lit(0.0))).alias("xi"))


def type_frequencies(df: DataFrame) -> DataFrame:
    """m, empirical share of rows and the model's share of integrated intensity."""
    n = df.groupBy("m").agg(F.count(F.lit(1)).alias("n"))
    model = df.select(F.posexplode("lam").alias("m", "l")).groupBy("m").agg(F.sum("l").alias("mass"))
    both = model.join(n, "m", "left")
    sums = both.agg(F.sum("n").alias("__n"), F.sum("mass").alias("__mass"))
    return both.join(F.broadcast(sums)).select("m", (F.coalesce("n", F.lit(0)) / F.col("__n")).alias("empirical"), (F.col("mass") / F.col("__mass")).alias("model"))


def ks_uniform(df: DataFrame, u: str = "u", key: str = "rn") -> DataFrame:
    """n and the Kolmogorov-Smirnov distance ks of u from the uniform distribution."""
    rows = running_totals(df.select(F.col(u).alias("u"), key).withColumn("one", F.lit(1).cast("long")), ["u", key], ["one"])
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    i = F.col("before_one")
    return rows.join(F.broadcast(n)).agg(F.first("n").alias("n"), F.max(F.greatest((i + 1) / F.col("n") - F.col("u"), F.col("u") - i / F.col("n"))).alias("ks"))


def kolmogorov_p(ks: float, n: int) -> float:
    """Asymptotic upper tail of the distance."""
    import math

    if n <= 0:
        return float("nan")
    lam = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * ks
    if lam < 0.2:
        return 1.0
    return max(0.0, min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 101))))


def diagnostics(df: DataFrame) -> DataFrame:
    """One row: mean rescaled time, KS distance of 1 - exp(-xi) and coverage error of the type shares."""
    xi = rescaled_times(df).withColumn("u", 1 - F.exp(-F.col("xi")))
    freq = type_frequencies(df).agg(F.sum(F.abs(F.col("empirical") - F.col("model"))).alias("coverage_error"))
    return xi.agg(F.avg("xi").alias("mean_xi")).join(ks_uniform(xi)).join(freq)


def confusion(df: DataFrame) -> DataFrame:
    """actual, predicted (type of the largest intensity, the first of equals) and n."""
    guess = F.array_position("lam", F.array_max("lam")).cast("int") - 1
    return df.groupBy(F.col("m").alias("actual"), guess.alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def type_scores(df: DataFrame) -> DataFrame:
    """m, precision, recall and f1 of each type."""
    c = confusion(df)
    types = c.select(F.explode(F.array("actual", "predicted")).alias("m")).distinct()
    hit = c.where(F.col("actual") == F.col("predicted")).select(F.col("actual").alias("m"), F.col("n").alias("hit"))
    rows, cols = c.groupBy(F.col("actual").alias("m")).agg(F.sum("n").alias("a")), c.groupBy(F.col("predicted").alias("m")).agg(F.sum("n").alias("p"))
    j = types.join(hit, "m", "left").join(rows, "m", "left").join(cols, "m", "left").na.fill(0)
    ratio = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    j = j.select("m", ratio(F.col("hit"), F.col("p")).alias("precision"), ratio(F.col("hit"), F.col("a")).alias("recall"))
    return j.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def mass_histogram(df: DataFrame, bins: int = 10) -> DataFrame:
    """type, bin and n: histogram of each type's share of the intensity; the last bin is closed. n_events counts rows of that type."""
    share = df.select("m", total().alias("__t"), F.posexplode("lam").alias("type", "l")).where(F.col("__t") > 0)
    share = share.withColumn("bin", F.least(F.floor(F.col("l") / F.col("__t") * bins), F.lit(bins - 1)).cast("int"))
    return share.groupBy("type", "bin").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("m") == F.col("type")).alias("n_events"))


def poisson_rates(df: DataFrame) -> DataFrame:
    """m and its constant rate: events by total time."""
    time = df.agg(F.sum("dt").alias("__t"))
    return df.groupBy("m").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(time)).select("m", F.when(F.col("__t") > 0, F.col("n") / F.col("__t")).otherwise(0.0).alias("rate"))


def hawkes_normal_equations(df: DataFrame, decays: Sequence[str], target: str) -> DataFrame:
    """One row: sums of products of the decayed counts (with an intercept) and with the target, for least squares."""
    x = [F.lit(1.0), *[F.col(c) for c in decays]]
    cols = [F.sum(x[i] * x[j]).alias(f"xx_{i}_{j}") for i in range(len(x)) for j in range(i + 1)]
    return df.agg(*cols, *[F.sum(x[i] * F.col(target)).alias(f"xy_{i}") for i in range(len(x))])


def solve_least_squares(row, k: int) -> list[float]:
    """Coefficients, not below 0, from one row of normal equations of k columns."""
    import numpy as np

    a = np.array([[row[f"xx_{max(i, j)}_{min(i, j)}"] for j in range(k)] for i in range(k)])
    return np.clip(np.linalg.lstsq(a, np.array([row[f"xy_{i}"] for i in range(k)]), rcond=None)[0], 0, None).tolist()
