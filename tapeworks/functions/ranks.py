"""Running totals over a global order without one global window."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PARTS = 64
#: Accuracy of the approximate quantiles around a place, and how far from it they are taken.
ACCURACY, SPAN = 20_000, 2e-4


def running_totals(df: DataFrame, order: Sequence[str], sums: Sequence[str], *, by: Sequence[str] = (), parts: int = PARTS) -> DataFrame:
    """before_<s>: sum of s over all rows that come before in `order` (within `by`), which must be a total order.

    The first order column is cut at approximate quantiles; each range sums on its own, and the totals of the ranges (for
    each group) are added, so no single task holds the order. A value with more than a range's share is a range of its own,
    cut on at quantiles of the second column. There are as many ranges as the session has shuffle partitions, and at least
    `parts`. Order columns must be numbers.
    """
    parts = max(parts, min(2000, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    quantiles = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    cut_at = lambda c: F.array_sort(F.percentile_approx(c, quantiles, max(1000, 10 * parts)))
    cuts = df.agg(cut_at(order[0]).alias("__cuts"), *[cut_at(c).alias("__inner") for c in order[1:2]])
    rows = df.join(F.broadcast(cuts))
    # Rows below, at and above each cut are told apart.
    place = lambda array, c, strict: F.coalesce(F.size(F.filter(array, lambda x: x < F.col(c) if strict else x <= F.col(c))), F.lit(0))
    rows = rows.withColumn("__outer", place("__cuts", order[0], True) + place("__cuts", order[0], False))
    if len(order) > 1:
        often = F.size(F.filter("__cuts", lambda x: x == F.col(order[0]))) > 1
        rows = rows.withColumn("__inner", F.when(often, place("__inner", order[1], True)).otherwise(0))
    else:
        rows = rows.withColumn("__inner", F.lit(0))
    rows = rows.withColumn("__range", F.struct("__outer", "__inner")).drop("__cuts", "__outer", "__inner")
    totals = rows.groupBy(*by, "__range").agg(*[F.sum(s).alias(f"__t_{s}") for s in sums])
    behind = W.partitionBy(*by).orderBy("__range") if by else W.partitionBy(F.lit(0)).orderBy("__range")
    offsets = totals.select(*by, "__range", *[F.coalesce(F.sum(f"__t_{s}").over(behind.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(f"__o_{s}") for s in sums])
    w = W.partitionBy(*by, "__range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({f"__l_{s}": F.coalesce(F.sum(s).over(w), F.lit(0)) for s in sums})
    rows = rows.join(offsets if by else F.broadcast(offsets), [*by, "__range"])
    rows = rows.withColumns({f"before_{s}": F.col(f"__l_{s}") + F.col(f"__o_{s}") for s in sums})
    return rows.drop("__range", *[f"__{a}_{s}" for a in "lo" for s in sums])


def quantiles(df: DataFrame, column: Column, probs: Sequence[float], *, by: Sequence[str] = ()) -> DataFrame:
    """q: the exact quantiles of a numeric column, linear between rows, in one row (for each group); null without values.

    Approximate quantiles on both sides of each place cut the values into ranges, whose sizes are counted. Only the
    ranges that hold a wanted place are sorted, SPAN * 2 of the rows each or nearly so; the cuts don't change the result.
    """
    rows = df.select(*by, column.cast("double").alias("__v")).where(F.col("__v").isNotNull())
    ends = [min(1.0, max(0.0, p + side)) for p in probs for side in (-SPAN, SPAN)]
    cuts = rows.groupBy(*by).agg(F.percentile_approx("__v", F.array(*map(F.lit, ends)), ACCURACY).alias("__cuts"), F.count(F.lit(1)).alias("__t"))
    rows = rows.join(cuts, list(by)) if by else rows.join(F.broadcast(cuts))
    above = [(F.col("__v") > F.get("__cuts", F.lit(i))).cast("int") + (F.col("__v") >= F.get("__cuts", F.lit(i))).cast("int") for i in range(len(ends))]
    rows = rows.withColumn("__r", sum(above[1:], above[0])).drop("__cuts")
    sizes = rows.groupBy(*by, "__r", "__t").agg(F.count(F.lit(1)).alias("n"))
    behind = (W.partitionBy(*by) if by else W.partitionBy(F.lit(0))).orderBy("__r").rowsBetween(W.unboundedPreceding, -1)
    at = [(F.col("__t") - 1) * F.lit(float(p)) for p in probs]
    holds = lambda k: (F.col("__o") <= k) & (k < F.col("__o") + F.col("n"))
    wanted = sizes.withColumn("__o", F.coalesce(F.sum("n").over(behind), F.lit(0))).where(reduce(or_, [holds(f(a)) for a in at for f in (F.floor, F.ceil)])).select(*by, "__r", "__o")
    held = rows.join(wanted if by else F.broadcast(wanted), [*by, "__r"]).groupBy(*by, "__r", "__o", "__t", "__v").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy(*by, "__r").orderBy("__v").rowsBetween(W.unboundedPreceding, -1)
    held = held.withColumn("__o", F.col("__o") + F.coalesce(F.sum("n").over(before), F.lit(0)))
    value = lambda k: F.max(F.when(holds(k), F.col("__v")))
    found = held.groupBy(*by).agg(F.first("__t").alias("__t"), *[value(f(a)).alias(f"__{n}{i}") for i, a in enumerate(at) for n, f in (("a", F.floor), ("b", F.ceil))])
    mixed = [F.when(F.floor(a) == F.ceil(a), F.col(f"__a{i}")).otherwise((F.ceil(a) - a) * F.col(f"__a{i}") + (a - F.floor(a)) * F.col(f"__b{i}")) for i, a in enumerate(at)]
    return found.select(*by, F.array(*mixed).alias("q"))
