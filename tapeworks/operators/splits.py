"""Chronological splits, scaling without leakage, sequence windows, samplers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeworks.operators.windows import in_order
from tapeworks.schema import SYMBOL


def numbered(df: DataFrame, *, by: tuple[str, ...] = (SYMBOL,)) -> DataFrame:
    """rn (from 0) and n_rows of each instrument."""
    return df.withColumns({"rn": F.row_number().over(in_order(*by)).cast("long") - 1, "n_rows": F.count(F.lit(1)).over(W.partitionBy(*by))})


def chronological_split(df: DataFrame, *, train: float = 0.6, val: float = 0.2, by: tuple[str, ...] = (SYMBOL,)) -> DataFrame:
    """split: train up to int(train T), val up to int((train + val) T), then test."""
    df = numbered(df, by=by)
    a, b = F.floor(F.col("n_rows") * train), F.floor(F.col("n_rows") * (train + val))
    return df.withColumn("split", F.when(F.col("rn") < a, "train").when(F.col("rn") < b, "val").otherwise("test"))


def walk_forward_splits(df: DataFrame, folds: int = 3, *, train: float = 0.6, by: tuple[str, ...] = (SYMBOL,)) -> DataFrame:
    """A copy of each row for every fold it takes part in: train is all before, then half a segment each of val and test."""
    df = numbered(df, by=by).withColumn("__base", F.floor(F.col("n_rows") * train))
    df = df.withColumn("__seg", F.greatest(F.lit(1), F.floor((F.col("n_rows") - F.col("__base")) / folds)))
    df = df.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    start = F.col("__base") + F.col("fold") * F.col("__seg")
    mid = start + F.floor(F.col("__seg") / 2)
    stop = F.least(start + F.col("__seg"), F.col("n_rows"))
    name = F.when(F.col("rn") < start, "train").when(F.col("rn") < mid, "val").when(F.col("rn") < stop, "test")
    return df.withColumn("split", name).where(F.col("split").isNotNull()).drop("__base", "__seg")


def fit_scaler(train: DataFrame, columns: Sequence[str], *, by: Sequence[str] = ()) -> DataFrame:
    """mean_<c> and std_<c> (of the population; 0 becomes 1) of the training rows, over all or for each of `by`."""
    stats = []
    for c in columns:
        sd = F.stddev_pop(c)
        stats += [F.avg(c).alias(f"mean_{c}"), F.when(sd > 0, sd).otherwise(1.0).alias(f"std_{c}")]
    return train.groupBy(*by).agg(*stats) if by else train.agg(*stats)


def scale(df: DataFrame, scaler: DataFrame, columns: Sequence[str], *, by: Sequence[str] = ()) -> DataFrame:
    """Columns less their mean, by their standard deviation. A scaler for all rows is one row."""
    joined = df.join(scaler, list(by), "left") if by else df.crossJoin(F.broadcast(scaler))
    joined = joined.withColumns({c: (F.col(c) - F.col(f"mean_{c}")) / F.col(f"std_{c}") for c in columns})
    return joined.drop(*[f"{p}_{c}" for p in ("mean", "std") for c in columns])


def sequence_windows(df: DataFrame, columns: Sequence[str], length: int, *, by: tuple[str, ...] = (SYMBOL,)) -> DataFrame:
    """window: the last `length` rows' columns in order, for each row that has so many."""
    w = in_order(*by).rowsBetween(-(length - 1), 0)
    return df.withColumn("window", F.collect_list(F.struct(*columns)).over(w)).where(F.size("window") == length)


def stride_sample(df: DataFrame, stride: int, *, by: tuple[str, ...] = (SYMBOL,)) -> DataFrame:
    """Every stride-th row of each instrument."""
    return numbered(df, by=by).where(F.col("rn") % stride == 0).drop("n_rows")


def balanced_sample(df: DataFrame, label: str, per_class: int, seed: int = 0, *, key: str = "seq") -> DataFrame:
    """per_class rows of each label in a seeded order; a scarce class is repeated until it has as many.

    Parts of a class are ranked on their own and hand on per_class rows at most, so no task holds a class.
    """
    order = F.xxhash64(F.lit(seed), key)
    parts = max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sizes = df.groupBy(F.col(label).alias("__label")).agg(F.count(F.lit(1)).alias("__n"))
    df = df.withColumn("__part", F.pmod(order, F.lit(parts)))
    for within in ([label, "__part"], [label]):
        df = df.withColumn("__r", F.row_number().over(W.partitionBy(*within).orderBy(order, key))).where(F.col("__r") <= per_class)
    df = df.join(sizes, df[label].eqNullSafe(sizes["__label"])).drop("__part", "__label")
    times = F.ceil((F.lit(per_class) - F.col("__r") + 1) / F.col("__n"))
    df = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.greatest(times, F.lit(1)).cast("int") - 1)))
    return df.drop("__r", "__n")


def permuted(df: DataFrame, columns: Sequence[str], seed: int = 0, *, key: str = "seq") -> DataFrame:
    """Columns shuffled against the rest: each column takes the values of a seeded order of the rows.

    Positions are dealt by hash ranges, so neither order needs one task: rows and values meet by rank within a range.
    """
    out = df
    for i, c in enumerate(columns):
        bucket = F.pmod(F.xxhash64(F.lit(f"{seed}/{i}/bucket"), key), F.lit(64))
        w = W.partitionBy("__bucket")
        rows = out.withColumn("__bucket", bucket)
        place = rows.withColumn("__rank", F.row_number().over(w.orderBy(key)))
        value = rows.select("__bucket", F.col(c).alias("__v"), F.row_number().over(w.orderBy(F.xxhash64(F.lit(f"{seed}/{i}"), key), key)).alias("__rank"))
        out = place.join(value, ["__bucket", "__rank"]).withColumn(c, F.col("__v")).drop("__bucket", "__rank", "__v")
    return out.select(*df.columns)


def leave_one_out(df: DataFrame, held: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows of all other keys, rows of the held keys)."""
    return df.join(held.select(key).distinct(), key, "left_anti"), df.join(held.select(key).distinct(), key, "left_semi")
