"""Resampling intervals without collecting rows: weights of every row in every replicate come from hashes.

The independent bootstrap gives a row a Poisson(1) weight; the stationary block bootstrap starts Poisson(1 / L) blocks of
geometric length at each row. Both are the large-sample forms of drawing rows, need no global state, and repeat exactly.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.functions.ranks import PARTS, running_totals
from tapeworks.session import ship, stored

#: Rows whose weights are worked out together, and rows of one range of the ranking, about.
CHUNK, RANGE = 1 << 15, 250_000
#: So many ranges' rows may have one prediction before they are cut on.
MOST = 8
U = np.uint64
P1, P2, P3, P4, P5 = U(0x9E3779B185EBCA87), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0x85EBCA77C2B2AE63), U(0x27D4EB2F165667C5)


def uniform(*keys: Column) -> Column:
    """A number in (0, 1) from a hash of the keys."""
    return (F.pmod(F.xxhash64(*keys), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def poisson_one(u: Column) -> Column:
    """Poisson(1) by inversion, up to 8."""
    out, total, p = F.lit(8), 0.0, float(np.exp(-1))
    cuts = []
    for k in range(8):
        total += p
        cuts.append((k, total))
        p /= k + 1
    for k, c in reversed(cuts):
        out = F.when(u < c, k).otherwise(out)
    return out


def resampled(df: DataFrame, n_boot: int, *, key: str = "idx", seed: int = 0) -> DataFrame:
    """Rows with replicate and weight (above 0)."""
    out = df.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    return out.withColumn("weight", poisson_one(uniform(F.lit(seed), F.col("replicate"), F.col(key)))).where(F.col("weight") > 0)


def block_resampled(df: DataFrame, n_boot: int, length: float, *, order: str = "idx", seed: int = 0) -> DataFrame:
    """Rows with replicate and weight: how many of the replicate's blocks (circular, mean length `length`) hold the row."""
    rows = running_totals(df.withColumn("one", F.lit(1).cast("long")), [order], ["one"]).withColumnRenamed("before_one", "at").drop("one")
    n = rows.agg(F.count(F.lit(1)).alias("__n"))
    p = min(1.0, 1.0 / max(length, 1e-6))
    starts = rows.select("at").withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    u, v = uniform(F.lit(seed), F.lit("start"), F.col("replicate"), F.col("at")), uniform(F.lit(seed), F.lit("length"), F.col("replicate"), F.col("at"))
    starts = starts.where(u < 1 - float(np.exp(-p))).join(F.broadcast(n))
    size = F.lit(1) if p >= 1 else F.ceil(F.log(v) / float(np.log1p(-p)))
    reach = F.least(F.greatest(size, F.lit(1)), F.col("__n"))
    covered = starts.select("replicate", "__n", F.explode(F.sequence(F.col("at"), F.col("at") + reach - 1)).alias("p")).select("replicate", F.pmod("p", "__n").alias("at"))
    weights = covered.groupBy("replicate", "at").agg(F.count(F.lit(1)).alias("weight"))
    return rows.join(weights, "at").drop("at")


def interval(stats: DataFrame, column: str, alpha: float = 0.05) -> DataFrame:
    """n, lo and hi of a statistic over replicates (those without one are left out)."""
    q = F.percentile(column, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    return stats.agg(F.count(column).alias("n"), F.get(q, F.lit(0)).alias("lo"), F.get(q, F.lit(1)).alias("hi"))


def replicate_auroc(weighted: DataFrame) -> DataFrame:
    """replicate and auroc of weighted rows (pred, label); replicates of one class have none."""
    counts = weighted.groupBy("replicate", "pred").agg(F.sum(F.when(F.col("label") == 1, F.col("weight")).otherwise(0)).alias("pos"), F.sum(F.when(F.col("label") == 0, F.col("weight")).otherwise(0)).alias("neg"))
    c = running_totals(counts, ["pred"], ["neg"], by=["replicate"])
    pairs = (F.sum("pos") * F.sum("neg")).cast("double")
    return c.groupBy("replicate").agg(F.when(pairs > 0, F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2)) / pairs).alias("auroc"))


def replicate_auprc(weighted: DataFrame) -> DataFrame:
    """replicate and auprc: average precision of weighted rows."""
    counts = weighted.groupBy("replicate", "pred").agg(F.sum(F.when(F.col("label") == 1, F.col("weight")).otherwise(0)).alias("pos"), F.sum("weight").alias("all"))
    c = running_totals(counts, ["pred"], ["pos", "all"], by=["replicate"])
    totals = counts.groupBy("replicate").agg(F.sum("pos").alias("__p"), F.sum("all").alias("__n"))
    c = c.join(totals, "replicate")
    precision = (F.col("__p") - F.col("before_pos")) / (F.col("__n") - F.col("before_all"))
    return c.groupBy("replicate").agg(F.when(F.first("__p") > 0, F.sum(F.col("pos") * precision) / F.first("__p")).alias("auprc"))


def replicate_ece(weighted: DataFrame, bins: int = 15) -> DataFrame:
    """replicate and ece over bins of equal weight."""
    rows = running_totals(weighted.select("replicate", "pred", "idx", "label", "weight"), ["pred", "idx"], ["weight"], by=["replicate"])
    rows = rows.join(weighted.groupBy("replicate").agg(F.sum("weight").alias("__n")), "replicate")
    at = F.least(F.floor((F.col("before_weight") + F.col("weight") / 2) * bins / F.col("__n")), F.lit(bins - 1))
    each = rows.groupBy("replicate", at.alias("bin")).agg(F.sum("weight").alias("w"), F.sum(F.col("weight") * (F.col("label") - F.col("pred"))).alias("gap"))
    return each.groupBy("replicate").agg((F.sum(F.abs("gap")) / F.sum("w")).alias("ece"))


def auroc_interval(df: DataFrame, n_boot: int = 200, *, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    return interval(replicate_auroc(resampled(df.select("idx", "pred", "label"), n_boot, seed=seed)), "auroc", alpha)


def mean_interval(df: DataFrame, column: str, n_boot: int = 200, *, key: str = "idx", alpha: float = 0.05, seed: int = 0) -> DataFrame:
    w = resampled(df.select(key, column), n_boot, key=key, seed=seed)
    return interval(w.groupBy("replicate").agg((F.sum(F.col(column) * F.col("weight")) / F.sum("weight")).alias("mean")), "mean", alpha)


def _uniform_longs(at: np.ndarray, before: np.uint64) -> np.ndarray:
    """What uniform() gives for keys that end in the longs `at`; `before` is xxhash64 of the keys before them."""
    turned = lambda x, k: (x << U(k)) | (x >> U(64 - k))
    h = (turned(at.astype(U) * P2, 31) * P1) ^ (np.array([before]) + P5 + U(8))
    h = turned(h, 27) * P1 + P4
    h = (h ^ (h >> U(33))) * P2
    h = (h ^ (h >> U(29))) * P3
    h ^= h >> U(32)
    return ((h & U((1 << 52) - 1)).astype(float) + 0.5) / float(1 << 52)


class BlockWeights:
    """The weights of block_resampled, for any stretch of positions on its own.

    A block is no longer than `reach`, the length that the smallest number of uniform() gives, so the blocks that hold a
    position start at most so far before it.
    """

    def __init__(self, n: int, length: float, keys: list[tuple[int, int]]):
        """keys: for each replicate, xxhash64 of what is hashed before a position, for starts and for lengths."""
        p = min(1.0, 1.0 / max(length, 1e-6))
        self.n, self.cut, self.step = n, 1 - float(np.exp(-p)), None if p >= 1 else float(np.log1p(-p))
        self.keys = np.array(keys, np.int64).reshape(-1, 2).view(U)
        self.reach = max(1, min(n, 1 if self.step is None else int(np.ceil(np.log(0.5 / (1 << 52)) / self.step)) + 1))
        self.chunk = max(CHUNK, self.reach)
        #: A position is in `reach` blocks of a replicate at most.
        self.kind = np.dtype(np.uint16 if self.reach < 1 << 16 else np.uint32)

    def stretch(self, first: int, size: int) -> np.ndarray:
        """Weights of positions first, first + 1, ...: a row for each position, a column for each replicate."""
        halo = self.reach - 1
        at = np.arange(first - halo, first + size, dtype=np.int64) % self.n
        out = np.empty((size, len(self.keys)), self.kind)
        for r, (start, long) in enumerate(self.keys):
            begins = np.flatnonzero(_uniform_longs(at, start) < self.cut)
            span = np.ones(len(begins)) if self.step is None else np.ceil(np.log(_uniform_longs(at[begins], long)) / self.step)
            ends = np.minimum(begins + np.clip(span, 1, self.reach).astype(np.int64), len(at))
            change = np.bincount(begins, minlength=len(at) + 1) - np.bincount(ends, minlength=len(at) + 1)
            out[:, r] = np.cumsum(change[:-1])[halo:]
        return out


def _places(pred: np.ndarray, null: np.ndarray, at: np.ndarray, cuts: np.ndarray, n: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """outer, inner and tie: ranges of the order (pred, at), nulls first and NaN last. All rows of a tie's outer range have one prediction."""
    below, through = np.searchsorted(cuts, pred, "left"), np.searchsorted(cuts, pred, "right")
    outer, tie = below + through, through - below > 1
    nan = np.isnan(pred) & ~null
    outer, tie = np.where(null, -1, np.where(nan, 2 * len(cuts) + 1, outer)), tie | null | nan
    # A prediction of many ranges' rows is cut on by position, into fewer parts: at most MOST ranges' rows are in one, and not each of many ties is cut.
    inner = np.where(through - below >= MOST, at * max(1, parts // MOST) // n, 0)
    return outer.astype(np.int32), np.where(null | nan, at * parts // n, inner).astype(np.int32), tie


def _doubles(column) -> tuple[np.ndarray, np.ndarray]:
    null = column.is_null().to_numpy(zero_copy_only=False)
    return np.where(null, np.nan, column.to_numpy(zero_copy_only=False)).astype(float), null


def _dealt(blocks: BlockWeights, cuts: np.ndarray, parts: int, table):
    """Rows of a chunk with their range and weights."""
    import pyarrow as pa

    at = table["at"].to_numpy(zero_copy_only=False)
    (pred, null), (label, _) = (_doubles(table[c].combine_chunks()) for c in ("pred", "label"))
    first = int(at[0]) // blocks.chunk * blocks.chunk
    weights = blocks.stretch(first, min(blocks.chunk, blocks.n - first))[at - first]
    return pa, table, at, pred, null, label, weights, _places(pred, null, at, cuts, blocks.n, parts)


def _range_totals(blocks: BlockWeights, cuts: np.ndarray, parts: int, table):
    """Of each range, the chunk's weights of positives, of negatives and of all rows."""
    pa, _, _, _, _, label, weights, (outer, inner, tie) = _dealt(blocks, cuts, parts, table)
    order = np.lexsort((inner, outer))
    o, i = outer[order], inner[order]
    begin = np.flatnonzero(np.append(True, (o[1:] != o[:-1]) | (i[1:] != i[:-1])))
    sums = [np.add.reduceat(np.where(of[order, None], weights[order], 0).astype(np.int64), begin) for of in (label == 1, label == 0, np.ones(len(label), bool))]
    return pa.table({"outer": o[begin], "inner": i[begin], "tie": tie[order][begin], **{c: pa.array(list(x), pa.list_(pa.int64())) for c, x in zip(("pos", "neg", "all"), sums, strict=True)}})


def _sum_totals(table):
    import pyarrow as pa

    sums = {c: [np.stack(table[c].to_pandas().to_list()).sum(0)] for c in ("pos", "neg", "all")}
    return pa.table({c: table[c][:1] for c in ("outer", "inner", "tie")} | {c: pa.array(x, pa.list_(pa.int64())) for c, x in sums.items()})


def _to_ranges(blocks: BlockWeights, cuts: np.ndarray, parts: int, table):
    pa, table, _, _, _, _, weights, (outer, inner, _) = _dealt(blocks, cuts, parts, table)
    pieces = []
    for i in range(0, len(weights), CHUNK):  # the bytes of one array stay below 2 GB
        w = np.ascontiguousarray(weights[i : i + CHUNK])
        ends = np.arange(len(w) + 1, dtype=np.int32) * np.int32(w.shape[1] * w.itemsize)
        pieces.append(pa.Array.from_buffers(pa.binary(), len(w), [None, pa.py_buffer(ends), pa.py_buffer(w)]))
    return pa.table({"outer": outer, "inner": inner, "at": table["at"], "pred": table["pred"], "label": table["label"], "w": pa.chunked_array(pieces, pa.binary())})


def _range_scores(kind: np.dtype, bins: int, before: dict, whole: np.ndarray, key, table):
    """For each replicate and bin of the calibration error, what one range adds to the metrics' sums (those without bins are in bin 0).

    before: of each range the totals of what comes before and, for ties, those of the outer range, in its first inner one.
    whole: totals of all rows. Totals are rows (positives, negatives, all) of one column for each replicate.
    """
    import pyarrow as pa

    ahead, tie, equal = before[key[0].as_py(), key[1].as_py()]
    boot = whole.shape[1]
    at = table["at"].to_numpy()
    (pred, null), (label, no_label) = (_doubles(table[c].combine_chunks()) for c in ("pred", "label"))
    rows = [np.frombuffer(c.buffers()[2], kind)[c.offset * boot : (c.offset + len(c)) * boot].reshape(-1, boot) for c in table["w"].chunks if len(c)]
    order = np.lexsort((at, pred))
    pred, label, weights, known = pred[order], label[order], np.concatenate(rows)[order], ~(null | no_label)[order]
    begin = np.flatnonzero(np.append(True, pred[1:] != pred[:-1])) if not tie else np.zeros(1, np.int64)
    miss = np.where(known, label - pred, 0.0)
    one, zero = label == 1, label == 0
    out = []
    for r in range(boot):
        w = weights[:, r].astype(float)
        p, n, a = whole[:, r].astype(float)
        if not tie:
            pos, neg, both = (np.add.reduceat(x, begin) for x in (w * one, w * zero, w))
        else:
            pos, neg, both = (np.zeros(1),) * 3 if equal is None else (x[r : r + 1].astype(float) for x in equal)
        to = [ahead[k, r] + np.cumsum(x) - x for k, x in enumerate((pos, neg, both))]
        some = pos > 0
        wins = (pos * (to[1] + neg / 2))[some].sum()
        precise = (pos[some] * ((p - to[0][some]) / (a - to[2][some]))).sum()
        mine = w > 0
        bin_ = np.minimum(np.floor((ahead[2, r] + np.cumsum(w) - w + w / 2)[mine] * bins / max(a, 1.0)), bins - 1).astype(np.int64)
        first = np.zeros((bins, 4))
        missed = w[mine] * miss[mine]
        first[0] = wins, precise, (missed * miss[mine]).sum(), w[known].sum()
        out.append(np.column_stack([np.full(bins, r), np.arange(bins), np.bincount(bin_, w[mine], bins), np.bincount(bin_, missed, bins), first]))
    out = np.concatenate(out)
    names = ("w", "gap", "wins", "precise", "square", "known")
    return pa.table({"replicate": out[:, 0].astype(np.int32), "bin": out[:, 1].astype(np.int32), **{c: out[:, 2 + k] for k, c in enumerate(names)}})


def block_metrics(df: DataFrame, length: float, n_boot: int = 200, *, order: str = "idx", bins: int = 15, seed: int = 0) -> DataFrame:
    """replicate, auroc, auprc, brier and ece of rows (idx, pred, label) with the weights of block_resampled; null where there is none.

    Rows are numbered once and never multiplied by replicates: one row carries its weights of all of them. Ranges of the
    order of predictions are ranked on their own, behind the totals of the ranges before, which are the driver's only rows.
    """
    spark = df.sparkSession
    ship(spark)
    rows = df.select(order, F.col("pred").cast("double").alias("pred"), F.col("label").cast("double").alias("label"), F.lit(1).cast("long").alias("one"))
    rows = stored(running_totals(rows, [order], ["one"]).select(F.col("before_one").alias("at"), "pred", "label"), "bootstrap-rows")
    n = rows.count()
    parts = min(2000, max(PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")), n // RANGE))
    cuts = rows.agg(F.array_sort(F.percentile_approx(F.when(~F.isnan("pred"), F.col("pred")), F.array(*[F.lit(i / parts) for i in range(1, parts)]), max(1000, 10 * parts)))).first()[0]
    cuts = np.array(cuts or [], float)
    hashed = lambda name: [F.xxhash64(F.lit(seed), F.lit(name), F.lit(r)) for r in range(n_boot)]
    keys = spark.range(1).select(F.array(*hashed("start")), F.array(*hashed("length"))).first()
    blocks = BlockWeights(n, length, list(zip(*keys, strict=True)))
    chunks = rows.groupBy(F.floor(F.col("at") / blocks.chunk).alias("chunk"))
    totals = chunks.applyInArrow(partial(_range_totals, blocks, cuts, parts), "outer int, inner int, tie boolean, pos array<long>, neg array<long>, all array<long>")
    totals = totals.groupBy("outer", "inner").applyInArrow(_sum_totals, totals.schema).collect()  # a row for each range
    before, so_far, ties = {}, np.zeros((3, n_boot), np.int64), {}
    for x in totals:
        if x["tie"]:
            ties[x["outer"]] = ties.get(x["outer"], 0) + np.array([x["pos"], x["neg"], x["all"]])
    for x in sorted(totals, key=lambda x: (x["outer"], x["inner"])):
        before[x["outer"], x["inner"]] = so_far, x["tie"], ties.pop(x["outer"], None)
        so_far = so_far + np.array([x["pos"], x["neg"], x["all"]])
    dealt = chunks.applyInArrow(partial(_to_ranges, blocks, cuts, parts), "outer int, inner int, at long, pred double, label double, w binary")
    scores = dealt.groupBy("outer", "inner").applyInArrow(partial(_range_scores, blocks.kind, bins, before, so_far), "replicate int, bin int, w double, gap double, wins double, precise double, square double, known double")
    each = scores.groupBy("replicate", "bin").agg(*[F.sum(c).alias(c) for c in ("w", "gap", "wins", "precise", "square", "known")])
    sums = each.groupBy("replicate").agg(F.sum(F.abs("gap")).alias("gap"), *[F.sum(c).alias(c) for c in ("w", "wins", "precise", "square", "known")])
    pairs, positives = (F.get(F.array(*[F.lit(float(v)) for v in x]), "replicate") for x in (so_far[0].astype(float) * so_far[1], so_far[0]))
    has = F.col("known") > 0
    return sums.select(
        "replicate", F.when(pairs > 0, F.col("wins") / pairs).alias("auroc"), F.when(positives > 0, F.col("precise") / positives).alias("auprc"),
        F.when(has, F.col("square") / F.col("w")).alias("brier"), F.when(has, F.col("gap") / F.col("w")).alias("ece"),
    )


def block_metric_intervals(df: DataFrame, length: float, n_boot: int = 200, *, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """metric, n, lo and hi of AUROC, AUPRC, Brier score and ECE under the block bootstrap."""
    stats = stored(block_metrics(df, length, n_boot, seed=seed), "bootstrap-metrics")
    out = None
    for name in ("auroc", "auprc", "brier", "ece"):
        row = interval(stats, name, alpha).select(F.lit(name).alias("metric"), "*")
        out = row if out is None else out.union(row)
    return out


def block_var_es_intervals(df: DataFrame, length: float = 50.0, n_boot: int = 200, *, level: float = 0.99, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """metric, n, lo and hi of VaR and ES of `ret`: weighted quantiles of the loss in each replicate."""
    w = block_resampled(df.select("idx", "ret"), n_boot, length, seed=seed).withColumn("loss", -F.col("ret"))
    bound = w.groupBy("replicate").agg(F.percentile("loss", level, F.col("weight")).alias("var"))
    es = w.join(bound, "replicate").groupBy("replicate").agg(F.first("var").alias("var"), (F.sum(F.when(F.col("loss") >= F.col("var"), F.col("loss") * F.col("weight"))) / F.sum(F.when(F.col("loss") >= F.col("var"), F.col("weight")))).alias("es"))
    return interval(es, "var", alpha).select(F.lit("var").alias("metric"), "*").union(interval(es, "es", alpha).select(F.lit("es").alias("metric"), "*"))


def stationary_block_indices(n: int, length: float, rng: np.random.Generator) -> np.ndarray:
    """Indices of one stationary bootstrap sample of a small series: circular blocks of geometric length."""
    p = min(1.0, 1.0 / max(length, 1e-6))
    fresh = rng.random(n) < p
    fresh[0] = True
    starts = rng.integers(0, n, n)
    at = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    return (starts[at] + np.arange(n) - at) % n
