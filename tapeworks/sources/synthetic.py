"""Generated data: order-flow sequences from a state-dependent Markov chain, training batches, returns."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.functions.ranks import running_totals
from tapeworks.operators.bootstrap import uniform
from tapeworks.schema import EVENT_TYPES
from tapeworks.session import ship


@dataclass(frozen=True)
class Flow:
    """Rates of the chain: market orders lean with the book's imbalance, limit orders against it, cancels follow volume."""

    steps: int = 200
    levels: int = 5
    market: float = 0.5
    limit: float = 2.0
    cancel_per_volume: float = 0.002
    lean_market: float = 0.8
    lean_limit: float = 0.5
    depth_mean: float = 100.0
    depth_cv: float = 0.5
    level_decay: float = 0.6
    size_mean: float = 5.0
    imbalance_levels: int = 5


def chain(cfg: Flow, rng: np.random.Generator) -> pd.DataFrame:
    """step, event_type, dt, size, level, side, and sizes of both sides after each event."""
    n = cfg.levels
    shape = 1 / max(cfg.depth_cv, 1e-6) ** 2
    book = rng.gamma(shape, cfg.depth_mean / shape, (2, n))  # rows: bid, ask
    weight = cfg.level_decay ** np.arange(n)
    weight /= weight.sum()
    rows, k = [], min(cfg.imbalance_levels, n)
    for step in range(cfg.steps):
        b, a = book[:, :k].sum(1)
        i = (b - a) / (b + a + 1e-9)
        lean = np.array([1, -1, -1, 1]) * i * np.repeat([cfg.lean_market, cfg.lean_limit], 2)
        rates = np.concatenate([np.repeat([cfg.market, cfg.limit], 2) * np.maximum(0, 1 + lean), cfg.cancel_per_volume * book.sum(1)]).clip(1e-12)
        dt = rng.exponential(1 / rates.sum())
        kind = int(rng.choice(6, p=rates / rates.sum()))
        level = int(rng.choice(n, p=weight)) if kind >= 2 else 0
        size = rng.exponential(cfg.size_mean)
        # A market order of one sign takes the other side; orders and cancels act on their own.
        side = kind % 2 if kind >= 2 else 1 - kind % 2
        book[side, level] = max(0.0, book[side, level] + (size if kind in (2, 3) else -size))
        rows.append((step, EVENT_TYPES[kind], dt, size, level + 1 if kind >= 2 else 0, "BS"[kind % 2], book[0].tolist(), book[1].tolist()))
    return pd.DataFrame(rows, columns=["step", "event_type", "dt", "size", "level", "side", "bids", "asks"])


def sequences(spark: SparkSession, n: int, cfg: Flow | None = None, seed: int = 0) -> DataFrame:
    """n sequences, one to a group; each has a generator of its own, so results don't depend on partitioning."""

    def run(cfg: Flow, pdf: pd.DataFrame) -> pd.DataFrame:
        at = int(pdf["sequence"].iat[0])
        return chain(cfg, np.random.default_rng([seed, at])).assign(sequence=at)

    schema = "step int, event_type string, dt double, size double, level int, side string, bids array<double>, asks array<double>, sequence long"
    ship(spark)
    return spark.range(n).withColumnRenamed("id", "sequence").groupBy("sequence").applyInPandas(partial(run, cfg or Flow()), schema)


def training_batch(spark: SparkSession, batch: int, steps: int, features: int, topology: int, seed: int = 0) -> DataFrame:
    """sequence, step, features, topology, label of random numbers."""
    rows = spark.range(batch * steps).select((F.col("id") / steps).cast("int").alias("sequence"), (F.col("id") % steps).cast("int").alias("step"), "id")
    noise = lambda n, s: F.array(*[F.randn(seed * 1000 + s + i) for i in range(n)])
    return rows.select("sequence", "step", noise(features, 0).alias("features"), noise(topology, 500).alias("topology"), (F.rand(seed + 7) > 0.5).cast("int").alias("label"))


def with_returns(df: DataFrame, *, alpha: float = 0.8, sigma: float = 0.01, seed: int = 0, order: str = "idx", group: str | None = None, chunk: int = 200_000) -> DataFrame:
    """ret: a first-order autoregression along `order` (distinct numbers), one series for each group, which is one task.

    Noise comes from hashes of group and order. A series of the whole table is dealt to tasks of `chunk` rows; each starts
    as many rows early as it takes for what came before to fall below 1e-17, so |alpha| must be below 1.
    """
    keys = [F.lit(seed), *([F.col(group)] if group else []), F.col(order)]
    draw = lambda k: uniform(F.lit(k), *keys)
    rows, by = df.withColumn("__e", sigma * F.sqrt(-2 * F.log(draw("radius"))) * F.cos(2 * math.pi * draw("angle"))), [group]
    if group is None:
        if abs(alpha) >= 1:
            raise ValueError("a series of the whole table needs |alpha| < 1")
        early = math.ceil(math.log(1e-17) / math.log(abs(alpha))) if alpha else 0
        size, by = max(chunk, early), ["__chunk"]
        rows = running_totals(rows.withColumn("__one", F.lit(1).cast("long")), [order], ["__one"]).withColumnRenamed("before___one", "__at").drop("__one")
        own = F.floor(F.col("__at") / size)
        lead = F.pmod("__at", F.lit(size)) >= size - early
        rows = rows.withColumns({"__own": own, "__chunk": F.explode(F.when(lead, F.array(own, own + 1)).otherwise(F.array(own)))})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable", ignore_index=True)
        out, last = np.zeros(len(pdf)), 0.0
        for i, e in enumerate(pdf["__e"]):
            last = out[i] = alpha * last + e
        return pdf.assign(ret=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", ret double"
    ship(df.sparkSession)
    out = rows.groupBy(*by).applyInPandas(run, schema)
    return (out if group else out.where(F.col("__own") == F.col("__chunk"))).drop("__e", "__at", "__own", "__chunk")
