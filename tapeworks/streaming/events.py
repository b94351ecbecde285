"""Structured Streaming: late events, live state of each instrument, windowed counts, sinks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tapeworks.operators.features import SMALL
from tapeworks.schema import NS, SEQ, SYMBOL, TS, instant
from tapeworks.session import ship


def monotonic(stream: DataFrame) -> DataFrame:
    """Events of each symbol that aren't older than the newest accepted one, in order of arrival (seq) across batches."""
    schema = stream.schema

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest = state.get[0] if state.exists else np.iinfo(np.int64).min
        # A symbol's rows of one micro-batch may come in several Arrow batches.
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(SEQ, kind="stable", ignore_index=True)
        ts = pdf[TS].to_numpy(np.int64)
        before = np.maximum.accumulate(np.concatenate([[newest], ts]))[:-1]
        state.update((int(max(newest, ts.max())),))
        yield pdf[ts >= before]

    ship(stream.sparkSession)
    return stream.groupBy(SYMBOL).applyInPandasWithState(keep, schema, "newest long", "append", GroupStateTimeout.NoTimeout)


def live_features(stream: DataFrame, types: tuple[str, ...], tau_s: float = 1.0) -> DataFrame:
    """Per event: dt, how many events so far, decayed counts of all and of each type. State: last time and the counts.

    Events of a symbol are taken in time order within a micro-batch; put `monotonic` before it.
    """
    fields = ["n", "ewm_all", *[f"ewm_{i}" for i in range(len(types))]]
    names = {f"ewm_{i}": f"ewm_{t}" for i, t in enumerate(types)}
    symbol = stream.schema[SYMBOL].dataType.simpleString()
    schema = f"{SYMBOL} {symbol}, {TS} long, {SEQ} long, dt double, n long, ewm_all double" + "".join(f", ewm_{i} double" for i in range(len(types)))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n, *values = state.get if state.exists else (None, 0, 0.0, *[0.0] * len(types))
        pdf = pd.concat(list(batches), ignore_index=True).sort_values([TS, SEQ], kind="stable", ignore_index=True)
        out = []
        for ts, seq, kind in zip(pdf[TS], pdf[SEQ], pdf["event_type"], strict=True):
            dt = (ts - last) / NS if last is not None else 0.0
            decay = float(np.exp(-dt / tau_s))
            values = [v * decay for v in values]
            values[0] += 1
            if kind in types:
                values[1 + types.index(kind)] += 1
            n, last = n + 1, int(ts)
            out.append((key[0], ts, seq, dt, n, *values))
        state.update((last, n, *values))
        yield pd.DataFrame(out, columns=[SYMBOL, TS, SEQ, "dt", *fields])

    held = "last long, n long, ewm_all double" + "".join(f", ewm_{i} double" for i in range(len(types)))
    ship(stream.sparkSession)
    return stream.groupBy(SYMBOL).applyInPandasWithState(step, schema, held, "append", GroupStateTimeout.NoTimeout).withColumnsRenamed(names)


def live_book(stream: DataFrame, levels: int) -> DataFrame:
    """Per event: mid, ret_1 (log return since the event before) and the queue ages qage_b_l and qage_a_l of each level.

    As `features.queue_age` has it, an age is the time since size or price of the level changed; a price that isn't there
    and an instrument's first event restart it. State: last mid, and size, price and restart of each level.
    Events of a symbol are taken in time order within a micro-batch; put `monotonic` before it.
    """
    places = [(side, i) for side in ("bid", "ask") for i in range(1, levels + 1)]
    ages = [f"qage_{side[0]}_{i}" for side, i in places]
    symbol = stream.schema[SYMBOL].dataType.simpleString()
    schema = f"{SYMBOL} {symbol}, {TS} long, {SEQ} long, mid double, ret_1 double" + "".join(f", {a} double" for a in ages)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches), ignore_index=True).sort_values([TS, SEQ], kind="stable", ignore_index=True)
        fresh, ts = not state.exists, pdf[TS].to_numpy(np.int64)
        held = iter([None] * (1 + 3 * len(places)) if fresh else state.get)
        best = pdf[["bid_price_1", "ask_price_1"]].astype(float).fillna(0.0)
        mid = ((best["bid_price_1"] + best["ask_price_1"]) / 2).to_numpy()
        logs, last = np.log(np.maximum(mid, SMALL)), next(held)
        out = {TS: ts, SEQ: pdf[SEQ], "mid": mid, "ret_1": np.diff(logs, prepend=logs[0] if fresh else np.log(max(last, SMALL)))}
        keep = [float(mid[-1])]
        for (side, i), name in zip(places, ages, strict=True):
            size, price = (pdf[f"{side}_{what}_{i}"].to_numpy(float) for what in ("size", "price"))
            was_size, was_price, restart = next(held), next(held), next(held)
            moved = lambda x, was: ~np.isclose(x, np.concatenate([[was], x[:-1]]), rtol=0, atol=0, equal_nan=True)
            changed = moved(size, np.nan if was_size is None else was_size) | moved(price, np.nan if was_price is None else was_price) | np.isnan(price)
            changed[0] |= fresh
            since = np.maximum.accumulate(np.where(changed, np.arange(len(ts)), -1))
            start = np.where(since >= 0, ts[since], ts[0] if fresh else restart)
            out[name] = (ts - start) / NS
            keep += [*(None if np.isnan(x[-1]) else float(x[-1]) for x in (size, price)), int(start[-1])]
        state.update(tuple(keep))
        yield pd.DataFrame({SYMBOL: key[0], **out})

    held = "mid double" + "".join(f", s_{a} double, p_{a} double, t_{a} long" for a in ages)
    ship(stream.sparkSession)
    return stream.groupBy(SYMBOL).applyInPandasWithState(step, schema, held, "append", GroupStateTimeout.NoTimeout)


def with_end(rows: DataFrame, after_s: float) -> DataFrame:
    """rows and one more without a symbol, after_s later than the last: landed as the last of a stream that ends, it moves
    the watermark past all windows and sessions of the others, which would stay open for ever. A longer gap than theirs is needed.
    """
    last = rows.agg((F.max(TS) + int(after_s * NS)).alias(TS)).where(F.col(TS).isNotNull())
    return rows.unionByName(last, allowMissingColumns=True)


def windowed_counts(stream: DataFrame, width: str, slide: str | None = None, *, late: str = "10 minutes") -> DataFrame:
    """start, end, symbol, event_type and n of tumbling or sliding windows; events later than the watermark are dropped.

    A window comes out when the watermark has passed its end: end a finite stream with `with_end`.
    """
    df = stream.withColumn("ts", instant(F.col(TS))).withWatermark("ts", late)
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return df.groupBy(w.alias("w"), SYMBOL, "event_type").agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", SYMBOL, "event_type", "n")


def session_counts(stream: DataFrame, gap: str, *, late: str = "10 minutes") -> DataFrame:
    """start, end, symbol and n of sessions that a gap ends; they come out as windows do."""
    df = stream.withColumn("ts", instant(F.col(TS))).withWatermark("ts", late)
    return df.groupBy(F.session_window("ts", gap).alias("w"), SYMBOL).agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", SYMBOL, "n")


def write_ndjson(stream: DataFrame, path: str, checkpoint: str, *, every: str | None = None) -> StreamingQuery:
    """JSON lines under path, a new set of files with each trigger; with no interval all there is, then it ends."""
    w = stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def rows_written(spark: SparkSession, path: str) -> int:
    """Rows that a sink under path holds, in the files that its queries have committed."""
    return spark.read.schema("value string").text(path).count()
