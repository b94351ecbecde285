"""Causal features of each event: book shape, returns, counts, decays, clock, queue ages."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeworks.operators.windows import before, in_order, nz, so_far
from tapeworks.schema import NS, SEQ, SYMBOL, TS, floor_div

SMALL = 1e-6


def plain(x: float) -> str:
    """A number as it stands in column names: 1, 0.5, 86400."""
    return str(int(x)) if x == int(x) else str(x)


def book_levels(df: DataFrame) -> int:
    return max([int(c.rsplit("_", 1)[1]) for c in df.columns if c.startswith("bid_size_")], default=0)


def depths(df: DataFrame, levels: int) -> DataFrame:
    """bsize_l and asize_l of each level; missing ones are 0."""
    return df.withColumns({f"{s}size_{i}": nz(F.col(f"{n}_size_{i}")) for s, n in (("b", "bid"), ("a", "ask")) for i in range(1, levels + 1)})


def spread_and_mid(df: DataFrame) -> DataFrame:
    bid, ask = nz(F.col("bid_price_1")), nz(F.col("ask_price_1"))
    return df.withColumns({"spread": ask - bid, "mid": (bid + ask) / 2})


def cumulative_depth(df: DataFrame, ks: Sequence[int], levels: int) -> DataFrame:
    """cdb_k, cda_k and the imbalance imb_k of the first k levels (k at most the levels there are)."""
    total = lambda n, k: sum((nz(F.col(f"{n}_size_{i}")) for i in range(2, min(k, levels) + 1)), nz(F.col(f"{n}_size_1")))
    out = {}
    for k in dict.fromkeys(ks):
        b, a = total("bid", k), total("ask", k)
        out |= {f"cdb_{k}": b, f"cda_{k}": a, f"imb_{k}": (b - a) / (b + a + SMALL)}
    return df.withColumns(out)


def causal_returns(df: DataFrame, horizons: Sequence[int] = (1, 5, 10), *, mid: str = "mid", by: tuple[str, ...] = (SYMBOL,)) -> DataFrame:
    """ret_h: log return over the last h rows; 0 in the first h."""
    w, m = in_order(*by), F.log(F.greatest(nz(F.col(mid)), F.lit(SMALL)))
    return df.withColumns({f"ret_{h}": nz(m - F.lag(m, h).over(w)) for h in horizons})


def inter_event_dt(df: DataFrame, *, by: tuple[str, ...] = (SYMBOL,)) -> DataFrame:
    """dt: seconds since the row before; 0 in the first."""
    return df.withColumn("dt", nz((F.col(TS) - F.lag(TS).over(in_order(*by))) / NS))


def rolling_counts(df: DataFrame, types: Sequence[str], windows_s: Sequence[float], *, column: str = "event_type", by: tuple[str, ...] = (SYMBOL,)) -> DataFrame:
    """cnt_<type>_<w> and cnt_all_<w>: events in (t - w, t] up to this row, not its peers behind it.

    A count so far less a count of what is too old, so no row is counted twice and no window is rescanned.
    """
    run, out = so_far(*by), {}
    for w in windows_s:
        old = before(int(w * NS), *by)
        for t in [*types, None]:
            one = F.lit(1) if t is None else F.when(F.col(column) == t, 1)
            out[f"cnt_{t or 'all'}_{plain(w)}"] = F.count(one).over(run) - F.count(one).over(old)
    return df.withColumns(out)


def ewma_counts(df: DataFrame, types: Sequence[str], taus_s: Sequence[float] = (1.0, 5.0), *, column: str = "event_type", by: tuple[str, ...] = (SYMBOL,), reach: float = 30.0) -> DataFrame:
    """ewm_<type>_<tau>: events that decay with e^(-dt / tau), without recursion.

    Time is cut into buckets of reach * tau. Within one a sum of growing exponentials is enough; what the bucket before
    and the one before that leave over is carried by a join on the bucket number. Older ones weigh under e^-reach.
    The first moment of a bucket is part of the sums, so exponents stay between 0 and reach.
    """
    out = df
    for tau in taus_s:
        size = int(reach * tau * NS)
        names = {t: f"ewm_{t or 'all'}_{plain(tau)}" for t in [*types, None]}
        rows = out.withColumn("__b", floor_div(F.col(TS), size)).withColumn("__x", (F.col(TS) - F.col("__b") * size) / (tau * NS))
        one = {t: F.when(F.lit(True) if t is None else F.col(column) == t, F.exp("__x")).otherwise(0.0) for t in names}
        w = W.partitionBy(*by, "__b").orderBy(TS, SEQ).rowsBetween(W.unboundedPreceding, W.currentRow)
        carry = rows.groupBy(*by, "__b").agg(*[(F.sum(one[t]) * F.exp(F.lit(-reach))).alias(f"__c{i}") for i, t in enumerate(names)])
        # What a bucket leaves goes to the next one, and decayed once more to the one after.
        after = F.explode(F.array(F.struct(F.lit(1).alias("on"), F.lit(1.0).alias("by")), F.struct(F.lit(2).alias("on"), F.lit(math.exp(-reach)).alias("by")))).alias("__to")
        left = carry.select("*", after).groupBy(*by, (F.col("__b") + F.col("__to.on")).alias("__b")).agg(*[F.sum(F.col(f"__c{i}") * F.col("__to.by")).alias(f"__c{i}") for i in range(len(names))])
        rows = rows.withColumns({f"__l{i}": F.sum(one[t]).over(w) for i, t in enumerate(names)})
        rows = rows.join(left, [*by, "__b"], "left")
        rows = rows.withColumns({name: F.exp(-F.col("__x")) * (F.col(f"__l{i}") + nz(F.col(f"__c{i}"))) for i, name in enumerate(names.values())})
        out = rows.drop("__b", "__x", *[f"__{a}{i}" for a in "lc" for i in range(len(names))])
    return out


def time_covariates(df: DataFrame) -> DataFrame:
    """tod_sin, tod_cos, tod_progress (whole seconds of the UTC day), dow_sin, dow_cos (Monday 0)."""
    second = F.pmod(floor_div(F.col(TS), NS), F.lit(86_400))
    day = F.pmod(floor_div(F.col(TS), 86_400 * NS) + 3, F.lit(7))
    turn = lambda x, n: x * (2 * 3.141592653589793 / n)
    return df.withColumns({"tod_sin": F.sin(turn(second, 86_400)), "tod_cos": F.cos(turn(second, 86_400)), "tod_progress": second / 86_400, "dow_sin": F.sin(turn(day, 7)), "dow_cos": F.cos(turn(day, 7))})


def event_resets(side: str, level: int) -> Column:
    """Rows that restart the queue of a side's level: orders and cancels there, and market orders that hit level 1."""
    names, sign = (("bid", "B"), "-") if side == "bid" else (("ask", "S"), "+")
    here = F.col("event_type").substr(1, 2).isin("LO", "CX") & (F.col("level") == level) & F.upper("side").isin(*[n.upper() for n in names])
    hit = (F.col("event_type") == f"MO{sign}") if level == 1 else F.lit(False)
    return nz_bool(here) | nz_bool(hit)


def nz_bool(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _restarts(side: str, level: int, extra: Column | None, by: tuple[str, ...]) -> Column:
    """The row's time where a level's queue restarts, else null."""
    size, price, w = F.col(f"{side}_size_{level}"), F.col(f"{side}_price_{level}"), in_order(*by)
    changed = ~F.lag(size).over(w).eqNullSafe(size) | ~F.lag(price).over(w).eqNullSafe(price) | price.isNull() | F.isnan(price)
    return F.when(changed if extra is None else changed | nz_bool(extra), F.col(TS))


def _ages(df: DataFrame, restarts: dict[str, Column], by: tuple[str, ...]) -> DataFrame:
    """A column for each name: seconds since its last restart. All restarts are found in one window and all ages in another."""
    df = df.withColumns({f"__{n}": c for n, c in restarts.items()})
    last = lambda n: F.last(f"__{n}", ignorenulls=True).over(so_far(*by))
    return df.withColumns({n: (F.col(TS) - last(n)) / NS for n in restarts}).drop(*[f"__{n}" for n in restarts])


def queue_age(df: DataFrame, side: str, level: int, *, name: str | None = None, extra: Column | None = None, by: tuple[str, ...] = (SYMBOL,)) -> DataFrame:
    """Seconds since size or price of this level changed (or `extra` was true); a price that isn't there restarts too.

    The age is the time since the last restart; an instrument's first row is one.
    """
    return _ages(df, {name or f"qage_{side[0]}_{level}": _restarts(side, level, extra, by)}, by)


def queue_ages(df: DataFrame, levels: int, *, event_aware: bool = False, halted: str | None = None, by: tuple[str, ...] = (SYMBOL,)) -> DataFrame:
    """Ages of all levels on both sides; with event_aware also restarted by events, with halted by halts."""
    restarts = {}
    for side in ("bid", "ask"):
        for level in range(1, levels + 1):
            extra = event_resets(side, level) if event_aware else None
            if halted:
                extra = F.col(halted) if extra is None else extra | nz_bool(F.col(halted))
            restarts[f"qage_{side[0]}_{level}"] = _restarts(side, level, extra, by)
    return _ages(df, restarts, by)


def age_from_last_update(df: DataFrame, side: str, level: int = 1) -> DataFrame:
    """The age from the column last_update_<side>_<level> (nanoseconds) where there is one, else the inferred age."""
    df = queue_age(df, side, level, name="__age")
    known = F.greatest((F.col(TS) - F.col(f"last_update_{side}_{level}")) / NS, F.lit(0.0))
    return df.withColumn(f"qage_{side[0]}_{level}", F.when(F.col(f"last_update_{side}_{level}").isNotNull(), known).otherwise(F.col("__age"))).drop("__age")


def one_hot(df: DataFrame, types: Sequence[str], column: str = "event_type") -> DataFrame:
    return df.withColumns({f"is_{t}": nz_bool(F.col(column) == t).cast("int") for t in types})


def feature_block(df: DataFrame, *, levels: int | None = None, ks: Sequence[int] = (1, 3, 5, 10), horizons: Sequence[int] = (1, 5, 10), types: Sequence[str] = (), windows_s: Sequence[float] = (), taus_s: Sequence[float] = ()) -> DataFrame:
    """All feature columns of a table with book snapshots, under their usual names."""
    levels = levels or book_levels(df)
    df = cumulative_depth(spread_and_mid(depths(df, levels)), ks, levels)
    df = time_covariates(inter_event_dt(causal_returns(df, horizons)))
    if windows_s:
        df = rolling_counts(df, types, windows_s)
    if taus_s:
        df = ewma_counts(df, types, taus_s)
    return queue_ages(df, levels)


def liquidity_surface(df: DataFrame, levels: int, kind: str = "imbalance") -> DataFrame:
    """surface: one value for each level, from bid and ask sizes (imbalance, bid, ask or net)."""
    b = lambda i: nz(F.col(f"bid_size_{i}"))
    a = lambda i: nz(F.col(f"ask_size_{i}"))
    value = {"imbalance": lambda i: (b(i) - a(i)) / (b(i) + a(i) + SMALL), "bid": b, "ask": a, "net": lambda i: b(i) - a(i)}[kind]
    return df.withColumn("surface", F.array(*[value(i) for i in range(1, levels + 1)]))


def rolling_quantiles(df: DataFrame, column: str, rows: int, qs: Sequence[float] = (0.2, 0.6, 1.0), *, by: tuple[str, ...] = (SYMBOL,)) -> DataFrame:
    """<column>_q<percent>: quantiles of a column over the last `rows` rows."""
    w = in_order(*by).rowsBetween(-(rows - 1), 0)
    return df.withColumns({f"{column}_q{plain(round(q * 100, 6))}": F.percentile(column, q).over(w) for q in qs})
