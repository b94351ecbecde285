"""Persistent homology over event windows, and its landscapes and images."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeworks.functions import diagrams as D
from tapeworks.functions.ranks import quantiles
from tapeworks.operators.windows import chunked
from tapeworks.schema import NS, SEQ, SYMBOL, TS
from tapeworks.session import ship

DIAGRAM = "array<struct<birth:double,pers:double>>"
#: Fields of at most so many pixels are worked out many at a time, so many numbers of a step at once.
SMALL, AT_ONCE = 96, 2_000_000
#: Rows that are gathered before their windows are worked out, about.
GATHERED = 20_000


@dataclass(frozen=True)
class Topology:
    """What is computed for each window."""

    windows_s: tuple[float, ...] = (1.0, 5.0, 10.0)
    complex: str = "cubical"
    dim: int = 1
    vector: str = "landscape"
    levels: int = 5
    grid: int = 64
    summary: str = "mean"
    size: int = 8
    sigma: float = 0.05
    births: tuple[float, float] | None = None
    spans: tuple[float, float] | None = None
    share: float = 0.99
    stride: int = 1

    @property
    def width(self) -> int:
        """Length of one window's vector."""
        return (self.dim + 1) * (self.levels if self.vector == "landscape" else self.size**2)


def window_diagrams(slab: np.ndarray, cfg: Topology) -> list[np.ndarray]:
    if cfg.complex == "cubical":
        return D.cubical(slab, cfg.dim) if slab.size else [np.zeros((0, 2))] * (cfg.dim + 1)
    return D.rips(slab, epsilon=D.epsilon_for_share(slab, cfg.share) if len(slab) > 2 else np.inf, dim=cfg.dim)


def vector(found: list[np.ndarray], cfg: Topology) -> np.ndarray:
    if cfg.vector == "landscape":
        return np.concatenate([D.landscape(x, cfg.levels, cfg.grid, cfg.summary) for x in found])
    return np.concatenate([D.image(x, cfg.size, cfg.sigma, cfg.births, cfg.spans) for x in found])


def _rolling(cfg: Topology, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values([TS, SEQ], kind="stable", ignore_index=True)
    ts, field = pdf[TS].to_numpy(np.int64), np.stack(pdf["surface"].to_numpy()) if len(pdf) else np.zeros((0, 1))
    own = np.flatnonzero(pdf["own"].to_numpy())
    out = []
    for i in own:
        parts = np.zeros(cfg.width * len(cfg.windows_s))
        if pdf["rn"].iat[i] % cfg.stride == 0:
            for k, w in enumerate(cfg.windows_s):
                first = np.searchsorted(ts[: i + 1], ts[i] - int(w * NS), side="right")
                parts[k * cfg.width : (k + 1) * cfg.width] = vector(window_diagrams(field[first : i + 1], cfg), cfg)
        out.append(parts.tolist())
    return pd.DataFrame({SYMBOL: pdf[SYMBOL].iloc[own].values, TS: ts[own], SEQ: pdf[SEQ].iloc[own].values, "topology": pd.Series(out, dtype=object)})


def rolling(df: DataFrame, cfg: Topology, *, chunk_s: float | None = None) -> DataFrame:
    """symbol, ts_ns, seq and topology (window after window) of rows with a `surface` array; rows off the stride are 0.

    A task holds one time chunk of an instrument and the longest window before it.
    """
    from tapeworks.operators.splits import numbered

    reach = int(max(cfg.windows_s) * NS)
    rows = numbered(df.select(SYMBOL, TS, SEQ, "surface")).drop("n_rows")
    dealt = chunked(rows, int((chunk_s or 20 * max(cfg.windows_s)) * NS), back_ns=reach)
    ship(df.sparkSession)
    return dealt.groupBy(SYMBOL, "chunk").applyInPandas(partial(_rolling, cfg), row_schema(df))


def row_schema(df: DataFrame) -> T.StructType:
    kind = df.schema[SYMBOL].dataType
    return T.StructType([T.StructField(SYMBOL, kind), T.StructField(TS, T.LongType()), T.StructField(SEQ, T.LongType()), T.StructField("topology", T.ArrayType(T.DoubleType()))])


def _small_vectors(slabs: np.ndarray, cfgs: Sequence[Topology]) -> list[np.ndarray]:
    """The vectors of many fields of one shape, for configurations that differ in vectors only."""
    found = D.cubical_many(slabs, cfgs[0].dim)
    each = lambda c, b, p: D.landscapes(b, p, c.levels, c.grid, c.summary) if c.vector == "landscape" else D.images(b, p, c.size, c.sigma, c.births, c.spans)
    return [np.concatenate([each(c, b, p) for b, p in found], 1) for c in cfgs]


def _window_vectors(cfgs: Sequence[Topology], table):
    """Own rows of whole groups, in the order of time within each, with the vectors of all configurations."""
    import pyarrow as pa

    new = _group_starts(table)
    ts, rn, own = (table[c].to_numpy() for c in (TS, "rn", "own"))
    surface = table["surface"].combine_chunks()
    sizes = np.diff(surface.offsets.to_numpy())
    even = surface.null_count == 0 and len(set(sizes.tolist())) == 1 and sizes[0] > 0
    flat = surface.flatten().to_numpy(zero_copy_only=False)
    field = flat.reshape(len(sizes), -1) if even else [None if x is None else np.asarray(x, float) for x in surface.to_pylist()]
    mine = np.flatnonzero(own)
    place = np.zeros(len(ts), np.int64)
    place[mine] = np.arange(len(mine))
    starts = np.cumsum([0] + [c.width * len(c.windows_s) for c in cfgs])
    out = np.zeros((len(mine), starts[-1]))
    alike: dict[tuple, list[int]] = {}
    for j, c in enumerate(cfgs):
        alike.setdefault((c.complex, c.dim, c.share, c.stride, c.windows_s), []).append(j)
    firsts: dict[float, np.ndarray] = {}
    for w in {w for c in cfgs for w in c.windows_s}:
        first = [a + np.searchsorted(ts[a:b], ts[a:b] - int(w * NS), side="right") for a, b in zip(new, [*new[1:], len(ts)], strict=True)]
        firsts[w] = np.minimum(np.concatenate(first), np.arange(1, len(ts) + 1))
    for (kind, _, _, stride, windows), js in alike.items():
        group = [cfgs[j] for j in js]
        on = mine[rn[mine] % stride == 0]
        for k, w in enumerate(windows):
            first = firsts[w][on]
            height = on + 1 - first
            spots = [slice(starts[j] + k * cfgs[j].width, starts[j] + (k + 1) * cfgs[j].width) for j in js]
            widest = max([c.grid * 4 if c.vector == "landscape" else c.size**2 for c in group] + [8])
            for h in np.unique(height):
                at, begin = on[height == h], first[height == h]
                if even and kind == "cubical" and 0 < h * field.shape[1] <= SMALL:
                    step = max(1, AT_ONCE // int(h * field.shape[1] * widest))
                    for i in range(0, len(at), step):
                        slabs = field[begin[i : i + step, None] + np.arange(h)]
                        for spot, x in zip(spots, _small_vectors(slabs, group), strict=True):
                            out[place[at[i : i + step]], spot] = x
                    continue
                for a, b in zip(at, begin, strict=True):
                    slab = field[b : a + 1] if even else np.stack(field[b : a + 1]) if a >= b else np.zeros((0, 1))
                    found = window_diagrams(slab, group[0])
                    for spot, c in zip(spots, group, strict=True):
                        out[place[a], spot] = vector(found, c)
    ends = np.arange(len(mine) + 1, dtype=np.int32) * np.int32(starts[-1])
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))
    kept = table.select([SYMBOL, TS, SEQ]).take(pa.array(mine))
    return kept.append_column("topology", lists)


def _group_starts(table) -> list[int]:
    """Where (symbol, chunk) changes, beginning with 0."""
    import pyarrow.compute as pc

    changed = np.zeros(max(len(table) - 1, 0), bool)
    for c in (SYMBOL, "chunk"):
        column = table[c].combine_chunks()
        changed |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False).astype(bool)
    return [0, *(np.flatnonzero(changed) + 1).tolist()]


def _vectors(cfgs: Sequence[Topology], batches):
    import pyarrow as pa

    held, size, wait = [], 0, GATHERED
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < wait:
            continue
        table = pa.Table.from_batches(held)
        last = _group_starts(table)[-1]  # more rows of this group may come
        if last:
            yield from _window_vectors(cfgs, table[:last]).to_batches()
        held = table[last:].to_batches()
        size = sum(x.num_rows for x in held)
        wait = GATHERED + size
    if size:
        yield from _window_vectors(cfgs, pa.Table.from_batches(held)).to_batches()


def vectors(df: DataFrame, cfgs: Sequence[Topology], *, chunk_s: float | None = None) -> DataFrame:
    """rolling() of several configurations in one pass, vectors one after another: symbol, ts_ns, seq and topology of rows with a symbol.

    Windows that several configurations have in common get one diagram, and small fields of one shape are worked out
    together. A task streams over its time chunks of instruments.
    """
    from tapeworks.operators.splits import numbered

    longest = max(w for c in cfgs for w in c.windows_s)
    rows = numbered(df.select(SYMBOL, TS, SEQ, F.col("surface").cast("array<double>").alias("surface")).where(F.col(SYMBOL).isNotNull())).drop("n_rows")
    dealt = chunked(rows, int((chunk_s or 20 * longest) * NS), back_ns=int(longest * NS))
    dealt = dealt.repartition(SYMBOL, "chunk").sortWithinPartitions(SYMBOL, "chunk", TS, SEQ)
    ship(df.sparkSession)
    return dealt.mapInArrow(partial(_vectors, list(cfgs)), row_schema(df))


def transform_windows(df: DataFrame, cfg: Topology, column: str = "slab") -> DataFrame:
    """topology of each row's own slab (array of rows)."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<double>")
    def embed(slabs: pd.Series) -> pd.Series:
        return slabs.map(lambda s: vector(window_diagrams(np.stack([np.asarray(r, float) for r in s]) if len(s) else np.zeros((0, 1)), cfg), cfg).tolist())

    ship(df.sparkSession)
    return df.withColumn("topology", embed(column))


def fitted_ranges(diagrams: DataFrame, column: str = "diagram", low: float = 0.01, high: float = 0.99) -> DataFrame:
    """One row: the quantiles of births and persistences of training diagrams, to freeze image axes with."""
    pts = diagrams.select(F.inline(column))
    ends = [quantiles(pts, F.col(c), [low, high]).select(F.get("q", F.lit(0)).alias(f"{c}_lo"), F.get("q", F.lit(1)).alias(f"{c}_hi")) for c in ("birth", "pers")]
    return ends[0].join(F.broadcast(ends[1]))


def landscape(diagram: Column, levels: int, grid: int) -> Column:
    """Mean heights of the first landscape functions of an array of (birth, pers), without leaving the JVM."""
    pts = F.filter(diagram, lambda p: p["pers"] > 0)
    lo, hi = F.array_min(F.transform(pts, lambda p: p["birth"])), F.array_max(F.transform(pts, lambda p: p["birth"] + p["pers"]))
    xs = F.transform(F.sequence(F.lit(0), F.lit(grid - 1)), lambda i: F.struct((lo + i * (hi - lo) / (grid - 1)).alias("x")))
    tent = lambda x, p: F.greatest(F.least(x - p["birth"], p["birth"] + p["pers"] - x), F.lit(0.0))
    heights = F.transform(xs, lambda x: F.reverse(F.array_sort(F.transform(pts, lambda p: tent(x["x"], p)))))
    mean = lambda k: F.aggregate(heights, F.lit(0.0), lambda a, h: a + F.coalesce(F.get(h, F.lit(k)), F.lit(0.0))) / grid
    return F.when(F.size(pts) > 0, F.array(*[mean(k) for k in range(levels)])).otherwise(F.array(*[F.lit(0.0)] * levels))


def image(diagram: Column, size: int, sigma: float, births: tuple[float, float], spans: tuple[float, float]) -> Column:
    """Sums of Gaussians on a fixed grid, without leaving the JVM."""
    cell = lambda r, i: r[0] + i * ((r[1] - r[0]) / (size - 1))
    bump = lambda p, i: F.exp(-(F.pow(cell(births, i % size) - p["birth"], 2) + F.pow(cell(spans, F.floor(i / size)) - p["pers"], 2)) / (2 * sigma * sigma)) * F.greatest(p["pers"], F.lit(0.0))
    return F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda i: F.aggregate(diagram, F.lit(0.0), lambda a, p: a + bump(p, i)))


def epsilons(df: DataFrame, column: str = "points", share: float = 0.99) -> DataFrame:
    """eps_quantile and eps_share of each row's point cloud."""
    from pyspark.sql.functions import pandas_udf

    def over(f):
        return lambda s: s.map(lambda p: f(np.stack([np.asarray(r, float) for r in p]), share) if len(p) else 0.0)

    ship(df.sparkSession)
    return df.withColumns({"eps_quantile": pandas_udf(over(D.epsilon_by_quantile), "double")(column), "eps_share": pandas_udf(over(D.epsilon_for_share), "double")(column)})


def clouds(df: DataFrame, point: Column, most: int = D.MAX_POINTS) -> DataFrame:
    """symbol, chunk and points: an instrument's events in their order, dealt evenly to as few chunks as hold at most `most`.

    No cloud is so large that its loops are thinned, and none is a remainder too small for a diagram.
    """
    from tapeworks.operators.splits import numbered

    rows = numbered(df.select(SYMBOL, TS, SEQ, point.alias("point")))
    chunk = F.floor(F.col("rn") * F.ceil(F.col("n_rows") / most) / F.col("n_rows"))
    return rows.groupBy(SYMBOL, chunk.alias("chunk")).agg(F.array_sort(F.collect_list("point")).alias("points"))


def pairwise_l2(df: DataFrame, key: str, column: str, window: Column) -> DataFrame:
    """Distances of all pairs inside each window of bounded size (a, b, l2) with a < b; `window` names a row's window."""
    left = df.select(window.alias("__w"), F.col(key).alias("a"), F.col(column).alias("x"))
    right = df.select(window.alias("__w"), F.col(key).alias("b"), F.col(column).alias("y"))
    square = F.aggregate(F.zip_with("x", "y", lambda p, q: (p.cast("double") - q.cast("double")) * (p.cast("double") - q.cast("double"))), F.lit(0.0), lambda s, v: s + v)
    return left.join(right, "__w").where(F.col("a") < F.col("b")).select("a", "b", F.sqrt(square).alias("l2"))


def search_grid(windows: Sequence[tuple[float, ...]], levels: Sequence[int] = (3, 5), grids: Sequence[int] = (32,), sizes: Sequence[int] = (4, 8, 16), sigmas: Sequence[float] = (0.05, 0.1)) -> list[Topology]:
    """The configurations of a search: landscapes by levels and grid, images by size and sigma, for each set of windows."""
    out = []
    for w in windows:
        out += [Topology(windows_s=w, levels=k, grid=g) for k in levels for g in grids]
        out += [Topology(windows_s=w, vector="image", size=n, sigma=s) for n in sizes for s in sigmas]
    return out


def backends() -> dict[str, bool]:
    """Which optional packages could be imported; none is needed."""
    import importlib.util

    return {name: importlib.util.find_spec(name) is not None for name in ("ripser", "gudhi", "persim")}
