"""Queries cover all of their input."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeworks.functions.diagrams import MAX_POINTS
from tapeworks.operators import topology
from tapeworks.plans import catalog
from tapeworks.plans.tables import events
from tests.conftest import SF, SF_ORACLE, rows


def test_rips_covers_every_symbol(spark):
    out = catalog.QUERIES["rips_udtf"](spark, SF_ORACLE)
    large = events(spark, SF_ORACLE).groupBy("symbol").count().where("count > 2")
    assert sorted(rows(out.select("symbol").distinct())) == sorted(rows(large, "symbol"))


def test_clouds_hold_every_event_and_are_never_thinned(spark):
    df = spark.range(500).select(F.when(F.col("id") < 301, 1).otherwise(F.when(F.col("id") < 397, 2).otherwise(3)).alias("symbol"), F.col("id").alias("ts_ns"), F.col("id").alias("seq"))
    out = rows(topology.clouds(df, F.array(F.col("seq").cast("double"))), "symbol", "points")
    assert sorted(x[0] for _, p in out for x in p) == list(range(500))
    assert sorted((s, len(p)) for s, p in out) == [(1, 75), (1, 75), (1, 75), (1, 76), (2, 96), (3, 51), (3, 52)]
    assert max(len(p) for _, p in out) <= MAX_POINTS


def test_rolling_topology_has_no_skipped_rows(spark):
    """Windows of one event have no features; every other row has some, not only each fifth or tenth."""
    for name in ("rolling_ph_landscape", "rolling_ph_rips"):
        out = catalog.QUERIES[name](spark, SF)
        n, found = out.agg(F.count(F.lit(1)), F.count_if(F.exists("topology", lambda x: x != 0))).first()
        assert found >= 0.5 * n, (name, found, n)


def test_homology_of_any_number_of_points_equals_plain_reduction():
    """Loops and voids by column reduction of the whole boundary matrix; windows are not thinned."""
    import itertools

    import numpy as np
    import pytest

    from tapeworks.functions import diagrams as D

    def plain(d, dim):
        simplices = [(max([d[a, b] for a, b in itertools.combinations(t, 2)], default=0.0), k, t) for k in range(1, dim + 3) for t in itertools.combinations(range(len(d)), k)]
        simplices.sort()
        index, low, out = {t: i for i, (_, _, t) in enumerate(simplices)}, {}, [[] for _ in range(dim + 1)]
        for v, k, t in simplices:
            column = {index[t[:q] + t[q + 1 :]] for q in range(k)} if k > 1 else set()
            while column and max(column) in low:
                column ^= low[max(column)]
            if column:
                low[max(column)] = column
                birth, size, _ = simplices[max(column)]
                if v > birth and size - 1 <= dim:
                    out[size - 1].append((birth, v - birth))
        return [sorted(x) for x in out]

    rng = np.random.default_rng(0)
    for n in (4, 7, 11):
        x = rng.normal(size=(n, 3))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for ours, theirs in zip(D.rips(x, dim=2), plain(D.distances(x), 2), strict=True):
            assert np.allclose(sorted(map(tuple, ours)), theirs) if theirs else not len(ours)
    x = rng.random((130, 2))
    found = D.rips(x)[1]
    assert len(found) == len(D.rips(x[rng.permutation(130)])[1]) > 20
    assert [len(v) for v in D.cubical(rng.random((5, 6)), 2)][2] == 0
    with pytest.raises(ValueError):
        D.rips(x, dim=3)


def test_running_totals_split_a_constant_first_key(spark):
    from tapeworks.functions.ranks import running_totals

    df = spark.range(4000).select(F.when(F.col("id") < 3900, 0.5).otherwise(F.col("id") / 1e4).alias("pred"), F.col("id").alias("idx"), F.lit(1).cast("long").alias("one"))
    out = running_totals(df, ["pred", "idx"], ["one"])
    rows_ = out.orderBy("pred", "idx").select("before_one").collect()
    assert [r[0] for r in rows_] == list(range(4000))
    plan = out._jdf.queryExecution().toString()
    assert "__range" in plan


def test_python_operators_run_from_another_folder(tmp_path):
    """Workers get the package from the driver: it is neither installed nor in their folder."""
    import subprocess
    import sys
    from pathlib import Path

    home = Path(__file__).resolve().parent.parent
    code = f"""
import sys
sys.path.insert(0, {str(home)!r})
from tapeworks.session import session
from tapeworks.sources import synthetic
s = session(spark__master="local[2]", spark__ui__enabled="false")
print("rows", synthetic.sequences(s, 2).count())
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, timeout=120)
    assert "rows" in done.stdout, done.stderr[-2000:]


def test_intermediate_tables_can_be_cleared(spark):
    from tapeworks.session import clear, scratch, tables

    before = tables(spark)
    spark.range(3).write.parquet(scratch(spark, "gone"))
    assert len(tables(spark) - before) == 1
    clear(spark, tables(spark) - before)
    assert tables(spark) == before


def test_live_book_state_goes_on_over_batches(spark, tmp_path):
    """The same features whether events come at once or file by file; sizes and prices that aren't there included."""
    from tapeworks.operators import features
    from tapeworks.schema import NS
    from tapeworks.streaming import events as live

    data = [(s, i * NS, i, *((None,) * 4 if (i + s) % 7 == 0 else (100.0 - i // 3, 101.0 + s, float(i // 2 % 2), 5.0))) for s in (0, 1) for i in range(12)]
    whole = spark.createDataFrame(data, "symbol int, ts_ns long, seq long, bid_price_1 double, ask_price_1 double, bid_size_1 double, ask_size_1 double")
    for n in range(3):
        whole.where(f"seq div 4 = {n}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = live.live_book(spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), 1)
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    names = ("symbol", "seq", "mid", "ret_1", "qage_b_1", "qage_a_1")
    ours = sorted(rows(spark.read.schema(stream.schema).parquet(str(tmp_path / "out")), *names))
    theirs = sorted(rows(features.queue_ages(features.causal_returns(features.spread_and_mid(whole), (1,)), 1), *names))
    assert len(ours) == 24
    for a, b in zip(ours, theirs, strict=True):
        assert all(abs(x - y) < 1e-9 for x, y in zip(a, b, strict=True)), (a, b)


def test_returns_of_a_whole_table_do_not_depend_on_chunks(spark):
    from tapeworks.sources import synthetic

    df = spark.range(2000).select(F.col("id").alias("idx"), F.lit(0).alias("g"))
    one, many = (dict(rows(synthetic.with_returns(df, chunk=n), "idx", "ret")) for n in (10_000, 200))
    assert len(one) == len(many) == 2000
    assert max(abs(one[i] - many[i]) for i in one) < 1e-15
    mean = sum(one.values()) / 2000
    var = sum((x - mean) ** 2 for x in one.values()) / 2000
    lag = sum((one[i] - mean) * (one[i + 1] - mean) for i in range(1999)) / 2000
    assert abs(lag / var - 0.8) < 0.08 and abs(var / (0.01**2 / (1 - 0.64)) - 1) < 0.3
    assert len(rows(synthetic.with_returns(df, group="g"))) == 2000


def test_balanced_sample_equals_a_plain_one(spark):
    from tapeworks.operators import splits

    df = spark.range(5000).select(F.col("id").alias("seq"), F.when(F.col("id") % 500 == 0, 1).when(F.col("id") % 3 > 0, 0).alias("label"))
    out = rows(splits.balanced_sample(df, "label", 64), "label", "seq", "copy")
    hashed = dict(rows(df.select("seq", F.xxhash64(F.lit(0), "seq"))))
    for label in (0, 1, None):
        ids = sorted((s for s, y in rows(df, "seq", "label") if y == label), key=lambda s: (hashed[s], s))
        want = sorted((ids[i % len(ids)], i // len(ids)) for i in range(64))
        assert sorted((s, c) for y, s, c in out if y == label) == want


def test_slices_count_from_the_end(spark):
    from tapeworks.operators import clean

    df = spark.range(30).select((F.col("id") % 2).alias("symbol"), F.col("id").alias("ts_ns"), F.col("id").alias("seq"))
    cut = lambda a, b: sorted(s // 2 for (s,) in rows(clean.slice_rows(df, a, b).where("symbol = 0"), "seq"))
    assert [cut(2, 4), cut(-3, 15), cut(-3, -1), cut(12, -1), cut(-99, 2)] == [[2, 3], [12, 13, 14], [12, 13], [12, 13], [0, 1]]


def test_times_without_a_zone_are_local(spark):
    from tapeworks.operators import clean

    data = ["2024-01-02 09:30:00", "2024-07-02T09:30:00.000000001", "2024-01-02T09:30:00Z", "2024-01-02T09:30:00+02:00", "2024-01-02", "1704187800"]
    got = [r[0] for r in rows(spark.createDataFrame([(x,) for x in data], "t string").select(clean.to_epoch_ns(F.col("t"), "America/New_York")))]
    hour, day = 3600 * 10**9, 1_704_153_600 * 10**9
    assert got == [day + 14 * hour + hour // 2, 1_719_878_400 * 10**9 + 13 * hour + hour // 2 + 1, day + 9 * hour + hour // 2, day + 7 * hour + hour // 2, day + 5 * hour, 1_704_187_800 * 10**9]


def test_report_intervals_hold_the_mean(spark):
    from tapeworks.sources import files

    reports = spark.createDataFrame([(f"r{i}", m, (i % 7) / 10) for i in range(40) for m in ("auroc", "brier")], "name string, metric string, value double")
    out = rows(files.aggregate_reports(reports, n_boot=200), "metric", "n", "macro", "micro", "lo", "hi")
    assert sorted(x[0] for x in out) == ["auroc", "brier"]
    for _, n, macro, micro, lo, hi in out:
        assert n == 40 and abs(macro - micro) < 1e-9 and macro - 0.12 < lo < macro < hi < macro + 0.12


def test_block_bootstrap_metrics_equal_those_of_multiplied_rows(spark, monkeypatch):
    """Few and many equal predictions, predictions without value, blocks longer than the table; chunks and ranges cut anywhere."""
    import math

    from tapeworks.operators import bootstrap

    monkeypatch.setattr(bootstrap, "CHUNK", 64)
    odd = F.when(F.col("id") % 41 == 5, F.lit(None)).otherwise(F.when(F.col("id") % 43 == 7, float("nan")).otherwise(0.25))
    label = F.when(F.col("id") % 31 == 3, F.lit(None)).otherwise((F.col("id") * 7 % 5 < 2).cast("int"))
    cases = [(500, F.col("id") * 37 % 11 / 11.0, 6.0), (500, F.sin("id"), 6.0), (400, odd, 3.0), (30, F.col("id") % 3 / 3.0, 50.0), (90, F.lit(0.5), 1.0), (5, F.lit(0.5), 2.0)]
    for size, pred, length in cases:
        df = spark.range(size).select((F.col("id") * 3 - 7).alias("idx"), pred.alias("pred"), label.alias("label"))
        w = bootstrap.block_resampled(df, 6, length, seed=2)
        brier = w.groupBy("replicate").agg((F.sum(F.col("weight") * F.pow(F.col("pred") - F.col("label"), 2)) / F.sum("weight")).alias("brier"))
        want = brier
        for other in (bootstrap.replicate_auroc(w), bootstrap.replicate_auprc(w), bootstrap.replicate_ece(w)):
            want = want.join(other, "replicate", "full")
        want = {x["replicate"]: x for x in want.collect()}
        got = bootstrap.block_metrics(df, length, 6, seed=2).collect()
        assert sorted(x["replicate"] for x in got if x["brier"] is not None) == sorted(want)
        for x in got:
            for name in ("auroc", "auprc", "brier", "ece"):
                a, b = x[name], want[x["replicate"]][name] if x["replicate"] in want else None
                assert a == b or (a is not None and b is not None and (math.isclose(a, b, abs_tol=1e-9) or a != a and b != b)), (size, name, a, b)


def test_block_bootstrap_cuts_large_ties_only():
    """A prediction that all rows share is dealt out; a hundred of equal size don't each get a range for every part of the table."""
    import numpy as np

    from tapeworks.operators import bootstrap

    n, parts = 20_000, 200
    at = np.arange(n)
    for pred, least, most in ((np.full(n, 0.5), 25, 25), (at % 100 / 100, 100, 400), (np.sort(at % 100 / 100), 100, 400), (np.sin(at), 200, 400)):
        cuts = np.quantile(pred, np.arange(1, parts) / parts, method="lower")
        outer, inner, _ = bootstrap._places(pred, np.zeros(n, bool), at, cuts, n, parts)
        sizes = np.unique(np.stack([outer, inner]), axis=1, return_counts=True)[1]
        assert least <= len(sizes) <= most and sizes.max() <= 9 * n / parts


def test_block_bootstrap_reads_its_rows_once_and_does_not_multiply_them(spark, capsys):
    """Each metric read and multiplied the rows anew, several times."""
    from tapeworks.operators import bootstrap

    df = spark.range(300).select(F.col("id").alias("idx"), (F.col("id") % 7 / 7.0).alias("pred"), (F.col("id") % 2).cast("int").alias("label"))
    for out in (bootstrap.block_metrics(df, 5.0, 4), bootstrap.block_metric_intervals(df, 5.0, 4)):
        out.explain("simple")
        plan = capsys.readouterr().out
        assert "Range (" not in plan and "Generate" not in plan


def _surfaces(spark, *, uneven: bool = False):
    """Two instruments, events at one time, gaps longer than the windows, values that repeat."""
    i = F.col("id")
    surface = [F.sin(i), (i % 3).cast("double"), F.cos(i * 2)]
    levels = F.when(i % 2 == 0, F.array(*surface)).otherwise(F.array(*surface[: 2 if uneven else 3]))
    ts = F.floor(i / 3) * 2_000_000_000 + F.when(i > 60, 40_000_000_000).otherwise(0)
    return spark.range(120).select((i % 2).alias("symbol"), ts.cast("long").alias("ts_ns"), i.alias("seq"), levels.alias("surface"), i)


def test_vectors_of_many_configurations_equal_rolling_ones(spark):
    import numpy as np

    shared = {"windows_s": (6.0, 20.0)}
    plain = [topology.Topology(levels=2, grid=16, **shared), topology.Topology(vector="image", size=3, sigma=0.5, **shared)]
    more = [topology.Topology(levels=1, grid=8, summary="max", dim=2, stride=3, windows_s=(3.0,)), topology.Topology(vector="image", size=2, births=(0.0, 1.0), spans=(0.0, 0.5), dim=0, windows_s=(9.0, 300.0)), topology.Topology(complex="rips", levels=2, windows_s=(12.0,))]
    for df, cfgs in ((_surfaces(spark), plain + more), (_surfaces(spark, uneven=True), plain)):
        got = {x["seq"]: x["topology"] for x in topology.vectors(df, cfgs, chunk_s=25.0).collect()}
        assert sorted(got) == list(range(120))
        start = 0
        for cfg in cfgs:
            width = cfg.width * len(cfg.windows_s)
            for x in topology.rolling(df, cfg, chunk_s=25.0).collect():
                assert np.allclose(got[x["seq"]][start : start + width], x["topology"], rtol=1e-9, atol=1e-12), (cfg, x["seq"])
            start += width


def test_vectors_do_not_depend_on_how_rows_are_batched(monkeypatch):
    """Groups go on from batch to batch; like windows have the very same vector, whatever is worked out with them."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(4)
    n = 300
    symbol = np.sort(rng.integers(0, 9, n))
    table = pa.table({"symbol": symbol, "ts_ns": np.arange(n) * 10**9, "seq": np.arange(n), "surface": [list(map(float, rng.integers(0, 5, 3))) for _ in range(n)], "rn": np.arange(n), "chunk": np.arange(n) // 50, "own": np.arange(n) % 7 > 0})
    cfgs = [topology.Topology(windows_s=(5.0,), levels=2, grid=16), topology.Topology(windows_s=(5.0,), vector="image", size=3, sigma=0.5)]
    whole = pa.Table.from_batches(topology._vectors(cfgs, table.to_batches()))
    monkeypatch.setattr(topology, "GATHERED", 20)
    monkeypatch.setattr(topology, "AT_ONCE", 1)
    assert pa.Table.from_batches(topology._vectors(cfgs, table.to_batches(max_chunksize=7))).equals(whole)
    assert whole["seq"].to_pylist() == [i for i in range(n) if i % 7]


def test_topology_search_works_its_vectors_out_once(spark, capsys):
    """Each model counted, fitted and scored rows whose windows were worked out anew each time."""
    from tapeworks.operators import models, splits

    df = splits.chronological_split(_surfaces(spark).withColumn("label", (F.col("seq") % 4 == 0).cast("int")))
    cfgs = topology.search_grid([(6.0,)], levels=(2,), grids=(16,), sizes=(3,), sigmas=(0.5,))
    out = models.topology_search(df, cfgs, "label", chunk_s=25.0)
    out.explain("simple")
    plan = capsys.readouterr().out
    assert "InPandas" not in plan and "InArrow" not in plan
    assert [(x["config"], x["vector"]) for x in sorted(out.collect())] == [(0, "landscape"), (1, "image")]
