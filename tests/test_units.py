"""Hand-computed cases: ties, nulls, single rows, empty tables, one-class labels."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeworks.functions import diagrams
from tapeworks.operators import actions, bootstrap, clean, features, labels, metrics, models, panel, risk, splits, tpp
from tapeworks.registry import Catalog, Registry
from tapeworks.schema import EVENT_SCHEMA, NS, conform, floor_div, require
from tapeworks.sources import binary, files, lobster, vendors
from tests.conftest import rows

EV = "symbol string, ts_ns long, seq long, event_type string, price double, size double"


def events(spark, *data):
    return spark.createDataFrame([("A", int(t * NS), i, e, p, s) for i, (t, e, p, s) in enumerate(data)], EV)


def test_floor_div_is_exact(spark):
    df = spark.createDataFrame([(1_704_078_023_688_080_001,), (-1,)], "t long")
    assert rows(df.select(floor_div(F.col("t"), 1000))) == [(1_704_078_023_688_080,), (-1,)]


def test_epoch_units_and_text(spark):
    data = ["1690000000", "1690000000000", "1690000000000000", "1690000000000000001", "2024-01-02T03:04:05.123456789Z", "2024-01-02 03:04:05", "junk", None, "1690000000.5"]
    got = [r[0] for r in rows(spark.createDataFrame([(x,) for x in data], "t string").select(clean.to_epoch_ns(F.col("t"))))]
    s = 1_690_000_000 * NS
    assert got == [s, s, s, s + 1, 1_704_164_645_123_456_789, 1_704_164_645 * NS, None, None, s + NS // 2]


def test_halves_round_to_even(spark):
    df = spark.createDataFrame([(0.125,), (0.375,)], "p double")
    assert rows(df.select(clean.round_to_tick(F.col("p"), 0.25))) == [(0.0,), (0.5,)]
    assert rows(df.select(clean.round_to_tick(F.col("p"), 0.25, half="away"))) == [(0.25,), (0.5,)]


def test_quality_drops_bad_rows(spark):
    raw = spark.createDataFrame([("2024-01-02T14:30:00Z", "TRADE", "100", "1"), ("not-a-time", "ADD", "100", "1"), ("2024-01-02T14:30:01Z", "ADD", "0.0", "1"), ("2024-01-02T14:30:02Z", "ADD", "100", "-1")], "timestamp string, event_type string, price string, size string")
    out = files.harmonise(raw.withColumn("symbol", F.lit("X")), min_price=1e-12)
    assert rows(out, "event_type", "price") == [("MO+", 100.0)]


def test_session_in_summer_time(spark):
    at = lambda h, m, s: (1_719_792_000 + h * 3600 + m * 60 + s)  # noqa: E731  2024-07-01
    df = events(spark, (at(6, 59, 59), "MO+", 1.0, 1.0), (at(7, 0, 0), "MO+", 1.0, 1.0), (at(15, 30, 59), "MO+", 1.0, 1.0), (at(15, 31, 0), "MO+", 1.0, 1.0))
    assert [r[0] for r in rows(clean.session_filter(df, start="08:00", end="16:30", tz="Europe/London"), "seq")] == [1, 2]


def test_gap_drops_both_neighbours(spark):
    df = events(spark, (60, "MO+", 1.0, 1.0), (61, "MO+", 1.0, 1.0), (305, "MO+", 1.0, 1.0), (306, "MO+", 1.0, 1.0), (307, "MO+", 1.0, 1.0))
    assert sorted(r[0] for r in rows(clean.halt_gap_filter(df, tz="UTC"), "seq")) == [0, 3, 4]
    two = df.where("seq in (1, 2)")
    assert clean.halt_gap_filter(two, tz="UTC").count() == 2


def test_explicit_halt_keeps_unknown(spark):
    df = spark.createDataFrame([("T",), ("H",), ("halted",), (None,)], "trading_state string")
    assert [r[0] for r in rows(clean.explicit_halt_filter(df))] == ["T", None]


def test_monotonic_is_against_newest_accepted(spark):
    df = spark.createDataFrame([("A", t, i) for i, t in enumerate((2, 0, 1, 2, 5, 4))], "symbol string, ts_ns long, seq long")
    assert sorted(r[0] for r in rows(clean.monotonic_filter(df, arrival="seq"), "seq")) == [0, 3, 4]


def test_first_of_duplicates_with_nulls(spark):
    df = spark.createDataFrame([(1, None, 5), (1, None, 3), (2, 1.0, 4)], "k int, p double, seq long")
    assert sorted(rows(clean.first_of_duplicates(df, ["k", "p"], ["seq"])), key=repr) == [(1, None, 3), (2, 1.0, 4)]


def test_types_by_level(spark):
    df = spark.createDataFrame([("LO+", 2), ("CX-", None), ("MO+", 1), ("LO-", 0)], "t string, l int")
    assert [r[0] for r in rows(df.select(clean.type_by_level(F.col("t"), F.col("l"))))] == ["LO+@2", "CX-", "MO+", "LO-"]


def test_labels_clamp_at_the_end_and_ignore_nulls(spark):
    df = events(spark, (0, "MO+", 100.0, 1.0), (1, "MO+", 101.0, 1.0), (2, "MO+", None, 1.0), (3, "MO+", 101.0, 1.0))
    assert [r[0] for r in rows(labels.clock_label(df, 1, mid="price").orderBy("seq"), "instability_s_1")] == [1, 0, 0, 0]
    assert [r[0] for r in rows(labels.event_label(df, 3, mid="price").orderBy("seq"), "instability_e_3")] == [1, 0, 0, 0]
    assert labels.clock_label(df, 1, mid="price", drop_tail=True).count() == 3
    assert labels.clock_label(df.limit(0), 1, mid="price").count() == 0


def test_forward_as_of_takes_first_of_ties(spark):
    df = spark.createDataFrame([("A", 0, 0, 1.0), ("A", NS, 1, 7.0), ("A", NS, 2, 9.0)], "symbol string, ts_ns long, seq long, mid double")
    out = df.withColumn("f", labels.forward_as_of("mid", NS)).orderBy("seq")
    assert [r[0] for r in rows(out, "f")] == [7.0, 9.0, 9.0]


def test_backward_as_of_before_first_and_ties(spark):
    ev = spark.createDataFrame([("A", 0, 0), ("A", 5, 1), ("A", 9, 2)], "symbol string, ts_ns long, seq long")
    book = spark.createDataFrame([("A", 2, 10.0), ("A", 5, 11.0)], "symbol string, ts_ns long, p double")
    assert rows(labels.backward_as_of(ev, book, ["p"]).orderBy("seq"), "p") == [(10.0,), (11.0,), (11.0,)]


def test_returns_are_causal(spark):
    df = events(spark, *[(i, "MO+", 100.0 + 2 * i, 1.0) for i in range(5)])
    out = features.causal_returns(df, [1, 2], mid="price").orderBy("seq")
    want = [0.0, *[math.log((102 + 2 * i) / (100 + 2 * i)) for i in range(4)]]
    assert [r[0] for r in rows(out, "ret_1")] == pytest.approx(want)
    assert [r[0] for r in rows(out, "ret_2")][:2] == [0.0, 0.0]


def test_rolling_counts_leave_later_peers_out(spark):
    df = spark.createDataFrame([("A", t * NS, i, "x") for i, t in enumerate((0, 1, 1, 1, 2, 4))], "symbol string, ts_ns long, seq long, event_type string")
    out = features.rolling_counts(df, ["x"], [1]).orderBy("seq")
    assert [r[0] for r in rows(out, "cnt_x_1")] == [1, 1, 2, 3, 1, 1]


def test_ewma_equals_recursion(spark):
    rng = np.random.default_rng(3)
    t = np.cumsum(rng.exponential(2.0, 400) * (rng.random(400) > 0.2))
    t[200:] += 500
    df = spark.createDataFrame([("A", int(x * NS), i, "ab"[i % 2]) for i, x in enumerate(t)], "symbol string, ts_ns long, seq long, event_type string")
    got = [r[0] for r in rows(features.ewma_counts(df, ["a"], [1.0]).orderBy("seq"), "ewm_a_1")]
    want, last, x = [], None, 0.0
    for i, s in enumerate((t * NS).astype(np.int64)):
        x = (x * math.exp(-(s - last) / NS) if last is not None else 0.0) + (i % 2 == 0)
        want.append(x)
        last = s
    assert got == pytest.approx(want, abs=1e-9)


def test_queue_age_restarts(spark):
    data = [("A", i * NS, i, 1.0 if i < 3 else 2.0, 10.0 if i != 4 else None) for i in range(6)]
    df = spark.createDataFrame(data, "symbol string, ts_ns long, seq long, bid_size_1 double, bid_price_1 double")
    assert [r[0] for r in rows(features.queue_age(df, "bid", 1).orderBy("seq"), "qage_b_1")] == [0, 1, 2, 0, 0, 0]


def test_age_from_last_update(spark):
    data = [("A", t * NS, i, 1.0, 1.0, u) for i, (t, u) in enumerate(((0, 0), (10, 5 * NS), (25, 5 * NS), (30, None)))]
    df = spark.createDataFrame(data, "symbol string, ts_ns long, seq long, bid_size_1 double, bid_price_1 double, last_update_bid_1 long")
    assert [r[0] for r in rows(features.age_from_last_update(df, "bid").orderBy("seq"), "qage_b_1")] == [0, 5, 20, 30]


def test_actions_divide_once_and_refuse_duplicates(spark):
    df = events(spark, (1_704_153_600, "MO+", 100.0, 1.0), (1_704_240_000, "MO+", 100.5, 1.0))
    ca = spark.createDataFrame([("A", "2024-01-02", 2.0), ("A", "2024-01-03", 0.0)], "symbol string, date string, adj_factor double").withColumn("date", F.to_date("date"))
    assert [r[0] for r in rows(actions.adjust_corporate_actions(df, ca).orderBy("seq"), "price")] == [50.0, 100.5]
    with pytest.raises(Exception, match="several corporate actions"):
        actions.adjust_corporate_actions(df, ca.union(ca)).collect()


def test_splits_small(spark):
    df = events(spark, *[(i, "MO+", 1.0, 1.0) for i in range(5)])
    assert [r[0] for r in rows(splits.chronological_split(df).orderBy("seq"), "split")] == ["train"] * 3 + ["val", "test"]
    one = splits.fit_scaler(df, ["price"])
    assert rows(one) == [(1.0, 1.0)]


def test_permuted_keeps_the_values(spark):
    df = spark.range(500).select(F.col("id").alias("seq"), F.col("id").alias("x"))
    out = rows(splits.permuted(df, ["x"]).orderBy("seq"))
    assert sorted(x for _, x in out) == list(range(500))
    assert [x for _, x in out] != list(range(500))


def preds(spark, p, y):
    return spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(p, y, strict=True))], "idx long, pred double, label int")


def test_auroc_ties_and_one_class(spark):
    assert rows(metrics.auroc(preds(spark, [0.5] * 4, [0, 1, 0, 1]))) == [(0.5,)]
    assert rows(metrics.auroc(preds(spark, [0.1, 0.9], [1, 1]))) == [(None,)]
    rng = np.random.default_rng(0)
    p, y = np.round(rng.random(300), 2), rng.integers(0, 2, 300)
    pos, neg = p[y == 1], p[y == 0]
    want = ((pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2) / (len(pos) * len(neg))
    assert rows(metrics.auroc(preds(spark, p, y)))[0][0] == pytest.approx(want)


def test_bin_sizes(spark):
    b = rows(metrics.reliability_bins(preds(spark, np.linspace(0, 1, 57), np.linspace(0, 1, 57) > 0.4)).orderBy("bin"), "n")
    assert [x[0] for x in b] == [4] * 12 + [3] * 3


def test_fdr_by_hand(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.5)], "key string, p double")
    got = {k: (q, r) for k, q, r in rows(metrics.benjamini_hochberg(df), "key", "qvalue", "rejected")}
    assert got["a"] == (pytest.approx(0.04), True)
    assert got["c"][0] == pytest.approx(0.16 / 3)
    assert got["d"] == (0.5, False)


def test_block_length_grows_with_dependence(spark):
    rng, out = np.random.default_rng(1), []
    for rho in (0.1, 0.9):
        e, x = rng.normal(size=400), np.zeros(400)
        for i in range(1, 400):
            x[i] = rho * x[i - 1] + e[i]
        p = (x - x.min()) / (x.max() - x.min())
        out.append(rows(metrics.block_length(preds(spark, p, np.zeros(400))))[0][0])
    assert out[1] > out[0] >= 1


def test_risk_by_hand(spark):
    df = spark.createDataFrame([(i, r, 0.0) for i, r in enumerate((0.01, -0.05, -0.02, 0.03))], "idx long, ret double, pred double")
    var, es = rows(risk.var_es(df, 0.5))[0]
    assert var == pytest.approx(np.quantile([-0.01, 0.05, 0.02, -0.03], 0.5))
    assert es == pytest.approx(0.035)
    exc = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(100)], "idx long, exc int")
    n00, n01, n10, n11, _ = rows(risk.christoffersen(exc))[0]
    assert (n00, n01, n10, n11) == (80, 9, 10, 0)
    assert metrics.chi2_p(3.841459) == pytest.approx(0.05, abs=1e-4)


def test_utility_prefers_least_threshold(spark):
    df = preds(spark, [0.1, 0.9, 0.9, 0.5], [0, 1, 1, 0])
    assert rows(risk.utility_threshold(df)) == [(0.9, 2.0)]


def test_tpp_by_hand(spark):
    df = spark.createDataFrame([(0, [1.0, 1.0], 0, 0.5), (1, [2.0, 1.0], 1, 1.0), (2, [2.0, 3.0], 0, 0.5)], "rn long, lam array<double>, m int, dt double")
    want = (-(math.log(1) + math.log(1) + math.log(2)) + (1.0 + 3.0 + 2.5)) / 3
    assert rows(tpp.nll_per_event(df))[0][0] == pytest.approx(want)
    assert sorted(rows(tpp.rescaled_times_per_type(df), "rn", "xi")) == [(0, 0.0), (1, 0.5), (2, 2.5)]
    lam = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(((1, 1), (2, 1), (2, 3), (1, 1)))], "rn long, lam array<double>")
    assert rows(models.smoothness(lam)) == [(10.0,)]


def test_panel_deciles(spark):
    pn = spark.createDataFrame([("M", f"s{i}", float(v), 0.01) for i, v in enumerate((1, 1, 1, 5, 9))], "market string, symbol string, median_daily_notional double, tick_size double")
    got = [r[0] for r in rows(panel.deciles_by_value(pn).orderBy("symbol"), "liq_decile")]
    assert got[:3] == [1, 1, 1] and got[4] > got[3]
    assert [r[0] for r in rows(panel.deciles_by_rank(pn).orderBy("symbol"), "liq_decile")] == [0, 2, 4, 6, 8]


def test_temperature_finds_the_scale(spark):
    rng = np.random.default_rng(5)
    z = rng.normal(0, 1.5, 4000)
    y = rng.random(4000) < 1 / (1 + np.exp(-z))
    t = models.temperature(preds(spark, 1 / (1 + np.exp(-2 * z)), y))
    assert t == pytest.approx(2.0, rel=0.15)


def test_bootstrap_covers(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(rng.normal(1, 1, 500))], "idx long, v double")
    n, lo, hi = rows(bootstrap.mean_interval(df, "v", 100))[0]
    assert n == 100 and lo < 1.1 and hi > 0.9 and 0.1 < hi - lo < 0.3
    w = bootstrap.block_resampled(df, 20, 10.0).groupBy("replicate").agg(F.sum("weight").alias("w"))
    assert 400 < rows(w.agg(F.avg("w")))[0][0] < 600
    idx = bootstrap.stationary_block_indices(100, 10.0, np.random.default_rng(0))
    assert len(idx) == 100 and (np.diff(idx) % 100 == 1).mean() > 0.8


def test_diagrams():
    line = np.arange(10.0)[:, None]
    assert diagrams.epsilon_for_share(line) == 1.0
    assert diagrams.spanning_tree(diagrams.distances(np.array([[0.0], [1.0], [6.0]]))).tolist() == [1.0, 5.0]
    t = np.linspace(0, 2 * np.pi, 16, endpoint=False)
    circle = np.stack([np.cos(t), np.sin(t)], 1)
    loops = diagrams.rips(circle)[1]
    assert len(loops) == 1 and loops[0, 1] > 1
    ring = np.ones((5, 5)) * 0.0
    ring[2, 2] = 3.0
    h0, h1 = diagrams.cubical(ring)
    assert len(h0) == 0 and h1.tolist() == [[0.0, 3.0]]
    d = np.array([[0.1, 0.3], [0.2, 0.2], [0.4, 0.1]])
    img = diagrams.image(d, 8, 0.07, (0, 1), (0, 0.5)).reshape(8, 8)
    x, y = np.linspace(0, 1, 8), np.linspace(0, 0.5, 8)
    want = sum(p * np.exp(-((x[None] - b) ** 2 + (y[:, None] - p) ** 2) / (2 * 0.07**2)) for b, p in d)
    assert np.allclose(img, want)
    assert diagrams.landscape(np.zeros((0, 2)), 3).tolist() == [0, 0, 0]


def test_binary_formats(spark):
    msg = [("S", 5, {"code": "O"}), ("R", 6, {"block": "x"}), ("H", 9, {"stock": "T", "state": "H", "state_reason": 7}), ("A", 10, {"id": 1, "side": "S", "shares": 5, "stock": "T", "price": 10_000}), ("L", 11, {"stock": "T"}), ("E", 12, {"id": 1, "shares": 2, "match": 9}), ("D", 13, {"id": 1})]
    f = spark.createDataFrame([("T", binary.encode(msg, "itch-5.0") + b"A\x00")], "symbol string, content binary")
    got = rows(binary.decode(f, "itch", session_date="2020-01-02", adjust=2.0).orderBy("seq"), "event_type", "price", "size", "halted")
    assert got == [("META", None, 0.0, True), ("LO-", 2.0, 5.0, None), ("MO+", None, 2.0, None), ("CX+", None, 0.0, None)]
    bad = spark.createDataFrame([("T", binary.encode(msg[:1], "itch-5.0") + b"?" * 40)], "symbol string, content binary")
    with pytest.raises(Exception, match="unknown message type"):
        binary.decode(bad, "itch-5.0").collect()
    assert binary.decode(bad, "itch-5.0", stop_at_unknown=True).count() == 0
    token = lambda t: {"token": t, "token_orig": t, "token_new": t}
    ouch = [("O", None, {"block": "x"}), ("A", None, token("T1") | {"side": "S", "shares": 50, "price": 10_010}), ("A", None, token("T2") | {"side": "B", "shares": 40, "price": 10_020}), ("T", None, token("T1") | {"shares": 25, "price": 10_030, "match": 1}), ("C", None, token("T2") | {"shares": 5, "reason": "U"}), ("D", None, token("T2"))]
    g = spark.createDataFrame([("T", binary.encode(ouch, "ouch-4.2"))], "symbol string, content binary")
    out = rows(binary.decode(g, "ouch-4.2").orderBy("seq"), "event_type", "size", "price", "token", "reason")
    assert [r[1] for r in out] == [50.0, 40.0, 25.0, 5.0, 0.0]
    assert [r[2] for r in out] == pytest.approx([1.001, 1.002, 1.003, None, None])
    assert out[-1][3:] == ("T2", "SYSTEM_CANCEL")


def test_binary_files_packed_by_hand(spark):
    """Bytes by the published layouts: types that only pass, junk between messages, layouts told by their rows."""
    import struct

    head = lambda kind, ns: struct.pack(">cHHHI", kind, 7, 0, ns >> 32, ns & 0xFFFFFFFF)
    add = head(b"A", 34_200_000_000_001) + struct.pack(">QcI8sI", 77, b"S", 300, b"ABC     ", 1_234_500)
    passed = head(b"Y", 5) + struct.pack(">8sc", b"ABC     ", b"0") + head(b"I", 6) + struct.pack(">QQc8sIIIcc", 1, 2, b"B", b"ABC     ", 1, 2, 3, b"O", b"L")
    gone = head(b"D", 34_200_000_000_009) + struct.pack(">Q", 77)
    file = lambda content: spark.createDataFrame([("T", content)], "symbol string, content binary")
    read = lambda content, layout, **o: rows(binary.decode(file(content), layout, **o).orderBy("seq"), "ts_ns", "event_type", "price", "size")
    want = [(34_200_000_000_001, "LO-", 123.45, 300.0), (34_200_000_000_009, "CX+", None, 0.0)]
    assert read(add + passed + gone, "itch") == want
    assert read(add + b"\x00\x01\x02" + gone, "itch", skip_unknown=True) == want
    with pytest.raises(Exception, match="unknown message type"):
        read(add + b"\x00\x01\x02" + gone, "itch")
    assert read(add + b"\x00\x01\x02" + gone, "itch", stop_at_unknown=True) == want[:1]
    little = struct.pack("<Qc", 42, b"X") + struct.pack("<QI", 9, 4)
    assert read(little, "itch") == [(42, "CX+", None, 4.0)]
    cancel = b"X" + struct.pack(">14sI", b"TOKEN".ljust(14), 25)
    assert read(b"\xff\xfe" + b"SO" + cancel, "ouch-4.2", skip_unknown=True) == [(None, "CX+", None, 25.0)]
    assert read(b"SO" + cancel, "ouch") == [(None, "CX+", None, 25.0)]
    assert read(b"", "itch") == []


def test_vendor_lines_that_are_no_json(spark):
    df = spark.createDataFrame([("nope",), ('{"e":"bookTicker","E":1690000000000,"s":"X","b":"1","B":"2","a":"3","A":"4"}',), ('{"e":"other"}',)], "value string")
    assert rows(vendors.binance(df), "event_type", "price", "size", "level") == [("LO+", 1.0, 2.0, 1), ("LO-", 3.0, 4.0, 1)]
    bad = spark.createDataFrame([('{"msg_type":"?"}',)], "value string")
    with pytest.raises(Exception, match="bad message"):
        vendors.tagged(bad, "ouch").collect()
    assert rows(vendors.tagged(bad, "ouch", fail=False), "bad") == [(True,)]


def test_lobster_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "TEST_message.csv").write_text("34200.0,1,11,100,10000,1\n34200.5,3,11,50,10000,-1\n")
    (tmp_path / "d" / "TEST_orderbook.csv").write_text("10005,5,10000,7\n10005,5,9990,7\n")
    out = lobster.discover(spark, str(tmp_path), 1, symbol="TEST", price_scale=1e-4, tick=0.0005, session_date="2025-01-02", side_aware=True).orderBy("seq")
    assert rows(out, "event_type", "level", "bid_size_1") == [("LO+", 1, 7.0), ("CX-", None, 7.0)]
    assert rows(out, "ts_ns")[0][0] == 1_735_776_000 * NS + 34_200 * NS


def test_files_round_trip(spark, tmp_path):
    df = events(spark, (1, "MO+", 1.0, 1.0), (0, "LO+", 2.0, 1.0))
    files.write_events(df, str(tmp_path / "cache"))
    assert files.read_events(spark, str(tmp_path / "cache"), symbol="A").count() == 2
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.ndjson").write_text('{"timestamp": 1735741800, "event_type": "trade", "price": 1.5, "size": 2}\n\nbroken\n')
    (tmp_path / "raw" / "b.itch").write_bytes(binary.encode([("X", 5, {"id": 1, "shares": 3})], "itch-minimal"))
    got = files.read_any(spark, str(tmp_path / "raw"), symbol="S")
    assert sorted(rows(got, "event_type", "size")) == [("CX+", 3.0), ("MO+", 2.0)]
    np.savez(tmp_path / "p.npz", pred=np.array([0.1, 0.2]), label=np.array([0, 1]))
    assert rows(files.read_predictions(spark, str(tmp_path / "p.npz")), "idx", "label") == [(0, 0), (1, 1)]
    (tmp_path / "w.csv").write_text("name,weight\na,2\nb,x\n")
    assert rows(files.read_weights(spark, str(tmp_path / "w.csv"))) == [("a", 2.0)]
    (tmp_path / "r" / "a").mkdir(parents=True)
    (tmp_path / "r" / "a" / "eval.json").write_text('{"auroc": 0.5, "note": "x"}')
    assert rows(files.read_reports(spark, str(tmp_path / "r" / "*" / "*.json"))) == [("a", "auroc", 0.5)]
    (tmp_path / "m.yaml").write_text("a: [1, 2]\n")
    assert files.load_manifest(spark, str(tmp_path / "m.yaml")) == {"a": [1, 2]}


def test_registry_and_schema(spark):
    r = Registry()
    r.register("a", lambda x: x + 1)
    assert r.create("a", 1) == 2
    with pytest.raises(KeyError):
        r.register("a", str)
    with pytest.raises(KeyError):
        r.create("b")
    assert Catalog().queries.names() == []
    df = conform(spark.createDataFrame([(float("nan"), "x")], "price double, extra string"))
    assert df.columns[: len(EVENT_SCHEMA)] == EVENT_SCHEMA.fieldNames()
    assert rows(df, "price", "extra") == [(None, "x")]
    with pytest.raises(ValueError, match="missing columns"):
        require(df, "nothing")


def test_slice_arithmetic():
    assert clean.resolve_slice(100, rows=30) == (70, 100)
    assert clean.resolve_slice(100, rows=30, offset=10, index=1) == (30, 60)
    assert clean.resolve_slice(10, cap=50) == (0, 10)


def test_quantiles_of_any_column(spark):
    from tapeworks.functions.ranks import quantiles

    rng = np.random.default_rng(3)
    values = [*rng.normal(size=300).tolist(), *[0.25] * 500, None, None]
    df = spark.createDataFrame([(i % 3, v) for i, v in enumerate(values)], "g int, v double")
    probs = [0.0, 0.01, 0.37, 0.5, 0.99, 1.0]
    known = np.array([v for v in values if v is not None])
    assert quantiles(df, F.col("v"), probs).first()["q"] == pytest.approx(np.quantile(known, probs).tolist())
    for r in quantiles(df, -F.col("v"), probs, by=["g"]).collect():
        mine = np.array([-v for i, v in enumerate(values) if i % 3 == r["g"] and v is not None])
        assert r["q"] == pytest.approx(np.quantile(mine, probs).tolist())
    assert quantiles(df.where("v > 1e9"), F.col("v"), [0.5]).first()["q"] in (None, [None])
