"""Commands end to end on small files."""

from __future__ import annotations

import json

import pytest

from tapeworks import __main__ as cli


def call(spark, *args):
    return cli.run(spark, cli.parser().parse_args(list(args)))


def test_ingest_then_build(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    lines = [json.dumps({"timestamp": f"2024-01-02T15:{i // 60:02d}:{i % 60:02d}Z", "event_type": ("trade", "add", "cancel")[i % 3], "price": 100 + (i // 15) * 0.5, "size": 1 + i % 4, "symbol": "X"}) for i in range(90)]
    (raw / "a.ndjson").write_text("\n".join(lines) + "\n")
    (tmp_path / "ca.csv").write_text("symbol,date,adj_factor\nX,2024-01-02,2.0\n")
    call(spark, "ingest", "--raw", str(raw), "--out", str(tmp_path / "ev"), "--actions", str(tmp_path / "ca.csv"), "--seconds", "10", "--events", "5")
    ev = spark.read.parquet(str(tmp_path / "ev"))
    assert ev.count() == 90
    assert {"instability_s_10", "instability_e_5"} <= set(ev.columns)
    assert ev.agg({"price": "min"}).first()[0] == 50.0
    assert {r[0] for r in ev.select("instability_s_10").distinct().collect()} == {0, 1}


def test_reports(spark, tmp_path):
    (tmp_path / "p.csv").write_text("idx,pred,label,ret\n0,0.1,0,0.01\n1,0.9,1,-0.05\n2,0.8,1,-0.02\n3,0.2,0,0.03\n")
    assert call(spark, "eval", "--predictions", str(tmp_path / "p.csv"))["auroc"] == 1.0
    out = call(spark, "economic", "--predictions", str(tmp_path / "p.csv"), "--alpha", "0.5", "--exceedances", str(tmp_path / "exc"))
    assert out["threshold"] == 0.8 and out["es"] == pytest.approx(0.035)
    for name, v in (("a", 0.5), ("b", 1.0)):
        (tmp_path / "r" / name).mkdir(parents=True)
        (tmp_path / "r" / name / "eval.json").write_text(json.dumps({"auroc": v}))
    (tmp_path / "w.csv").write_text("name,weight\na,3\n")
    (row,) = call(spark, "aggregate", "--reports", str(tmp_path / "r" / "*" / "*.json"), "--weights", str(tmp_path / "w.csv"))
    assert row["macro"] == 0.75 and row["micro"] == pytest.approx(0.625)
    (tmp_path / "m.json").write_text(json.dumps({"steps": [{"command": "eval", "options": {"predictions": str(tmp_path / "p.csv")}}]}))
    assert call(spark, "manifest", "--manifest", str(tmp_path / "m.json"))["eval"]["auprc"] == 1.0


def test_panel_and_backends(spark, tmp_path):
    (tmp_path / "panel.csv").write_text("mkt,symbol,median_daily_notional,tick_size\nN,A,1e6,0.01\nN,B,8e5,0.01\nP,C,5e5,0.01\n")
    call(spark, "panel", "--panel", str(tmp_path / "panel.csv"), "--out", str(tmp_path / "out.json"))
    got = {r.symbol: r.liq_decile for r in spark.read.json(str(tmp_path / "out.json")).collect()}
    assert got == {"C": 0, "B": 3, "A": 6}
    assert set(call(spark, "backends")) == {"ripser", "gudhi", "persim"}


def test_models_of_a_built_table(spark, tmp_path):
    from tapeworks.operators import labels
    from tapeworks.plans.tables import book
    from tapeworks.sources import files
    from tests.conftest import SF

    out = lambda name: str(tmp_path / name)
    files.write_events(labels.instability_labels(book(spark, SF).where("symbol < 3"), seconds=[3600], events=[5], eta=10), out("ev"))
    call(spark, "build", "--events-dir", out("ev"), "--out", out("table"), "--taus", "3600")
    key = ("--table", out("table"), "--label-key", "instability_e_5")
    report = call(spark, "baselines", *key)
    assert 0 <= report["auroc"] <= 1 and 0 <= report["brier"] <= 1
    names = cli.feature_columns(spark.read.parquet(out("table")))
    assert {r["feature"] for r in call(spark, "interpret", *key)} == set(names)
    assert {r["horizon"] for r in call(spark, "report-multi", "--table", out("table"))} == {"instability_s_3600", "instability_e_5"}
    symbols = [r[0] for r in spark.read.parquet(out("ev")).select("symbol").distinct().orderBy("symbol").collect()]
    (tmp_path / "panel.csv").write_text("market,symbol,median_daily_notional,tick_size\n" + "".join(f"M{s},{s},1,0.01\n" for s in symbols))
    held = call(spark, "cross-market", *key, "--panel", out("panel.csv"), "--mode", "lomo")
    assert {r["market"] for r in held} == {f"M{s}" for s in symbols}
    assert [r["mode"] for r in call(spark, "cross-market", *key, "--panel", out("panel.csv"))] == ["pooled"]
    call(spark, "case-studies", "--events-dir", out("ev"), "--output", out("cases"), "--top-k", "3", "--horizon-s", "3600")
    assert spark.read.option("header", "true").csv(out("cases")).count() == 3
    searched = call(spark, "topo-search", "--events-dir", out("ev"), "--instrument", str(symbols[0]), "--label-key", "instability_e_5", "--levels", "3", "--windows", "43200", "--landscape-res", "8", "--chunk-s", "1728000")
    assert len(searched) == 8 and all(r["auroc"] is None or 0 <= r["auroc"] <= 1 for r in searched)


def test_regimes_and_thresholds(spark, tmp_path):
    lines = [f"{i},{(i * 7 % 10) / 10},{int(i >= 60 and i % 2)},{(0.001 if i < 60 else 0.05) * (-1) ** i}" for i in range(120)]
    (tmp_path / "p.csv").write_text("idx,pred,label,ret\n" + "\n".join(lines) + "\n")
    got = {r["regime"]: r for r in call(spark, "metrics-regime", "--predictions", str(tmp_path / "p.csv"))}
    assert set(got) == {"calm", "volatile", "overall"} and got["calm"]["n"] == 60
    assert got["calm"]["auroc"] == 0.5  # one class
    file = ("econ-baseline", "--predictions", str(tmp_path / "p.csv"), "--alpha", "0.9")
    assert call(spark, *file, "--threshold", "0.5")["threshold"] == 0.5
    for objective in ("utility", "es_min", "var_exceed"):
        assert set(call(spark, *file, "--threshold-objective", objective)) == {"threshold", "scale", "var_protected", "es_protected", "var_baseline", "es_baseline"}
    assert len(call(spark, *file, "--grid")) == 6


def test_cache_and_merge(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    for name in ("AA", "BB"):
        (raw / f"{name}.ndjson").write_text("".join(json.dumps({"timestamp": f"2024-01-02T15:00:{i:02d}Z", "event_type": "trade", "price": 10 + i, "size": 1}) + "\n" for i in range(5)))
    call(spark, "cache", "--input", str(raw), "--out", str(tmp_path / "one"), "--instrument", "X")
    assert {r[0] for r in spark.read.parquet(str(tmp_path / "one")).select("symbol").distinct().collect()} == {"X"}
    call(spark, "cache", "--input", str(raw), "--out", str(tmp_path / "each"), "--per-file", "--keep-auctions")
    assert {(r[0], r[1]) for r in spark.read.parquet(str(tmp_path / "each")).groupBy("symbol").count().collect()} == {("AA", 5), ("BB", 5)}
    for day in ("d1", "d2"):
        (tmp_path / day).mkdir()
        (tmp_path / day / f"A_{day}_message_1.csv").write_text("34200.0,1,11,5,100000,1\n34201.0,4,11,5,100000,1\n")
        (tmp_path / day / f"A_{day}_orderbook_1.csv").write_text("100100,7,100000,5\n100200,7,100000,5\n")
    call(spark, "merge-lobster", "--instrument", "A", "--days", str(tmp_path / "d1"), str(tmp_path / "d2"), "--out", str(tmp_path / "merged"), "--levels", "1")
    assert spark.read.parquet(str(tmp_path / "merged")).count() == 4
