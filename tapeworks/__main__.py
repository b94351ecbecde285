"""Command line: python -m tapeworks <command> ...; each command is a short plan over the operators."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.operators import actions, clean, features, labels, metrics, models, panel, risk, splits, topology, tpp
from tapeworks.schema import conform
from tapeworks.session import session
from tapeworks.sources import files, lobster


def ingest(spark: SparkSession, a: argparse.Namespace) -> None:
    """Raw files to labelled events, one folder for each symbol."""
    hours = None if a.keep_auctions else (a.start, a.end, a.tz)
    df = files.read_any(spark, a.raw, symbol=a.symbol, levels=a.levels, tick=a.tick, session=hours)
    if a.actions:
        df = actions.adjust_corporate_actions(df, spark.read.option("header", "true").csv(a.actions).select("symbol", F.to_date("date").alias("date"), F.col("adj_factor").try_cast("double").alias("adj_factor")), mode=a.actions_mode)
        df = clean.round_price_columns(df, a.tick) if a.tick else df
    df = labels.instability_labels(labels.with_mid(df), seconds=a.seconds, events=a.events, eta=a.eta)
    files.write_events(df, a.out)
    files.write_report(spark, {"columns": df.columns, "tick": a.tick, "session": hours, "eta": a.eta}, f"{a.out.rstrip('/')}-meta")


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t == "double" and c.startswith(("imb_", "ret_", "cd", "dt", "spread", "tod_", "dow_", "qage_", "cnt_", "ewm_"))]


def build(spark: SparkSession, a: argparse.Namespace) -> None:
    """Events to features, splits and scaled columns."""
    df = splits.chronological_split(features.feature_block(files.read_events(spark, a.events_dir, symbol=a.symbol), windows_s=a.windows, taus_s=a.taus))
    wanted = feature_columns(df)
    scaler = splits.fit_scaler(df.where("split = 'train'"), wanted)
    splits.scale(df, scaler, wanted).write.mode("overwrite").partitionBy("split").parquet(a.out)
    files.write_split_schema(df, scaler, f"{a.out.rstrip('/')}-schema")


def evaluate(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Ranking and calibration of a prediction file."""
    df = metrics.valid(files.read_predictions(spark, a.predictions))
    return metrics.classification_report(df).join(metrics.delong_ci(df).select("lo", "hi")).first().asDict()


def aggregate(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Means of reports over folders, by weight if there are any."""
    return files.aggregate_reports(files.read_reports(spark, a.reports), files.read_weights(spark, a.weights) if a.weights else None, n_boot=a.n_boot)


def economic(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Tail risk of the returns in a prediction file, with coverage tests."""
    df = files.read_predictions(spark, a.predictions)
    exc = risk.exceedances(df, a.alpha)
    kupiec, chris = risk.kupiec(exc, a.alpha).first(), risk.christoffersen(exc).first()
    out = risk.var_es(df, a.alpha).first().asDict() | risk.utility_threshold(df).first().asDict()
    out |= {"kupiec_p": metrics.chi2_p(kupiec["lr"]), "christoffersen_p": metrics.chi2_p(chris["lr"])}
    if a.exceedances:
        files.write_csv(exc.select("idx", "exc"), a.exceedances, order=("idx",))
    return out


def preview(spark: SparkSession, a: argparse.Namespace) -> dict:
    """What corporate actions would change, with a sample of rows."""
    df = clean.filter_preview(files.read_table(spark, a.events_file), symbol=a.symbol)
    ca = spark.read.option("header", "true").csv(a.actions).select("symbol", F.to_date("date").alias("date"), F.col("adj_factor").try_cast("double").alias("adj_factor"))
    adjusted = actions.adjust_corporate_actions(df, ca)
    if a.sample:
        files.write_csv(actions.sample_before_after(df, adjusted, a.limit), a.sample)
    return actions.preview_summary(adjusted).first().asDict()


def panels(spark: SparkSession, a: argparse.Namespace) -> None:
    """Deciles and match groups of a panel file."""
    df = panel.match_groups(panel.deciles_by_rank(files.read_panel(spark, a.panel), by=["market"] if a.per_market else []))
    files.write_panel(df, a.out)


def point_process(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Likelihood and fit of a table of intensities."""
    df = spark.read.parquet(a.arrays)
    row = tpp.diagnostics(df).join(tpp.nll_per_event(df)).first().asDict()
    return row | {"ks_p": tpp.kolmogorov_p(row["ks"], row["n"]), "confusion": [r.asDict() for r in tpp.confusion(df).orderBy("actual", "predicted").collect()]}


def _labelled(df: DataFrame, a: argparse.Namespace) -> DataFrame:
    return labels.instability_labels(labels.with_mid(df), seconds=a.seconds, events=a.events, eta=a.eta)


def cache(spark: SparkSession, a: argparse.Namespace) -> None:
    """JSON lines to labelled events; the instrument is given, in the rows or, with --per-file, the file's stem."""
    raw = files.read_ndjson(spark, a.input)
    raw = raw.withColumn("symbol", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.[^./]*)?$", 1)) if a.per_file else raw
    hours = None if a.keep_auctions else (a.start, a.end, a.tz)
    files.write_events(_labelled(files.harmonise(raw, symbol=a.instrument, tick=a.tick, session=hours), a), a.out)


def merge_lobster(spark: SparkSession, a: argparse.Namespace) -> None:
    """Message and book pairs of several day folders to one table of labelled events."""
    days = [lobster.discover(spark, day, a.levels, symbol=a.instrument, tick=a.tick, price_scale=a.price_scale) for day in a.days]
    files.write_events(_labelled(conform(clean.union_frames(*days)), a), a.out)


def regime_metrics(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Ranking and calibration of calm and volatile rows, by the median of realised volatility, and of all."""
    df = risk.regimes(risk.realised_volatility(files.read_predictions(spark, a.predictions)))
    return risk.regime_metrics(metrics.valid(df))


def baseline_economics(spark: SparkSession, a: argparse.Namespace) -> dict | DataFrame:
    """VaR and ES of returns that are left out above a threshold, against returns of the same volatility."""
    df = files.read_predictions(spark, a.predictions)
    if a.grid:
        return risk.derisk_grid(df, a.grid_pcts, a.alpha)
    if a.threshold is not None:
        at = a.threshold
    elif a.threshold_objective == "utility":
        at = risk.utility_threshold(df, w_pos=a.w_pos, w_neg=a.w_neg).first()["threshold"]
    else:
        at = risk.risk_threshold(df, {"es_min": "es"}.get(a.threshold_objective, a.threshold_objective), alpha=a.alpha).first()["threshold"]
    return {"threshold": at} | risk.derisk(df, at, a.alpha).first().asDict()


def case_studies(spark: SparkSession, a: argparse.Namespace) -> None:
    """The rows of the test split with the largest moves: the top k, or those from a quantile on."""
    df = splits.chronological_split(labels.with_mid(files.read_events(spark, a.events_dir, symbol=a.instrument)))
    df = df.where("split = 'test'")
    found = labels.largest_moves(df, a.top_k, horizon_s=a.horizon_s) if a.top_k else labels.moves_above(df, a.quantile, horizon_s=a.horizon_s)
    files.write_csv(found.select("symbol", "ts_ns", "seq", "event_type", "mid", "abs_dmid"), a.output, order=("symbol", "ts_ns", "seq"))


def _modelled(spark: SparkSession, a: argparse.Namespace, *wanted: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Train and test rows of a built table with the wanted labels, and its features; missing values are 0."""
    df = spark.read.parquet(a.table)
    names = feature_columns(df)
    df = df.fillna(0.0, names)
    for label in wanted:
        df = df.where(F.col(label).isNotNull())
    return df.where("split = 'train'"), df.where("split = 'test'"), names


def baselines(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Logistic regression on the features of a built table, scored on its test rows."""
    train, test, names = _modelled(spark, a, a.label_key)
    scored = models.predict(models.fit_logistic(train, names, a.label_key), test, names)
    return metrics.classification_report(scored.select(F.col("seq").alias("idx"), "pred", F.col(a.label_key).alias("label"))).first().asDict()


def interpret(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """What shuffling each feature costs the logistic regression."""
    train, test, names = _modelled(spark, a, a.label_key)
    return models.permutation_importance(models.fit_logistic(train, names, a.label_key), test.withColumn("label", F.col(a.label_key)), names)


def report_multi(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """A logistic regression for each horizon's label of a built table."""
    wanted = [c for c in spark.read.parquet(a.table).columns if c.startswith("instability_")]
    train, test, names = _modelled(spark, a, *wanted)
    return models.multi_horizon(train, test, names, wanted, key="seq")


def cross_market(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Models of all markets of a panel, and of all but one, scored on the rows of each."""
    train, test, names = _modelled(spark, a, a.label_key)
    markets = files.read_panel(spark, a.panel).select(F.col("symbol").cast("string").alias("__symbol"), "market").distinct()
    both = train.union(test)
    both = both.join(markets, both["symbol"].cast("string") == markets["__symbol"])
    return models.cross_market(both, names, a.label_key, key="seq").where(F.col("mode") == {"pooled": "pooled", "lomo": "held_out"}[a.mode])


def topo_search(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """AUROC on validation rows of each configuration of topological features."""
    df = features.liquidity_surface(files.read_events(spark, a.events_dir, symbol=a.instrument), a.levels)
    grid = topology.search_grid([(w,) for w in a.windows], grids=tuple(a.landscape_res))
    return models.topology_search(splits.chronological_split(df), grid, a.label_key, chunk_s=a.chunk_s)


def manifest(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Runs the commands of a manifest: a list of {command: name, options: {...}} under `steps`."""
    done = {}
    for step in files.load_manifest(spark, a.manifest).get("steps", []):
        args = [step["command"], *[x for k, v in step.get("options", {}).items() for x in ((f"--{k}",) if v is True else (f"--{k}", *map(str, v if isinstance(v, list) else [v])))]]
        done[step["command"]] = run(spark, parser().parse_args(args))
    return done


COMMANDS = {"ingest": ingest, "build": build, "eval": evaluate, "aggregate": aggregate, "economic": economic, "ca-preview": preview, "panel": panels, "tpp-eval": point_process, "manifest": manifest, "backends": lambda spark, a: topology.backends()}
COMMANDS |= {"cache": cache, "merge-lobster": merge_lobster, "metrics-regime": regime_metrics, "econ-baseline": baseline_economics, "case-studies": case_studies, "baselines": baselines, "interpret": interpret, "report-multi": report_multi, "cross-market": cross_market, "topo-search": topo_search}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tapeworks", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    add = lambda name: sub.add_parser(name, help=COMMANDS[name].__doc__)
    c = add("ingest")
    c.add_argument("--raw", required=True)
    c.add_argument("--out", required=True)
    c.add_argument("--symbol")
    c.add_argument("--levels", type=int, default=10)
    c.add_argument("--tick", type=float)
    c.add_argument("--start", default="09:30")
    c.add_argument("--end", default="16:00")
    c.add_argument("--tz", default="America/New_York")
    c.add_argument("--keep-auctions", action="store_true")
    c.add_argument("--actions")
    c.add_argument("--actions-mode", default="divide")
    c.add_argument("--eta", type=float, default=0.0)
    c.add_argument("--seconds", type=float, nargs="*", default=[1, 5, 10])
    c.add_argument("--events", type=int, nargs="*", default=[100, 500])
    c = add("build")
    c.add_argument("--events-dir", required=True)
    c.add_argument("--out", required=True)
    c.add_argument("--symbol")
    c.add_argument("--windows", type=float, nargs="*", default=[])
    c.add_argument("--taus", type=float, nargs="*", default=[1, 5])
    for name in ("eval", "economic", "metrics-regime", "econ-baseline"):
        c = add(name)
        c.add_argument("--predictions", required=True)
        if name == "economic":
            c.add_argument("--alpha", type=float, default=0.99)
            c.add_argument("--exceedances")
        if name == "econ-baseline":
            c.add_argument("--alpha", type=float, default=0.99)
            c.add_argument("--threshold", type=float)
            c.add_argument("--threshold-objective", choices=["utility", "var_exceed", "es_min"], default="utility")
            c.add_argument("--grid", action="store_true")
            c.add_argument("--grid-pcts", type=int, nargs="*", default=[50, 60, 70, 80, 90, 95])
            c.add_argument("--w-pos", type=float, default=1.0)
            c.add_argument("--w-neg", type=float, default=1.0)
    for name in ("cache", "merge-lobster"):
        c = add(name)
        c.add_argument("--out", required=True)
        c.add_argument("--instrument")
        c.add_argument("--tick", type=float)
        c.add_argument("--eta", type=float, default=0.0)
        c.add_argument("--seconds", type=float, nargs="*", default=[1, 5, 10])
        c.add_argument("--events", type=int, nargs="*", default=[100, 500])
        if name == "cache":
            c.add_argument("--input", required=True)
            c.add_argument("--per-file", action="store_true")
            c.add_argument("--start", default="09:30")
            c.add_argument("--end", default="16:00")
            c.add_argument("--tz", default="America/New_York")
            c.add_argument("--keep-auctions", action="store_true")
        else:
            c.add_argument("--days", nargs="+", required=True)
            c.add_argument("--levels", type=int, default=10)
            c.add_argument("--price-scale", type=float, default=1.0)
    for name in ("case-studies", "topo-search"):
        c = add(name)
        c.add_argument("--events-dir", required=True)
        c.add_argument("--instrument")
        if name == "case-studies":
            c.add_argument("--output", required=True)
            c.add_argument("--horizon-s", type=float, default=5)
            c.add_argument("--quantile", type=float, default=0.99)
            c.add_argument("--top-k", type=int)
        else:
            c.add_argument("--label-key", required=True)
            c.add_argument("--levels", type=int, default=10)
            c.add_argument("--windows", type=float, nargs="*", default=[1.0, 5.0, 10.0])
            c.add_argument("--landscape-res", type=int, nargs="*", default=[64])
            c.add_argument("--chunk-s", type=float)
    for name in ("baselines", "interpret", "report-multi", "cross-market"):
        c = add(name)
        c.add_argument("--table", required=True, help="what build has written")
        if name != "report-multi":
            c.add_argument("--label-key", required=True)
        if name == "cross-market":
            c.add_argument("--panel", required=True)
            c.add_argument("--mode", choices=["pooled", "lomo"], default="pooled")
    c = add("aggregate")
    c.add_argument("--reports", required=True)
    c.add_argument("--weights")
    c.add_argument("--n-boot", type=int, default=500)
    c = add("ca-preview")
    c.add_argument("--events-file", required=True)
    c.add_argument("--actions", required=True)
    c.add_argument("--symbol")
    c.add_argument("--sample")
    c.add_argument("--limit", type=int, default=100)
    c = add("panel")
    c.add_argument("--panel", required=True)
    c.add_argument("--out", required=True)
    c.add_argument("--per-market", action="store_true")
    c = add("tpp-eval")
    c.add_argument("--arrays", required=True)
    c = add("manifest")
    c.add_argument("--manifest", required=True)
    add("backends")
    return p


def run(spark: SparkSession, a: argparse.Namespace):
    out = COMMANDS[a.command](spark, a)
    return [r.asDict() for r in out.collect()] if isinstance(out, DataFrame) else out


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    out = run(session(), a)
    if out is not None:
        print(json.dumps(out, sort_keys=True, default=str))


if __name__ == "__main__":
    main()
