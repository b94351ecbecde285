"""Reading and writing of event tables, predictions, panels, reports and manifests."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.operators import bootstrap, clean
from tapeworks.schema import EVENT_SCHEMA, SEQ, SYMBOL, TS, conform, require
from tapeworks.session import ship
from tapeworks.sources import binary, lobster

REQUIRED = (TS, "event_type", "size")
#: Aliases of panel columns (fixed values).
PANEL_ALIASES = {"market": ("market", "Market", "mkt"), "symbol": ("symbol", "Symbol", "instr")}
RAW = "timestamp string, event_type string, price string, size string, level string, side string, symbol string, venue string, trading_state string"


def read_ndjson(spark: SparkSession, path: str, *, stream: bool = False) -> DataFrame:
    """Raw rows of JSON lines under path; blank and malformed lines give none, an empty file the same columns."""
    reader = (spark.readStream if stream else spark.read).option("recursiveFileLookup", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad")
    df = reader.schema(RAW + ", _bad string").json(path)
    # Files are read again where only _bad is asked for; a filter on the parsed columns too keeps the scan whole.
    return df.where(F.col("_bad").isNull() & (F.col("timestamp").isNotNull() | F.col("event_type").isNotNull())).drop("_bad")


def harmonise(raw: DataFrame, *, symbol: str | None = None, tick: float | None = None, scale: float = 1.0, session: tuple[str, str, str] | None = None, min_price: float = 0.0, min_size: float = 0.0, dedupe: bool = True, source_tz: str = "UTC") -> DataFrame:
    """Canonical events of raw rows: types, prices, times; session, halts, quality and duplicates if asked for.

    Times written without a zone are local to source_tz.
    """
    df = raw.withColumn(TS, clean.to_epoch_ns(F.col("timestamp"), source_tz)).drop("timestamp")
    df = df.withColumn(SYMBOL, F.coalesce(F.col(SYMBOL), F.lit(symbol)))
    df = clean.canonical_events(df, tick=tick, scale=scale)
    if SEQ not in df.columns:
        df = df.withColumn(SEQ, F.monotonically_increasing_id())
    df = conform(df)
    if session:
        start, end, tz = session
        df = clean.halt_gap_filter(clean.explicit_halt_filter(clean.session_filter(df, start=start, end=end, tz=tz)), tz=tz)
    df = clean.quality_filter(df, min_price=min_price, min_size=min_size)
    return clean.first_of_duplicates(df, [SYMBOL, TS, "event_type", "price", "size"], [SEQ]) if dedupe else df


def read_any(spark: SparkSession, path: str, *, symbol: str | None = None, levels: int = 10, **options) -> DataFrame:
    """All event files under a folder by their suffix: .ndjson .jsonl .itch .itc .bin .ouch .ouc, and CSV pairs."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    it, names = fs.listFiles(hadoop, True), set()
    while it.hasNext():
        names.add(it.next().getPath().getName().rsplit(".", 1)[-1].lower())
    parts = []
    if names & {"ndjson", "jsonl"}:
        lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{ndjson,jsonl}").schema(RAW + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
        parts.append(harmonise(lines.where(F.col("_bad").isNull() & F.col("event_type").isNotNull()).drop("_bad"), symbol=symbol, **options))
    if names & {"itch", "itc", "bin"}:
        parts.append(binary.read_files(spark, path, "itch", symbol=symbol, glob="*.{itch,itc,bin}"))
    if names & {"ouch", "ouc"}:
        parts.append(binary.read_files(spark, path, "ouch", symbol=symbol, glob="*.{ouch,ouc}"))
    if "csv" in names:
        parts.append(conform(lobster.discover(spark, path, levels, symbol=symbol)))
    return clean.union_frames(*parts) if parts else spark.createDataFrame([], EVENT_SCHEMA)


def write_events(df: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """One folder for each symbol; rows of a symbol are written in order. Large symbols are split over files by time."""
    df.repartitionByRange(SYMBOL, TS).sortWithinPartitions(SYMBOL, TS, SEQ).write.mode(mode).partitionBy(SYMBOL).parquet(path)


def read_events(spark: SparkSession, path: str, *, symbol: str | None = None) -> DataFrame:
    """The written table, or one symbol of it (only its folder is read)."""
    df = require(spark.read.parquet(path), *REQUIRED)
    return df.where(F.col(SYMBOL) == symbol) if symbol is not None else df


def instruments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(SYMBOL).distinct()


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """idx, pred, label and what else there is, from CSV files with a header or NPZ files."""
    if path.endswith(".npz"):
        files = spark.read.format("binaryFile").load(path).select("content")

        def arrays(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import numpy as np

            for batch in batches:
                for content in batch["content"]:
                    z = np.load(io.BytesIO(content))
                    n = len(z["pred"])
                    get = lambda k, z=z, n=n: z[k].astype(float) if k in z.files else np.full(n, np.nan)
                    yield pd.DataFrame({"idx": z["idx"] if "idx" in z.files else np.arange(n), "pred": z["pred"].astype(float), "label": z["label"].astype(int), "ret": get("ret"), "pred2": get("pred2")})

        ship(spark)
        return files.mapInPandas(arrays, "idx long, pred double, label int, ret double, pred2 double")
    df = spark.read.option("header", "true").csv(path)
    kinds = {"idx": "long", "pred": "double", "label": "double", "ret": "double", "pred2": "double"}
    return df.select(*[(F.col(c).try_cast(kinds[c]).cast("int") if c == "label" else F.col(c).try_cast(kinds[c])).alias(c) for c in df.columns if c in kinds])


def zip_files(a: DataFrame, b: DataFrame, order: str = "idx") -> DataFrame:
    """Rows of two prediction files by number; different lengths are an error."""
    from tapeworks.functions.ranks import running_totals

    number = lambda df, o: running_totals(df.withColumn("one", F.lit(1).cast("long")), [o], ["one"]).withColumnRenamed("before_one", "at").drop("one")
    n, m = a.count(), b.count()
    if n != m:
        raise ValueError(f"{n} predictions and {m} returns")
    return number(a, order).join(number(b, order).drop(order), "at").drop("at")


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """Panel from CSV or JSON, under its usual column names."""
    df = spark.read.json(path) if path.endswith(".json") else spark.read.option("header", "true").option("inferSchema", "false").csv(path)
    have = set(df.columns)
    cols = []
    for name, others in PANEL_ALIASES.items():
        found = [F.col(c) for c in others if c in have]
        cols.append((F.coalesce(*found) if found else F.lit(None)).cast("string").alias(name))
    numbers = [F.col(c).try_cast("double").alias(c) for c in ("median_daily_notional", "tick_size") if c in have]
    used = {c for others in PANEL_ALIASES.values() for c in others} | {"median_daily_notional", "tick_size"}
    return df.select(*cols, *numbers, *[F.col(c) for c in df.columns if c not in used])


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """name and weight; rows without a number are left out."""
    df = spark.read.schema("name string, weight string").option("header", "true").csv(path)
    return df.select("name", F.col("weight").try_cast("double").alias("weight")).where(F.col("weight").isNotNull())


def read_reports(spark: SparkSession, glob: str) -> DataFrame:
    """name (of the report's folder), metric and value of JSON reports."""
    df = spark.read.text(glob, wholetext=True)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return df.select(name.alias("name"), F.explode(F.from_json("value", "map<string,string>")).alias("metric", "v")).select("name", "metric", F.col("v").try_cast("double").alias("value")).where(F.col("value").isNotNull())


def aggregate_reports(reports: DataFrame, weights: DataFrame | None = None, *, n_boot: int = 0, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """metric, n, macro and micro over reports; with n_boot also lo and hi, the bootstrap interval of macro."""
    df = reports.join(weights, "name", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0))) if weights is not None else reports.withColumn("weight", F.lit(1.0))
    out = df.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("macro"), (F.sum(F.col("weight") * F.col("value")) / (F.sum("weight") + 1e-12)).alias("micro"))
    if not n_boot:
        return out
    drawn = bootstrap.resampled(reports.select("metric", "value", F.xxhash64("name", "metric", "value").alias("key")), n_boot, key="key", seed=seed)
    means = drawn.groupBy("metric", "replicate").agg((F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("mean"))
    ends = means.groupBy("metric").agg(F.percentile("mean", alpha / 2).alias("lo"), F.percentile("mean", 1 - alpha / 2).alias("hi"))
    return out.join(ends, "metric", "left")


def p_values_by_type(spark: SparkSession, glob: str, field: str = "ks_per_type") -> DataFrame:
    """name, type and p of a map of p-values in JSON reports."""
    df = spark.read.text(glob, wholetext=True)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return df.select(name.alias("name"), F.explode(F.from_json(F.get_json_object("value", f"$.{field}"), "map<string,double>")).alias("type", "p"))


def load_manifest(spark: SparkSession, path: str) -> dict[str, Any]:
    """A manifest or configuration in YAML or JSON."""
    text = "\n".join(r.value for r in spark.read.text(path).collect())  # a small file that people write
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text) or {}


def write_predictions(df: DataFrame, path: str) -> None:
    df.select("idx", "pred", "label").write.mode("overwrite").option("header", "true").csv(path)


def write_panel(df: DataFrame, path: str) -> None:
    """JSON or CSV by the path's suffix."""
    w = df.write.mode("overwrite")
    w.json(path) if path.endswith(".json") else w.option("header", "true").csv(path)


def write_report(spark: SparkSession, report: dict[str, Any], path: str) -> None:
    """A small JSON document through Spark's writers, so that any store will do."""
    spark.createDataFrame([(json.dumps(report, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_split_schema(df: DataFrame, scaler: DataFrame, path: str) -> None:
    """Feature names and scaler of a split table beside it."""
    write_report(df.sparkSession, {"columns": df.columns, "types": [t for _, t in df.dtypes], "scaler": scaler.first().asDict()}, path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table or JSON lines, by what is there."""
    return harmonise(read_ndjson(spark, path)) if path.endswith((".ndjson", ".jsonl")) else spark.read.parquet(path)


def socket_lines(spark: SparkSession, host: str, port: int) -> DataFrame:
    """A stream of text lines from a socket, for development: it can't be replayed after a failure."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def write_intensities(df: DataFrame, path: str) -> None:
    """Rows of a point process as Parquet and their diagnostics beside it."""
    from tapeworks.operators import tpp

    df.write.mode("overwrite").parquet(f"{path}/arrays")
    row = tpp.diagnostics(df).first().asDict()
    write_report(df.sparkSession, row | {"ks_p": tpp.kolmogorov_p(row["ks"], row["n"])}, f"{path}/diagnostics")


def write_csv(df: DataFrame, path: str, *, limit: int | None = None, order: tuple[str, ...] = ()) -> None:
    """CSV with a header; with a limit the first rows in order."""
    df = df.orderBy(*order) if order else df
    (df.limit(limit) if limit else df).write.mode("overwrite").option("header", "true").csv(path)


def bundle(spark: SparkSession, globs: list[str], path: str) -> int:
    """Reports and small tables that match the globs as one zip file; how many files it holds."""
    import zipfile

    hadoop, buffer, n = spark._jvm.org.apache.hadoop.fs.Path, io.BytesIO(), 0
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for glob in globs:
            fs = hadoop(glob).getFileSystem(spark._jsc.hadoopConfiguration())
            for status in fs.globStatus(hadoop(glob)) or []:
                if status.isFile():
                    name = status.getPath().toUri().getPath().lstrip("/")
                    z.writestr(name, bytes(spark.read.format("binaryFile").load(status.getPath().toString()).select("content").first()[0]))
                    n += 1
    out = hadoop(path)
    stream = out.getFileSystem(spark._jsc.hadoopConfiguration()).create(out, True)
    stream.write(bytearray(buffer.getvalue()))
    stream.close()
    return n
