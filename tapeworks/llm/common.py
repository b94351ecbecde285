"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.session import clear, scratch, ship, tables

#: White space and word patterns of the query contracts (fixed values).
WHITE = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: The columns that every pipeline stage but the last hands on.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One input table, with only the columns that are asked for."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def ascii_lower(column: Column) -> Column:
    """Lower-cases A-Z only; null counts as empty. lower() does the same to ASCII texts, and faster."""
    text = F.coalesce(column, F.lit(""))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def unused_prefix(df: DataFrame) -> str:
    """A prefix that no column of df begins with."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def words_of(column: Column) -> Column:
    """Array of words; empty for null."""
    return F.regexp_extract_all(F.coalesce(column, F.lit("")), F.lit(WORD), F.lit(0))


def materialise(df: DataFrame, label: str = "part", *, rows: int | None = None, per_file: int = 100_000) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends here, so a lost executor costs no recomputation of what came before.

    Given the most rows that df can have, it is written by tasks of per_file rows each instead of one file for every
    shuffle partition: thousands of tiny files cost more than what is in them.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    (df if rows is None else df.coalesce(max(1, -(-rows // per_file)))).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the intermediate tables that df reads, when nothing will read them again."""
    names = {f.split("/")[-2] for f in df.inputFiles()}
    clear(df.sparkSession, {path for path in tables(df.sparkSession) if path.rsplit("/", 1)[-1] in names})


@contextmanager
def without_shuffle_files(spark: SparkSession) -> Iterator[None]:
    """What is written within keeps no shuffle files once it is written; else they stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def small_join(big: DataFrame, small: DataFrame, keys: list[str], *, how: str = "inner", max_rows: int = 20_000, salts: int = 32) -> DataFrame:
    """Joins a per-key table to rows whose keys may be very uneven.

    Up to max_rows rows (counted, small is expected to be materialised) it is broadcast. Beyond that every key of small
    is repeated for each of `salts` salts and the rows of big are spread over them, so no key lands in one task.
    """
    if small.count() <= max_rows:
        return big.join(F.broadcast(small), keys, how)
    salt = f"{unused_prefix(big)}salt"
    salted = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = big.withColumn(salt, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in big.columns]), F.lit(salts)).cast("int"))
    return spread.join(salted, [*keys, salt], how).drop(salt)


def held_out(modulus: int, remainder: int, column: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves this remainder."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


#: Rows of one Arrow batch at most, for every operator alike: plans are lazy, so a number for each would follow what is built last.
BATCH_ROWS = 512


def python_rows(spark: SparkSession) -> None:
    """Makes Python workers ready: they can import this package, and get batches of few rows, as texts may be very long."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
