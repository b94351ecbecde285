"""Shared helpers, and rows that are odd in other columns than the text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeworks.llm import quality_rules
from tapeworks.llm.common import held_out, materialise, small_join
from tests.conftest import rows


def test_small_join_salted_equals_broadcast(spark):
    big = spark.range(500).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"), F.lit("x").alias("kept"))
    small = spark.createDataFrame([(0, "a"), (1, "b"), (5, "c")], "k long, s string")
    for how in ("inner", "left"):
        a, b = (sorted(rows(small_join(big, small, ["k"], how=how, max_rows=n), "k", "v", "s"), key=repr) for n in (10, 0))
        assert a == b
    assert len(a) == 500


def test_materialise_in_few_files(spark):
    df = spark.range(1000).repartition(7)
    out = materialise(df, rows=1000, per_file=500)
    assert out.count() == 1000 and len(out.inputFiles()) <= 2
    assert materialise(df.limit(0), rows=0).count() == 0


def test_held_out_of_nulls(spark):
    df = spark.createDataFrame([(1,), (None,)], "doc_id long").withColumn("h", held_out(5, 0))
    assert rows(df.where("doc_id is null"), "h") == [(False,)]


def test_quality_with_null_and_small_groups(spark):
    words = [f"{chr(97 + i % 26)}{chr(97 + i % 7)}xy" for i in range(40)]
    docs = [(i, " ".join(words[i % 20 :] + words[: i % 20]), (None, "en", "de")[i % 3], None if i % 2 else "s", 0) for i in range(150)]
    docs += [(7, " ".join(w + "$$$$" for w in words), "en", "s", 0), (None, " ".join(words), None, None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    out = quality_rules.quality_rules(df)
    assert out.count() == len(docs)
    kept = [tuple(r) for r in quality_rules.stage(spark, df, "").select("doc_id", "text").collect()]
    assert (None, " ".join(words)) in kept
    # of the two rows with doc_id 7 only the clean one stays
    assert [t for i, t in kept if i == 7] == [docs[7][1]]


def test_shared_folder_is_the_sessions(spark):
    from tapeworks.session import shared_dir

    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
