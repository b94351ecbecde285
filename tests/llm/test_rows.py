"""Repeated and null ids, clashing columns, very long texts and hot groups; each operator and each pipeline stage."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tapeworks.llm import exact_dedup, langid, near_dedup, packing, pii, substring_dedup
from tapeworks.llm.common import DOCUMENT_COLUMNS
from tests.conftest import rows
from tests.llm import brute
from tests.llm.test_operators import OPERATORS, prose, table

_rng = random.Random(11)
SHARED = " ".join(prose(_rng, 12).capitalize() + "." for _ in range(4))
OTHER = " ".join(prose(_rng, 12).capitalize() + "." for _ in range(4))
#: One id with a long, a short and a null text, and rows that repeat each other wholly.
REPEATED = [(7, f"{SHARED} {OTHER}"), (7, "short"), (7, None), (7, OTHER), (3, f"{SHARED} tail here."), (None, OTHER), (None, None), (9, "twice"), (9, "twice")]
HELPERS = "__lead __hash __n __size __copies __parts __part __salt __mark __norm __at __keep __sizes __fresh __here __sha __row __id __content __text place content class component rep fp bands items id n at h1 h2 spans first r other hub key order label mine theirs group q m df l s v0 m0 l0_0 use start d bound scale base instances k e c p shard piece bin slot row ids n_tokens lang_pred held_out score predicted toxic words".split()


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_repeated_ids_with_other_texts(spark, name):
    out = OPERATORS[name](table(spark, REPEATED))
    assert out.count() == len(REPEATED)
    assert out.where("doc_id = 7").count() == 4 and out.where("doc_id is null").count() == 2


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_columns_named_like_helpers(spark, name):
    df = table(spark, [*REPEATED, (12, "some other words")]).withColumns({c: F.lit("x") for c in HELPERS})
    assert OPERATORS[name](df).count() == len(REPEATED) + 1


def test_exact_dedup_hands_clashing_columns_on(spark):
    df = table(spark, ["a", "A", "b"]).withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in HELPERS})
    out = exact_dedup.content_sort_dedup(df)
    for r in out.collect():
        assert all(r[c] == f"{c}{r.doc_id}" for c in HELPERS)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_a_text_of_a_megabyte(spark, name):
    rng = random.Random(1)
    texts = [prose(rng, 30_000, 5_000), "x" * 1_000_000, "ab cd " * 170_000, "short one"]
    assert OPERATORS[name](table(spark, texts)).select("doc_id").distinct().count() == 4


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, name):
    """Nulls, repeats, extra columns and empty tables; every stage but the last returns the columns of documents."""
    stage = dict(corpus_pipeline.STAGES)[name]
    odd = table(spark, [*REPEATED, "", "  ", None, "a b c"], extra="x", __id="y")
    out = stage(spark, odd, "")
    assert name == "packing" or tuple(out.columns) == DOCUMENT_COLUMNS
    out.collect()
    assert stage(spark, odd.limit(0), "").count() == 0


def test_near_dedup_links_by_each_text_of_an_id(spark):
    rng = random.Random(2)
    b, c = prose(rng, 60, 10_000), prose(rng, 60, 10_000)
    docs = spark.createDataFrame([(5, b), (5, c), (7, c + " more"), (3, b + " words"), (9, prose(rng, 60, 10_000))], "doc_id long, text string")
    out = rows(near_dedup.near_duplicates(docs, width=2), "doc_id", "component_id")
    assert sorted(out) == [(3, 3), (5, 3), (5, 3), (7, 3), (9, 9)]


def test_near_dedup_stage_drops_rows_not_ids(spark):
    rng = random.Random(3)
    b, c = prose(rng, 60, 10_000), prose(rng, 60, 10_000)
    docs = table(spark, [(5, b), (5, c), (3, b + " words"), (8, c + " more"), (8, c + " again"), (2, None), (None, b)])
    left = sorted((r.doc_id or 0, r.text or "") for r in near_dedup.stage(spark, docs, "").collect())
    assert left == sorted([(3, b + " words"), (5, c), (2, ""), (0, b)])


def test_spans_of_one_id_are_kept_apart(spark):
    out = {(r.doc_id, r.n_sentences): (r.text or "", r.n_removed) for r in substring_dedup.substring_dedup(table(spark, REPEATED)).collect() if r.doc_id in (7, 3)}
    assert out[3, 5] == (f"{SHARED} tail here.", 0)  # the least id is first
    assert out[7, 8][1] in (4, 8) and out[7, 1] == ("short", 0) and out[7, 0] == ("", 0)
    assert {out[7, 8][1], out[7, 4][1]} in ({4}, {8, 0}, {4, 0}, {8, 4}) and out[7, 8][1] + out[7, 4][1] == 8


def test_exact_dedup_spreads_and_compares_hot_texts(spark):
    """A hot text, leads that many unlike texts share, texts that only lower() makes equal, hot rows without any id."""
    data = [(i, "Hot text") for i in range(400)] + [(1000 + i, "the same long beginning of it " + str(i % 150)) for i in range(300)]
    data += [(2000 + i, "\u00c4hnlich" if i % 2 else "\u00e4hnlich") for i in range(200)] + [(None, "nobody")] * 150 + [(None, "hot TEXT"), (3000, "NOBODY?"), (5, "hot text"), (None, None), (7, "")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("x", F.monotonically_increasing_id())
    for keep, best in (("largest", max), ("smallest", min)):
        out = exact_dedup.content_sort_dedup(df, keep=keep, most_rows=20, partitions=7).collect()
        groups = {}
        for i, t in data:
            groups.setdefault(brute.lower(t), []).append(i)
        assert len(out) == len(data)
        for r in out:
            ids = groups[brute.lower(r.text)]
            assert (r.group_size, r.keep_id) == (len(ids), best((i for i in ids if i is not None), default=None)), r
        for t, ids in groups.items():
            assert sum(r.kept for r in out if brute.lower(r.text) == t) == 1, t


def test_packing_spreads_rows_of_one_id(spark):
    df = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b c").alias("text"))
    out = packing.best_fit_packing(df, shard_pieces=100)
    assert out.groupBy("shard").count().agg(F.max("count")).first()[0] < 200 and out.count() == 3000


def test_training_rows_of_one_id_are_read_once(spark):
    df = spark.range(200).select(F.lit(1).cast("long").alias("doc_id"), F.lit("der die das und nicht ein eine").alias("text"), F.lit("de").alias("lang"))
    seen = []
    fit, langid.fit = langid.fit, lambda s, y, k, seed=0: seen.extend(s) or fit(s, y, k, seed)
    try:
        langid.train(df)
    finally:
        langid.fit = fit
    assert len(seen) == 1


def test_all_words_of_a_training_text_are_read(spark):
    text = " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(5000))
    seen = []
    fit, langid.fit = langid.fit, lambda s, y, k, seed=0: seen.extend(s) or fit(s, y, k, seed)
    try:
        langid.train(spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string"))
    finally:
        langid.fit = fit
    assert sorted(w for s in seen for w in s) == sorted(text.split())


def test_contexts_of_long_words(spark):
    """A pattern of words longer than any fixed number of characters."""
    rng = random.Random(4)
    long = ("kontonummernverzeichnis" * 3, "unterbrechungsfreistellung" * 3, "bezeichner")
    docs = [f"x{i} {' '.join(long)} +49 {rng.randrange(10**8, 10**9)} ok" for i in range(9)] + [f"{' '.join(long)} 7788-9911x end"]
    out = {r.doc_id: r for r in pii.personal_data(table(spark, docs)).collect()}
    assert [docs[9][x.s : x.e] for x in out[10].spans] == ["7788-9911x"]

