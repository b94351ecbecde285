"""Corpus operators do the whole job: cases that an earlier form left undone."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tapeworks.llm import near_dedup, substring_dedup
from tapeworks.session import tables


def _sentence(rng, n):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) + "."


def _left(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return {r.doc_id: r.text for r in substring_dedup.substring_dedup(df).collect()}


def test_the_tail_of_a_repeated_passage_goes(spark):
    rng = random.Random(1)
    unit = " ".join(_sentence(rng, n) for n in (20, 8, 7))
    a, b, c, d = (_sentence(rng, 30) for _ in range(4))
    out = _left(spark, [(1, f"{a} {unit} {b}"), (2, f"{c} {unit} {d}")])
    assert out[1] == f"{a} {unit} {b}"
    assert out[2].split() == f"{c} {d}".split()


def _chars(rng, first, last, n):
    return "".join(chr(rng.randrange(first, last)) for _ in range(n))


def test_passages_in_scripts_without_blanks_go(spark):
    rng = random.Random(2)
    han = lambda: _chars(rng, 0x4E00, 0x9000, 14) + "\u3002"
    thai = lambda: _chars(rng, 0x0E01, 0x0E2F, 60)
    shared, a, b, c, d = "".join(han() for _ in range(5)), han(), han(), han(), han()
    phrases, e, f = " ".join(thai() for _ in range(3)), thai(), thai()
    out = _left(spark, [(1, a + shared + b), (2, c + shared + d), (3, f"{e} {phrases}"), (4, f"{phrases} {f}")])
    assert out[1] == a + shared + b and out[2] == c + d
    assert out[3] == f"{e} {phrases}" and out[4] == f


def test_a_cyrillic_passage_pasted_into_a_sentence_goes_whole(spark):
    rng = random.Random(3)
    word = lambda: _chars(rng, 0x430, 0x450, 7)
    line = lambda: " ".join(word() for _ in range(9)).capitalize() + "."
    passage, a, b, c, d = " ".join(line() for _ in range(4)), word(), word().capitalize(), word(), word().capitalize()
    out = _left(spark, [(1, f"{a} {passage} {b}"), (2, f"{c} {passage} {d}")])
    assert out[2].split() == [c, d]


def test_joined_sentences_are_the_text():
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice(["a", "B", ".", " ", "\n", "\u3002", "\u300d", "\u4e00", "\u0e01", "\u0430", "\u0410", "\u3000", "|"]) for _ in range(40))
        parts, breaks, _ = substring_dedup.sentences(text)
        assert "".join(p + b for p, b in zip(parts, breaks, strict=True)) == text
        plain = "".join(x for x in text if x.isascii())
        assert substring_dedup.BREAK.split(plain) == substring_dedup.ASCII_BREAK.split(plain)


def _shuffled(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def test_near_duplicates_leave_texts_where_they_are(spark):
    """Texts that meet no other aren't shuffled, and neither shuffle files nor tables of all bands outlast their use."""
    rng = random.Random(3)
    docs = [(i, " ".join(f"{rng.getrandbits(60):x}" for _ in range(1500))) for i in range(200)]
    docs += [(1000 + i, docs[i][1] + " more") for i in range(5)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    size = sum(len(t) for _, t in docs)
    files, others, shuffled = _shuffle_files(spark), tables(spark), _shuffled(spark)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = near_dedup.near_duplicates(df, width=2)
        left = _shuffle_files(spark) - files
        assert _shuffled(spark) - shuffled < size / 3
        assert not left
        assert not [t for t in tables(spark) - others if "near-signatures" in t or "near-mapped" in t]
        assert {r.doc_id: r.component_id for r in found.collect()} == {i: i % 1000 for i, _ in docs}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_full_filter_of_texts_loses_none(spark, monkeypatch):
    rng = random.Random(5)
    docs = [(i, " ".join(f"w{rng.getrandbits(40)}" for _ in range(20))) for i in range(300)]
    df = spark.createDataFrame(docs + docs[:9], "doc_id long, text string").withColumn("content", near_dedup._content())
    chosen = df.where("doc_id % 3 = 0").select("doc_id", "content").distinct()
    want = sorted(r.doc_id for r in df.where("doc_id % 3 = 0").collect())
    for most in (1, near_dedup.MOST_SLOTS):
        monkeypatch.setattr(near_dedup, "MOST_SLOTS", most)
        passed = near_dedup._likely(df, chosen)
        assert passed.columns == df.columns
        assert sorted(r.doc_id for r in passed.join(chosen, ["doc_id", "content"]).collect()) == want
    assert passed.where(F.col("doc_id") % 3 != 0).count() < 30
    assert near_dedup._likely(df, chosen.limit(0)).isEmpty()
