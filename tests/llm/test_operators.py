"""Corpus operators on small tables: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tapeworks.llm import bpe, exact_dedup, langid, licenses, near_dedup, packing, pii, quality_rules, substring_dedup, toxicity
from tests.conftest import SF, SF_ORACLE, rows, sorted_rows
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts, **extra):
    """Documents with ids from 1; a text may be a tuple (id, text)."""
    data = [(*(x if isinstance(x, tuple) else (i + 1, x)), "en", "s", None if (t := x[1] if isinstance(x, tuple) else x) is None else len(t)) for i, x in enumerate(texts)]
    df = spark.createDataFrame(data, DOCS)
    return df.withColumns({k: F.lit(v) for k, v in extra.items()}) if extra else df


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


ODD = [None, "", "   \n\t ", "One", "x" * 5000, "Ünïcödé 日本 😀 text", "a b c", "Same text", "same TEXT", "same text", (None, "no id"), (None, None), (7, "again"), (7, "again")]
OPERATORS = {
    "exact_dedup": lambda d: exact_dedup.content_sort_dedup(d),
    "near_duplicates": lambda d: near_dedup.near_duplicates(d, width=2),
    "substring_dedup": lambda d: substring_dedup.substring_dedup(d),
    "quality_rules": lambda d: quality_rules.quality_rules(d),
    "personal_data": lambda d: pii.personal_data(d),
    "packing": lambda d: packing.best_fit_packing(d),
    "encoding": lambda d: bpe.encoding_digests(d),
    "language": lambda d: langid.identify(d, langid.train(d)),
    "license_scan": lambda d: licenses.license_scan(d),
    "toxicity": lambda d: toxicity.toxicity(d, d.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows_give_a_row_each(spark, name):
    """Nulls, empty and long texts, repeated rows, null ids and columns named like results or helpers."""
    clash = dict.fromkeys(("kept", "score", "ids", "spans", "n_words", "key", "row", "bin", "rep", "label", "__row2"), "x")
    out = OPERATORS[name](table(spark, ODD, **clash))
    assert out.count() == len(ODD)
    assert out.where("doc_id is null").count() == 2


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, name):
    assert OPERATORS[name](table(spark, ["x"]).limit(0)).count() == 0


def test_exact_dedup_groups(spark):
    out = {r.doc_id: r for r in exact_dedup.content_sort_dedup(table(spark, ODD[:10]), keep="largest").collect()}
    assert [(out[i].keep_id, out[i].group_size, out[i].kept) for i in (8, 9, 10)] == [(10, 3, False), (10, 3, False), (10, 3, True)]
    assert (out[1].keep_id, out[1].group_size) == (2, 2)  # null counts as empty
    assert out[8].text_sha256 == hashlib.sha256(b"same text").hexdigest()
    small = {r.doc_id: r.kept for r in exact_dedup.content_sort_dedup(table(spark, ODD[:10])).collect()}
    assert small[8] and not small[10]
    twice = exact_dedup.content_sort_dedup(table(spark, [(7, "a"), (7, "a"), (None, "b"), (None, "b"), (None, "a")])).where("kept").collect()
    assert sorted((r.text, r.doc_id) for r in twice) == [("a", 7), ("b", None)]


def test_exact_dedup_hot_group_is_spread(spark):
    """A text with most of the rows goes through the counted and salted path."""
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    out = exact_dedup.content_sort_dedup(df, keep="largest", partitions=8)
    assert rows(out.where("text = 'hot'").agg(F.min("group_size"), F.max("keep_id"), F.count_if("kept"))) == [(2000, 2999, 1)]
    assert out.where("kept").count() == 1001


def test_exact_dedup_matches_sql(spark, duck):
    a = sorted_rows(exact_dedup.op5_content_sort_dedup(spark, SF_ORACLE).toPandas())
    assert a == sorted_rows(duck.execute(exact_dedup.SQL).df())


def test_near_duplicates_equal_brute_force(spark):
    """Copies, chains, and a family whose members are near its base but mostly not near each other."""
    rng = random.Random(4)
    base = prose(rng, 120, 10_000).split()
    docs = [(0, " ".join(base))]
    for i in range(1, 90):
        w = list(base)
        for _ in range(rng.choice((1, 4, 8, 11, 14))):
            w[rng.randrange(len(w))] = f"n{rng.randrange(100_000)}"
        docs.append((i, " ".join(w)))
    w = list(base)
    for i in range(100, 112):  # a chain: each step is near the one before
        for k in range(3):
            w[(i * 7 + k) % len(w)] = f"c{i}{k}"
        docs.append((i, " ".join(w)))
    docs += [(200 + i, prose(rng, rng.randrange(1, 30), 40)) for i in range(60)]
    docs += [(300, docs[5][1].upper()), (301, None), (302, "  "), (303, "one"), (304, "ONE")]
    out = rows(near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), width=2), "doc_id", "n_shingles", "component_id", "kept")
    want = brute.near_components(docs, 2)
    sizes = {i: len(brute.shingles(t, 2)) for i, t in docs}
    assert {i: c for i, _, c, _ in out} == want
    assert {i: n for i, n, _, _ in out} == sizes
    assert all(k == (i == c) for i, _, c, k in out)
    five = rows(near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), width=5), "doc_id", "component_id")
    assert dict(five) == brute.near_components(docs, 5)


def test_sketch_fills_and_estimates():
    import numpy as np

    for n in (1, 2, 7, 300, 5000):
        s = near_dedup.mix(np.arange(1, n + 1, dtype=np.uint64))
        assert (near_dedup.sketch(s) != np.iinfo(np.uint64).max).all()
    a, b = (near_dedup.mix(np.arange(x, x + 900, dtype=np.uint64)) for x in (0, 100))
    share = (near_dedup.sketch(a, 2000) == near_dedup.sketch(b, 2000)).mean()
    assert abs(share - 0.8) < 0.05


def test_base_statistics_equal_brute_force(spark):
    rng = random.Random(1)
    texts = [prose(rng, rng.randrange(0, 60), 5) for _ in range(60)] + ["a b\n\na b\n \na  b", "#$ %& <x>|*", " ".join("abcdefgh" * 3), None, "x\r\ny\x0bz\x0c", "é ß 😀"]
    out = {r[0]: r[1:] for r in rows(quality_rules.base_statistics(table(spark, texts)), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    assert out == {i + 1: brute.base_statistics(t) for i, t in enumerate(texts)}


def test_outliers_are_rejected_and_clean_ones_stay(spark):
    rng = random.Random(2)
    clean = [" ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9))) for _ in range(rng.randrange(30, 90))) for _ in range(300)]
    junk = [" ".join(f"{w}###" for w in clean[0].split()), clean[1].upper(), " ".join("x" * 80 for _ in range(25)) + f" {clean[2]}"[:40]]
    docs = [(i, t, "en", "s", 0) for i, t in enumerate(clean + junk)]
    out = dict(rows(quality_rules.quality_rules(spark.createDataFrame(docs, DOCS)), "doc_id", "kept"))
    assert all(out[i] for i in range(300))
    assert not out[300] and not out[301]
    assert {i for i, k in out.items() if k} == brute.quality_kept([d[:4] for d in docs])


TRICKY = ["a@b.c_d@e.fg a@b@c.de x@y. @z.w", "1.2.3.4.5.6.7.8 999.1.1.1 010.0.0.1 1.2.3", "4539 1488 0343 6467 4539-1488-0343-6467 1234567890123456 " + "1" * 3000, "+1 (234) 555-7890 +12 +1234567 tel+44 20 7946 0958.", "😀 a.b+c%d@e-f.gh", None, "", "a" * 3000 + "@" + "b" * 3000 + ".c"]


def test_base_spans_equal_brute_force(spark):
    out = {r.doc_id: r for r in pii.personal_data(table(spark, TRICKY)).collect()}
    for i, t in enumerate(TRICKY):
        want = brute.base_spans(t)
        assert [(pii.KINDS[x.k], x.s, x.e) for x in out[i + 1].base] == want, t
        assert set(map(tuple, out[i + 1].base)) <= set(map(tuple, out[i + 1].spans))


def test_patterns_discover_unseen_identifiers(spark):
    rng = random.Random(3)
    known = [f"Ada wrote: reach me by mail at u{rng.randrange(10**6)}@host{i}.org today" for i in range(12)]
    docs = [*known, "Bob wrote: reach me by mail at user99(at)host please", "Eve wrote: reach me by mail at eve1234.example now", "total 1234567 units", "key " + "0a1b" * 8]
    out = {r.doc_id: r for r in pii.personal_data(table(spark, docs)).collect()}
    found = [(pii.KINDS[x.k], docs[13][x.s : x.e]) for x in out[14].spans]
    assert found == [("email", "eve1234.example")]
    assert not out[15].spans
    assert [pii.KINDS[x.k] for x in out[16].spans] == ["secret"]


def test_redaction(spark):
    text = "mail a@b.cd or +1 234 567 8901 end"
    docs = table(spark, [text, "nothing", None])
    out = {r.doc_id: r for r in pii.stage(spark, docs, "").collect()}
    assert out[1].text == "mail [EMAIL] or [PHONE] end" == brute.redact(text, brute.base_spans(text), pii.KINDS)
    assert (out[2].text, out[3].text, out[1].n_chars) == ("nothing", None, len(out[1].text))


def test_packing_invariants(spark):
    rng = random.Random(5)
    docs = table(spark, [prose(rng, rng.choice((0, 1, 5, 90, 300, 1000, 2600))) for _ in range(300)])
    caps = (64, 256, 1024)
    out = packing.best_fit_packing(docs, capacities=caps, shard_pieces=100).toPandas()
    words = {r.doc_id: len(r.text.split()) for r in docs.collect()}
    assert out.groupby("doc_id")["length"].sum().to_dict() == words
    for (_, _), b in out.groupby(["shard", "bin"]):
        assert b["length"].sum() == b["used"].iloc[0] <= b["capacity"].iloc[0]
        assert b["capacity"].iloc[0] == min(c for c in caps if c >= b["used"].iloc[0])
        b = b[b["length"] > 0].sort_values("slot")
        assert (b["slot"].iloc[1:].values == (b["slot"] + b["length"]).iloc[:-1].values).all()
    assert out["length"].sum() / out.drop_duplicates(["shard", "bin"])["capacity"].sum() > 0.9
    with pytest.raises(ValueError):
        packing.best_fit_packing(docs, capacities=())


def test_packing_picks_the_cheaper_bin():
    place, caps = packing.pack([60, 60, 60, 60], (64, 256), overhead=0)
    assert len(set(place)) == 1 and caps == [256] or caps == [64] * 4
    assert packing.pack([10], (64, 256))[1] == [64]


def test_codec_equals_the_library():
    from tokenizers import Tokenizer

    path = bpe.default_path()
    codec, lib, rng = bpe.codec(path), Tokenizer.from_file(path), random.Random(6)
    lib.no_truncation()
    parts = [" ", "  ", "\n", "\n\n", "\t", "a", "zq", "Xx", "'s", "'ll", "　", "\xa0", "à", "\x1c", "\x85", "é", "日本", "😀", "<|endoftext|>", "12", "!", "\r\n", "word" * 30, "qzxj" * 40, "\x00", "İ"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        ids = lib.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == ids, repr(text)
        n, a, b = codec.digest([text])[0]
        assert (n, a) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert b == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encode_then_decode(spark):
    docs = table(spark, ["Hello  world\n", None, "", "à la carte 😀"])
    back = bpe.decode_documents(bpe.encode_documents(docs))
    assert dict(rows(back)) == {1: "Hello  world\n", 2: "", 3: "", 4: "à la carte 😀"}


def test_disguised_words_are_restored(spark):
    texts = ["idiot stupid trash clown moron loser scum pathetic worthless disgusting the of and " * 40, "plain words about nothing " * 30]
    fixer = toxicity.Deobfuscator(toxicity.language_model(table(spark, texts)))
    for written, word in {"1d10t": "idiot", "$tup1d": "stupid", "tr@sh": "trash", "cl0wn": "clown", "m.o.r.o.n": "moron", "l o s e r": "loser", "scuuuum": "scum", "d1sgu5t1ng": "disgusting"}.items():
        assert word in toxicity.words(fixer.restore(f"the {written} and")), written
    for plain in ("the words of 2024 and 10 more", "a@b.cd", "deadbeef0123456789deadbeef0123456789"):
        assert fixer.restore(plain) == plain


def test_toxicity_learns_and_never_reads_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF_ORACLE}/documents.parquet"), spark.read.parquet(f"{SF_ORACLE}/labels.parquet")
    out = toxicity.toxicity(docs, labels).toPandas().set_index("doc_id").sort_index()
    known = labels.toPandas().set_index("doc_id")["toxic"]
    both = out.join(known, how="inner")
    held = both[both["held_out"]]
    assert (held["predicted"] == held["toxic"]).mean() > 0.9
    assert both[both["toxic"] == 0]["predicted"].mean() < 0.03
    assert out["score"].between(0, 1).all()
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.toxicity(docs, flipped).toPandas().set_index("doc_id").sort_index()
    assert (again["score"] - out["score"]).abs().max() < 1e-9


def test_language_of_held_out_documents(spark):
    out = langid.op8_crf_language(spark, SF_ORACLE).toPandas().set_index("doc_id")
    truth = spark.read.parquet(f"{SF_ORACLE}/documents.parquet").select("doc_id", "lang").toPandas().set_index("doc_id")["lang"]
    held = out[out["held_out"]]
    assert (held["lang_pred"] == truth[held.index]).mean() > 0.97


def test_words_of_mixed_text(spark):
    docs = spark.read.parquet(f"{SF_ORACLE}/documents.parquet")
    model = langid.train(docs)
    mixed = table(spark, ["the and that with nicht und auch der", None, "123 ½ !"])
    out = {r.doc_id: r for r in langid.label_words(mixed, model).collect()}
    assert out[1].langs[:3] == ["en"] * 3 and out[1].langs[-3:] == ["de"] * 3
    assert out[2].words == out[3].words == []
    pred = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(mixed, model).collect()}
    assert pred[2] == pred[3] == ("und", 0.0)


def test_forward_backward_equals_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    s, start, moves = rng.normal(size=(4, 1, 3)), rng.normal(size=3), rng.normal(size=(3, 3))
    gamma, pairs, logz = langid.forward_backward(s, np.ones((4, 1), bool), start, moves)
    weight = {p: np.exp(start[p[0]] + sum(s[t, 0, p[t]] for t in range(4)) + sum(moves[p[t], p[t + 1]] for t in range(3))) for p in itertools.product(range(3), repeat=4)}
    z = sum(weight.values())
    assert logz[0] == pytest.approx(np.log(z))
    for t in range(4):
        for k in range(3):
            assert gamma[t, 0, k] == pytest.approx(sum(w for p, w in weight.items() if p[t] == k) / z)
    assert pairs[0, 1] == pytest.approx(sum(w * sum(p[t] == 0 and p[t + 1] == 1 for t in range(3)) for p, w in weight.items()) / z)


def test_licenses(spark):
    rng = random.Random(7)
    ordinary = [prose(rng, 60) + "\nMit und der Lizenz.\nthe version of this work under all" for _ in range(40)]
    docs = [*ordinary, "text\nReleased under the MIT License.\nmore", "x\nLicensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", None, "", "All rights reserved."]
    out = {r.doc_id: r for r in licenses.license_scan(table(spark, docs)).collect()}
    assert [out[i].license for i in (41, 42, 43, 46)] == ["mit", "apache-2.0", "gpl-3.0", "reserved"]
    assert all(out[i].license == "none" for i in (*range(1, 41), 44, 45))
    assert out[41].n_paragraphs == 2 and out[45].n_paragraphs == 0


def test_repeated_passages_go(spark):
    rng = random.Random(8)
    passage = " ".join(prose(rng, 11).capitalize() + "." for _ in range(5))
    one, two = " ".join(prose(rng, 9) + "." for _ in range(4)), " ".join(prose(rng, 9) + "." for _ in range(4))
    long = prose(rng, 55) + "."
    docs = [(1, f"{one} {passage}"), (2, f"{passage.upper()}\n{two}"), (3, f"{long} {passage} {passage}"), (4, f"{long} {one}"), (5, "Short. One. Two."), (6, "Short. One. Two."), (7, None), (8, one)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = {r.doc_id: r for r in substring_dedup.substring_dedup(df).collect()}
    want = brute.span_removals(docs)
    assert {i: (r.text, r.n_removed) for i, r in out.items()} == want
    assert out[1].text == docs[0][1] and passage.upper() not in out[2].text and two in out[2].text
    # One sentence is no run of several, however long.
    assert out[4].text.strip() == long and out[5].text == out[6].text == docs[4][1] and out[8].text.strip() == ""
    assert out[7].text is None


def test_substring_equals_brute_force_on_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    out = {r.doc_id: (r.text, r.n_removed) for r in substring_dedup.substring_dedup(df).collect()}
    assert out == brute.span_removals([tuple(r) for r in df.collect()])
