"""Operators that SQL can't express, against plain versions that share none of their code."""

from __future__ import annotations

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tapeworks.llm import bpe, langid, licenses, packing, pii, toxicity
from tests.conftest import SF, SF_ORACLE
from tests.llm import brute
from tests.llm.test_operators import prose, table


@pytest.fixture(scope="module")
def fixer(spark):
    docs = spark.read.parquet(f"{SF_ORACLE}/documents.parquet").select("text")
    return toxicity.Deobfuscator(toxicity.language_model(docs))


def test_trigram_costs_are_those_of_plain_counts(spark):
    texts = ["the cat", "The Cat sat.", None, ""]
    costs = toxicity.language_model(table(spark, texts))
    k, counts = toxicity.CLASSES, {}
    for t in filter(None, texts):
        c = [0, *(ord(x) - 96 if x.isalpha() else 0 for x in t.lower()), 0]
        for g in zip(c, c[1:], c[2:], strict=False):
            counts[g] = counts.get(g, 0) + 1
    one = [1.0 + sum(n for g, n in counts.items() if g[2] == c) for c in range(k)]
    p1 = [x / sum(one) for x in one]
    for a, b, c in [(0, 20, 8), (3, 1, 20), (1, 20, 0), (9, 9, 9)]:
        pair = sum(n for g, n in counts.items() if g[1:] == (b, c))
        p2 = (pair + 20 * p1[c]) / (sum(n for g, n in counts.items() if g[1] == b) + 20)
        p3 = (counts.get((a, b, c), 0) + 5 * p2) / (sum(n for g, n in counts.items() if g[:2] == (a, b)) + 5)
        assert costs[a, b, c] == pytest.approx(-math.log(p3), rel=1e-5)


def test_viterbi_finds_the_best_of_all_readings(fixer):
    rng = random.Random(5)
    stretches = ["1d10t", "$tup1d", "s.c.u.m", "l o s e r", "scuuum", "7r4sh", "iiddiot", "p o o p"]
    stretches += ["".join(rng.choice("abeilost013457@$! .") for _ in range(rng.randrange(2, 9))).strip(" .") or "a" for _ in range(60)]
    for x in stretches:
        read, cost = brute.readings(fixer, x)
        got = fixer.decode(x)
        if got != x:
            ks = [0, 0, *(fixer.classes[min(ord(c), 0xFFFF)] for c in got)]
            # Equal costs may have several readings: the cost counts, and it is the least.
            assert got == read or sum(fixer.costs[a][b][c] for a, b, c in zip(ks, ks[1:], ks[2:], strict=False)) <= cost + 1e-6, x


def test_disguises_of_any_length_are_read(fixer):
    plain = "theringandthattionofhereinthatheandingtheon"  # of the syllables of these documents
    long = plain.replace("e", "3").replace("o", "0")
    assert fixer.restore(f"so {long} now") == f"so {plain} now"
    for n in (5, 30, 150, 900):
        assert "idiot" in toxicity.words(fixer.restore("id" + "i" * n + "ot")), n
    assert "poop" in toxicity.words(fixer.restore("p o o p")) and "die" in toxicity.words(fixer.restore("d   i   e"))
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b2b0b822cd15d6c15b0f00a08"
    assert fixer.restore(f"key {key} end") == f"key {key} end"


def test_every_document_is_encoded_as_by_the_library(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_path())
    lib.no_truncation()
    lib.no_padding()
    out = {r.doc_id: r for r in bpe.op6_forced_boundary_bpe(spark, SF_ORACLE).collect()}
    docs = spark.read.parquet(f"{SF_ORACLE}/documents.parquet").select("doc_id", "text").collect()
    assert len(out) == len(docs)
    for doc_id, text in docs:
        ids = lib.encode(text or "", add_special_tokens=False).ids
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert (out[doc_id].n_tokens, out[doc_id].ids_sha256, out[doc_id].decoded_sha256) == want


def test_letters_of_any_script_are_cut_where_no_token_joins_them():
    from tokenizers import Tokenizer

    path = bpe.default_path()
    codec, lib, rng = bpe.codec(path), Tokenizer.from_file(path), random.Random(9)
    cut = 0
    for letters in ("qzxjvkwQZXJ", "\u0436\u0449\u044e\u044f\u0444", "\u4e00\u9f98\u9750\ud55c\u3042", "\u00df\u00fe\u0142\u0111", "aq\u0449\u9f98z'\u00b2\u0e01"):
        for _ in range(300):
            word = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 12)))
            assert codec.encode(word) == lib.encode(word, add_special_tokens=False).ids, word
            cut += len(codec.parts(word)) > 1
    assert cut > 300


def test_languages_equal_a_plain_forward_backward(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs, max_train=40)
    langs, k = model["langs"], len(model["langs"])
    few = docs.where(F.length("text").between(1, 800)).limit(40)
    out = {r.doc_id: r for r in langid.identify(few, model).collect()}
    for doc_id, text in few.select("doc_id", "text").collect():
        words = re.findall(r"[^\W\d_]+", text.lower())
        if not words:
            assert (out[doc_id].lang_pred, out[doc_id].score) == ("und", 0.0)
            continue
        e = [[math.exp(float(sum(model["weights"][f][c] for f in langid.features(w, model["lexicon"])))) for c in range(k)] for w in words]
        move = [[math.exp(model["moves"][i][j]) for j in range(k)] for i in range(k)]
        fore, back = [[math.exp(model["start"][c]) * e[0][c] for c in range(k)]], [[1.0] * k]
        scaled = lambda v: [x / sum(v) for x in v]
        for t in range(1, len(words)):
            fore.append(scaled([sum(fore[-1][i] * move[i][j] for i in range(k)) * e[t][j] for j in range(k)]))
        for t in range(len(words) - 2, -1, -1):
            back.append(scaled([sum(move[i][j] * e[t + 1][j] * back[-1][j] for j in range(k)) for i in range(k)]))
        shares = [scaled([a * b for a, b in zip(x, y, strict=True)]) for x, y in zip(fore, back[::-1], strict=True)]
        mean = [sum(s[c] for s in shares) / len(words) for c in range(k)]
        assert out[doc_id].score == pytest.approx(max(mean), abs=1e-3)
        assert out[doc_id].lang_pred == langs[mean.index(max(mean))] or sorted(mean)[-1] - sorted(mean)[-2] < 1e-3


def test_planted_identifiers_are_discovered(spark):
    """Identifiers that no base pattern fits, behind words that stand before base ones: nine in ten are found, and little else."""
    rng = random.Random(6)
    lead = {"phone": "call our office under", "email": "please write mail to", "ip": "log shows host address"}
    docs, hidden = [], []
    for i in range(60):
        docs += [f"{prose(rng, 6)} {lead['phone']} +49 {rng.randrange(10**8, 10**9)} now", f"{prose(rng, 5)} {lead['email']} u{rng.randrange(10**6)}@h{i}.org soon", f"{prose(rng, 5)} {lead['ip']} 10.{i}.{rng.randrange(255)}.{rng.randrange(255)} again"]
    for i in range(30):
        kind = ("phone", "email", "ip")[i % 3]
        value = {"phone": f"0{rng.randrange(10**5, 10**6)}-{i}", "email": f"user{i}(at)host", "ip": f"srv{rng.randrange(100, 999)}x"}[kind]
        hidden.append((len(docs) + 1, kind, value.split("(")[0]))
        docs.append(f"{prose(rng, 7)} {lead[kind]} {value} {prose(rng, 4)}")
    plain = [f"{prose(rng, 30)} {rng.randrange(10**5)} pieces and {rng.randrange(1900, 2030)}" for _ in range(200)]
    out = {r.doc_id: r for r in pii.personal_data(table(spark, docs + plain)).collect()}
    found = [(i, kind, value) for i, kind, value in hidden if (kind, value) in {(pii.KINDS[x.k], docs[i - 1][x.s : x.e]) for x in out[i].spans}]
    assert len(found) >= 0.9 * len(hidden)
    assert sum(bool(out[len(docs) + i + 1].spans) for i in range(len(plain))) <= 2


def test_discovery_goes_on_until_nothing_is_new(spark):
    """Each hop's instances alone make the next hop's pattern known."""
    docs = [f"alpha +49 30 {5550000 + i} x" for i in range(8000)]
    for hop, (last, word, n) in enumerate((("alpha", "bravo", 400), ("bravo", "delta", 20), ("delta", "gamma", 1))):
        # The same instances stand behind the last hop's pattern, where most are known, and the next one's.
        docs += [f"{w} id{hop}{i}77 x" for i in range(n) for w in (last, word)]
    out = {r.doc_id: r for r in pii.personal_data(table(spark, docs)).collect()}
    assert all(out[i + 1].spans for i in range(len(docs)))


def test_packing_is_near_the_best_of_all_packings():
    rng = random.Random(7)
    caps, worst = (8, 16, 32), 1.0
    for _ in range(40):
        lengths = [rng.randrange(1, 33) for _ in range(rng.randrange(1, 10))]
        place, sizes = packing.pack(lengths, caps, overhead=2)
        for b, c in enumerate(sizes):
            assert sum(n for n, p in zip(lengths, place, strict=True) if p == b) <= c
        worst = max(worst, sum(c + 2 for c in sizes) / brute.least_packing(lengths, caps, 2))
    assert worst <= 1.35


def test_what_shards_cost():
    rng = random.Random(8)
    lengths = [min(4096, int(rng.lognormvariate(5, 1.2)) + 1) for _ in range(40_000)]
    cost = lambda x: sum(c + packing.OVERHEAD for c in packing.pack(x)[1])
    assert cost(lengths[::2]) + cost(lengths[1::2]) <= 1.002 * cost(lengths)


def test_licences_wrapped_over_lines_tags_and_strangers(spark):
    rng = random.Random(10)
    ordinary = [prose(rng, 60) + ".\nNothing to see here.\n" + prose(rng, 20) + "." for _ in range(150)]
    wrapped = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version."
    odd = [wrapped, "// SPDX-License-Identifier: Apache-2.0\nint x;", "This work is licensed under the Zorblat Public License, version 7.", "Some words.\n\n * Redistribution and use in source and binary\n * forms, with or without modification, are permitted provided that\n * the following conditions are met:\n"]
    out = {r.doc_id: r for r in licenses.license_scan(table(spark, ordinary + odd)).collect()}
    assert [out[151 + i].license for i in range(4)] == ["gpl-3.0", "apache-2.0", "unknown", "bsd"]
    assert out[151].n_paragraphs == 1 and all(out[i + 1].license == "none" for i in range(150))


def test_licences_of_documents_equal_a_plain_search(spark):
    """The notices that the documents hold as they are published, found by a plain search for them."""
    docs = spark.read.parquet(f"{SF_ORACLE}/documents.parquet").select("doc_id", "text")
    out = {r.doc_id: set(filter(None, r.families.split(","))) for r in licenses.license_scan(docs).collect()}
    squeeze = lambda t: " ".join((t or "").lower().split())
    notices = {f: [squeeze(x).rstrip(".") for x in t] for f, t in licenses.TEMPLATES.items()}
    for doc_id, text in docs.collect():
        want = {f for f, xs in notices.items() if any(x in squeeze(text) for x in xs)}
        assert want <= out[doc_id], (doc_id, want, out[doc_id])
    assert sum(map(bool, out.values())) >= 40
