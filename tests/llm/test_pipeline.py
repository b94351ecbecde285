"""The pipeline against a plain version, stage by stage and as a whole."""

from __future__ import annotations

import __spark_entry__ as entry
import corpus_pipeline
from tapeworks.llm import pii
from tapeworks.llm.common import DOCUMENT_COLUMNS
from tests.conftest import SF_ORACLE
from tests.llm import brute


def plain(docs):
    """(id, text) after all stages but the last, in one process."""
    kept = brute.quality_kept([(r.doc_id, r.text, r.lang, r.source) for r in docs])
    docs = {r.doc_id: r.text for r in docs if r.doc_id in kept}
    by_text = {}
    for i in sorted(docs):
        by_text[brute.lower(docs[i])] = i
    docs = {i: docs[i] for i in by_text.values()}
    comp = brute.near_components(sorted(docs.items()), 5)
    return {i: docs[i] for i in docs if comp[i] == i}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_ORACLE}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    want = plain(docs.collect())
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, SF_ORACLE)
        assert tuple(docs.columns) == DOCUMENT_COLUMNS, name
    assert {r.doc_id: r.text for r in docs.collect()} == want
    clean = corpus_pipeline.STAGES[3][1](spark, docs, SF_ORACLE)
    assert tuple(clean.columns) == DOCUMENT_COLUMNS
    spans = {r.doc_id: [(pii.KINDS[x.k], x.s, x.e) for x in r.spans] for r in pii.personal_data(docs).collect()}
    for i, text in want.items():
        assert set(brute.base_spans(text)) <= set(spans[i])
    masked = {r.doc_id: r.text for r in clean.collect()}
    assert masked == {i: brute.redact(t, spans[i], pii.KINDS) for i, t in want.items()}


def test_run_packs_every_word_that_is_left(spark):
    out = corpus_pipeline.run(spark, SF_ORACLE).toPandas()
    want = plain(spark.read.parquet(f"{SF_ORACLE}/documents.parquet").collect())
    assert set(out["doc_id"]) == set(want)
    assert (out.groupby(["shard", "bin"])["length"].sum() <= out.groupby(["shard", "bin"])["capacity"].first()).all()


def test_entry_names_all_ten_and_the_pipeline():
    names = set(entry.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)}
    assert "pipeline" in names
