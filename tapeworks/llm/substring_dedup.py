"""Substring dedup with sliding sentence spans.

From every sentence of every text a run of consecutive sentences is hashed (128 bits), and another that ends with it; runs
are joined globally, and sentences covered by any but the first occurrence of a run are removed. The first occurrence is
the one with the least (doc_id, place). A run reaches on until it has SENTENCES sentences and MIN_WORDS words, so it depends
on what follows its start, or precedes its end, alone and equal passages have equal runs. Every sentence of a repeated
passage that is long enough lies in such a run inside it, so none of it stays.

Sentences end at end marks before a blank and at line ends; where a script puts no blanks between sentences or words, they
end without one, and characters are counted as parts of words. A passage may be pasted into the middle of a sentence, so a
run may also begin or end at a capitalised word behind a small letter or a bar, or where such a script meets another. That
cuts a sentence into parts, but parts of one sentence count as one: a run always holds several sentences.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.llm.common import materialise, python_rows, table

SENTENCES, MIN_WORDS = 2, 20
#: Scripts that put no blanks between words, and how many of their characters count as a word.
DENSE = ((2, "\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"), (4, "\u0e01-\u0eff\u1000-\u109f\u1780-\u17ff\u1950-\u19df\u1a20-\u1aaf\ua9e0-\ua9ff\uaa60-\uaa7f"))


def _ranges(category: str) -> str:
    """The letters of a category, for use in a character class."""
    at = [c for c in range(0x20000) if unicodedata.category(chr(c)) == category]
    starts = [c for c, before in zip(at, [-2, *at], strict=False) if c != before + 1]
    ends = [c for c, after in zip(at, [*at[1:], -2], strict=True) if after != c + 1]
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends, strict=True))


#: Sentence ends before a blank, and those that need none; closing marks stay with their sentence.
ENDS = ".!?\u2026\u0589\u061f\u06d4\u0700-\u0702\u0964\u0965\u104a\u104b\u1362\u1367\u1368\u166e\u17d4\u17d5\u1803\u1809\u203c\u203d\u2047-\u2049\ua4ff\ua60e\ua60f\uabeb"
FULL, CLOSE = "\u3002\uff01\uff0e\uff1f\uff61\u0964\u0965\u104b\u1362\u17d4\u17d5\u06d4", "\u300d\u300f\u3011\u3009\u300b\u201d\u2019\uff09"
BLANK, LOWERS, UPPERS, ALL_DENSE = "[ \\t\u00a0\u3000]+", _ranges("Ll"), _ranges("Lu"), "".join(x for _, x in DENSE)
#: Where a sentence ends.
END = rf"(?<=[{ENDS}{FULL}]){BLANK}|(?<=[{FULL}][{CLOSE}]){BLANK}|{BLANK[:-1]}*\n\s*|(?<=[{ALL_DENSE}]){BLANK}(?=[{ALL_DENSE}])|(?<=[{FULL}])(?![\s{FULL}{CLOSE}])(?!\Z)|(?<=[{FULL}][{CLOSE}])(?![\s{FULL}{CLOSE}])(?!\Z)"
#: Where a passage may be pasted into one.
PASTE = rf"(?<=[{LOWERS}|]){BLANK}(?=[{UPPERS}])|(?<=[{ALL_DENSE}]){BLANK}|{BLANK}(?=[{ALL_DENSE}])"
BREAK = re.compile(f"(?:({END})|({PASTE}))")
#: The same for ASCII texts, where it is faster.
ASCII_BREAK = re.compile(r"(?:((?<=[.!?])[ \t]+|[ \t]*\n\s*)|((?<=[a-z|])[ \t]+(?=[A-Z])))")
COUNTED = [(n, re.compile(f"[{x}]")) for n, x in DENSE]


def sentences(text: str) -> tuple[list[str], list[str], list[int]]:
    """Parts, what separates each from the next, and the number of the sentence that each is of; joined in turn they are the text."""
    found = (ASCII_BREAK if text.isascii() else BREAK).split(text)
    ends = found[1::3]
    numbers = [0]
    for end in ends:
        numbers.append(numbers[-1] + (end is not None))
    return found[::3], [*(e if e is not None else p for e, p in zip(ends, found[2::3], strict=True)), ""], numbers


def length(sentence: str, words: int) -> int:
    """Words by blanks, and by characters where the script has no blanks."""
    return words if sentence.isascii() else words + sum(len(x.findall(sentence)) // n for n, x in COUNTED)


def runs(text: str) -> list[tuple[int, int, bytes]]:
    """(first part, number of parts, digest) of each run; parts without words are passed over."""
    import xxhash

    pieces, _, sentence = sentences(text)
    found = [(i, w) for i, s in enumerate(pieces) if (w := s.encode("utf-8", "surrogatepass").lower().split())]
    lengths = [length(pieces[i], len(w)) for i, w in found]
    # Only sentences with words are counted.
    number, last = [], None
    for i, _ in found:
        number.append(number[-1] + (sentence[i] != last) if number else 0)
        last = sentence[i]
    digests = [xxhash.xxh3_128_digest(b" ".join(w)) for _, w in found]
    before = np.concatenate([[0], np.cumsum(lengths)]).tolist()
    out, n = set(), len(found)

    def emit(at: int, to: int) -> None:
        out.add((found[at][0], found[to][0] - found[at][0] + 1, xxhash.xxh3_128_digest(b"".join(digests[at : to + 1]))))

    enough = lambda at, to: number[to] - number[at] >= SENTENCES - 1 and before[to + 1] - before[at] >= MIN_WORDS
    # The least end of each start, and the greatest start of each end, only move on.
    to = 0
    for at in range(n):
        to = max(to, at)
        while to < n and not enough(at, to):
            to += 1
        if to == n:
            break
        emit(at, to)
    at = n - 1
    for to in range(n - 1, -1, -1):
        at = min(at, to)
        while at >= 0 and not enough(at, to):
            at -= 1
        if at < 0:
            break
        emit(at, to)
    return sorted(out)


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        row, at, n, digests = [], [], [], []
        for r, text in enumerate(batch["text"]):
            for first, many, digest in runs(text) if text else ():
                row.append(r)
                at.append(first)
                n.append(many)
                digests.append(digest)
        h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        yield pd.DataFrame({"h1": h[:, 0], "h2": h[:, 1], "place": batch["place"].to_numpy()[row], "content": batch["content"].to_numpy()[row], "at": np.asarray(at, np.int32), "n": np.asarray(n, np.int32)})


def _removed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts, total, gone = [], [], []
        for text, spans in zip(batch["text"], batch["spans"], strict=True):
            parts, breaks, number = sentences(text) if text else ([], [], [])
            covered = {i for s in (spans if spans is not None else ()) for i in range(s["at"], s["at"] + s["n"]) if parts[i].strip()}
            texts.append("".join(p + b for i, (p, b) in enumerate(zip(parts, breaks, strict=True)) if i not in covered) if covered else text)
            total.append(len({k for p, k in zip(parts, number, strict=True) if p.strip()}))
            gone.append(len({number[i] for i in covered}))
        yield pd.DataFrame({"doc_id": batch["doc_id"], "n_sentences": total, "n_removed": gone, "text": texts})


def substring_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, n_removed (sentences that lose words) and the text that is left, for every row of docs (doc_id, text).

    Sentences are compared after lower-casing A-Z and squeezing white space. A null text stays null. Rows with a null
    doc_id come last in the order of occurrences. Rows that repeat a doc_id with another text are texts of their own, in
    the order of a hash of the text; rows that repeat both are one place, so a passage that only they hold stays in each.
    Other columns are ignored; an empty table gives no rows.
    """
    python_rows(docs.sparkSession)
    # Place and content tell rows apart; null ids get a place behind all others.
    place = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", place.alias("place"), F.xxhash64("doc_id", "text").alias("content"))
    spans = materialise(rows.select("place", "content", "text").mapInPandas(_runs, "h1 long, h2 long, place long, content long, at int, n int"), "substring-runs")
    here = F.struct("place", "content", "at")
    first = spans.groupBy("h1", "h2").agg(F.min(here).alias("first"), F.count(F.lit(1)).alias("times")).where(F.col("times") > 1).select("h1", "h2", "first")
    # Written first: a join of two shuffled sides can be split where one passage holds very many rows.
    first = materialise(first, "substring-first", rows=spans.count() // 2, per_file=500_000)
    again = spans.join(first, ["h1", "h2"]).where(here != F.col("first"))
    marks = again.groupBy("place", "content").agg(F.collect_set(F.struct("at", "n")).alias("spans"))
    marks = materialise(marks, "substring-marks")
    return rows.join(marks, ["place", "content"], "left").select("doc_id", "text", "spans").mapInPandas(_removed, "doc_id long, n_sentences long, n_removed long, text string")


def op2_sentence_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document."""
    return substring_dedup(table(spark, sf_dir, "documents", "doc_id", "text"))
