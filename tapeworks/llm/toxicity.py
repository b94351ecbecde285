"""Toxicity: noisy-channel deobfuscation, then a classifier on the restored text.

Character trigram counts of all documents are the language model (a table of fixed size). Stretches that look
disguised (leetspeak, spaced-out letters, drawn-out repeats) are decoded with the Viterbi algorithm over a lattice: every
written character may stand for letters at a cost, separators may be nothing or a word boundary, and repeats may be
dropped. A logistic regression over the words of restored texts, learnt from labelled documents, gives the score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.llm.common import held_out, materialise, python_rows, table

#: Labelled rows that the classifier is fitted on at most: those with the smallest hashed ids.
MAX_TRAIN = 8_000
#: A word is a feature when so many different groups of like training texts hold it.
MIN_GROUPS = 6
#: ... and its share differs between the labels by so many standard errors.
MIN_Z = 5.0
STEPS, RATE, L2 = 400, 0.5, 2e-4
#: What a written character may stand for besides itself (fixed values).
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
SEPARATORS = " .*_-~"
#: Channel costs (negative log probabilities).
COST = {"same": 0.0, "leet": 0.7, "gap": 0.2, "boundary": 1.0, "drop": 0.4, "double": 3.0, "digit": 6.0}
#: A stretch may also be no word at all but a key or a number, drawn letter by letter: cost of each, and of such a stretch.
KEY_LETTER, KEY = 3.0, 12.0
#: Character classes of the language model: white space and marks, a-z, letters of Latin-1, all other letters.
CLASSES = 64
LEETED = re.compile(r"(?<![\w@$!|+€£])(?=[\w@$!|+(€£]*[a-zA-Z])(?:[^\W\d_]*[0-9@$!|+(€£]+(?=[^\W\d_])[\w@$!|+(€£]*|[^\W\d_]+[0-9@$|+€£]+)(?![\w@$|+€£]|\.\w)")
LEET_HINT = re.compile(r"[0-9@$!|+(€£][a-zA-Z]|[a-zA-Z][0-9@$|+€£]")
SPACED = re.compile(r"(?<![^\W_])[\w@$!|+€£](?:[ .*_~-]{1,4}[\w@$!|+€£]){2,}(?![^\W_])")
DRAWN_HINT = re.compile(r"([^\W\d_])\1\1")
DRAWN = re.compile(r"[^\W\d_]*?([^\W\d_])\1\1[^\W\d_]*")
WORDS = re.compile(r"[^\W\d_]+")
MEMORY = 200_000


def char_classes() -> np.ndarray:
    """Class of each code point below 65536."""
    out = np.full(0x10000, 63, np.uint8)
    out[:0x80] = 0
    for i in range(26):
        out[[ord("a") + i, ord("A") + i]] = i + 1
    for i in range(0xDF, 0x100):
        out[i] = 27 + i - 0xDF
        if i not in (0xDF, 0xF7, 0xFF):
            out[i - 0x20] = 27 + i - 0xDF
    out[0x80:0xC0] = 0
    out[0xD7] = out[0xF7] = 0
    out[0x2000:0x2070] = out[0x3000:0x3004] = 0
    return out


def _count_trigrams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    classes = char_classes()
    total = np.zeros(CLASSES**3, np.int64)
    for batch in batches:
        for text in batch["text"]:
            if text:
                c = classes[np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32), 0xFFFF)].astype(np.int32)
                c = np.concatenate([[0], c, [0]])
                total += np.bincount(c[:-2] * (CLASSES * CLASSES) + c[1:-1] * CLASSES + c[2:], minlength=CLASSES**3)
    found = np.flatnonzero(total)
    yield pd.DataFrame({"gram": found, "n": total[found]})


def language_model(docs: DataFrame) -> np.ndarray:
    """Costs [a, b, c] of class c after a, b from the counts of all texts. At most CLASSES ** 3 counts come to the driver."""
    counts = docs.select("text").mapInPandas(_count_trigrams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(CLASSES**3)
    n[counts["gram"].to_numpy(np.int64)] = counts["n"].to_numpy(float)
    n = n.reshape(CLASSES, CLASSES, CLASSES)
    bi, uni = n.sum(0), n.sum((0, 1)) + 1.0
    p1 = uni / uni.sum()
    p2 = (bi + 20 * p1) / (bi.sum(1, keepdims=True) + 20)
    return -np.log((n + 5 * p2[None]) / (n.sum(2, keepdims=True) + 5)).astype(np.float32)


class Deobfuscator:
    """Restores disguised stretches of a text; decoded stretches are remembered."""

    def __init__(self, costs: np.ndarray):
        self.costs = costs.tolist()
        self.classes = char_classes().tolist()
        self.known: dict[str, str] = {}

    def _options(self, chars: str, i: int) -> list[tuple[str, float]]:
        """What position i may stand for: characters and their channel costs; empty means nothing."""
        c = chars[i]
        if c in SEPARATORS:
            return [("", COST["gap"]), (" ", COST["boundary"])]
        out = [(x, COST["leet"]) for x in LEET.get(c, "")]
        if c.isalpha():
            out.append((c, COST["same"]))
            if i and chars[i - 1] == c:
                run = chars[max(0, i - 2) : i + 2].count(c)
                out.append(("", COST["drop"] if run > 2 else COST["double"]))
        elif c.isdigit() or not out:
            out.append((c, COST["digit"]))
        return out

    def decode(self, stretch: str) -> str:
        """The likeliest reading of a stretch between word boundaries, by the Viterbi algorithm; the stretch itself if a key is likelier.

        A state is the last two character classes read. A position has few readings, so few states are reached at any.
        """
        chars = stretch.lower()
        if chars in self.known:
            return self.known[chars] or stretch
        kind = lambda x: self.classes[ord(x)] if ord(x) < 0x10000 else 63
        # state: classes of the last two characters of the reading -> (cost, back pointer)
        reached: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for i in range(len(chars)):
            options = [(x, cost, kind(x) if x else 0) for x, cost in self._options(chars, i)]
            new: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (cost, back) in reached.items():
                row = self.costs[a][b]
                for x, extra, k in options:
                    state, total, path = ((a, b), cost + extra, back) if not x else ((b, k), cost + extra + row[k], (back, x))
                    if (old := new.get(state)) is None or total < old[0]:
                        new[state] = (total, path)
            reached = new
        cost, back = min(reached.values(), key=lambda y: y[0])
        out = []
        while back:
            back, x = back
            out.append(x)
        if len(self.known) >= MEMORY:
            self.known.clear()
        # A key is drawn letter by letter; letters written again cost it nothing, as they do for a word.
        fresh = sum(a != b and a not in SEPARATORS for a, b in zip(chars, " " + chars[:-1], strict=True))
        self.known[chars] = "".join(reversed(out)) if cost <= KEY + KEY_LETTER * fresh + COST["drop"] * (len(chars) - fresh) else ""
        return self.known[chars] or stretch

    def _joined(self, m: re.Match) -> str:
        """Both readings of spaced-out letters: with the word boundaries that the model sets, and as one word."""
        if not any(map(str.isalpha, m[0])):
            return m[0]
        read = self.decode(m[0])
        return f" {read} {read.replace(' ', '')} " if " " in read else f" {read} "

    def restore(self, text: str) -> str:
        if LEET_HINT.search(text):
            text = LEETED.sub(lambda m: self.decode(m[0]), text)
        if SPACED.search(text):
            text = SPACED.sub(self._joined, text)
        if DRAWN_HINT.search(text):
            text = DRAWN.sub(lambda m: self.decode(m[0]), text)
        return text


def words(restored: str) -> set[str]:
    return set(WORDS.findall(restored.lower()))


def _training_rows(costs: np.ndarray, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import xxhash

    fixer = Deobfuscator(costs)
    for batch in batches:
        found = [sorted(words(fixer.restore(t or ""))) for t in batch["text"]]
        # Like texts mostly have the same least hashed word: copies count as one group.
        group = [min((xxhash.xxh3_64_intdigest(w) >> 1 for w in f), default=0) for f in found]
        yield pd.DataFrame({"label": batch["toxic"], "group": group, "words": pd.Series(found, dtype=object)})


def fit(train: DataFrame, costs: np.ndarray) -> tuple[float, dict[str, float]]:
    """Intercept and word weights of a logistic regression over word presence; without both labels, the base rate."""
    rows = train.mapInPandas(partial(_training_rows, costs), "label int, group long, words array<string>").withColumn("row", F.monotonically_increasing_id())
    rows = materialise(rows, "toxic-train")
    toxic = (F.col("label") == 1).cast("int")
    ones, zeros = rows.select("group", "label").distinct().agg(F.sum(toxic), F.sum(1 - toxic)).first()
    ones, zeros = max(ones or 0, 1), max(zeros or 0, 1)
    spread = rows.select("group", "label", F.explode("words").alias("w")).distinct().groupBy("w").agg(F.sum(toxic).alias("a"), F.sum(1 - toxic).alias("b"))
    share = (F.col("a") + F.col("b")) / (ones + zeros)
    z = (F.col("a") / ones - F.col("b") / zeros) / F.sqrt(share * (1 - share) * (1 / ones + 1 / zeros))
    chosen = materialise(spread.where((F.col("a") + F.col("b") >= MIN_GROUPS) & (share < 1)).where(F.abs(z) >= MIN_Z).select("w"), "toxic-words")
    kept = rows.select("row", "label", "group", F.explode_outer("words").alias("w"))
    kept = kept.join(chosen, "w", "left_semi").groupBy("row").agg(F.collect_list("w").alias("ws"))
    base = rows.select("row", "label", "group")
    pdf = base.join(kept, "row", "left").toPandas().sort_values("row", ignore_index=True)
    if not len(pdf):
        return 0.0, {}
    y = pdf["label"].to_numpy(float)
    rate = (y.sum() + 0.5) / (len(y) + 1)
    bias = math.log(rate / (1 - rate))
    if y.min() == y.max():
        return bias, {}
    names = sorted({w for ws in pdf["ws"] if ws is not None for w in ws})
    index = {w: i for i, w in enumerate(names)}
    lengths = [0 if ws is None else len(ws) for ws in pdf["ws"]]
    at = np.repeat(np.arange(len(pdf)), lengths)
    col = np.fromiter((index[w] for ws in pdf["ws"] if ws is not None for w in ws), np.int64, sum(lengths))
    weight = 1 / pdf.groupby("group")["label"].transform("size").to_numpy(float)
    weight /= weight.sum()
    w, b = np.zeros(len(names)), bias
    # Full-batch Adam: the objective is convex and the number of steps fixed, so fits repeat exactly.
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for t in range(1, STEPS + 1):
        z = b + np.bincount(at, w[col], len(pdf))
        e = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = np.append(np.bincount(col, e[at], len(names)) + L2 * w, e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = RATE * (0.1 if t > STEPS // 2 else 0.3) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return float(b), {x: float(w[i]) for x, i in index.items() if abs(w[i]) > 1e-3}


def _score(costs: np.ndarray, bias: float, weights: dict[str, float], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    fixer, names = Deobfuscator(costs), weights.keys()
    for batch in batches:
        z = [bias + math.fsum(weights[w] for w in names & words(fixer.restore(t or ""))) for t in batch["text"]]
        score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": score, "predicted": (score >= 0.5).astype(np.int32)})


def toxicity(docs: DataFrame, labels: DataFrame, *, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs (doc_id, text), learnt from labels (doc_id, toxic).

    Labels of held-out rows (crc32 of the id as text divisible by 5) are never read. Null and empty texts get the base
    rate. Null or repeated label rows are dropped; without labels of both kinds all scores are the base rate. Repeated
    documents each get a row; other columns are ignored; an empty table gives no rows.
    """
    python_rows(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    costs = language_model(docs)
    known = labels.select("doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(5, 0)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    train = docs.join(materialise(known, "toxic-labels"), "doc_id").select("text", "toxic")
    bias, weights = fit(train, costs)
    judged = docs.withColumn("held_out", held_out(5, 0))
    return judged.mapInPandas(partial(_score, costs, bias, weights), "doc_id long, held_out boolean, score double, predicted int")


def op3_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))
