"""Language identification with a linear-chain conditional random field.

Every word gets emission scores from its affixes, character n-grams and lexicon entry; transitions between languages are
learnt too. Training sequences splice stretches of documents of different languages, so the model sees code-switching.
Forward-backward gives each word's marginal distribution; a document's language is the one with most expected words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeworks.llm.common import held_out, materialise, python_rows, small_join, table

#: Training rows of each language at most (those with the smallest hashes); all their words are read, in stretches.
MAX_TRAIN = 400
STRETCH = 24
BUCKETS = 1 << 17
#: A training word seen so often is a lexicon entry.
MIN_LEXICON = 3
EPOCHS, BATCH, RATE, L2 = 3, 64, 0.05, 1e-5
GROUP = 128
MEMORY = 300_000
WORDS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def words_in(text: str | None) -> list[str]:
    # Fractions and the like are word characters but no letters; the test ends at the first letter.
    return WORDS.findall(text.lower()) if text and any(map(str.isalpha, text)) else []


def features(word: str, lexicon: frozenset[str] | set[str]) -> list[int]:
    """Hashed features of one word: prefixes, suffixes, character n-grams within its bounds, lexicon entry."""
    marked = f"^{word}$"
    found = {f"p{word[:k]}" for k in (1, 2, 3)} | {f"s{word[-k:]}" for k in (1, 2, 3)}
    found.update(marked[i : i + k] for k in (2, 3) for i in range(len(marked) - k + 1))
    if word in lexicon:
        found.add(f"w{word}")
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in found]


class Emissions:
    """Row of emission scores of each word; remembered rows are forgotten when there are too many."""

    def __init__(self, weights: np.ndarray, lexicon: set[str]):
        self.weights, self.lexicon = weights, lexicon
        self.index: dict[str, int] = {}
        self.rows = np.zeros((1024, weights.shape[1]), np.float32)

    def ids(self, documents: list[list[str]]) -> list[np.ndarray]:
        if len(self.index) > MEMORY:
            self.index = {}
        new = list(set().union(*documents).difference(self.index))
        if new:
            found = [features(w, self.lexicon) for w in new]
            starts = np.cumsum([0, *map(len, found)])[:-1]
            flat = np.fromiter((x for f in found for x in f), np.int64)
            scores = np.add.reduceat(self.weights[flat], starts, axis=0)
            at = len(self.index)
            while len(self.rows) < at + len(new):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[at : at + len(new)] = scores
            self.index.update(zip(new, range(at, at + len(new)), strict=True))
        get = self.index.__getitem__
        return [np.fromiter(map(get, d), np.int32, len(d)) for d in documents]


def forward_backward(scores: np.ndarray, valid: np.ndarray, start: np.ndarray, moves: np.ndarray, *, learn: bool = True) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """Marginals [T, B, K], and to learn from expected transitions [K, K] and log partition of B sequences; scores [T, B, K], valid [T, B]."""
    steps, _, k = scores.shape
    top = scores.max(2, keepdims=True)
    e = np.exp(scores - top)
    a = np.exp(moves - moves.max())
    alpha, norm = np.empty_like(e), np.ones(scores.shape[:2], e.dtype)
    now = np.exp(start - start.max())[None] * e[0]
    for t in range(steps):
        if t:
            now = (now @ a) * e[t]
        norm[t] = now.sum(1)
        now = now / norm[t][:, None]
        alpha[t] = now
    beta = np.empty_like(e)
    last = np.ones_like(e[0])
    beta[-1] = last
    for t in range(steps - 2, -1, -1):
        back = ((e[t + 1] * last) @ a.T) / norm[t + 1][:, None]
        last = np.where(valid[t + 1][:, None], back, 1.0)
        beta[t] = last
    gamma = alpha * beta
    gamma /= gamma.sum(2, keepdims=True)
    if not learn:
        return gamma, None, None
    pairs = np.zeros((k, k))
    if steps > 1:
        right = np.where(valid[1:, :, None], e[1:] * beta[1:] / norm[1:, :, None], 0)
        pairs = np.einsum("tbi,tbj->ij", alpha[:-1], right) * a
    logz = ((np.log(norm) + top[..., 0]) * valid).sum(0) + start.max() + moves.max() * (valid.sum(0) - 1)
    return gamma, pairs, logz


def fit(stretches: list[list[str]], labels: list[int], k: int, seed: int = 0) -> dict:
    """Emission weights, start and transition scores, by mini-batches on the exact conditional likelihood."""
    rng = np.random.default_rng(seed)
    counts = Counter(w for s in stretches for w in s)
    lexicon = {w for w, n in counts.items() if n >= MIN_LEXICON}
    names = list(counts)
    index = {w: i for i, w in enumerate(names)}
    found = [np.asarray(features(w, lexicon)) for w in names]
    sizes = np.array([len(f) for f in found])
    starts, flat = np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.concatenate(found)
    weights, start, moves = np.zeros((BUCKETS, k), np.float32), np.zeros(k), np.zeros((k, k))
    squares, s_start, s_moves = np.full((BUCKETS, 1), 1e-6, np.float32), np.full(k, 1e-6), np.full((k, k), 1e-6)
    coded = [np.fromiter((index[w] for w in s), np.int64, len(s)) for s in stretches]
    for _ in range(EPOCHS):
        order, sequences, at = rng.permutation(len(coded)), [], 0
        while at < len(order):  # one to four stretches in a row, whatever their languages
            n = int(rng.integers(1, 5))
            sequences.append(order[at : at + n])
            at += n
        for b in range(0, len(sequences), BATCH):
            part = sequences[b : b + BATCH]
            ids = [np.concatenate([coded[i] for i in s]) for s in part]
            truth = [np.concatenate([np.full(len(coded[i]), labels[i]) for i in s]) for s in part]
            steps = max(map(len, ids))
            word, valid, y = np.zeros((steps, len(ids)), np.int64), np.zeros((steps, len(ids)), bool), np.zeros((steps, len(ids)), np.int64)
            for j, (i, l) in enumerate(zip(ids, truth, strict=True)):
                word[: len(i), j], valid[: len(i), j], y[: len(i), j] = i, True, l
            used, inverse = np.unique(word[valid], return_inverse=True)
            token_features = np.concatenate([flat[starts[u] : starts[u] + sizes[u]] for u in used])
            bounds = np.concatenate([[0], np.cumsum(sizes[used])[:-1]])
            rows = np.add.reduceat(weights[token_features], bounds, axis=0)
            scores = np.zeros((steps, len(ids), k), np.float64)
            scores[valid] = rows[inverse]
            gamma, pairs, _ = forward_backward(scores, valid, start, moves)
            delta = gamma[valid]
            delta[np.arange(len(delta)), y[valid]] -= 1
            per_word = np.stack([np.bincount(inverse, delta[:, c], len(used)) for c in range(k)], 1)
            both = valid[1:] & valid[:-1]
            g_moves = pairs - np.bincount(y[:-1][both] * k + y[1:][both], minlength=k * k).reshape(k, k)
            g_start = gamma[0].sum(0) - np.bincount(y[0], minlength=k)
            hit, where = np.unique(token_features, return_inverse=True)
            g = np.zeros((len(hit), k))
            np.add.at(g, where, np.repeat(per_word, sizes[used], axis=0))
            g = g / len(ids) + L2 * weights[hit]
            # Adagrad with one rate for each feature
            squares[hit] += (g * g).sum(1, keepdims=True)
            weights[hit] -= RATE * g / np.sqrt(squares[hit])
            s_moves += (g_moves / len(ids)) ** 2
            moves -= RATE * (g_moves / len(ids)) / np.sqrt(s_moves)
            s_start += (g_start / len(ids)) ** 2
            start -= RATE * (g_start / len(ids)) / np.sqrt(s_start)
    return {"weights": weights, "start": start, "moves": moves, "lexicon": lexicon}


def _stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = [(lang, found[i : i + STRETCH]) for lang, text in zip(batch["lang"], batch["text"], strict=True) for found in [words_in(text)] for i in range(0, len(found), STRETCH)]
        yield pd.DataFrame({"lang": pd.Series([x[0] for x in out], dtype=object), "words": pd.Series([x[1] for x in out], dtype=object)})


def train(docs: DataFrame, *, max_train: int = MAX_TRAIN) -> dict | None:
    """The model learnt from docs (doc_id, text, lang); None without any word of known language.

    Rows are chosen by a hash of id and text, each distinct one once, and all words of a chosen row are learnt from.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", F.xxhash64("doc_id", "text").alias("content"))
    # The smallest hashes of a language are among its rows below twice the share that is wanted: no language's rows meet in one task.
    counts = materialise(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("__n")), "lang-counts")
    place = F.pmod("content", F.lit(1 << 52))
    few = small_join(labelled, counts, ["lang"]).where(place / float(1 << 52) <= F.lit(2.0 * max_train + 50) / F.col("__n")).select("lang", "content").distinct()
    rank = F.row_number().over(W.partitionBy("lang").orderBy(place, "content"))
    ids = few.withColumn("r", rank).where(F.col("r") <= max_train).select("lang", "content")
    ids = materialise(ids, "lang-train")
    rows = docs.select("lang", "text", F.xxhash64("doc_id", "text").alias("content")).join(ids, ["lang", "content"]).dropDuplicates(["lang", "content"]).select("lang", "text")
    pdf = rows.mapInPandas(_stretches, "lang string, words array<string>").toPandas()
    pdf = pdf.assign(words=[list(w) for w in pdf["words"]], key=[" ".join(w) for w in pdf["words"]]).sort_values(["lang", "key"], ignore_index=True)
    if not len(pdf):
        return None
    langs = sorted(pdf["lang"].unique())
    return fit(pdf["words"].tolist(), [langs.index(x) for x in pdf["lang"]], len(langs)) | {"langs": langs}


class Tagger:
    """Marginals of the words of whole documents."""

    def __init__(self, model: dict):
        self.langs, self.start, self.moves = model["langs"], model["start"].astype(np.float32), model["moves"].astype(np.float32)
        self.emissions = Emissions(model["weights"], model["lexicon"])

    def marginals(self, documents: list[list[str]]) -> Iterator[tuple[int, np.ndarray]]:
        """(number of the document, [words, languages]) of those with words, shortest first."""
        ids = self.emissions.ids(documents)
        order = sorted((i for i in range(len(ids)) if len(ids[i])), key=lambda i: len(ids[i]))
        at = 0
        while at < len(order):
            part = order[at : at + GROUP]
            # long documents go in smaller groups: the table of scores stays of one size
            while len(part) > 1 and len(part) * len(ids[part[-1]]) > GROUP * 4096:
                part = part[: len(part) // 2]
            at += len(part)
            steps = len(ids[part[-1]])
            scores, valid = np.zeros((steps, len(part), len(self.langs)), np.float32), np.zeros((steps, len(part)), bool)
            for j, i in enumerate(part):
                scores[: len(ids[i]), j], valid[: len(ids[i]), j] = self.emissions.rows[ids[i]], True
            gamma, _, _ = forward_backward(scores, valid, self.start, self.moves, learn=False)
            for j, i in enumerate(part):
                yield i, gamma[: len(ids[i]), j]


def _predict(model: dict | None, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    tagger = Tagger(model) if model else None
    for batch in batches:
        lang, score = [UNKNOWN] * len(batch), np.zeros(len(batch))
        if tagger:
            for i, gamma in tagger.marginals([words_in(t) for t in batch["text"]]):
                share = gamma.mean(0)
                best = int(share.argmax())
                lang[i], score[i] = tagger.langs[best], min(1.0, float(share[best]))
        yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "lang_pred": lang, "score": score})


def _label(model: dict | None, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    tagger = Tagger(model) if model else None
    for batch in batches:
        found = [words_in(t) for t in batch["text"]]
        out: list[list[str]] = [[UNKNOWN] * len(f) for f in found]
        for i, gamma in tagger.marginals(found) if tagger else ():
            out[i] = [tagger.langs[k] for k in gamma.argmax(1)]
        yield pd.DataFrame({"doc_id": batch["doc_id"], "words": pd.Series(found, dtype=object), "langs": pd.Series(out, dtype=object)})


def label_words(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, the words of the whole text and the language of each; empty arrays for texts without letters."""
    python_rows(docs.sparkSession)
    return docs.select("doc_id", "text").mapInPandas(partial(_label, model), "doc_id long, words array<string>, langs array<string>")


def identify(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of docs.

    Null texts and texts without letters are `und` with score 0, as is everything if nothing could be learnt. Repeated
    rows each get a row; other columns are ignored; an empty table gives no rows.
    """
    python_rows(docs.sparkSession)
    judged = docs.select("doc_id", "text").withColumn("held_out", held_out(4, 2))
    return judged.mapInPandas(partial(_predict, model), "doc_id long, held_out boolean, lang_pred string, score double")


def op8_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return identify(docs, train(docs.where(~held_out(4, 2))))
