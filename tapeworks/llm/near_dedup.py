"""Near-duplicate detection: fast similarity sketching, banding, exact verification, connected components.

Sketch (Dahlgaard, Knudsen, Thorup 2017): in each of t rounds every element is thrown into a random bin with a random
value; then t more rounds send every element to one fixed bin each, so every coordinate is filled however small the set.
A bin keeps the least (round, value). Equal coordinates estimate Jaccard similarity with concentration as for
sampling without replacement, at a cost that doesn't multiply the set's size by t.

Documents with the same shingle set are one class. Classes that share a band meet in a bucket, where links are sought
without emitting all pairs: each member is verified against the bucket's most central member (its hub); those that miss it form
the bucket of the next round. Jaccard distance is a metric, so a member that misses a hub by more than twice the
threshold can't link to anything linked to it; the others, unless one component already holds both, meet the members of
the hub's component that share one of their rarest shingles (prefix filter). All links are confirmed on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeworks.llm.common import DOCUMENT_COLUMNS, discard, python_rows, table, without_shuffle_files
from tapeworks.llm.common import materialise as written

BANDS, ROWS = 48, 5
T = BANDS * ROWS
#: With similarity 0.8 all bands of a pair differ with probability (1 - 0.8 ** ROWS) ** BANDS, 5e-9.
STAR_ROUNDS = 4
#: Slots of 64 bits, broadcast, tell which texts may be wanted: one for four texts lets about 1.6 % of the others pass. With this many at most, more pass; none is lost.
MOST_SLOTS = 1 << 19
U = np.uint64
M1, M2, K1, K2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * M1
    x = (x ^ (x >> U(27))) * M2
    return x ^ (x >> U(31))


class WordHashes(dict):
    """64-bit hash of each word; forgets all when it has grown to `most` words."""

    def __init__(self, most: int = 100_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, hashes: WordHashes, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of one whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, U)
    h = np.fromiter(map(hashes.__getitem__, words), U, len(words))
    if len(h) < width:
        acc = np.array([len(h)], U) * K2
        for j in range(len(h)):
            acc = mix(acc * K1 + h[j : j + 1])
        return acc
    acc = h[: len(h) - width + 1]
    for j in range(1, width):
        acc = mix(acc * K1 + h[j : len(h) - width + 1 + j])
    return np.unique(mix(acc + K2))


@lru_cache(4)
def seeds(t: int) -> np.ndarray:
    return mix(np.arange(1, 2 * t + 1, dtype=U) * K1)


def sketch(items: np.ndarray, t: int = T) -> np.ndarray:
    """t coordinates of a non-empty set: round in the high 16 bits, value below."""
    full = np.iinfo(np.uint64).max
    out = np.full(t, full, U)
    seed, low = seeds(t), U((1 << 48) - 1)
    done, block = 0, max(1, min(t, int(1.3 * t * np.log(t) / len(items)) + 1))
    while done < t:
        rounds = np.arange(done, min(t, done + block))
        h = mix(items[None, :] ^ seed[rounds][:, None])
        bins = ((h >> U(32)) * U(t)) >> U(32)
        np.minimum.at(out, bins.ravel().astype(np.int64), ((mix(h + K2) & low) | (rounds.astype(U) << U(48))[:, None]).ravel())
        done += len(rounds)
        if not (out == full).any():
            return out
    for b in np.flatnonzero(out == full):
        out[b] = (mix(mix(items ^ seed[t + b]) + K2) & low).min() | (U(t + b) << U(48))
    return out


def bands_of(coordinates: np.ndarray, bands: int, rows: int) -> np.ndarray:
    acc = mix(np.arange(1, bands + 1, dtype=U) * K2)
    for part in coordinates.reshape(bands, rows).T:
        acc = mix(acc * K1 + part)
    return acc.view(np.int64)


def _signatures(width: int, bands: int, rows: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        hashes = WordHashes()
        for batch in batches:
            out = []
            for text in batch["text"]:
                s = shingle_set(text, hashes, width)
                out.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), bands_of(sketch(s, bands * rows), bands, rows)) if len(s) else (0, None, None))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "content": batch["content"], "n_shingles": [x[0] for x in out], "fp": [x[1] for x in out], "bands": [x[2] for x in out]})

    return run


def _sets(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "items": [shingle_set(t, hashes, width).view(np.int64) for t in batch["text"]]})

    return run


def materialise(df: DataFrame, label: str, **size: int | None) -> DataFrame:
    """The table that is written; its shuffle files go at once, as one of full sets or texts after the other would be several times the input."""
    with without_shuffle_files(df.sparkSession):
        return written(df, label, **size)


def _likely(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows (content and others) without most of those whose content is not one of chosen's: a filter of bits, so that a join need not shuffle every text."""
    slots = max(1, min(MOST_SLOTS, chosen.count() // 4))
    slot = F.pmod(F.col("content"), F.lit(slots))
    one, mask = F.lit(1).cast("long"), F.lit(63)
    bits = [F.call_function("shiftleft", one, F.shiftright("content", at).bitwiseAND(mask).cast("int")) for at in (44, 54)]
    both = bits[0].bitwiseOR(bits[1])
    held = chosen.groupBy(slot.alias("__slot")).agg(F.bit_or(both).alias("__held"))
    found = rows.join(F.broadcast(held), slot == F.col("__slot"))
    return found.where(F.col("__held").bitwiseAND(both) == both).select(*rows.columns)


def _verified(pairs: DataFrame, sets: DataFrame, most: int | None = None) -> DataFrame:
    """(id, other, inter, both) with the sizes of intersection and union of the full sets."""
    left = pairs.join(sets.withColumnRenamed("items", "x"), "id")
    rows = left.join(sets.select(F.col("id").alias("other"), F.col("items").alias("y")), "other")
    inter = F.size(F.array_intersect("x", "y"))
    rows = rows.select("id", "other", inter.alias("inter"), (F.size("x") + F.size("y")).alias("__sum"))
    return materialise(rows.select("id", "other", "inter", (F.col("__sum") - F.col("inter")).alias("both")), "near-pairs", rows=most, per_file=4_000)


def _led(rows: DataFrame) -> DataFrame:
    """Bucket rows (key, id, n, order) with the hub of each bucket; buckets of one member are left out."""
    hubs = rows.groupBy("key").agg(F.min("order").alias("__hub"), F.max("order").alias("__last")).where(F.col("__hub") != F.col("__last"))
    return rows.join(hubs.select("key", F.col("__hub.id").alias("hub")), "key")


def _rare_pairs(some: DataFrame, others: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (id, other) of some (id, n, mine, theirs) and others (id, n, theirs) with equal theirs.

    Two sets of this similarity share one of their rarest items: of n items in the order of their frequency the first
    n - ceil(percent * n / 100) + 1 are enough. Items that many sets hold come last, so a group of near copies meets
    only in what few of them have.
    """
    both = materialise(some.select("id", "n").union(others.select("id", "n")).distinct(), "near-few", rows=sets.count())
    few = both.count()
    items = both.join(sets, "id").select("id", "n", F.explode("items").alias("item"))
    items = items.join(items.groupBy("item").agg(F.count(F.lit(1)).alias("df")), "item")
    rank = F.row_number().over(W.partitionBy("id").orderBy("df", "item"))
    rare = items.withColumn("r", rank).where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * percent / 100 - 1e-9) + 1).where(F.col("df") > 1)
    rare = materialise(rare.select("id", "n", "r", "item"), "near-rare", rows=few, per_file=100)
    here = some.select("id", "theirs").distinct().join(rare, "id")
    there = others.select("id", "theirs").join(rare, "id").select(F.col("id").alias("other"), F.col("n").alias("m"), F.col("r").alias("q"), F.col("theirs").alias("group"), "item")
    pairs = here.join(there, "item").where(F.col("theirs").eqNullSafe(F.col("group")) & (F.col("id") != F.col("other")))
    # What stands before the first shared item in either order is not shared: enough must be left for the overlap needed.
    enough = (100 + percent) * (F.least(F.col("n") - F.col("r"), F.col("m") - F.col("q")) + 1) >= percent * (F.col("n") + F.col("m"))
    return pairs.where(enough & (100 * F.least("n", "m") >= percent * F.greatest("n", "m"))).select("id", "other").distinct()


def components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(id, label): the least id reachable over edges (id, other), by minimum labels with pointer jumping."""
    both = materialise(edges.select("id", "other").union(edges.select(F.col("other").alias("id"), F.col("id").alias("other"))).distinct(), "near-graph", rows=most)
    ends = both.count()
    labels = materialise(both.groupBy("id").agg(F.least(F.col("id"), F.min("other")).alias("label")), "near-labels", rows=ends)
    while True:
        seen = both.join(labels.select(F.col("id").alias("other"), "label"), "other").groupBy("id").agg(F.min("label").alias("next"))
        step = labels.join(seen, "id").select("id", "label", F.least("label", "next").alias("next"))
        step = step.join(labels.select(F.col("id").alias("next"), F.col("label").alias("jump")), "next", "left")
        step = materialise(step.select("id", F.col("label").alias("old"), F.least("next", "jump").alias("label")), "near-labels", rows=ends)
        if step.where(F.col("old") != F.col("label")).isEmpty():
            return step.select("id", "label")
        labels = step.select("id", "label")


SIGNATURE = "doc_id long, content long, n_shingles long, fp binary, bands array<long>"


def _content() -> Column:
    """Tells rows of one doc_id apart."""
    return F.xxhash64("doc_id", "text")


def linked_rows(docs: DataFrame, *, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, by_id: bool = True) -> DataFrame:
    """doc_id, content (a hash of the row), n_shingles, class, component and rep, the least doc_id of the component, of rows with a doc_id.

    Rows with the same shingle set are one class, whatever their ids; class and component are null without shingles.
    With by_id all rows of one doc_id are in one component; else each row goes by its own text alone.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("content", _content())
    python_rows(spark)
    named = docs.where(F.col("doc_id").isNotNull())
    signed = materialise(named.mapInPandas(_signatures(width, bands, rows), SIGNATURE), "near-signatures")
    total = signed.count()
    # Classes are numbered in the table that is written, so numbers hold. Written before it is joined: a join of two
    # shuffled sides can be split where one key holds very many rows.
    classes = signed.where(F.col("fp").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("rep")).withColumn("class", F.monotonically_increasing_id())
    classes = materialise(classes, "near-classes", rows=total)
    mapped = signed.join(classes, "fp", "left").select("doc_id", "content", "n_shingles", "class", "rep", F.when(F.col("doc_id") == F.col("rep"), F.col("bands")).alias("bands"))
    mapped = materialise(mapped, "near-mapped", rows=total, per_file=8_000)
    discard(signed)
    members = mapped.where(F.col("bands").isNotNull()).select(F.explode("bands").alias("key"), F.col("class").alias("id"), F.col("n_shingles").alias("n"))
    shared = members.groupBy("key").agg(F.min("id").alias("__first"), F.max("id").alias("__last"), F.count(F.lit(1)).alias("size")).where(F.col("__first") != F.col("__last")).select("key", "size")
    shared = materialise(shared, "near-shared", rows=total * bands, per_file=500_000)
    bucket = materialise(members.join(shared, "key").select("key", "id", "n", "size").distinct(), "near-meetings", rows=total * bands, per_file=500_000)
    met = bucket.count()
    # How many others it meets: the most central member of a group of near copies leads in all its buckets.
    central = bucket.groupBy("id").agg(F.sum("size").alias("met"))
    bucket = materialise(bucket.join(central, "id").select("key", "id", "n", F.struct((-F.col("met")).alias("met"), "id").alias("order")), "near-buckets", rows=met)
    narrow = materialise(mapped.drop("bands"), "near-rows", rows=total)
    discard(mapped)
    mapped = narrow
    # One row of each class gives its set: the first in the order of content among those of the least doc_id.
    chosen = mapped.where(F.col("doc_id") == F.col("rep")).join(bucket.select(F.col("id").alias("class")).distinct(), "class", "left_semi")
    chosen = materialise(chosen.groupBy(F.col("class").alias("id")).agg(F.first("doc_id").alias("doc_id"), F.min("content").alias("content")), "near-chosen", rows=met)
    wanted = _likely(named, chosen).join(chosen, ["doc_id", "content"]).dropDuplicates(["id"]).select("id", "text")
    sets = materialise(wanted.mapInPandas(_sets(width), "id long, items array<long>"), "near-sets", rows=min(total, met), per_file=4_000)

    linked = F.lit(100) * F.col("inter") >= F.lit(percent) * F.col("both")
    # Jaccard distance is a metric: beyond twice the threshold from a hub nothing linked to it can be reached.
    reachable = 1 - F.col("inter") / F.col("both") <= 2 * (1 - percent / 100) + 1e-9
    edges, near_misses, counts = [], [], []
    at = _led(bucket)
    for _ in range(STAR_ROUNDS):
        at = materialise(at, "near-led", rows=met)
        met = at.count()
        if not met:
            break
        star = at.where(F.col("id") != F.col("hub"))
        found = _verified(star.select("id", F.col("hub").alias("other")).distinct(), sets, met)
        edges.append(found.where(linked).select("id", "other"))
        counts.append(met)
        near_misses.append(found.where(~linked & reachable).select("id", F.col("other").alias("hub")))
        at = _led(star.join(found.where(~linked).select("id", F.col("other").alias("hub")), ["id", "hub"]).select("key", "id", "n", "order"))
    else:
        # Members that missed every hub so far are compared by their rarest shingles.
        at = materialise(at, "near-strays", rows=met)
        if not at.isEmpty():
            left = at.select("id", "n").distinct()
            stray = _verified(_rare_pairs(left.withColumns({"mine": F.col("id"), "theirs": F.lit(None).cast("long")}), left.withColumn("theirs", F.lit(None).cast("long")), sets, percent), sets)
            edges.append(stray.where(linked).select("id", "other"))
            counts.append(stray.count())
    labels = None
    if edges:
        links = reduce(DataFrame.union, edges)
        links_most = 2 * sum(counts)
        labels = components(links, links_most)
        # One near the hub of another component may still link to some member there.
        open_ = reduce(DataFrame.union, near_misses).distinct()
        open_ = open_.join(labels, "id", "left").select("id", "hub", F.coalesce("label", "id").alias("mine"))
        open_ = open_.join(labels.select(F.col("id").alias("hub"), "label"), "hub", "left").select("id", "mine", F.coalesce("label", "hub").alias("theirs"))
        open_ = materialise(open_.where(F.col("mine") != F.col("theirs")).distinct(), "near-open", rows=links_most)
        if not open_.isEmpty():
            sizes = bucket.select("id", "n").distinct()
            # A component of one is its hub, which has been compared: labels holds those of more.
            there = sizes.join(labels, "id").select("id", "n", F.col("label").alias("theirs")).join(open_.select("theirs").distinct(), "theirs", "left_semi")
            more = _verified(_rare_pairs(open_.join(sizes, "id"), there, sets, percent), sets).where(linked).select("id", "other")
            if not more.isEmpty():
                links = labels.where(F.col("id") != F.col("label")).select("id", F.col("label").alias("other")).union(more)
                labels = components(links)
    if by_id:
        # Rows of one doc_id with unlike sets are linked through their doc_id.
        several = mapped.where(F.col("class").isNotNull()).groupBy("doc_id").agg(F.min("class").alias("other"), F.max("class").alias("__last")).where(F.col("other") != F.col("__last")).select("doc_id", "other")
        several = materialise(several, "near-several", rows=total)
        if not several.isEmpty():
            same = mapped.where(F.col("class").isNotNull()).join(several, "doc_id").where(F.col("class") != F.col("other")).select(F.col("class").alias("id"), "other")
            labels = components(same if labels is None else same.union(labels.where(F.col("id") != F.col("label")).select("id", F.col("label").alias("other"))))
    done = mapped.select("doc_id", "content", "n_shingles", "class", "rep")
    if labels is None:
        return done.withColumn("component", F.col("class"))
    found = materialise(labels.join(classes, labels["id"] == classes["class"]).select("class", "label", F.col("rep").alias("r")), "near-found", rows=total)
    least = found.groupBy("label").agg(F.min("r").alias("least"))
    found = materialise(found.join(least, "label").select("class", "label", "least"), "near-components", rows=total)
    done = done.join(found, "class", "left")
    return done.select("doc_id", "content", "n_shingles", "class", F.coalesce("label", "class").alias("component"), F.coalesce("least", "rep").alias("rep"))


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs (doc_id, text; other columns are ignored).

    Texts link when 100 * |A n B| >= percent * |A u B| of their sets of `width`-word shingles; fewer words are one
    shingle. Shingles are compared as 64-bit hashes of their words, in the search and on the full sets alike. Null and
    empty texts, and texts without words, link with nothing. A row without doc_id links with nothing, has a null
    component_id and is kept. Rows that repeat a doc_id are one document: each links by its own text, and all share one
    component. Empty tables give empty results.
    """
    found = linked_rows(docs, width=width, percent=percent, bands=bands, rows=rows)
    by_doc = F.coalesce("rep", "doc_id")
    done = found.select("doc_id", "n_shingles", by_doc.alias("component_id"), (F.col("doc_id") == by_doc).alias("kept"))
    nameless = docs.where(F.col("doc_id").isNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("content", _content()).mapInPandas(_signatures(width, bands, rows), SIGNATURE)
    return done.union(nameless.select("doc_id", "n_shingles", F.lit(None).cast("long"), F.lit(True)))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 2-word shingle sets have a similarity of 0.8 or more."""
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), width=2)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each component stays, the one with the smallest doc_id (five-word shingles).

    Every row goes by its own text, so a row that repeats a doc_id with another text stays unless that text has a near
    copy; of rows of the smallest doc_id that are near copies of each other the one with the least hash stays. Rows
    without a doc_id or without words all stay, as do rows that repeat both doc_id and text of one that stays. Columns
    besides those of documents are dropped.
    """
    found = linked_rows(docs, width=5, by_id=False).where(F.col("component").isNotNull())
    place = F.struct("doc_id", "content")
    last = found.groupBy("component").agg(F.min(place).alias("first"))
    gone = materialise(found.join(last, "component").where(place != F.col("first")).select(F.col("doc_id").alias("__id"), F.col("content").alias("__content")).distinct(), "near-gone")
    rows = docs.select(*DOCUMENT_COLUMNS)
    return rows.join(gone, (rows["doc_id"] == gone["__id"]) & (F.xxhash64(rows["doc_id"].cast("long"), rows["text"]) == gone["__content"]), "left_anti")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) > 1 THEN [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] ELSE w END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)), r AS (
  SELECT doc_id AS id, doc_id AS other FROM documents UNION SELECT r.id, e.y FROM r JOIN e ON e.x = r.other
), c AS (SELECT id, min(other) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
