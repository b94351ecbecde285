"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted. Pieces (documents, cut where they exceed the largest length) are dealt into
shards of bounded size by a hash; each shard is packed on its own: pieces by falling length go into the open bin that
they leave least room in; if none holds the piece, the size to open is the one whose cost per word is least for what the
remaining pieces could fill it with. At last every bin shrinks to the smallest permitted length that holds its contents.
Only lengths travel: texts stay where they are.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.llm.common import materialise, python_rows, table, words_of

CAPACITIES = (512, 1024, 2048, 4096)
#: Cost of one sequence of capacity c: c + OVERHEAD, in words.
OVERHEAD = 32
SHARD_PIECES = 20_000
SCHEMA = "shard long, bin int, capacity int, used int, slot int, doc_id long, piece int, start long, length int"


def fill_estimate(counts: np.ndarray, first: int, room: int) -> int:
    """Words that a bin of this room would hold if, after its first piece, it always took the longest remaining piece that fits."""
    used, room = first, room - first
    length = room
    taken: dict[int, int] = {}
    while length > 0:
        below = counts[: length + 1].nonzero()[0]
        if not len(below) or below[-1] == 0:
            break
        length = int(below[-1])
        n = min(int(counts[length]) - taken.get(length, 0) - (length == first), room // length)
        if n > 0:
            used, room = used + n * length, room - n * length
        length = min(length - 1, room)
    return used


def pack(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD) -> tuple[list[int], list[int]]:
    """Bin of each piece and capacity of each bin. Every length must be at most the largest capacity; 0 takes no room."""
    sizes = sorted(set(capacities))
    counts = np.zeros(sizes[-1] + 1, np.int64)
    np.add.at(counts, np.asarray(lengths, np.int64), 1)
    counts[0] = 0
    place, room, used, open_ = [0] * len(lengths), [], [], []  # open_: (room, bin), sorted
    memo: dict[tuple[int, int], int] = {}
    for i in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        n = lengths[i]
        at = bisect_left(open_, (n, -1))
        if at < len(open_):
            _, b = open_.pop(at)
        else:
            # counts only falls, and slowly: an estimate holds while pieces of the same length are placed.
            key = n
            if key not in memo:
                memo.clear()
                memo[key] = min((c for c in sizes if c >= n), key=lambda c: ((c + overhead) / max(1, fill_estimate(counts, n, c)), -c))
            b = len(room)
            room.append(memo[key])
            used.append(0)
        place[i] = b
        room[b] -= n
        used[b] += n
        if n:
            counts[n] -= 1
        insort(open_, (room[b], b))
    return place, [next(c for c in sizes if c >= u) for u in used]


def _packer(capacities: Sequence[int], overhead: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "start"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        lengths = pdf["length"].tolist()
        place, caps = pack(lengths, capacities, overhead)
        pdf["bin"] = np.asarray(place, np.int32)
        pdf["capacity"] = np.asarray([caps[b] for b in place], np.int32)
        group = pdf.groupby("bin")
        pdf["used"] = group["length"].transform("sum").astype("int32")
        pdf["slot"] = (group["length"].cumsum() - pdf["length"]).astype("int32")
        return pdf[["shard", "bin", "capacity", "used", "slot", "doc_id", "piece", "start", "length"]]

    return run


def best_fit_packing(docs: DataFrame, *, capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row per piece: shard, bin, capacity and used of its bin, its slot there, doc_id, piece number, first word and length.

    Lengths are words of the whole text; null and empty texts are one piece of length 0. Repeated rows are packed each;
    a null doc_id stays null; neither puts rows into one shard. Other columns are ignored; an empty table gives no rows.
    The same files, read alike, give the same bins.
    """
    if not capacities or min(capacities) < 1:
        raise ValueError("capacities must be positive")
    spark, most = docs.sparkSession, max(capacities)
    python_rows(spark)
    words = F.size(words_of(F.col("text")))
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words.cast("long").alias("n"))
    pieces = F.greatest(F.ceil(F.col("n") / most), F.lit(1)).cast("int")
    cut = sized.select("doc_id", "n", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"))
    cut = cut.select("doc_id", "piece", (F.col("piece") * F.lit(most)).cast("long").alias("start"), F.least(F.lit(most), F.col("n") - F.col("piece") * F.lit(most)).cast("int").alias("length"))
    # Numbers that are written hold; they deal rows out evenly even where ids repeat or are null.
    cut = materialise(cut.withColumn("row", F.monotonically_increasing_id()), "packing-pieces")
    shards = max(1, -(-cut.count() // shard_pieces))
    dealt = cut.select("doc_id", "piece", "start", "length", F.pmod(F.xxhash64("row", "doc_id"), F.lit(shards)).cast("long").alias("shard"))
    return dealt.groupBy("shard").applyInPandas(_packer(tuple(capacities), overhead), SCHEMA)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packing of all documents."""
    return best_fit_packing(table(spark, sf_dir, "documents", "doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: where every piece of every document goes; null and empty texts are pieces of length 0, repeated rows go each."""
    return best_fit_packing(docs)
