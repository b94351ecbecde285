"""Exact dedup by content sort.

Rows are dealt out by Spark's sampled range splitters over the leading normalised characters, every range is sorted
externally by the whole normalised text, and neighbours are compared in full; rows between two unlike neighbours are a group.

A task must not get all texts that begin alike, so leads of many rows or bytes are dealt on by a hash of the text. Nor must
it get all copies of one text: texts of many rows or bytes are counted first, by an aggregate whose key is the whole
normalised text and that combines map-side; their rows are dealt on by a hash of the row, and every range gets one marker,
the text with its count and keeper, which is sorted and compared with its neighbours like any row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeworks.llm.common import DOCUMENT_COLUMNS, ascii_lower, materialise, small_join, table, unused_prefix

LEAD = 24
#: Rows and bytes of text beyond which a lead or a text is spread: so much may meet in one sort group.
MOST_ROWS, MOST_BYTES = 1000, 64 << 20
RESULT = ("keep_id", "group_size", "kept", "text_sha256")


def _parts(n: Column, size: Column, rows: int, most_bytes: int) -> Column:
    """How many groups so many rows and bytes are dealt to; null if they are few."""
    parts = F.ceil(F.greatest(n / rows, size / most_bytes))
    return F.when((n > rows) | (size > most_bytes), F.greatest(parts, F.lit(2)))


def content_sort_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", partitions: int | None = None, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Adds keep_id, group_size, kept and text_sha256 to every row of docs.

    Texts are equal when identical after lower-casing A-Z. `keep` names which identifier of a group stays ("smallest" or
    "largest"). Null text counts as empty. A null identifier is never kept while its group has another one; if all are
    null, keep_id is null and one row stays. Of rows that repeat both text and identifier one stays. Empty tables give
    empty results. Input columns with the name of a result column are replaced; all others pass through, whatever their names.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest, not {keep!r}")
    best = F.max if keep == "largest" else F.min
    if {id_col, text_col} & set(RESULT):
        raise ValueError("the identifier and the text can't have the name of a result column")
    names = [c for c in docs.columns if c not in RESULT]
    # Names of helper columns that no input column has.
    p = unused_prefix(docs)
    lead, hashed, n, size, copies, parts, part, salt, mark, norm, at, held = (f"{p}{x}" for x in ("lead", "hash", "n", "size", "copies", "parts", "part", "salt", "mark", "norm", "at", "keep"))
    ident, text = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    # Equal texts have equal hashes; lower() is more than A-Z, so a hash may also join unlike ones, which the sort tells apart.
    rows = docs.select(*[F.col(f"`{c}`") for c in names]).withColumns({lead: F.lower(F.substring(text, 1, LEAD)), hashed: F.xxhash64(F.lower(text))})
    counts = materialise(rows.groupBy(lead, hashed).agg(F.count(F.lit(1)).alias(n), F.sum(F.octet_length(text)).alias(size)), "exact-counts")
    most = counts.count()
    many = _parts(F.col(n), F.col(size), most_rows, most_bytes)
    texts = materialise(counts.select(lead, hashed, many.alias(copies)).where(F.col(copies).isNotNull()), "exact-texts", rows=most)
    leads = counts.groupBy(lead).agg(F.sum(n).alias(n), F.sum(size).alias(size)).select(lead, many.alias(parts)).where(F.col(parts).isNotNull())
    keyed = small_join(rows, materialise(leads, "exact-leads", rows=most), [lead], how="left")
    keyed = keyed.withColumn(part, F.when(F.col(parts).isNull(), 0).otherwise(F.pmod(hashed, parts)).cast("long"))
    keyed = small_join(keyed, texts, [lead, hashed], how="left")
    # Rows of one identifier stay together; those without one are told apart by all they hold.
    spread = F.when(ident.isNotNull(), F.xxhash64(ident)).otherwise(F.xxhash64(*[F.col(f"`{c}`") for c in names]))
    keyed = keyed.withColumn(salt, F.when(F.col(copies).isNull(), 0).otherwise(F.pmod(spread, copies)).cast("long"))
    keys = [lead, part, salt]
    told = {mark: "string", size: "long", held: rows.schema[id_col].dataType, at: "long"}
    dealt = keyed.select(*[F.col(f"`{c}`") for c in names], *keys, *[F.lit(None).cast(t).alias(c) for c, t in told.items()])
    if not texts.isEmpty():
        # One marker of each such text for each of its ranges; `at` is where the row without any identifier may stay.
        hot = keyed.where(F.col(copies).isNotNull()).groupBy(lead, part, ascii_lower(text).alias(mark)).agg(F.first(copies).alias(copies), F.count(F.lit(1)).alias(size), best(ident).alias(held), F.min(salt).alias(at))
        hot = hot.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.col(copies) - 1)))
        dealt = dealt.unionByName(hot.select(*keys, *told), allowMissingColumns=True)
    dealt = dealt.repartitionByRange(partitions, *keys) if partitions else dealt.repartitionByRange(*keys)
    dealt = dealt.withColumn(norm, ascii_lower(F.coalesce(F.col(mark), text)))
    marker = F.col(size).isNotNull()
    # Equal neighbours in the sorted range, a marker first among them.
    equals = W.partitionBy(*keys).orderBy(norm).rangeBetween(W.currentRow, W.currentRow)
    before = W.partitionBy(*keys).orderBy(norm, marker.desc(), ident.desc_nulls_last() if keep == "largest" else ident.asc_nulls_last())
    sizes = F.coalesce(F.max(size).over(equals), F.count(F.lit(1)).over(equals))
    keeper = F.when(F.max(size).over(equals).isNotNull(), F.max(held).over(equals)).otherwise(best(ident).over(equals))
    last = F.lag(norm).over(before)
    fresh = last.isNull() | (last != F.col(norm)) | F.lag(marker).over(before)
    here = ident.isNotNull() | F.coalesce(F.max(at).over(equals) == F.col(salt), F.lit(True))
    out = dealt.select(*[F.col(f"`{c}`") for c in names], marker.alias(mark), norm, keeper.alias("keep_id"), sizes.alias(f"{p}sizes"), fresh.alias(f"{p}fresh"), here.alias(f"{p}here")).where(~F.col(mark))
    kept = F.col(f"{p}fresh") & F.col(f"{p}here") & ident.eqNullSafe(F.col("keep_id"))
    return out.select(*[F.col(f"`{c}`") for c in names], "keep_id", F.col(f"{p}sizes").alias("group_size"), kept.alias("kept"), F.sha2(norm, 256).alias("text_sha256"))


def op5_content_sort_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document; of equal texts the largest doc_id stays."""
    found = content_sort_dedup(table(spark, sf_dir, "documents", "doc_id", "text"), keep="largest")
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: only the row that stays of each group."""
    return content_sort_dedup(docs.select(*DOCUMENT_COLUMNS), keep="largest").where("kept").select(*DOCUMENT_COLUMNS)


SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
), g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g ON n.norm = g.norm
"""
