"""Personal data: fixed base patterns, then bootstrapped contextual extraction.

Base matches and long hexadecimal credentials are seed entities. The words before an entity are lexical patterns.
Every identifier-like token is an instance, linked to the patterns it stands behind; rounds over that graph score a
pattern by the share of its distinct instances that are known to be of one kind, and an instance by the patterns it
stands behind. Instances behind high-confidence patterns are found as that kind wherever they stand.
Everything is DataFrame functions; spans are code points, end exclusive.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.llm.common import DOCUMENT_COLUMNS, materialise, table

KINDS = ("email", "ip", "card", "phone", "secret")
#: The base patterns in a form whose search is linear in the text: no match can start inside a run that was not one.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: An identifier-like token: it holds a digit, and MIN_TOKEN characters.
TOKEN = r"(?<![A-Za-z0-9_.@+-])[A-Za-z_.@+-]*+[0-9][A-Za-z0-9_.@+-]*+"
MIN_TOKEN = 4
SECRET = r"^(?=.*[0-9])(?=.*[A-Fa-f])[0-9A-Fa-f]{32,}$"
#: A pattern is trusted with this many distinct known instances and this share of all its distinct instances.
MIN_SUPPORT, MIN_CONFIDENCE = 5, 0.8
MIN_SCORE = 0.75
#: Rounds go on until no instance is added or changes its kind; the limit only ends an unending change of kinds.
MAX_ROUNDS = 50
CONTEXT_WORDS = 3
#: The last words of a text that is read backwards, whatever their length.
LAST_WORDS = r"^[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+){0,3}+"
SPAN = "struct<s:int,e:int,v:string,c:string>"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def part(i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2))

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), part), F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: str, span: Column) -> Column:
    match = span["v"]
    if kind == "ip":
        small = lambda x: (F.length(F.ltrim(x, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(x, F.lit("0")).try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(match, "[.]"), small)
    if kind == "card":
        n = F.length(_digits(match))
        return F.when(n.between(16, 19), _luhn(_digits(match))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    return F.lit(True)


def _spans(text: str, pattern: str, gate: Column) -> tuple[Column, Column]:
    """Pieces between the matches, and the matches: their lengths give the positions."""
    none = F.array().cast("array<string>")
    return F.when(gate, F.split(text, pattern, -1)).otherwise(none), F.when(gate, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)


def _placed(pieces: Column, matches: Column) -> Column:
    """Matches with their places, and the words just before each.

    An array that grows in a fold is copied at every step, so matches are placed in blocks of the root of their number and
    the blocks are joined: a text of n matches takes n ** 1.5 steps.
    """
    n = F.size(matches)
    block = F.ceil(F.sqrt(n)).cast("int")
    none = F.array().cast(f"array<{SPAN}>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc: Column, i: Column) -> Column:
        piece, match = F.get(pieces, i), F.get(matches, i)
        s = acc["at"] + F.length(piece)
        e = s + F.length(match)
        before = F.reverse(F.regexp_extract(F.reverse(piece), LAST_WORDS, 0))
        span = F.struct(s.alias("s"), e.alias("e"), match.alias("v"), before.alias("c"))
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def moved(by: Column, x: Column) -> Column:
        return F.struct((x["s"] + by).alias("s"), (x["e"] + by).alias("e"), x["v"].alias("v"), x["c"].alias("c"))

    def join(acc: Column, x: Column) -> Column:
        return F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.transform(x["out"], lambda y: moved(acc["at"], y))).alias("out"))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int")), lambda b: F.aggregate(F.sequence(b * block, F.least((b + 1) * block, n) - 1), start, step))
    return F.aggregate(blocks, start, join, lambda acc: acc["out"])


def _context(before: Column) -> Column:
    """The last one to three words before, lower-cased: each is a pattern."""
    words = F.filter(F.split(F.lower(before), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    ends = lambda k: F.when(F.size(words) >= k, F.concat_ws(" ", F.slice(words, -k, k)))
    return F.filter(F.array(*[ends(k) for k in range(1, CONTEXT_WORDS + 1)]), lambda x: x.isNotNull())


def _named(kind: Column, x: Column) -> Column:
    return F.struct(kind.alias("k"), x["s"].alias("s"), x["e"].alias("e"))


def _instance(kind: Column, x: Column) -> Column:
    return F.struct(kind.alias("k"), F.xxhash64(F.lower(x["v"])).alias("v"), _context(x["c"]).alias("c"), x["s"].alias("s"), x["e"].alias("e"))


def find_base(docs: DataFrame) -> DataFrame:
    """doc_id, __row, base (kind, s, e) and instances (kind or null, value, c, s, e) of every row."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    df = df.withColumn("__digit", F.col("text").rlike("[0-9]")).withColumn("__row", F.xxhash64("doc_id", "text"))
    gates = {"email": F.contains("text", F.lit("@")), "ip": F.col("__digit"), "card": F.col("__digit"), "phone": F.contains("text", F.lit("+")), "token": F.col("__digit")}
    for kind, pattern in {**PATTERNS, "token": TOKEN}.items():
        pieces, matches = _spans("text", pattern, gates[kind])
        df = df.withColumns({f"__p_{kind}": pieces, f"__m_{kind}": matches})
    # Pieces and matches are read by the lambdas, so they must stay columns: each is read twice in this step.
    df = df.select("doc_id", "__row", *[F.when((F.size(f"__m_{k}") > 0) & (F.size(f"__p_{k}") > 0), _placed(F.col(f"__p_{k}"), F.col(f"__m_{k}"))).otherwise(F.array().cast(f"array<{SPAN}>")).alias(k) for k in gates])
    df = df.withColumns({k: F.filter(k, partial(_valid, k)) for k in PATTERNS})
    flat = [F.transform(k, partial(_named, F.lit(i))) for i, k in enumerate(PATTERNS)]
    df = df.withColumn("base", F.concat(*flat))
    clean = F.transform("token", lambda x: F.struct(x["s"].alias("s"), (x["s"] + F.length(F.regexp_replace(x["v"], r"[._@+-]+$", ""))).alias("e"), F.regexp_replace(x["v"], r"[._@+-]+$", "").alias("v"), x["c"].alias("c")))
    df = df.withColumn("token", clean)
    apart = lambda x: ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
    df = df.withColumn("token", F.filter("token", lambda x: apart(x) & (F.length(x["v"]) >= MIN_TOKEN)))
    made = [F.transform(k, partial(_instance, F.lit(i))) for i, k in enumerate(PATTERNS)]
    secret = F.transform("token", lambda x: _instance(F.when(x["v"].rlike(SECRET), F.lit(KINDS.index("secret"))), x))
    return df.select("doc_id", "__row", "base", F.concat(*made, secret).alias("instances"))


def learn(instances: DataFrame, most: int) -> DataFrame:
    """(v, kind) of up to `most` instances: the kind of every instance that seeds or high-confidence patterns name."""
    seeds = materialise(instances.where(F.col("k").isNotNull()).groupBy("v").agg(F.min("k").alias("k")).withColumn("score", F.lit(1.0)), "pii-seeds", rows=most)
    links = materialise(instances.select("v", F.explode("c").alias("p")).distinct(), "pii-links", rows=CONTEXT_WORDS * most)
    total = links.groupBy("p").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_SUPPORT)
    known, size = seeds, None
    state = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum((F.xxhash64("v", "k") % (1 << 40)).cast("long"))).first())
    for _ in range(MAX_ROUNDS):
        votes = links.join(known, "v").groupBy("p", "k").agg(F.sum("score").alias("votes"), F.count(F.lit(1)).alias("support"))
        rated = votes.where(F.col("support") >= MIN_SUPPORT).join(total, "p").withColumn("confidence", F.col("votes") / F.col("n"))
        trusted = materialise(rated.where(F.col("confidence") >= MIN_CONFIDENCE).select("p", "k", "confidence"), "pii-patterns", rows=most)
        doubt = F.exp(F.sum(F.log(1 - 0.98 * F.col("confidence"))))
        scored = links.join(trusted, "p").groupBy("v", "k").agg((1 - doubt).alias("score"))
        best = scored.groupBy("v").agg(F.max_by(F.struct("k", "score"), F.struct("score", -F.col("k"))).alias("b")).select("v", "b.k", "b.score")
        new = best.where(F.col("score") >= MIN_SCORE).join(seeds, "v", "left_anti")
        known = materialise(seeds.union(new), "pii-known", rows=most)
        size, last = state(known), size
        if size == last:
            break
    return known.select("v", F.col("k").alias("kind"))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, __row, base and spans: arrays of (k, s, e) sorted by kind as listed and start, for every row of docs.

    docs needs doc_id and text; null text is empty. Repeated rows each get their spans; a null doc_id is a value of its
    own. Tables without any match, and empty ones, give empty arrays or no rows. Spans of different kinds may overlap.
    """
    found = materialise(find_base(docs), "pii-base")
    instances = found.select("doc_id", "__row", F.inline("instances"))
    most = found.agg(F.coalesce(F.sum(F.size("instances")), F.lit(0))).first()[0]
    kinds = learn(instances, most)
    # A seed value of one kind doesn't rename base spans: only instances that the base left unnamed are added.
    open_ = instances.where(F.col("k").isNull() | (F.col("k") == KINDS.index("secret")))
    added = open_.join(kinds, "v").groupBy("doc_id", "__row").agg(F.collect_set(F.struct(F.col("kind").alias("k"), "s", "e")).alias("added"))
    added = materialise(added, "pii-added", rows=most).withColumnsRenamed({"doc_id": "__id", "__row": "__r"})
    joined = found.join(added, found["doc_id"].eqNullSafe(added["__id"]) & (found["__row"] == added["__r"]), "left")
    extra = F.coalesce("added", F.array().cast("array<struct<k:int,s:int,e:int>>"))
    return joined.select("doc_id", "__row", F.array_sort("base").alias("base"), F.array_sort(F.concat("base", extra)).alias("spans"))


def _is_kind(kind: int, x: Column) -> Column:
    return x["k"] == kind


def _joined(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat(F.get(names, x["k"]), F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))), ",")


def op9_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of personal data in every document."""
    found = personal_data(table(spark, sf_dir, "documents", "doc_id", "text"))
    counts = [F.size(F.filter("base", partial(_is_kind, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(PATTERNS)]
    return found.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """text with every stretch that spans cover replaced by the name of the kind that begins it."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    order = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("b"), x["k"].alias("k"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        e, fresh = -x["b"], x["s"] >= acc["at"]
        parts = F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.get(names, x["k"])))
        return F.struct(F.greatest(acc["at"], e).alias("at"), F.when(fresh, parts).otherwise(acc["out"]).alias("out"))

    return F.aggregate(order, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: personal data is replaced by the name of its kind; every document stays. n_chars follows the text.

    Null texts stay null, repeated rows each stay, an empty table stays empty. Columns besides those of documents are dropped.
    """
    found = personal_data(docs).where(F.size("spans") > 0).select(F.col("doc_id").alias("__id"), F.col("__row").alias("__r"), "spans").distinct()
    rows = docs.select(*DOCUMENT_COLUMNS).withColumn("__row", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    rows = rows.join(found, rows["doc_id"].eqNullSafe(found["__id"]) & (rows["__row"] == found["__r"]), "left")
    rows = rows.withColumn("text", F.when(F.size("spans") > 0, redacted(F.col("text"), F.col("spans"))).otherwise(F.col("text")))
    return rows.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*DOCUMENT_COLUMNS)
