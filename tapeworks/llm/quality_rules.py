"""Quality rules: fixed base rules, then robust multivariate outliers per language and source.

Each document becomes a vector of transformed statistics. For every (language, source) a minimum-covariance-determinant
estimate is found by concentration steps from two deterministic starts: the subset of the H share of rows with the
smallest distances gives the next centre and scatter, and the start whose scatter has the smaller determinant wins.
Rows beyond the cut-off Mahalanobis distance are rejected. Everything is DataFrame arithmetic: the Cholesky factor is
unrolled into columns, sums are exact integers (vectors lie on a grid of thousandths), and quantiles are exact because
vectors and logarithms of distances lie on grids, which bound how many values there are. All aggregates combine map-side, so an uneven source is no hot task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.llm.common import DOCUMENT_COLUMNS, UPPER, WHITE, materialise, small_join, table, words_of

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
MAX_REPEAT_SHARE = 30
WINDOW = 8
#: Share of a group's rows in the concentrated subset.
H = 0.75
#: Concentration steps go on while any group's least log determinant falls by more than CONVERGED; this many end an odd case.
MAX_STEPS = 40
CONVERGED = 1e-3
#: Groups of fewer rows use the estimate of their language, then of all rows; below that nothing is rejected.
MIN_GROUP = 100
GRID = 1000
#: Statistic -> least standard deviation that a group is taken to have (so constant statistics don't make a singular scatter).
FLOORS = {"word_length": 0.12, "symbols": 0.2, "dup_lines": 0.1, "repeats": 0.1, "capitals": 0.08}
D = len(FLOORS)
#: Median of a chi-square variable with D degrees of freedom (Wilson-Hilferty), which the distances are scaled to.
CHI2_MEDIAN = D * (1 - 2 / (9 * D)) ** 3
#: Cut-off of the scaled distance. Gaussian rows stay far below; only gross outliers are beyond.
CUT = 8.0
#: A group's scale is taken to be at least this.
MIN_SCALE = 0.5
#: Distances are compared on a grid of so many steps for each factor of e, so quantiles have few values however far rows are.
DISTANCE_GRID = 1000


def base_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the base columns to docs: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    Null text has no words. Columns of docs with these names are replaced.
    """
    clean = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    long = lambda c: c.cast("long")
    df = docs.withColumn("__w", words_of(F.col(f"`{text}`")))
    df = df.withColumn("__h", F.transform("__w", lambda w: F.xxhash64(w)))
    # A column that a lambda reads is read elsewhere in the same step too, so that it stays a column and isn't computed for each element.
    n = F.size("__h")
    df = df.withColumn("__k", F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(1))), lambda i: F.xxhash64(F.slice("__h", i, WINDOW)))).otherwise(F.array().cast("array<bigint>")))
    pairs = F.array_sort(F.transform("__k", lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
    df = df.withColumn("__p", F.when(F.size(F.array_distinct("__k")) < F.size("__k"), pairs).otherwise(F.array().cast("array<struct<k:bigint,i:int>>")))
    same = lambda p, j: F.coalesce(p["k"] == F.get(F.col("__p"), j)["k"], F.lit(False))
    df = df.withColumn("__s", F.array_sort(F.transform(F.filter("__p", lambda p, j: same(p, j - 1) | same(p, j + 1)), lambda p: p["i"])))
    covered = F.aggregate(F.transform("__s", lambda s, j: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("__s"), j + 1) - s, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b)
    df = df.withColumn("__l", F.filter(F.split(clean, "\n"), lambda x: F.length(F.translate(x, WHITE, "")) > 0))
    df = df.withColumns({
        "n_words": long(F.size("__w")),
        "word_chars": long(F.length(F.translate(clean, WHITE, ""))),
        "n_symbols": long(F.length(clean) - F.length(F.translate(clean, SYMBOLS, ""))),
        "n_dup_lines": long(F.size("__l") - F.size(F.array_distinct("__l"))),
        "n_repeat_words": long(covered),
        "__lines": long(F.size("__l")),
        "__capitals": long(F.length(clean) - F.length(F.translate(clean, UPPER, ""))),
    })
    df = df.drop("__w", "__h", "__k", "__p", "__s", "__l")
    return df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_SHARE * F.col("n_words")))


def _vector() -> dict[str, Column]:
    """The transformed statistics on the grid, as integers."""
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    raw = {
        "word_length": F.log(chars / n),
        "symbols": F.log1p(10 * F.col("n_symbols") / n),
        "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("__lines"), F.lit(1)),
        "repeats": F.col("n_repeat_words") / n,
        "capitals": F.col("__capitals") / chars,
    }
    return {f"v{i}": F.round(raw[name] * GRID).cast("long") for i, name in enumerate(FLOORS)}


def _estimates(sums: DataFrame) -> DataFrame:
    """Centre m_i and lower Cholesky factor l_ij of the floored scatter from exact sums, and the log determinant."""
    n = F.col("n").cast("double")
    df = sums.withColumns({f"m{i}": F.col(f"s{i}") / n / GRID for i in range(D)})
    cov = lambda i, j: F.col(f"s{i}_{j}") / n / GRID**2 - F.col(f"m{i}") * F.col(f"m{j}") + F.lit(list(FLOORS.values())[i] ** 2 if i == j else 0.0)
    for i in range(D):
        for j in range(i + 1):
            rest = cov(i, j)
            for k in range(j):
                rest = rest - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
            df = df.withColumn(f"l{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}_{j}"))
    logdet = sum((F.log(F.col(f"l{i}_{i}")) for i in range(1, D)), F.log(F.col("l0_0")))
    keep = [f"m{i}" for i in range(D)] + [f"l{i}_{j}" for i in range(D) for j in range(i + 1)]
    return df.select("key", "start", logdet.alias("logdet"), *keep)


def _place(distance: Column) -> Column:
    return F.round(F.log1p(distance) * DISTANCE_GRID).cast("long")


def _value(place: Column) -> Column:
    """The distance at a place on the grid."""
    return F.expm1(place / DISTANCE_GRID)


def _distance(df: DataFrame, name: str) -> DataFrame:
    """The place of the Mahalanobis distance on the logarithmic grid, by forward substitution."""
    for i in range(D):
        rest = F.col(f"v{i}") / GRID - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}_{j}") * F.col(f"__y{j}")
        df = df.withColumn(f"__y{i}", rest / F.col(f"l{i}_{i}"))
    square = sum((F.col(f"__y{i}") * F.col(f"__y{i}") for i in range(1, D)), F.col("__y0") * F.col("__y0"))
    df = df.withColumn(name, _place(F.sqrt(square)))
    return df.drop(*[f"__y{i}" for i in range(D)], *[f"m{i}" for i in range(D)], *[f"l{i}_{j}" for i in range(D) for j in range(i + 1)], "logdet")


def _sums() -> list[Column]:
    products = [F.sum(F.col(f"v{i}") * F.col(f"v{j}")).alias(f"s{i}_{j}") for i in range(D) for j in range(i + 1)]
    return [F.count(F.lit(1)).alias("n"), *[F.sum(f"v{i}").alias(f"s{i}") for i in range(D)], *products]


def routes(stats: DataFrame, min_group: int) -> DataFrame:
    """(l, s) -> use: the key whose estimate the group uses; `keys`: those it takes part in."""
    sizes = materialise(stats.where(~F.col("base_failed")).groupBy("l", "s").agg(F.count(F.lit(1)).alias("n")), "mcd-sizes")
    langs = sizes.groupBy("l").agg(F.sum("n").alias("nl"))
    total = sizes.agg(F.sum("n").alias("nt"))
    df = sizes.join(langs, "l").join(F.broadcast(total))
    own, lang, every = F.concat_ws("\u0001", F.lit("2"), "l", "s"), F.concat_ws("\u0001", F.lit("1"), "l"), F.lit("0")
    df = df.select("l", "s", F.when(F.col("n") >= min_group, own).when(F.col("nl") >= min_group, lang).when(F.col("nt") >= min_group, every).alias("use"), own.alias("__own"), lang.alias("__lang"), every.alias("__every"))
    groups = sizes.count()
    df = materialise(df, "mcd-routes", rows=groups)
    used = df.where(F.col("use").isNotNull()).select(F.col("use").alias("key")).distinct()
    member = df.select("l", "s", F.explode(F.array("__own", "__lang", "__every")).alias("key")).join(used, "key", "left_semi")
    return df.select("l", "s", "use"), materialise(member, "mcd-members", rows=3 * groups)


def mcd_estimates(stats: DataFrame, members: DataFrame) -> DataFrame:
    """One row per key: centre, factor and the scale that brings the median distance to that of a Gaussian."""
    keys = 2 * members.count()  # and two starts of each
    rows = small_join(stats.where(~F.col("base_failed")).select("l", "s", *[f"v{i}" for i in range(D)]), members, ["l", "s"]).drop("l", "s")
    middle = materialise(rows.groupBy("key").agg(*[F.percentile(f"v{i}", 0.5).alias(f"c{i}") for i in range(D)]), "mcd-medians", rows=keys)
    off = small_join(rows, middle, ["key"])
    spread = materialise(off.groupBy("key").agg(*[F.first(f"c{i}").alias(f"c{i}") for i in range(D)], *[F.percentile(F.abs(F.col(f"v{i}") - F.col(f"c{i}")), 0.5).alias(f"d{i}") for i in range(D)]), "mcd-spread", rows=keys)
    floors = list(FLOORS.values())
    z = [F.abs(F.col(f"v{i}") - F.col(f"c{i}")) / F.greatest(1.4826 * F.col(f"d{i}"), F.lit(floors[i] * GRID)) for i in range(D)]
    starts = F.array(F.struct(F.lit(0).alias("start"), _place(F.sqrt(sum((x * x for x in z[1:]), z[0] * z[0]))).alias("d")), F.struct(F.lit(1).alias("start"), _place(F.greatest(*z)).alias("d")))
    at = small_join(rows, spread, ["key"]).select("key", *[f"v{i}" for i in range(D)], F.inline(starts))
    low = None
    for _ in range(MAX_STEPS):
        bound = materialise(at.groupBy("key", "start").agg(F.percentile("d", H).alias("bound")), "mcd-bound", rows=keys)
        inner = small_join(at, bound, ["key", "start"]).where(F.col("d") <= F.col("bound"))
        found = materialise(_estimates(inner.groupBy("key", "start").agg(*_sums())), "mcd-step", rows=keys)
        at = _distance(small_join(rows.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1)))), found, ["key", "start"]), "d")
        # The grid may let a scatter go up and down in the end: the least one so far must fall.
        now = found.select("key", "start", "logdet")
        if low is not None:
            both = now.join(low, ["key", "start"])
            if both.where(F.col("low") - F.col("logdet") > CONVERGED).isEmpty():
                break
            now = both.withColumn("logdet", F.least("logdet", "low")).drop("low")
        low = materialise(now.withColumnRenamed("logdet", "low"), "mcd-low", rows=keys)
    scale = at.groupBy("key", "start").agg((_value(F.percentile("d", 0.5)) / F.sqrt(F.lit(CHI2_MEDIAN))).alias("scale"))
    both = found.join(scale, ["key", "start"])
    best = both.groupBy("key").agg(F.min_by(F.struct(*[c for c in both.columns if c != "key"]), F.struct("logdet", "start")).alias("b"))
    return materialise(best.select("key", "b.*"), "mcd-best", rows=keys)


def _row() -> Column:
    """Tells rows of one doc_id apart."""
    return F.xxhash64("doc_id", "text", "lang", "source")


def quality_rules(docs: DataFrame, *, min_group: int = MIN_GROUP, cut: float = CUT) -> DataFrame:
    """doc_id, the base columns, distance (by the scale of its group; null where there is no estimate or the base failed), kept (distance at most cut), and __row, a hash of the row.

    docs needs doc_id, text, lang, source; other columns are ignored. Null lang or source is a value of its own.
    Repeated rows count as often as they come. With fewer than min_group rows that pass the base, nothing else is
    rejected. An empty table gives an empty result.
    """
    text = base_statistics(docs.select("doc_id", "text", _row().alias("__row"), F.coalesce("lang", F.lit("\u0002")).alias("l"), F.coalesce("source", F.lit("\u0002")).alias("s")))
    stats = materialise(text.withColumns(_vector()).drop("text", "__lines", "__capitals"), "mcd-stats")
    use, members = routes(stats, min_group)
    best = mcd_estimates(stats, members)
    routed = small_join(stats, materialise(use.join(best, use["use"] == best["key"], "left").drop("key", "start"), "mcd-use", rows=members.count()), ["l", "s"], how="left")
    scored = _distance(routed, "__d").withColumn("distance", F.when(~F.col("base_failed"), _value(F.col("__d")) / F.greatest(F.col("scale"), F.lit(MIN_SCALE))))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= cut, F.lit(True))
    return scored.withColumn("kept", kept).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance", "__row")


def op7_mcd_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and verdict of every document."""
    return quality_rules(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")).drop("__row")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that are kept."""
    kept = quality_rules(docs).where("kept").select(F.col("doc_id").alias("__id"), F.col("__row").alias("__r")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["__id"]) & (_row() == kept["__r"]), "left_semi").select(*DOCUMENT_COLUMNS)
