"""Quality rules by robust multivariate outliers.

Base rules reject short texts and texts in which most words repeat. The statistics of the
others are transformed and each language and source gets a minimum-covariance-determinant
estimate: from several starts, concentration steps keep the half of the rows with the
smallest Mahalanobis distances and take their mean and covariance; the estimate with the
least determinant stays, and one more step takes the rows that fit it. A row is rejected if
its distance to its group's estimate exceeds `CUTOFF`. Since half of a group decides, junk
that fills a third of it does not hide.

A step sums counts, vectors and products per group, start and distance bin, so that the
choice of the nearest rows and their moments come from one pass and no group meets in one
task. Groups of under MIN_ROWS rows use the estimate over all rows of their language, small
languages that over all rows; where these are under LEAST rows, the base rules alone decide.
All of it is DataFrame operations.

Nulls: a null text has no words and fails; null languages and sources are groups of their
own. Repeated rows count each, ties fall alike. An empty table gives no rows. Only the named
columns are read for the statistics; other columns pass through `accept`, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, let, tidy, unpacked, whole_row, words

SYMBOLS, MARKS = "#*$%&|<>", "!"
#: Share of rows that an estimate rests on, concentration steps, and the share that fits in the last one.
KEEP, STEPS, FITS = 0.5, 6, 0.975
#: Squared distance beyond which a row is rejected; it is far beyond the normal quantiles since statistics have long tails.
CUTOFF = 45.0
MIN_ROWS, LEAST, MANY_GROUPS = 200, 30, 20_000
#: Standard deviations that are added to each estimate: no statistic counts as exact.
FLOOR = {"x0": 0.08, "x1": 0.35, "x2": 0.5, "x3": 0.12, "x4": 0.6, "x5": 0.35}
X = list(FLOOR)


def chi_square_below(x: float, freedom: int) -> float:
    """Share of a chi-square distribution of even freedom below x."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(freedom // 2))


def chi_square_at(share: float, freedom: int) -> float:
    """The value below which that share lies."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_below(mid, freedom) < share else (low, mid)
    return low


def consistent(share: float) -> float:
    """The factor that makes the covariance of the nearest share of normal rows that of all."""
    return share / chi_square_below(chi_square_at(share, len(X)), len(X) + 2)


def repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that the text has twice or more.

    Window hashes carry their position in their low bits; sorted, equal windows are neighbours.
    Of the 64 bits of a hash all but those of the position decide, so a false match needs two
    different windows of one text to agree in (64 - log2 of the words) bits.
    """

    def dup(w: Column, bits: Column, low: Column) -> Column:
        hashed = F.transform(F.slice(w, 1, F.size(w) - 2), lambda x, i: F.xxhash64(x, w[i + 1], w[i + 2]).bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long")))
        same = lambda x, y: F.call_function("shiftright", x, bits) == F.call_function("shiftright", y, bits)

        def found(s: Column) -> Column:
            again = F.filter(s, lambda x, i: F.coalesce(same(x, F.get(s, i - 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, i + 1)), F.lit(False)))
            at = F.transform(again, lambda x: x.bitwiseAND(low))
            return let(at, lambda a: F.size(F.array_distinct(F.concat(a, F.transform(a, lambda x: x + 1), F.transform(a, lambda x: x + 2)))))

        return let(F.sort_array(hashed), found)

    def sized(bits: Column) -> Column:
        return let(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1, lambda low: dup(w, bits, low))

    return F.when(F.size(w) < 4, 0).otherwise(let(F.length(F.bin(F.size(w).cast("long"))).cast("int"), sized))


def with_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with one struct column `stats`: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and x0 to x5."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    without = lambda signs: F.length(text) - F.length(F.translate(text, signs, ""))
    counted = let(
        words(F.col(text_col)),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).cast("long").alias("n_repeat_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars")),
    )
    more = docs.select(
        "*",
        counted.alias("_w"),
        without(SYMBOLS).cast("long").alias("_symbols"),
        (F.length(text) - F.length(F.replace(text, F.lit(MARKS), F.lit("")))).alias("_marks"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("_dup"),
    )
    n, chars = F.greatest("_w.n_words", F.lit(1)), F.greatest("_w.word_chars", F.lit(1))
    failed = (F.col("_w.n_words") < 50) | (100 * F.col("_w.n_repeat_words") > 50 * F.col("_w.n_words"))
    x = [
        F.log(chars / n),
        F.log1p(100 * F.col("_symbols") / chars),
        F.log1p(100 * F.col("_dup") / n),
        F.asin(F.sqrt(F.least(F.col("_w.n_repeat_words") / n, F.lit(1.0)))),
        F.log(n.cast("double")),
        F.log1p(100 * F.col("_marks") / chars),
    ]
    stats = F.struct(
        "_w.n_words", "_w.word_chars", F.col("_symbols").alias("n_symbols"), F.col("_dup").alias("n_dup_lines"), "_w.n_repeat_words", failed.alias("base_failed"), *(v.alias(k) for k, v in zip(X, x, strict=True))
    )
    return more.select(*docs.columns, stats.alias("stats"))


def _attach(rows: DataFrame, table: DataFrame, keys: list[str], n: int) -> DataFrame:
    """rows with table's columns; the table is broadcast if there are at most MANY_GROUPS groups."""
    return rows.join(F.broadcast(table) if n <= MANY_GROUPS else table, keys)


def groups(rows: DataFrame) -> DataFrame:
    """lang, source and the group whose estimate they use: their own, their language's or that of all."""
    one = rows.where("not base_failed").groupBy("lang", "source").agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy("lang"))
    own = F.concat_ws("\x1f", F.lit("own"), "lang", F.col("lang").isNull(), "source", F.col("source").isNull())
    pool = F.concat_ws("\x1f", F.lit("lang"), "lang", F.col("lang").isNull())
    return one.select("lang", "source", F.when(F.col("n") >= MIN_ROWS, own).when(whole >= MIN_ROWS, pool).otherwise("all").alias("key"))


def members(rows: DataFrame, table: DataFrame, n_groups: int) -> DataFrame:
    """rows with the key of each estimate that they enter: their group's own, and those of their language and of all where some group uses them."""
    good = rows.where("not base_failed")
    own = _keyed(good, table.where("key like 'own%'"), n_groups).where("key is not null")
    by_lang = table.where("key like 'lang%'").select(F.col("lang").alias("_lang"), "key").distinct()
    by_lang = F.broadcast(by_lang) if n_groups <= MANY_GROUPS else by_lang
    of_lang = good.join(by_lang, good["lang"].eqNullSafe(by_lang["_lang"])).drop("_lang")
    out = own.unionByName(of_lang)
    return out.unionByName(good.withColumn("key", F.lit("all"))) if table.where("key = 'all'").limit(1).count() else out


def swept(matrix: Column) -> Column:
    """inverse and log_det of a symmetric positive matrix (array of rows) by sweeping each row."""

    def sweep(a: Column, k: Column) -> Column:
        def entry(v: Column, i: Column, j: Column) -> Column:
            d = a[k][k]
            return F.when((i == k) & (j == k), 1 / d).when(i == k, v / d).when(j == k, -v / d).otherwise(v - a[i][k] * a[k][j] / d)

        return F.transform(a, lambda row, i: F.transform(row, lambda v, j: entry(v, i, j)))

    start = F.struct(matrix.alias("inverse"), F.lit(0.0).alias("log_det"))
    step = lambda acc, k: F.struct(sweep(acc["inverse"], k).alias("inverse"), (acc["log_det"] + F.log(acc["inverse"][k][k])).alias("log_det"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(X) - 1)), start, step)


D = range(len(X))
_SUMS = ["n", *(f"s{i}" for i in D), *(f"p{i}_{j}" for i in D for j in range(i, len(X)))]


def _moments() -> list[Column]:
    """n, sums s_i and products p_i_j of the statistics."""
    return [F.count("*").alias("n"), *(F.sum(X[i]).alias(f"s{i}") for i in D), *(F.sum(F.col(X[i]) * F.col(X[j])).alias(f"p{i}_{j}") for i in D for j in range(i, len(X)))]


def _estimate(sums: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """keys, mu, inv and log_det of the covariance times factor, with the floor."""
    mean = {i: F.col(f"s{i}") / F.col("n") for i in D}
    cov = lambda i, j: factor * (F.col(f"p{min(i, j)}_{max(i, j)}") / F.col("n") - mean[i] * mean[j]) + (FLOOR[X[i]] ** 2 if i == j else 0.0)
    full = sums.select(*keys, F.array(*(mean[i] for i in D)).alias("mu"), F.array(*(F.array(*(cov(i, j) for j in D)) for i in D)).alias("cov"))
    return full.select(*keys, "mu", swept(F.col("cov")).alias("s")).select(*keys, "mu", F.col("s.inverse").alias("inv"), F.col("s.log_det").alias("log_det"))


def _starts(keyed: DataFrame) -> DataFrame:
    """key, start, mu, inv: medians with quartile ranges (0) or with the floor alone (1), and the mean and covariance of all rows (2)."""
    parts = [F.percentile_approx(x, [0.25, 0.5, 0.75], 10_000).alias(x) for x in X]
    sums = cut(keyed.groupBy("key").agg(*parts, *_moments()).where(F.col("n") >= LEAST), "rule-starts")
    median = F.array(*(F.col(x)[1].cast("double") for x in X))
    diagonal = lambda of: F.array(*(F.array(*(1 / of(i) if i == j else F.lit(0.0) for j in D)) for i in D))
    ranges = diagonal(lambda i: F.pow((F.col(X[i])[2] - F.col(X[i])[0]) / 1.349, 2) + FLOOR[X[i]] ** 2)
    plain = diagonal(lambda i: F.lit(FLOOR[X[i]] ** 2))
    two = [sums.select("key", F.lit(k).alias("start"), median.alias("mu"), inv.alias("inv")) for k, inv in enumerate((ranges, plain))]
    return two[0].union(two[1]).union(_estimate(sums.withColumn("start", F.lit(2)), ["key", "start"], 1.0).select("key", "start", "mu", "inv"))


def distance(mu: Column, inv: Column, x: list[Column]) -> Column:
    """Squared Mahalanobis distance."""
    off = [v - mu[i] for i, v in enumerate(x)]
    return sum((inv[i][j] * off[i] * off[j] for i in range(len(x)) for j in range(len(x))), F.lit(0.0))


@tidy
def estimates(rows: DataFrame) -> tuple[DataFrame, int]:
    """lang, source, mu, inv for every group of rows (lang, source, base_failed, x0..x5) that has one, and how many groups there are."""
    table = cut(groups(rows), "rule-groups")
    n_groups = table.count()
    keyed = members(rows, table, n_groups)
    far = distance(F.col("mu"), F.col("inv"), [F.col(x) for x in X])
    now = _starts(keyed)
    by = ["key", "start"]
    for _ in range(STEPS):
        now = cut(now, "rule-estimate")
        bins = _attach(keyed, now, ["key"], n_groups).withColumn("bin", F.floor(16 * F.log2(1 + far)))
        binned = bins.groupBy(*by, "bin").agg(*_moments())
        before = F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        kept = binned.withColumn("before", before).withColumn("all", F.sum("n").over(Window.partitionBy(*by))).where(F.col("before") < KEEP * F.col("all"))
        now = _estimate(kept.groupBy(*by).agg(*(F.sum(c).alias(c) for c in _SUMS)), by, consistent(KEEP))
    best = cut(now.groupBy("key").agg(F.min_by(F.struct("mu", "inv"), F.struct("log_det", "start")).alias("e")).select("key", "e.*"), "rule-least")
    fits = _attach(keyed, best, ["key"], n_groups).where(far <= chi_square_at(FITS, len(X)))
    last = _estimate(fits.groupBy("key").agg(*_moments()), ["key"], consistent(FITS))
    return cut(table.join(last, "key").select("lang", "source", "mu", "inv"), "rule-estimates"), n_groups


def _keyed(rows: DataFrame, table: DataFrame, n_groups: int) -> DataFrame:
    t = table.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *(c for c in table.columns if c not in ("lang", "source")))
    t = F.broadcast(t) if n_groups <= MANY_GROUPS else t
    return rows.join(t, rows["lang"].eqNullSafe(t["_lang"]) & rows["source"].eqNullSafe(t["_source"]), "left").drop("_lang", "_source")


def _verdict(rows: DataFrame, table: DataFrame, n_groups: int, stats: str = "") -> DataFrame:
    """rows with `kept`: base rules, then the distance to the group's estimate."""
    s = lambda c: F.col(f"{stats}{c}")
    far = distance(F.col("mu"), F.col("inv"), [s(x) for x in X])
    return _keyed(rows, table, n_groups).withColumn("kept", ~s("base_failed") & (F.coalesce(far, F.lit(0.0)) <= CUTOFF)).drop("mu", "inv")


def _rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    return with_stats(base).select("doc_id", "lang", "source", "stats.*")


@tidy
def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, the statistics, base_failed and kept of every document; texts are read once."""
    rows = cut(_rows(docs, id_col, text_col, lang_col, source_col), "rule-stats")
    return _verdict(rows, *estimates(rows)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@tidy
def accept(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns: texts are read once, and written with their statistics."""
    rows = cut(with_stats(whole_row(docs, text="text", lang="lang", source="source")).drop("text"), "rule-rows")
    found = estimates(rows.select("lang", "source", "stats.*"))
    return unpacked(_verdict(rows, *found, stats="stats.").where("kept"), docs)
