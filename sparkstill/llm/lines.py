"""Line deduplication by an exact set-similarity join.

A line is the set of its five-word shingles (a line of fewer words: the whole of it). A
line is removed if an earlier one (by document id, then line number) has a Jaccard
similarity of THRESHOLD or more with it; lines without words stay. The position of a line is
its document's id, its number, and between them, where texts share an id, the text's hash.

Lines of equal sets are one class, represented by its first line; all others of the class
go. Tokens are ordered by rarity: by the count of their first word, which bounds their own
(a table of counts by word hash, of fixed size; any order is exact, rare tokens first make
it quick). Similar lines share a
token of their prefixes, so representatives are joined over prefix tokens, with the length
and the positional filter, and candidates are verified by their Jaccard similarity. A line
is first compared with the first line of each token's list; only lines that this does not
settle are compared with the others of their lists (lists of three or more only), a pair once, at its first common token.
Pairs are held against one more bound before any tokens are joined: a token of one set only changes one bit of the sets'
parities, which have a bit for each token of all but the longest lines, so that unlike lines that share a token are told apart.
Only lines of a pair that may match, or of a list with something left, are made tokens of again.
All of it is DataFrame operations.

Nulls: a null text stays null; a null id counts as the first. Rows that repeat an id and a
text share their positions, and keep or lose lines alike. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, let, released, small, tidy, unpacked, whole_row

SHINGLE, THRESHOLD, BUCKETS = 5, 0.8, 8192
#: Longs of a line's parities, a power of two.
PARITY = 8
WORD = r"[^\x20\x09-\x0D]"
_POSITION = ["doc_id", "t", "line_no"]


def line_words(line: Column) -> Column:
    """The words of a line; only one with other white space than spaces needs a regular expression."""
    return F.array_remove(F.when(line.rlike(r"[\x09-\x0D]"), F.split(line, SPACE)).otherwise(F.split(line, " ")), "")


def shingles(w: Column, scale: Column | None = None, size: int = SHINGLE) -> Column:
    """The distinct token keys, ascending, of a line given as the column of its words (one or more).

    A key is 56 bits of the shingle's hash below the frequency of its first word (0 without
    a scale): a shingle is at most as frequent as its words, so a small key means a rare token.
    """

    def key(first: Column, hashed: Column) -> Column:
        own = hashed.bitwiseAND((1 << 56) - 1)
        return own if scale is None else F.get(scale, F.xxhash64(first).bitwiseAND(BUCKETS - 1).cast("int")).bitwiseOR(own)

    long_ = F.transform(F.slice(w, 1, F.size(w) - (size - 1)), lambda x, i: key(x, F.xxhash64(x, *(F.get(w, i + k) for k in range(1, size)))))
    short = F.array(key(F.get(w, F.lit(0)), F.xxhash64(F.array_join(w, " "))))
    return F.when(F.size(w) >= size, F.sort_array(F.array_distinct(long_))).otherwise(short)


def rarity(docs: DataFrame, buckets: int = BUCKETS) -> Column:
    """How frequent the words of each hash bucket are, on a log scale in the high bits of a long, as a constant array.

    Words are counted between spaces; that one beside a line end is counted with it only makes the order a little worse.
    """
    word = docs.select(F.explode(F.split("text", " ")).alias("w"))
    counts = word.groupBy(F.xxhash64("w").bitwiseAND(buckets - 1).alias("b")).agg(F.count("*").alias("n"))
    scale = [0] * buckets
    for x in counts.collect():  # buckets rows at most
        scale[x["b"]] = min(120, int(3 * math.log2(1 + x["n"]))) << 56
    return F.split(F.lit(",".join(map(str, scale))), ",").cast("array<bigint>")


def line_sets(docs: DataFrame, scale: Column, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, t, line_no, a, b (hashes of the set), size and prefix of every line of docs (doc_id, t, text) that has a word.

    Lines are chosen by their text, since a filter on the keys would be pushed below and compute them twice.
    """
    lines = docs.select("doc_id", "t", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.col("line").rlike(WORD))
    keyed = lines.select(*_POSITION, line_words(F.col("line")).alias("w")).select(*_POSITION, shingles(F.col("w"), scale).alias("keys"))
    size = F.size("keys")
    prefix = F.slice("keys", 1, size - F.ceil(threshold * size - 1e-9).cast("int") + 1)
    return keyed.select(*_POSITION, F.xxhash64("keys").alias("a"), F.hash("keys").alias("b"), size.alias("size"), prefix.alias("prefix"))


def representatives(rows: DataFrame) -> DataFrame:
    """doc_id, t, line_no, size and prefix of the first line of each class of equal sets."""
    first = F.min(F.struct(*_POSITION)).alias("p")
    return rows.groupBy("a", "b", "size").agg(first, F.first("prefix").alias("prefix")).select("p.*", "size", "prefix")


def _may_match(x: Column, y: Column, before: Column, threshold: float) -> Column:
    """Length and positional filter for two lines that share a token (x, y: size << 32 | place), with at most `before` common tokens before it."""
    size, place = (lambda v: F.shiftright(v, 32)), (lambda v: v.bitwiseAND((1 << 32) - 1))
    a, b = size(x), size(y)
    overlap = F.ceil(threshold / (1 + threshold) * (a + b) - 1e-9)
    return (F.least(a, b) >= threshold * F.greatest(a, b) - 1e-9) & (before + 1 + F.least(a - place(x) - 1, b - place(y) - 1) >= overlap)


@tidy
def shared_postings(reps: DataFrame) -> DataFrame:
    """token, a line's position, one (its size and the token's place, as size << 32 | place), first (position and one of the token's first line) and n (the token's lines), for tokens of two lines or more.

    Tokens are counted first, with partial sums, so that no list meets in one task and only
    the postings of shared tokens are looked at again.
    """
    one = F.col("size").cast("long") * F.lit(1 << 32)
    postings = reps.select(*_POSITION, one.alias("one"), F.posexplode("prefix").alias("i", "token")).select("token", *_POSITION, (F.col("one") + F.col("i")).alias("one"))
    shared = released(cut(postings.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token"), "line-shared"))
    listed = cut(postings.join(small(shared), "token"), "line-listed")
    first = listed.groupBy("token").agg(F.min(F.struct(*_POSITION, "one")).alias("first"), F.count("*").alias("n"))
    found = cut(listed.join(first, "token").select("token", F.struct(*_POSITION).alias("p"), "one", F.struct(*(f"first.{c}" for c in _POSITION)).alias("first"), F.col("first.one").alias("first_one"), "n"), "line-postings")
    return released(found)


def listed(positions: DataFrame, name: str) -> DataFrame:
    """id, u and the line numbers (`name`) of positions, by document."""
    return cut(positions.groupBy(F.col("doc_id").alias("id"), F.col("t").alias("u")).agg(F.collect_set("line_no").alias(name)), f"line-{name}")


def _of(docs: DataFrame, lists: DataFrame, how: str = "inner") -> DataFrame:
    """docs with the lists of their line numbers."""
    return docs.join(small(lists), docs["doc_id"].eqNullSafe(lists["id"]) & (docs["t"] == lists["u"]), how)


@tidy
def tokens_of(docs: DataFrame, positions: DataFrame) -> DataFrame:
    """p (a position) and tokens of the lines at some positions, once for rows that are repeated."""
    wanted = listed(positions, "wanted")
    once = docs.where("not again").union(docs.where("again").dropDuplicates(["doc_id", "t"]))
    some = _of(once, wanted).select("doc_id", "t", F.split("text", "\n").alias("l"), F.explode("wanted").alias("line_no"))
    split_ = some.select(F.struct(*_POSITION).alias("p"), line_words(F.get("l", F.col("line_no"))).alias("w"))
    return cut(split_.select("p", shingles(F.col("w")).alias("tokens")), "line-tokens")


def parities(tokens: DataFrame) -> DataFrame:
    """p and the parities of each row's tokens, PARITY longs: whether an odd number of tokens has each value of nine bits of the hash. A token of one set only changes one bit."""
    each = tokens.select("p.*", F.explode("tokens").alias("k"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright("k", PARITY.bit_length() - 1).bitwiseAND(63).cast("int"))
    word = F.col("k").bitwiseAND(PARITY - 1)
    sums = each.groupBy(*_POSITION).agg(*(F.bit_xor(F.when(word == i, bit).otherwise(F.lit(0).cast("long"))).alias(f"s{i}") for i in range(PARITY)))
    return cut(sums.select(F.struct(*_POSITION).alias("p"), *(f"s{i}" for i in range(PARITY))), "line-parities")


def _near_enough(x: str, y: str, sizes: Column, threshold: float) -> Column:
    """Whether the parities of x and y (prefixes of their columns) allow a Jaccard similarity of the threshold; sizes: the sum of both."""
    differ = sum((F.bit_count(F.col(f"{x}s{i}").bitwiseXOR(F.col(f"{y}s{i}"))) for i in range(PARITY)), F.lit(0))
    return differ <= (1 - threshold) / (1 + threshold) * sizes + 1e-9


def _likely(pairs: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """x and y of the pairs (x, y, sizes) whose parities allow the threshold."""
    side = lambda c: sketches.select(F.col("p").alias(c), *(F.col(f"s{i}").alias(f"{c}s{i}") for i in range(PARITY)))
    return cut(pairs.join(side("x"), "x").join(side("y"), "y").where(_near_enough("x", "y", F.col("sizes"), threshold)).select("x", "y"), "line-likely")


def _verified(pairs: DataFrame, tokens: DataFrame, threshold: float) -> DataFrame:
    """x of the pairs (a cut table, each pair once) whose Jaccard similarity is at least the threshold; tokens move for lines of a pair only."""
    sides = cut(pairs.select(F.explode(F.array("x", "y")).alias("p"), "x", "y"), "line-sides")
    both = tokens.join(small(sides), "p").groupBy("x", "y").agg(F.collect_list("tokens").alias("t"))
    one, other = F.get("t", F.lit(0)), F.get("t", F.lit(1))
    common = F.size(F.array_intersect(one, other))
    found = both.where(common >= threshold * (F.size(one) + F.size(other) - common) - 1e-9).select("x").distinct()
    return released(cut(found, "line-found"))


@tidy
def unsettled(shared: DataFrame, found: DataFrame) -> DataFrame:
    """token, p, one and settled (1 if p is among `found`) of the lists that have something left to compare: two lines or more after the first, one of them not settled."""
    settled = found.select(F.col("x").alias("p"), F.lit(1).alias("settled"))
    rest = cut(shared.where((F.col("n") > 2) & (F.col("p") != F.col("first"))).select("token", "p", "one").join(settled, "p", "left").fillna(0, ["settled"]), "line-rest")
    open_ = cut(rest.where("settled = 0").select("token").distinct(), "line-open")
    return cut(rest.join(small(open_), "token"), "line-left")


@tidy
def similar_to_earlier(docs: DataFrame, reps: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """x: positions of the representatives that have an earlier similar line."""
    shared = shared_postings(reps)
    place = lambda v: v.bitwiseAND((1 << 32) - 1)
    at_most = F.least(place(F.col("one")), place(F.col("first_one")))
    star = shared.where((F.col("p") != F.col("first")) & _may_match(F.col("one"), F.col("first_one"), at_most, threshold))
    sizes = F.shiftright("one", 32) + F.shiftright("first_one", 32)
    star = cut(star.select(F.col("p").alias("x"), F.col("first").alias("y"), sizes.alias("sizes")).distinct(), "line-star")
    compared = tokens_of(docs, star.select(F.explode(F.array("x", "y")).alias("p")).select("p.*"))
    sketches = parities(compared)
    found = _verified(_likely(star, sketches, threshold), compared, threshold)
    # lines not settled by the first of a list, against the others before them; a pair meets in the list of
    # each shared token, and counts in that of the first one only, before which the two have none in common
    left = unsettled(shared, found)
    lines = cut(left.select("p").distinct(), "line-compared")
    more_lines = tokens_of(docs, lines.join(compared.select("p"), "p", "left_anti").select("p.*"))
    tokens, sketches = compared.union(more_lines), sketches.union(parities(more_lines))
    lists = shared.select("p", "token").join(lines, "p", "left_semi").groupBy("p").agg(F.sort_array(F.collect_list("token")).alias("mine"))
    others = released(cut(left.join(lists.join(sketches, "p"), "p"), "line-others"))
    # both sides have the same columns and no filter of their own, so that they share a shuffle; only unsettled lines count as x
    x, y = others.alias("x"), others.alias("y")
    near = _near_enough("x.", "y.", F.shiftright("x.one", 32) + F.shiftright("y.one", 32), threshold)
    may = (F.col("y.p") < F.col("x.p")) & (2 * F.col("x.settled") + F.col("y.settled") < 2) & _may_match(F.col("x.one"), F.col("y.one"), F.lit(0), threshold) & near
    once = F.array_min(F.array_intersect("x.mine", "y.mine")) == F.col("x.token")
    rest = x.join(y, (F.col("x.token") == F.col("y.token")) & may & once).select(F.col("x.p").alias("x"), F.col("y.p").alias("y"))
    more = _verified(released(cut(rest, "line-pairs")), tokens, threshold)
    return cut(found.union(more).distinct(), "line-gone")


def placed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row (all columns), doc_id, t, again and text.

    t tells texts that share an id apart: a hash of the text, 0 where an id has one text only;
    again: whether there are more rows of the id.
    """
    base = whole_row(docs, doc_id=id_col, text=text_col)
    h = F.xxhash64("text")
    ids = base.groupBy("doc_id").agg(F.count("*").alias("n"), F.min(h).alias("a"), F.max(h).alias("b")).where("n > 1")
    ids = cut(ids.select(F.col("doc_id").alias("id"), F.lit(True).alias("again"), (F.col("a") != F.col("b")).alias("many")), "line-shared-ids")
    if not ids.limit(1).count():  # no id is repeated: nothing to look up
        return base.select("row", "doc_id", F.lit(0).cast("long").alias("t"), F.lit(False).alias("again"), "text")
    found = base.join(small(ids), base["doc_id"].eqNullSafe(ids["id"]), "left")
    return found.select("row", "doc_id", F.when(F.col("many"), h).otherwise(0).alias("t"), F.coalesce("again", F.lit(False)).alias("again"), "text")


def _rebuilt(docs: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """row (all columns), doc_id, text as it was, and lines: the text that is left, n_lines and n_removed."""
    base = placed(docs, id_col, text_col)
    texts = base.select("doc_id", "t", "again", "text")
    reps = released(cut(representatives(line_sets(texts, rarity(texts), threshold)), "line-representatives"))
    gone = similar_to_earlier(texts, reps, threshold).select(F.col("x").alias("p"))
    kept = released(listed(reps.select(F.struct(*_POSITION).alias("p")).join(gone, "p", "left_anti").select("p.*"), "kept"))
    joined = _of(base.drop("text"), kept, "left").withColumn("text", F.col("row").getField(text_col))  # a text that is moved is moved once
    blank = r"^[\x20\x09-\x0D]*$"

    def rebuilt(lines: Column) -> Column:
        all_ = F.sequence(F.lit(0), F.size(lines) - 1)
        empty = F.filter(all_, lambda i: F.get(lines, i).rlike(blank))
        stay = F.array_union(F.array_intersect(all_, F.coalesce("kept", F.array().cast("array<int>"))), empty)
        return let(F.sort_array(stay), lambda s: F.struct(F.array_join(F.transform(s, lambda i: F.get(lines, i)), "\n").alias("text"), F.size(lines).alias("n_lines"), (F.size(lines) - F.size(s)).alias("n_removed")))

    return joined.select("row", "doc_id", "text", let(F.split(F.coalesce("text", F.lit("")), "\n"), rebuilt).alias("lines"))


@tidy
def dedup(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with later similar lines removed from the text."""
    text = F.when(F.col("text").isNotNull(), F.col("lines.text"))
    return unpacked(_rebuilt(docs, threshold, id_col, text_col), docs, **{text_col: text})


@tidy
def dedup_counts(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the text that is left, n_lines and n_removed."""
    rows = _rebuilt(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), threshold, "doc_id", "text")
    return rows.select("doc_id", F.when(F.col("text").isNotNull(), F.col("lines.text")).alias("text"), "lines.n_lines", "lines.n_removed")
