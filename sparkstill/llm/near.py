"""Near-duplicate documents by SimHash, and an exact set-similarity join for what it leaves open.

A document is the set of its five-word shingles (of fewer words: the whole of it; words as
in `simhash.fingerprint`). Documents with a Jaccard similarity of THRESHOLD or more are
linked. Equal sets are one class.

Each class has a SimHash fingerprint of its shingles. Fingerprints that differ in few bits are
found by the grid of segment popcounts (`simhash.links`), and candidates are verified by their
Jaccard similarity. At 0.8 fingerprints differ in about 10 of 64 bits, and in up to 20 now and
then, where unlike texts begin: no radius finds all pairs, so that classes which these links do
not connect are compared further, exactly.

Similar sets share a token of their prefixes (rare tokens first,
by counts per hash bucket, a table of fixed size; any order is exact). Each class is
compared with the first of each token's list; only pairs in lists of three or more that
these links do not connect are compared further, a pair once, at its first common token.
Pairs that may match by length and place are held against a bound first: a token that is in
one of two sets only changes one bit of their parities, which have a bit for each token or
more. Every candidate that is left is verified.

Texts without words (a null text too) are one class. Rows have a number of their own, so that null
and repeated ids are rows like others. An empty table gives no rows.
Only the named columns are read; `keep_first` passes all others on, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import cut, small, tidy, unpacked, whole_row
from .components import components

SHINGLE, THRESHOLD, BUCKETS, PARITY, SEED = 5, 0.8, 1 << 17, 8, 42


def tokens(text: str | None, size: int = SHINGLE):
    """The distinct shingles of a text as ascending 64-bit hashes."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    hashes = np.fromiter((xxh64_intdigest(x, SEED) for x in words), np.uint64, len(words))
    size = min(size, len(words))
    out = np.zeros(len(words) - size + 1 if size else 0, np.uint64)
    for k in range(size):
        out = (out ^ hashes[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def _buckets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    import numpy as np

    n, held, many = np.zeros(BUCKETS, np.int64), [], 0
    for batch in batches:
        for text in batch.column("text"):
            held.append((tokens(text.as_py(), size) & np.uint64(BUCKETS - 1)).astype(np.int32))
            many += len(held[-1])
            if many > 1 << 21:
                n += np.bincount(np.concatenate(held), minlength=BUCKETS)
                held, many = [], 0
    if held:
        n += np.bincount(np.concatenate(held), minlength=BUCKETS)
    met = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(n[met])], ["b", "n"])


def rarity(texts: DataFrame, size: int = SHINGLE):
    """How frequent the tokens of each hash bucket are, on a log scale (BUCKETS numbers of 0 to 127)."""
    import numpy as np

    found = texts.select("text").mapInArrow(lambda b: _buckets(b, size), "b int, n long").groupBy("b").agg(F.sum("n").alias("n")).toPandas()  # BUCKETS rows at most
    n = np.zeros(BUCKETS)
    n[found["b"].to_numpy(int)] = found["n"].to_numpy()
    return np.minimum(127, 3 * np.log2(1 + n)).astype(np.uint8)


def _sets(batches: Iterator[pa.RecordBatch], scale, size: int, threshold: float) -> Iterator[pa.RecordBatch]:
    import numpy as np
    from xxhash import xxh64_intdigest

    for batch in batches:
        sets, sizes, prefixes, parities, prints = [], [], [], [], []
        for text in batch.column("text"):
            t = tokens(text.as_py(), size)
            keys = (scale[t & np.uint64(BUCKETS - 1)].astype(np.uint64) << np.uint64(56)) | (t >> np.uint64(8))
            n = len(t) - int(np.ceil(threshold * len(t) - 1e-9)) + 1 if len(t) else 0
            n_bits = max(64 * PARITY, 1 << (len(t) - 1).bit_length() if len(t) else 0)
            odd = np.bincount(((t >> np.uint64(20)) & np.uint64(n_bits - 1)).astype(np.int64), minlength=n_bits) & 1
            sets.append(xxh64_intdigest(t.tobytes(), SEED))
            sizes.append(len(t))
            prefixes.append(np.sort(keys)[:n].view(np.int64))
            parities.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            prints.append(simhash.majority(t))
        columns = [pa.array(np.array(sets, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(parities, pa.list_(pa.int64())), pa.array(prints, pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column("n"), *columns], ["n", "a", "size", "prefix", "parity", "fp"])


def _similar(batches: Iterator[pa.RecordBatch], size: int, threshold: float) -> Iterator[pa.RecordBatch]:
    import numpy as np

    for batch in batches:
        keep = []
        for x, y in zip(batch.column("ta"), batch.column("tb"), strict=True):
            u, v = tokens(x.as_py(), size), tokens(y.as_py(), size)
            common = len(np.intersect1d(u, v, assume_unique=True))
            keep.append(common >= threshold * (len(u) + len(v) - common) - 1e-9)
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


@tidy
def _verified(pairs: DataFrame, texts: DataFrame, classes: DataFrame, size: int, threshold: float) -> DataFrame:
    """The pairs a, b of classes whose Jaccard similarity is at least the threshold: texts travel, which take less room than their tokens."""
    pairs = cut(pairs.distinct(), "near-pairs")
    nodes = pairs.select("a").union(pairs.select("b")).distinct()
    wanted = small(cut(classes.join(nodes, "a", "left_semi").select("a", "n"), "near-wanted"))
    found = cut(texts.join(wanted, "n").select("a", "text"), "near-texts")
    both = pairs.join(found.withColumnRenamed("text", "ta"), "a").join(found.select(F.col("a").alias("b"), F.col("text").alias("tb")), "b")
    return cut(both.select("a", "b", "ta", "tb").mapInArrow(lambda x: _similar(x, size, threshold), "a long, b long"), "near-links")


def _may_match(x: Column, y: Column, before: Column, threshold: float) -> Column:
    """Length and positional filter for two sets that share a token (x and y: size << 32 | place of the token), with at most `before` common tokens before it."""
    size, place = (lambda v: F.shiftright(v, 32)), (lambda v: v.bitwiseAND((1 << 32) - 1))
    a, b, i, j = size(x), size(y), place(x), place(y)
    overlap = F.ceil(threshold / (1 + threshold) * (a + b) - 1e-9)
    return (F.least(a, b) >= threshold * F.greatest(a, b) - 1e-9) & (before + 1 + F.least(a - i - 1, b - j - 1) >= overlap)


def _differ(x: str, y: str) -> Column:
    """In how many bits the parities of two sets differ; the longer one, of twice as many bits, is folded."""
    n = F.least(F.size(x), F.size(y))
    fold = lambda v: F.when(F.size(v) > n, F.zip_with(F.slice(v, F.lit(1), n), F.slice(v, n + 1, n), lambda a, b: a.bitwiseXOR(b))).otherwise(F.col(v))
    return F.aggregate(F.zip_with(fold(x), fold(y), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda acc, k: acc + k)


def _most(x: Column, y: Column, threshold: float) -> Column:
    """The most tokens that are in one only of two similar sets."""
    return (1 - threshold) / (1 + threshold) * (F.shiftright(x, 32) + F.shiftright(y, 32)) + 1e-9


@tidy
def shared_postings(classes: DataFrame) -> DataFrame:
    """token, a, at (size << 32 | place), first (a and at of the token's first class) and n (classes of the token), for tokens of two classes or more.

    Tokens are counted first, with partial sums; only the postings of shared ones are looked at again.
    """
    one = F.col("size").cast("long") * F.lit(1 << 32)
    postings = classes.select("a", one.alias("one"), F.posexplode("prefix").alias("i", "token")).select("token", "a", (F.col("one") + F.col("i")).alias("at"))
    shared = cut(postings.groupBy("token").agg(F.count("*").alias("n")).where("n > 1"), "near-shared")
    listed = cut(postings.join(small(shared), "token"), "near-listed")
    first = listed.groupBy("token").agg(F.min(F.struct("a", "at")).alias("first"))
    return cut(listed.join(first, "token").where(F.col("a") != F.col("first.a")), "near-postings")


def apart(pairs: DataFrame, root: DataFrame) -> DataFrame:
    """The pairs a, b whose ends are not in one component of root (node, root)."""
    ends = [root.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in ("a", "b")]
    return pairs.join(ends[0], "a", "left").join(ends[1], "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select(*(F.col(c) for c in pairs.columns))


@tidy
def simhash_links(texts: DataFrame, classes: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs a, b of similar classes that SimHash finds: of equal fingerprints each class with the first one, of fingerprints that differ in few bits the first ones."""
    prints = cut(classes.groupBy("fp").agg(F.min("a").alias("first"), F.count("*").alias("n")), "near-prints")
    same = classes.select("a", "fp").join(prints.where("n > 1"), "fp").where("a <> first").select("a", F.col("first").alias("b"))
    ends = [prints.select(F.col("fp").alias(c), F.col("first").alias(f"f{c}")) for c in ("a", "b")]
    close = cut(simhash.links(prints.select("fp")), "near-close").join(ends[0], "a").join(ends[1], "b").select(F.col("fa").alias("a"), F.col("fb").alias("b"))
    return _verified(same.union(close), texts, classes, size, threshold)


@tidy
def links(texts: DataFrame, classes: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs a, b of similar classes that connect all that are connected, out of texts (n, text) and classes (a, n, size, prefix, parity, fp)."""
    hashed = simhash_links(texts, classes, size, threshold)
    shared = shared_postings(classes)
    place = lambda v: v.bitwiseAND((1 << 32) - 1)
    before = F.least(place(F.col("at")), place(F.col("first.at")))
    may = shared.where(_may_match(F.col("at"), F.col("first.at"), before, threshold))
    star = may.groupBy("a", F.col("first.a").alias("b")).agg(F.max(_most(F.col("at"), F.col("first.at"), threshold)).alias("most"))
    parity = classes.select("a", "parity")
    star = apart(star, components(hashed, "near-simhash"))
    star = star.join(parity, "a").join(parity.select(F.col("a").alias("b"), F.col("parity").alias("other")), "b")
    found = cut(hashed.union(_verified(star.where(_differ("parity", "other") <= F.col("most")).select("a", "b"), texts, classes, size, threshold)), "near-first")
    root = components(found, "near-star")
    # classes that are not connected yet, against the others of their lists; both sides have the same columns, so that they share a shuffle
    # (two that are not the first of a list meet in lists of three or more only)
    more = shared.where("n > 2")
    lists = more.groupBy("a").agg(F.sort_array(F.collect_list("token")).alias("mine"))
    others = more.select("token", "a", "at").join(parity, "a").join(lists, "a")
    others = cut(others.join(root.withColumnRenamed("node", "a"), "a", "left").select("token", "a", "at", "parity", "mine", F.coalesce("root", "a").alias("root")), "near-others")
    x, y = others.alias("x"), others.alias("y")
    near = _may_match(F.col("x.at"), F.col("y.at"), F.lit(0), threshold) & (_differ("x.parity", "y.parity") <= _most(F.col("x.at"), F.col("y.at"), threshold))
    once = F.array_min(F.array_intersect("x.mine", "y.mine")) == F.col("x.token")
    rest = x.join(y.hint("merge"), (F.col("x.token") == F.col("y.token")) & (F.col("x.a") < F.col("y.a")) & (F.col("x.root") != F.col("y.root")) & near & once)
    pair = [F.col("x.a").alias("a"), F.col("y.a").alias("b"), F.least("x.root", "y.root").alias("u"), F.greatest("x.root", "y.root").alias("v")]
    open_ = cut(rest.select(*pair, _differ("x.parity", "y.parity").alias("d")), "near-open")
    # of the pairs between two groups the one with the least difference first; then those that are not connected by what this found
    best = cut(open_.groupBy("u", "v").agg(F.min_by(F.struct("a", "b"), F.struct("d", "a", "b")).alias("p")).select("p.*"), "near-best")
    more = _verified(best, texts, classes, size, threshold)
    left = apart(open_.join(best, ["a", "b"], "left_anti"), components(found.union(more), "near-more"))
    last = _verified(left.select("a", "b"), texts, classes, size, threshold)
    return cut(found.union(more).union(last), "near-all-links")


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row (all columns), doc_id, text and n, a number of the row's own, as a written table."""
    return cut(whole_row(docs, doc_id=id_col, text=text_col).withColumn("n", F.monotonically_increasing_id()), "near-rows")


@tidy
def roots(texts: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """n and root (the same for all rows that links connect) of texts (n, text)."""
    scale = texts.sparkSession.sparkContext.broadcast(rarity(texts, size))
    rows = cut(texts.mapInArrow(lambda b: _sets(b, scale.value, size, threshold), "n long, a long, size int, prefix array<long>, parity array<long>, fp long"), "near-sets")
    classes = cut(rows.groupBy("a").agg(F.min("n").alias("n"), *(F.first(c).alias(c) for c in ("size", "prefix", "parity", "fp"))), "near-classes")
    root = components(links(texts, classes, size, threshold), "near-components")
    return cut(rows.select("n", "a").join(root.withColumnRenamed("node", "a"), "a", "left").select("n", F.coalesce("root", "a").alias("root")), "near-roots")


@tidy
def near_duplicates(docs: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and root (the same for all rows that links connect) of every document."""
    rows = _numbered(docs.select(id_col, text_col), id_col, text_col)
    return rows.select("n", "doc_id").join(roots(rows.select("n", "text"), size, threshold), "n").select("doc_id", "root")


@tidy
def keep_first(docs: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group that links connect, with its own columns.

    It is the one with the smallest id; a null id comes after all others, and of rows with
    one id the first in the order of reading stays. Texts without words are one group.
    """
    rows = _numbered(docs, id_col, text_col)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "n")
    placed = cut(roots(rows.select("n", "text"), size, threshold).join(rows.select("n", "doc_id"), "n").select("n", "root", order.alias("order")), "near-order")
    first = placed.groupBy("root").agg(F.min_by("n", "order").alias("first"), F.count("*").alias("members")).where("members > 1")
    gone = placed.join(first, "root").where("n <> first").select("n")
    return unpacked(rows.join(small(cut(gone, "near-gone")), "n", "left_anti"), docs)
