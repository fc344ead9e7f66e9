"""Exact Jaccard join of word n-gram sets by parity sketches.

A document is the set of its distinct four-word shingles. Each token of a set turns over one
bit of a sketch, so that two sketches differ in at most as many bits as there are tokens in
one set only. Sets of sizes a and b with a Jaccard similarity of 0.85 or more have at most
15 (a + b) / 185 such tokens.

Sizes are cut into bands, as wide as the threshold lets similar sizes differ: similar sets are
in one band or in two that follow each other. For a band with at most D differing bits its
sketches have S > D segments, so that similar sets have S - D equal segments. Equal segments are found
by a join over their values. An empty segment says nothing and is left out; this loses no
pair as long as one of the two sets has more than D segments that are not empty. A set that has
fewer deals its tokens to segments once more, by another hash, until it has; a pair meets under
the first hash that serves either of them.

Sets of equal tokens are one class. In the list of a segment's value every class is
compared with the first and the last one, in two orders; then classes that the links found do
not connect are compared among themselves. Similar sets have at least as many equal segments as either
of them has segments over D, so that a set shares more than it has to spare: one that shares fewer, as those
that have a passage in common do, is left out before its segments move, and again among the lists of classes that are
not connected, in all of them and in those that join many such classes. Pairs are held against whole sketches first, then verified from
their texts, so that each link is exact.

Tokens and classes are known by 64-bit hashes. Nulls: a null text, or one without words, is an empty set, which is linked
with nothing; a null id is never the smallest, and a component of null ids only has none.
Repeated rows are rows of one class. An empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small, tidy
from .components import components
from .near import tokens

SHINGLE, SEED = 4, 42
#: The least similarity, in hundredths: 100 * common >= SIMILAR * all.
SIMILAR = 85
#: Bits of a segment, as a power of two, unconnected classes beyond which a list is one that many share, and bits of the largest table of shared values.
SEGMENT, LONG, TABLE = 10, 8, 1 << 28
#: Words of a short sketch, which is held against others inside the join.
SHORT = 8


@functools.lru_cache(maxsize=None)
def bands(most: int, similar: int = SIMILAR) -> list[tuple[int, int]]:
    """The least and greatest sizes of the bands, up to `most` tokens at least: a set's similar sets are at most as large as the next band's greatest."""
    out = [(1, 100 // similar)]
    while out[-1][1] < most:
        low = out[-1][1] + 1
        out.append((low, 100 * low // similar))
    return out


def differing(a: int, b: int, similar: int = SIMILAR) -> int:
    """The most tokens that are in one only of two similar sets of these sizes."""
    return (100 - similar) * (a + b) // (100 + similar)


def segments(band: tuple[int, int], similar: int = SIMILAR) -> tuple[int, int]:
    """Segments of a band's sketches, and the most bits in which similar sets' sketches differ (the smaller set is in the band)."""
    d = differing(band[1], 100 * band[1] // similar, similar)
    return d + 2 + d // 4, d


def mixed(x):
    """64-bit numbers with their bits mixed."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def parts(t, n_segments: int, turn: int):
    """Which segments of a sketch are not empty, and their values, under one way to deal tokens.

    A segment has 2 ** SEGMENT bits; its value is the sum (exclusive or) of a number for each bit that is set,
    so that tokens that turn over one bit twice leave no trace.
    """
    import numpy as np

    h = t if not turn else np.sort(mixed(t ^ mixed(np.uint64([turn]))))
    segment = ((h >> np.uint64(32)) * np.uint64(n_segments)) >> np.uint64(32)
    bit = (segment << np.uint64(SEGMENT)) | (h & np.uint64((1 << SEGMENT) - 1))
    starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
    values = np.bitwise_xor.reduceat(mixed(bit + np.uint64(1)), starts)
    full = values != 0
    return segment[starts][full], values[full]


def signatures(t, similar: int = SIMILAR) -> list[tuple]:
    """What a set is filed under: for its own band and, as the larger of a pair, for the band before, under each hash that is needed: (band and hash, segments to spare, values).

    Sets that are similar share more values than either of them has to spare under the first hash that
    leaves one of them something to spare; -1 under hashes that do not.
    """
    import numpy as np

    every = bands(1 << max(1, len(t)).bit_length(), similar)
    own = next(k for k, (low, high) in enumerate(every) if low <= len(t) <= high) if len(t) else 0
    out = []
    for k in (own, own - 1):
        if k < 0 or not len(t) or not (shape := segments(every[k], similar))[1]:
            continue  # sets of one size that may differ in no token are equal, and one class
        turn = 0
        while True:
            at, values = parts(t, shape[0], turn)
            spare = max(-1, len(at) - shape[1] - 1)
            out.append(((k << 16) | turn, spare, mixed(values ^ mixed(at | np.uint64((k << 48) | (turn << 32))))))
            if spare >= 0:
                break
            turn += 1
    return out


def sketch(t) -> bytes:
    """A whole sketch: a power of two of bits, two for each token or more."""
    import numpy as np

    n_bits = max(64, 1 << (2 * len(t) - 1).bit_length())
    at = ((t >> np.uint64(11)) & np.uint64(n_bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=n_bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def short(t) -> list[int]:
    """A sketch of SHORT words of 64 bits, whatever the size of the set."""
    import numpy as np

    odd = np.bincount(((t >> np.uint64(37)) & np.uint64(64 * SHORT - 1)).astype(np.int64), minlength=64 * SHORT) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).tolist()


def apart(x: bytes, y: bytes) -> int:
    """In how many bits two sketches differ; the longer one is folded."""
    import numpy as np

    a, b = (np.frombuffer(v, np.uint8) for v in (x, y))
    while len(a) != len(b):
        a, b = (a, b) if len(a) > len(b) else (b, a)
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _class(t) -> int:
    from xxhash import xxh64_intdigest

    x = xxh64_intdigest(t.tobytes(), SEED)
    return x - (1 << 64) if x >> 63 else x


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for text in batch.column("text"):
            t = tokens(text.as_py(), size)
            found.append((_class(t), len(t), sketch(t) if len(t) else None, short(t) if len(t) else None))
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
        columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), *columns], ["doc_id", "t", "a", "n", "sketch", "short"])


def _filed(batches: Iterator[pa.RecordBatch], size: int, similar: int, table=None, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """value and a of each signature; a class that this task has just filed is not filed again.

    With a table of bits that shared values set, those values only, with their band and hash (`part`) and the segments that a has to spare there,
    and none of a band and hash in which a shares no more than that.
    """
    import numpy as np

    seen: set = set()

    def batch_of(held: list) -> pa.RecordBatch:
        sizes = np.array([len(v) for _, _, _, v in held])
        values = np.concatenate([v for _, _, _, v in held])
        columns = [np.repeat(np.array([h[c] for h in held], kind), sizes) for c, kind in ((0, np.int64), (1, np.int32), (2, np.int32))[: 1 if table is None else 3]]
        columns = [values.view(np.int64), *columns]
        if table is not None:
            at = values & np.uint64(64 * len(table) - 1)
            met = (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0
            n_met = np.bincount(np.repeat(np.arange(len(held)), sizes), met, len(held))
            met &= np.repeat(n_met > np.array([h[2] for h in held]), sizes)
            columns = [c[met] for c in columns]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["value", "a", "part", "spare"][: len(columns)])

    for batch in batches:
        held: list = []
        for text in batch.column("text"):
            t = tokens(text.as_py(), size)
            if not len(t) or (a := _class(t)) in seen:
                continue
            if len(seen) >= most:
                seen.clear()
            seen.add(a)
            held += [(a, *s) for s in signatures(t, similar)]
            if len(held) >= 512:
                yield batch_of(held)
                held = []
        if held:
            yield batch_of(held)


def _close(batches: Iterator[pa.RecordBatch], similar: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose sizes and sketches allow the similarity."""
    for batch in batches:
        keep = []
        for m, n, x, y in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "sa", "sb")), strict=True):
            keep.append(100 * min(m, n) >= similar * max(m, n) and apart(x, y) <= differing(m, n, similar))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _similar(batches: Iterator[pa.RecordBatch], size: int, similar: int) -> Iterator[pa.RecordBatch]:
    """Pairs of the similarity, by their texts. A first class, which many pairs share, is made tokens of once."""
    import numpy as np

    known: dict = {}

    def tokens_of(a: int, text) -> object:
        if a not in known:
            if len(known) >= 64:
                known.clear()
            known[a] = tokens(text.as_py(), size)
        return known[a]

    for batch in batches:
        keep = []
        for a, b, x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("ta"), batch.column("tb"), strict=True):
            u, v = tokens_of(a, x), tokens_of(b, y)
            common = len(np.intersect1d(u, v, assume_unique=True))
            keep.append(100 * common >= similar * (len(u) + len(v) - common))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _short(classes: DataFrame) -> DataFrame:
    """a, n and the words k0, k1, ... of the short sketch."""
    return classes.select("a", "n", *(F.col("short")[k].alias(f"k{k}") for k in range(SHORT)))


def _may(similar: int):
    """Whether sizes and short sketches of x and y allow the similarity."""
    m, n = F.col("x.n"), F.col("y.n")
    differ = functools.reduce(lambda p, q: p + q, (F.bit_count(F.col(f"x.k{k}").bitwiseXOR(F.col(f"y.k{k}"))) for k in range(SHORT)))
    return (100 * F.least(m, n) >= similar * F.greatest(m, n)) & ((100 + similar) * differ <= (100 - similar) * (m + n))


@tidy
def _linked(pairs: DataFrame, docs: DataFrame, classes: DataFrame, size: int, similar: int) -> DataFrame:
    """The pairs a, b of classes that are similar: sizes and short sketches first, then whole sketches, then texts."""
    x, y = _short(classes).alias("x"), _short(classes).alias("y")
    first = pairs.alias("p").join(x, F.col("p.a") == F.col("x.a"))
    may = cut(first.join(y, (F.col("p.b") == F.col("y.a")) & _may(similar)).select("p.a", "p.b", F.col("x.n").alias("na"), F.col("y.n").alias("nb")), "ngrams-may")
    sketched = may.join(classes.select("a", F.col("sketch").alias("sa")), "a").join(classes.select(F.col("a").alias("b"), F.col("sketch").alias("sb")), "b")
    close = cut(sketched.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(lambda b: _close(b, similar), "a long, b long"), "ngrams-close")
    nodes = close.select("a").union(close.select(F.col("b").alias("a"))).distinct()
    wanted = small(cut(classes.join(nodes, "a", "left_semi").select("a", "t"), "ngrams-wanted"), 16 << 20)
    # one text of each class: rows of one text, however many, are put together before they move
    texts = cut(docs.join(wanted, "t").groupBy("a").agg(F.first("text").alias("text")), "ngrams-texts")
    both = close.join(texts.withColumnRenamed("text", "ta"), "a").join(texts.select(F.col("a").alias("b"), F.col("text").alias("tb")), "b")
    return cut(both.select("a", "b", "ta", "tb").mapInArrow(lambda x: _similar(x, size, similar), "a long, b long"), "ngrams-links")


def _table(shared: DataFrame):
    """A table of bits, of a size of TABLE at most, with those set that shared values name: it lets few other values pass, and none less."""
    import numpy as np

    n_bits = min(TABLE, max(1 << 16, 1 << (8 * shared.count()).bit_length()))
    at = F.col("value").bitwiseAND(n_bits - 1)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int"))
    words = shared.select(F.shiftright(at, 6).alias("k"), bit.alias("b")).groupBy("k").agg(F.bit_or("b").alias("b")).toPandas()  # TABLE / 64 rows at most
    table = np.zeros(n_bits // 64, np.uint64)
    table[words["k"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64).view(np.uint64)
    return table


def _open(listed: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """The rows of lists that hold classes which the links do not connect: value, a, part, spare, root, and `long` where these are more than LONG."""
    root = components(found, f"{name}-found").withColumnRenamed("node", "a")
    named = listed.join(root, "a", "left").select("value", "a", "part", "spare", F.coalesce("root", "a").alias("root"))
    lists = named.select("value", "root").distinct().groupBy("value").agg(F.count("*").alias("many")).where("many > 1")
    return cut(named.join(lists, "value").select(*named.columns, (F.col("many") > LONG).alias("long")), f"{name}-open")


def _pairs(rows: DataFrame, name: str, *seen: DataFrame) -> DataFrame:
    """Pairs a < b out of rows of x and y, each once, without those that were seen before."""
    pairs = rows.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    for before in seen:
        pairs = pairs.join(before, ["a", "b"], "left_anti")
    return cut(pairs, name)


@tidy
def links(docs: DataFrame, classes: DataFrame, size: int = SHINGLE, similar: int = SIMILAR) -> DataFrame:
    """Pairs a, b of similar classes that connect all that are connected, out of docs (t, text) and classes (a, n, t, sketch)."""
    filed = docs.select("text").mapInArrow(lambda b: _filed(b, size, similar), "value long, a long")
    shared = cut(filed.groupBy("value").agg(F.min("a").alias("first"), F.max("a").alias("last")).where("first <> last"), "ngrams-shared")
    bits = docs.sparkSession.sparkContext.broadcast(_table(shared))
    again = docs.select("text").mapInArrow(lambda b: _filed(b, size, similar, bits.value), "value long, a long, part int, spare int")
    listed = cut(again.join(shared, "value").select("value", "a", "part", "spare", "first", "last").distinct(), "ngrams-listed")
    star = _pairs(listed.select(F.col("a").alias("x"), F.explode(F.array("first", "last")).alias("y")), "ngrams-star")
    found = _linked(star, docs, classes, size, similar)
    # classes of one list that are not connected yet, with the first and last ones in another order
    open_ = _open(listed, found, "ngrams-once")
    turn = F.xxhash64("a", F.lit(1))
    ends = open_.groupBy("value").agg(F.min_by("a", turn).alias("p"), F.max_by("a", turn).alias("q"))
    other = _pairs(open_.join(ends, "value").select(F.col("a").alias("x"), F.explode(F.array("p", "q")).alias("y")), "ngrams-other", star)
    found = cut(found.union(_linked(other, docs, classes, size, similar)), "ngrams-both")
    # those that are left, among themselves
    open_ = _open(listed, found, "ngrams-twice")
    counts = open_.groupBy("a", "part").agg(F.count("*").alias("n"), F.sum(F.col("long").cast("int")).alias("n_long"), F.max("spare").alias("spare"))
    enough = counts.where("n > spare").select("a", "part", F.expr("n_long > spare").alias("heavy"))
    left = open_.join(enough, ["a", "part"]).where("not long or heavy").select("value", "a", "root").distinct()
    left = cut(left.join(_short(classes), "a"), "ngrams-left")
    # sizes and short sketches are held against each other inside the join, so that only pairs that may be similar leave it
    x, y = left.alias("x"), left.alias("y")
    rest = x.join(y, (F.col("x.value") == F.col("y.value")) & (F.col("x.a") < F.col("y.a")) & (F.col("x.root") != F.col("y.root")) & _may(similar))
    more = _pairs(rest.select(F.col("x.a").alias("x"), F.col("y.a").alias("y")), "ngrams-pairs", star, other)
    return cut(found.union(_linked(more, docs, classes, size, similar)), "ngrams-all-links")


def joined(rows: DataFrame, table: DataFrame, key: str, many: str) -> DataFrame:
    """rows with the columns of a table of one row a key, which says how many rows the key has.

    Keys of many rows are few, as many as there are shuffle partitions at most, and are sent to
    all tasks; the rows of the others are joined by a shuffle.
    """
    parts_ = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = table.agg(F.sum(many)).first()[0] or 0
    hot = table.where(F.col(many) > max(1000, total // parts_))
    more = [c for c in table.columns if c not in (key, many)]
    first = rows.join(F.broadcast(hot.select(key, F.lit(True).alias("_hot"), *more)), key, "left")
    rest = first.where("_hot is null").drop("_hot", *more).join(table.drop(many), key)
    return first.where("_hot").drop("_hot").unionByName(rest)


@tidy
def near_duplicates(docs: DataFrame, size: int = SHINGLE, similar: int = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id reachable over links) of every document."""
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).withColumn("t", F.xxhash64("text"))
    rows = cut(base.mapInArrow(lambda b: _sets(b, size), "doc_id long, t long, a long, n long, sketch binary, short array<long>"), "ngrams-sets")
    filled = rows.where("n > 0")
    classes = cut(filled.groupBy("a").agg(F.min("doc_id").alias("least"), F.count("*").alias("many"), F.min("t").alias("t"), *(F.first(c).alias(c) for c in ("n", "sketch", "short"))), "ngrams-classes")
    root = components(links(base.select("t", "text"), classes, size, similar), "ngrams-components")
    rooted = cut(classes.join(root.withColumnRenamed("node", "a"), "a", "left").select("a", "many", "least", F.coalesce("root", "a").alias("root")), "ngrams-rooted")
    sizes = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    named = cut(joined(rooted.select("root", "a", F.col("many").alias("rows")), sizes, "root", "members").select("a", F.col("rows").alias("many"), "component_id"), "ngrams-named")
    own = joined(filled.select("doc_id", F.col("n").alias("n_shingles"), "a"), named, "a", "many")
    alone = rows.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return own.select("doc_id", "n_shingles", "component_id").union(alone)
