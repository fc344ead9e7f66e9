"""Merkle manifest of a table: a radix-ranked trie over its rows, per source.

A leaf is the hash of a row's fields. The rank of a leaf in its source comes from histograms
of the digits of its id, from the highest digit down: what stands before an id is what is
counted for smaller digits under the same higher ones. No table is sorted as a whole, and a
window holds the digits below one prefix, BASE at most. The digits of a rank in the base of the
fan-out are the path through the trie: leaves that share all but their LEVELS last digits meet
in one group, which reduces them level by level, longest prefix first, to one node of the
next pass. The nodes of one pass are at most a 3 ** LEVELS-th of those before. The sources'
own roots are the leaves of one more trie.

Nulls: a null field is `-`; a null id stands before all others of its source, and a null source
before all other sources; a row without an id is never tampered with. Rows that repeat an id in
a source stand by their leaf's hash; rows that are alike in all fields have leaves of their own.
Texts are hashed whole, an empty text as one of no bytes. Only the named columns are read. An
empty table gives no rows and has no root.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small, tidy

FAN, LEVELS, DIGIT = 3, 6, 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """A field's part of what is hashed: its size in bytes, a colon and the value, or a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def tampered(doc_id: Column) -> Column:
    """Whether a row's text loses its line ends in the test of the proofs."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.lit(False))


def _same(a: str, b: str, names: list[str]) -> Column:
    return functools.reduce(lambda x, y: x & y, (F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in names))


def _joined(a: DataFrame, b: DataFrame, names: list[str]) -> DataFrame:
    """a with the other columns of b, where the named ones are equal or both null."""
    more = [F.col(f"b.{c}") for c in b.columns if c not in names]
    return a.alias("a").join(b.alias("b"), _same("a", "b", names)).select("a.*", *more)


def radix_ranks(rows: DataFrame, by: list[str], key: str, rank: str, same: str) -> DataFrame:
    """rows with two columns: how many rows of the same `by` have a smaller key, and how many an equal one (itself included).

    Keys are longs; a null is smaller than all others.
    """
    ends = rows.agg(F.min(key), F.max(key)).first()
    low, high = ends[0] or 0, ends[1] or 0
    sign = low < 0 <= high or high - low >= 1 << 62
    bits = 64 if sign else max(1, (high - low).bit_length())
    number = F.col(key).bitwiseXOR(-(1 << 63)) if sign else F.col(key) - low
    levels = -(-bits // DIGIT)
    counts = [cut(rows.groupBy(*by, F.col(key).alias("_key"), number.alias("_p")).agg(F.count("*").alias("_n")), "merkle-keys")]
    for _ in range(levels):  # up to one row for each `by`, or two if there are null keys
        counts.append(counts[-1].groupBy(*by, F.shiftrightunsigned("_p", DIGIT).alias("_p")).agg(F.sum("_n").alias("_n")))
    counts[1:] = [cut(c, "merkle-digits") for c in counts[1:]]
    before = lambda *parent: Window.partitionBy(*by, *parent).orderBy(F.col("_p").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    first = lambda *parent: F.coalesce(F.sum("_n").over(before(*parent)), F.lit(0))
    ranks = counts[-1].select(*by, F.col("_p").alias("_up"), first().alias("_base"))
    for c in counts[-2::-1]:  # from the highest digit down
        placed = c.withColumn("_up", F.shiftrightunsigned("_p", DIGIT)).withColumn("_in", first("_up"))
        ranks = _joined(placed, ranks, [*by, "_up"]).withColumn("_base", F.col("_base") + F.col("_in")).drop("_up", "_in")
        if c is not counts[0]:
            ranks = ranks.drop("_n").withColumnRenamed("_p", "_up")
    found = ranks.select(*by, F.col("_key").alias(key), F.col("_base").alias(rank), F.col("_n").alias(same))
    return _joined(rows, found, [*by, key])


@tidy
def ranked(rows: DataFrame) -> DataFrame:
    """rows (source, doc_id, leaf, ...) with `k`, from 0 in each source by id, and `n`, the rows of the source."""
    base = cut(radix_ranks(rows.withColumn("_row", F.monotonically_increasing_id()), ["source"], "doc_id", "k", "_same"), "merkle-ranks")
    out, many = base, ["source", "doc_id"]
    hashed = F.conv(F.substring("leaf", 1, 15), 16, 10).cast("long")
    for key, value in (("_hash", hashed), ("_row", F.col("_row"))):
        again = out.where("_same > 1")
        if not again.limit(1).count():
            break
        again = radix_ranks(again.drop("_same").withColumn(key, value), many, key, "_more", "_same").withColumn("k", F.col("k") + F.col("_more"))
        names = [c for c in base.columns if c != "_same"]
        out = cut(out.where("_same = 1").select(*names, "_same", *([F.lit(None).cast("long").alias("_hash")] if "_hash" in out.columns else [])).unionByName(again.drop("_more"), allowMissingColumns=True), "merkle-again")
        many = [*many, "_hash"]
    sizes = small(cut(rows.groupBy("source").agg(F.count("*").alias("n")), "merkle-sizes"))
    return cut(_joined(out.select(*rows.columns, "k"), sizes, ["source"]), "merkle-leaves")


def _depth(n: Column) -> Column:
    """Levels of a trie over n leaves."""
    return F.size(F.filter(F.array(*(F.lit(FAN**k) for k in range(40))), lambda p: p < n))


def _up(nodes: Column) -> Column:
    """The nodes of the next level: each is the hash of three, or what is left, of this one."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / F.lit(FAN)).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, i * FAN + 1, FAN), "").cast("binary"), 256))


def _steps(rows: DataFrame, place: Column) -> Column:
    """The siblings left and right of a place, level by level, in its group."""
    steps = []
    for j in range(LEVELS):
        at = F.floor(place / F.lit(FAN**j)).cast("int")
        run = (at - at % FAN).cast("int")
        nodes = F.col(f"l{j}")
        left = F.array_join(F.slice(nodes, run + 1, at % FAN), "")
        right = F.array_join(F.slice(nodes, at + 2, F.lit(FAN - 1) - at % FAN), "")
        steps.append(F.struct(left.alias("l"), right.alias("r")))
    return F.slice(F.array(*steps), F.lit(1), F.least(F.col("depth"), F.lit(LEVELS)))


def proofs(nodes: DataFrame, name: str) -> DataFrame:
    """nodes (g, k, n, h and others) with `path` (siblings l and r of each level, from the leaf on) and `top`, the root of each g.

    k counts from 0 to n - 1 in each g; g may be null.
    """
    others = [c for c in nodes.columns if c not in ("g", "k", "n", "depth")]
    leveled = nodes if "depth" in nodes.columns else nodes.withColumn("depth", _depth(F.col("n")))
    size = FAN**LEVELS
    block = F.floor(F.col("k") / F.lit(size)).cast("long").alias("block")
    groups = leveled.groupBy("g", block, "depth").agg(F.sort_array(F.collect_list(F.struct("k", *others))).alias("own"))
    groups = groups.withColumn("l0", F.transform("own", lambda x: x["h"]))
    for j in range(1, LEVELS + 1):
        groups = groups.withColumn(f"l{j}", F.when(F.col("depth") >= j, _up(F.col(f"l{j - 1}"))).otherwise(F.col(f"l{j - 1}")))
    groups = cut(groups, name)
    tops = groups.select("g", F.col("block").alias("k"), (F.col("depth") - LEVELS).alias("depth"), F.col(f"l{LEVELS}")[0].alias("h"))
    none = F.array().cast("array<struct<l:string,r:string>>")
    higher = tops.where("depth > 0")
    if higher.limit(1).count():
        above = proofs(higher, f"{name}-up").select("g", F.col("k").alias("block"), F.col("path").alias("above"), F.col("top").alias("head"))
        held = groups.alias("a").join(above.alias("b"), _same("a", "b", ["g", "block"]), "left").select("a.*", "above", "head")
    else:
        held = groups.withColumn("above", none).withColumn("head", F.lit(None).cast("string"))
    each = held.select("g", "depth", *(f"l{j}" for j in range(LEVELS)), F.coalesce("above", none).alias("above"), F.coalesce("head", F.col(f"l{LEVELS}")[0]).alias("top"), F.explode("own").alias("x"))
    path = F.concat(_steps(each, (F.col("x.k") % size).cast("int")), F.col("above"))
    return each.select("g", "x.*", path.alias("path"), "top")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda h, s: F.sha2(F.concat(s["l"], h, s["r"]).cast("binary"), 256))


def _by_source(roots: DataFrame) -> DataFrame:
    """g (all one), k, n, source and h of the sources' roots in the order of their names' bytes, null first.

    A row a source: ranges of names are numbered inside, and the rows of the ranges before are added.
    """
    key = F.col("source").asc_nulls_first()
    parts = int(roots.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = cut(roots.repartitionByRange(parts, key).sortWithinPartitions(key).select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("id")), "merkle-sources")
    sizes = ranges.groupBy("part").agg(F.count("*").alias("many"), F.min("id").alias("first"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    sizes = sizes.select("part", "first", F.coalesce(F.sum("many").over(before), F.lit(0)).alias("base"))
    return ranges.join(F.broadcast(sizes), "part").select(F.lit(0).alias("g"), (F.col("base") + F.col("id") - F.col("first")).alias("k"), F.lit(ranges.count()).alias("n"), "source", "h")


@tidy
def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """doc_id, source, leaf, changed (the leaf of the tampered row), subroot, root and path (siblings to the root) of every row.

    fields: the columns of the id, the source, two others and the text, in this order.
    """
    doc_id, source, lang, n_chars, text = (F.col(f"`{c}`") for c in fields)
    flat = F.when(tampered(doc_id), F.translate(text, "\n", "")).otherwise(text)
    rows = docs.select(doc_id.cast("long").alias("doc_id"), source.cast("string").alias("source"), leaf(doc_id, source, lang, n_chars, text).alias("leaf"), F.when(tampered(doc_id) & text.contains("\n"), leaf(doc_id, source, lang, n_chars, flat)).alias("changed"))
    leaves = ranked(cut(rows, "merkle-rows"))
    own = cut(proofs(leaves.select(F.col("source").alias("g"), "k", "n", F.col("leaf").alias("h"), "doc_id", "changed"), "merkle-trie"), "merkle-proofs")
    roots = own.groupBy(F.col("g").alias("source")).agg(F.first("top").alias("h"))
    heads = cut(proofs(_by_source(roots), "merkle-top").select("source", F.col("path").alias("above"), F.col("top").alias("root")), "merkle-heads")
    both = own.select("doc_id", F.col("g").alias("source"), F.col("h").alias("leaf"), F.coalesce("changed", "h").alias("changed"), F.col("top").alias("subroot"), "path")
    joined = both.alias("a").join(small(heads, 4 << 20).alias("b"), _same("a", "b", ["source"])).select("a.*", "above", "root")
    return joined.select("doc_id", "source", "leaf", "changed", "subroot", "root", F.concat("path", "above").alias("path"))


def verify(found: DataFrame) -> DataFrame:
    """What op13 returns, out of `manifest`: proofs as hashes, and the root that each tampered (or else original) leaf gives."""
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["l"], s["r"])), "")
    rows = found.withColumn("proof_sha256", F.sha2(siblings.cast("binary"), 256)).withColumn("folded_root", folded(F.col("changed"), F.col("path")))
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
