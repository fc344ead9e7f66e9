"""Document fingerprints by winnowing.

Every k-gram of code points has a rolling hash; in each window of w hashes the smallest
is chosen, of equal ones the rightmost, and each chosen hash is kept once with its
position. Two texts that share a run of w + k - 1 code points share a chosen hash. A text
with fewer than k code points has the hash of the whole, one with fewer than w hashes
their minimum. A fingerprint is a string: positions and hashes in text order.

The likeness of two fingerprints is the Jaccard similarity of their hash sets (1 for two
empty ones).

Nulls are empty texts; an empty text has an empty fingerprint; equal texts have equal
fingerprints; a single document is its own next one; null ids come last in descending
order. Only the named columns are read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Texts that share a run of GRAM + WINDOW - 1 = 35 code points share a chosen hash; a hash in 12 or 13 code points is chosen.
GRAM, WINDOW = 12, 24
_BASE, _MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9
TYPE = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def gram_hashes(points, gram: int = GRAM):
    """Hash of each k-gram: a polynomial of the code points modulo 2^64, mixed and cut to 32 bits."""
    import numpy as np

    n = len(points)
    if not n:
        return np.zeros(0, np.uint32)
    gram = min(gram, n)
    h = np.zeros(n - gram + 1, np.uint64)
    width, done = 1, 0
    # blocks[j]: the polynomial of the 2^j points from a place on; a gram is put together from its binary digits
    block, power = points.astype(np.uint64) + np.uint64(1), np.uint64(_BASE)
    with np.errstate(over="ignore"):
        while True:
            if gram & width:
                h = h * power + block[done : done + len(h)]
                done += width
            width *= 2
            if width > gram:
                break
            block = block[: len(block) - width // 2] * power + block[width // 2 :]
            power = power * power
        h ^= h >> np.uint64(29)
        h *= np.uint64(_MIX)
    return (h >> np.uint64(32)).astype(np.uint32)


def winnow(hashes, window: int = WINDOW):
    """Positions of the chosen hashes, ascending."""
    import numpy as np

    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    window = min(window, n)
    # hash and, below it, how far left the position is: the minimum is the smallest hash with the rightmost position
    key = (hashes.astype(np.uint64) << np.uint64(32)) | np.arange(n - 1, -1, -1, dtype=np.uint64)
    span = 1
    while span * 2 <= window:
        key = np.minimum(key[: len(key) - span], key[span:])
        span *= 2
    if window > span:
        key = np.minimum(key[: n - window + 1], key[window - span :])
    at = (n - 1) - (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return at[np.concatenate([[True], at[1:] != at[:-1]])]


def fingerprint(text: str, gram: int = GRAM, window: int = WINDOW):
    """The fingerprint string of a text and the sorted distinct hashes in it."""
    import numpy as np

    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    hashes = gram_hashes(points, gram)
    at = winnow(hashes, window)
    chosen = hashes[at]
    return " ".join(f"{p:x}:{h:08x}" for p, h in zip(at.tolist(), chosen.tolist(), strict=True)), np.unique(chosen)


def likeness(a, b) -> float:
    """Jaccard similarity of two sorted arrays of distinct hashes."""
    import numpy as np

    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def _pairs(batches: Iterator[pa.RecordBatch], gram: int, window: int) -> Iterator[pa.RecordBatch]:
    """Rows of a part in descending order, each with the next one's text; the last of a part is a copy of the next part's first."""

    def row(own: tuple, text: str, next_set) -> tuple:
        doc_id, mine, printed, hashes = own
        half = len(mine) // 2
        edited = mine[: len(mine) - half] + text[:half]
        other, other_set = fingerprint(edited, gram, window)
        digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return doc_id, len(mine), digest, printed, other, likeness(hashes, other_set), likeness(hashes, next_set)

    held = None
    for batch in batches:
        out = []
        for part, copy, doc_id, text in zip(*(batch.column(c) for c in ("part", "copy", "doc_id", "text")), strict=True):
            mine = text.as_py() or ""
            printed, hashes = fingerprint(mine, gram, window)
            if held and held[0] == part:
                out.append(row(held[1], mine, hashes))
            held = None if copy.as_py() else (part, (doc_id.as_py(), mine, printed, hashes))
        columns = list(zip(*out, strict=True)) or [[]] * 7
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def next_edits(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each document and of its edit with the next one in descending id order (after the last: the first).

    Ids alone decide which part of the order a row is in: ranges of ids between quantiles.
    The first row of a part also goes, as a copy, to the part before it, so that texts are
    shuffled once and no part needs another.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions")) * 4
    cuts = base.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 100_000).alias("q")).first()["q"]
    cuts = sorted(set(cuts or []))
    # part 0 holds the largest ids; a null id is in the last part
    part = F.when(F.col("doc_id").isNull(), len(cuts)).otherwise(_above(cuts, F.col("doc_id")))
    tops = base.select("doc_id", part.alias("part")).groupBy("part").agg(F.max("doc_id").alias("top"))
    order = Window.orderBy("part")
    tops = tops.select("part", "top", F.lag("part").over(order).alias("before"), F.max("part").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("last")).collect()
    copies = {(x["part"], x["top"]): x["last"] if x["before"] is None else x["before"] for x in tops}
    # one row of each part is its first: of those with the top id the one with the least text
    table = spark.createDataFrame([(p, t, to) for (p, t), to in copies.items()], "part int, top long, to int")
    rows = base.select("doc_id", "text", part.cast("int").alias("part")).join(F.broadcast(table), "part")
    own = F.struct("part", F.lit(False).alias("copy"))
    other = F.struct(F.col("to").alias("part"), F.lit(True).alias("copy"))
    places = F.when(F.col("doc_id").eqNullSafe(F.col("top")), F.array(own, other)).otherwise(F.array(own))
    placed = rows.select("doc_id", "text", F.explode(places).alias("p")).select("p.part", "p.copy", "doc_id", "text")
    placed = placed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "part")
    placed = placed.sortWithinPartitions("part", "copy", F.col("doc_id").desc_nulls_last(), F.crc32(F.col("text").cast("binary")))
    return placed.mapInArrow(lambda b: _pairs(b, gram, window), TYPE)


def _above(cuts: list[int], value):
    """How many of the sorted cuts are at or above the value, by halving."""
    if not cuts:
        return F.lit(0)
    middle = len(cuts) // 2
    return F.when(value > cuts[middle], _above(cuts[middle + 1 :], value)).otherwise(F.lit(len(cuts) - middle) + _above(cuts[:middle], value))
