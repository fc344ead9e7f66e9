"""SimHash near-duplicates by segment popcounts.

A fingerprint is cut into segments and embedded as the vector of their bit counts. The
Manhattan distance of two vectors is at most the Hamming distance of the fingerprints, so
linked fingerprints lie within that distance on the grid of vectors. Two grid points at
distance 2 or less have a common point at distance 1 or less from both: each distinct
fingerprint is filed under its own cell and the cells one step away, equal cells are
joined, and the join keeps pairs whose fingerprints differ in few enough bits. Equal
fingerprints meet as one; components of the links are found among distinct fingerprints.

Nulls and texts without words have fingerprint zero; repeated rows share a fingerprint; a
null id never is the smallest; an empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import components

SEGMENTS, DISTANCE, SEED = 16, 2, 42


def majority(hashes) -> int:
    """The bits that are set in over half of the hashes, as a signed 64-bit number; 0 if there are none."""
    import numpy as np

    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: str | None, size: int = 3) -> int:
    """The fingerprint of one text, as a signed 64-bit number."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    last = max(1, len(words) - size + 1)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False)) if len(words) >= size else [b" ".join(words)]
    return majority(np.fromiter((xxh64_intdigest(x, SEED) for x in shingles), np.uint64, last))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [fingerprint(x.as_py()) for x in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp of every document."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return base.mapInArrow(_fingerprints, "doc_id long, fp long")


def cells(prints: DataFrame, segments: int = SEGMENTS) -> DataFrame:
    """fp and cell: a point's own grid cell and those one step away, as hashes of the vectors.

    An equal hash of different vectors costs a comparison, never a link.
    """
    width = 64 // segments
    mask = F.lit((1 << width) - 1)
    counts = F.array(*(F.bit_count(F.shiftrightunsigned("fp", k * width).bitwiseAND(mask)) for k in range(segments)))
    point = prints.select("fp", counts.alias("v"))
    steps = [F.struct(F.lit(-1).alias("k"), F.lit(0).alias("d"))]
    steps += [F.struct(F.lit(k).alias("k"), F.lit(d).alias("d")) for k in range(segments) for d in (-1, 1)]
    near = point.select("fp", "v", F.explode(F.array(*steps)).alias("s"))
    moved = [F.col("v")[k] + F.when(F.col("s.k") == k, F.col("s.d")).otherwise(0) for k in range(segments)]
    inside = (F.col("s.k") < 0) | (F.element_at("v", F.greatest("s.k", F.lit(0)) + 1) + F.col("s.d")).between(0, width)
    return near.where(inside).select("fp", F.xxhash64(*moved).alias("cell"))


def links(prints: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """Pairs a < b of the distinct fingerprints in `prints` that differ in at most `distance` bits."""
    if distance > 2:
        raise ValueError("cells one step away cover distances up to 2")
    left, right = cells(prints, segments), cells(prints, segments)
    # by a shuffle: Spark takes exploded rows to be no more than those before, and would gather up to 33 a fingerprint for a broadcast
    pair = left.select("cell", F.col("fp").alias("a")).join(right.select("cell", F.col("fp").alias("b")).hint("merge"), "cell")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    return pair.where((F.col("a") < F.col("b")) & close).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, **columns: str) -> DataFrame:
    """doc_id, fp and component_id (the smallest id reachable over links) of every document."""
    rows = cut(fingerprints(docs, **columns), "simhash")
    prints = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    found = components(cut(links(prints.select("fp"), distance), "simhash-links"), "simhash-components")
    rooted = prints.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")
