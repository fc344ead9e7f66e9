"""Byte-level BPE encoding by overlapping chunks, and decoding.

A text is cut into chunks that overlap. Each chunk is pre-tokenised on its own, from
its first character, which may stand inside a pre-token; matching depends only on where it
begins, so as soon as a chunk has a boundary at a place where the chunk before it has one
too, both go on alike. The first such place in an overlap is where the two are stitched.
The text between two stitches is a piece; pieces start and end at true boundaries and are
encoded alone. From the first overlap without a common boundary on, the rest of the text
is one piece. Decoding concatenates the bytes of the ids.

A boundary within three characters of a chunk's end, or behind the start of the white space
it ends with, is not used: the longest contraction and the look-ahead behind white space
need what comes after.

The chunks of a text are looked at in the task that holds the text; those of a text of
more than SPREAD characters are dealt over tasks, and so are its pieces. Both ways cut,
stitch and encode by the same functions.

Nulls are encoded as empty texts (no ids). Repeated rows are encoded each; rows are told
apart by a number of their own, so ids may repeat or be null. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, tidy

CHUNK, OVERLAP, SPREAD = 1 << 10, 1 << 7, 1 << 16
_CODECS: dict = {}


def codec(path: str, pattern: str):
    """This worker's encoder for a rank file."""
    import tiktoken

    if path not in _CODECS:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _CODECS[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _CODECS[path]


def chunk_places(length: int, chunk: int, overlap: int) -> range:
    """Where the chunks of a text of some characters start; the last one reaches the text's end."""
    return range(0, max(1, length - overlap), chunk)


def boundaries(part: str, last: bool, pattern, chunk: int, overlap: int) -> tuple[list[int], list[int]]:
    """Starts of the pre-tokens of a chunk: those in the overlap with the chunk before, and those in that with the next."""
    found = [m.start() for m in pattern.finditer(part)]
    limit = min(len(part) - 3, len(part.rstrip()))
    return [x for x in found if x < overlap], [] if last else [x for x in found if chunk <= x <= limit]


def piece_starts(text: str, pattern, chunk: int, overlap: int) -> list[int]:
    """0 and the stitches of a text before the first overlap without one."""
    starts, before = [0], set()
    for at in chunk_places(len(text), chunk, overlap):
        head, tail = boundaries(text[at : at + chunk + overlap], at + chunk + overlap >= len(text), pattern, chunk, overlap)
        if at:
            common = before.intersection(at + x for x in head)
            if not common:
                break
            starts.append(min(common))
        before = {at + x for x in tail}
    return starts


def _chunk_rows(batches: Iterator[pa.RecordBatch], pattern: str, chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    import regex

    use = regex.compile(pattern)
    names = ["row", "k", "head", "tail"]
    kinds = [pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    for batch in batches:
        for row, k, at, part, last in zip(*(batch.column(c).to_pylist() for c in ("row", "k", "at", "part", "last")), strict=True):
            head, tail = boundaries(part, last, use, chunk, overlap)
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([row, k, [at + x for x in head], [at + x for x in tail]], kinds, strict=True)], names)


def stitches(chunks: DataFrame) -> DataFrame:
    """row and the sorted starts of its pieces: 0 and the stitches before the first overlap without one."""
    order = Window.partitionBy("row").orderBy("k")
    meet = F.array_min(F.array_intersect(F.lag("tail").over(order), F.col("head")))
    found = chunks.select("row", "k", F.when(F.col("k") == 0, F.lit(0)).otherwise(meet).alias("start"))
    lost = F.max(F.col("start").isNull().cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return found.select("row", "start", lost.alias("lost")).where("lost = 0").groupBy("row").agg(F.array_sort(F.collect_list("start")).alias("starts"))


def _digest(ids: list[int], signs: list[str]) -> str:
    return ",".join([signs[i] for i in ids])


def _encode_rows(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    use = codec(path, pattern)
    signs = [str(x) for x in range(use.n_vocab)]
    for batch in batches:
        found = [use.encode_ordinary(x) for x in batch.column("text").to_pylist()]
        ids = [_digest(x, signs) for x in found]
        raw = [use.decode_bytes(x) for x in found]
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("k"), pa.array(map(len, found), pa.int64()), pa.array(ids, pa.string()), pa.array(raw, pa.binary())], ["row", "k", "n", "ids", "decoded"])


def encoded(text: str, use, pattern, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """The ids of a text: those of its pieces, one after the other."""
    starts = piece_starts(text, pattern, chunk, overlap)
    return [x for a, b in zip(starts, [*starts[1:], len(text)], strict=True) for x in use.encode_ordinary(text[a:b])]


def _digest_rows(batches: Iterator[pa.RecordBatch], path: str, pattern: str, chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    import regex

    use, match = codec(path, pattern), regex.compile(pattern)
    signs = [str(x) for x in range(use.n_vocab)]
    for batch in batches:
        n, ids, raw = [], [], []
        for x in batch.column("text"):
            found = encoded(x.as_py() or "", use, match, chunk, overlap)
            n.append(len(found))
            ids.append(hashlib.sha256(_digest(found, signs).encode()).hexdigest())
            raw.append(hashlib.sha256(use.decode_bytes(found)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(raw)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


@tidy
def encode_pieces(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, row, k, n, ids (decimal, by commas) and decoded bytes of each piece of each text of docs (doc_id, text), dealt over tasks."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.expr("uuid()").alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = cut(rows, "bpe-long")
    size = F.length("text")
    places = F.posexplode(F.sequence(F.lit(0), F.greatest(size - overlap, F.lit(1)) - 1, F.lit(chunk))).alias("k", "at")
    parts = rows.select("row", "text", size.alias("size"), places)
    parts = parts.select("row", "k", "at", F.substr("text", F.col("at") + 1, F.lit(chunk + overlap)).alias("part"), (F.col("at") + chunk + overlap >= F.col("size")).alias("last"))
    parts = cut(parts.repartition(n, "row", "k").mapInArrow(lambda b: _chunk_rows(b, pattern, chunk, overlap), "row string, k int, head array<long>, tail array<long>"), "bpe-chunks")
    split = rows.select("row", "text").join(stitches(parts), "row").select("row", "text", "starts", F.posexplode("starts").alias("k", "start"))
    end = F.coalesce(F.get("starts", F.col("k") + 1), F.length("text"))
    pieces = split.select("row", "k", F.substr("text", (F.col("start") + 1).cast("int"), (end - F.col("start")).cast("int")).alias("text"))
    coded = pieces.repartition(n, "row", "k").mapInArrow(lambda b: _encode_rows(b, path, pattern), "row string, k int, n long, ids string, decoded binary")
    return coded.join(rows.select("row", "doc_id"), "row")


@tidy
def round_trip(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, spread: int = SPREAD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    size = F.length(F.coalesce("text", F.lit("")))
    here = base.where(size <= spread).mapInArrow(lambda b: _digest_rows(b, path, pattern, chunk, overlap), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    pieces = encode_pieces(base.where(size > spread), path, pattern, chunk, overlap)
    whole = pieces.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("k", "ids", "decoded"))).alias("p"))
    ids = F.array_join(F.filter(F.col("p.ids"), lambda x: x != ""), ",")
    decoded = F.array_join(F.transform("p.decoded", lambda x: F.hex(x)), "")
    return here.unionByName(whole.select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.unhex(decoded), 256).alias("decoded_sha256")))
