"""Token ids in a bit-plane file format.

A table of chunks: whole documents in ascending id order until a chunk has its number of
ids. The ids of a chunk are split into blocks of fixed size (the last is filled with
zeros); each block is transposed into bit planes (plane p holds bit p of every id) and
the p-th planes of all blocks are compressed together with zstandard. A chunk row holds
the planes, their number, the count of ids and the documents with their lengths; the
chunk index (part, chunk, number of ids, first and last document) is a table of its own,
and from it follows where each chunk starts in the whole sequence.

Spark writes both tables, so a lost executor repeats its part only.

Nulls: a null text is an empty document (its end id alone); a null id sorts first.
Repeated rows are written as often as they occur, in a fixed order. An empty table gives
empty files. Extra columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir
from .tokens import encoded

CHUNK_IDS, BLOCK_IDS = 1 << 18, 1 << 13
CHUNK_TYPE = "part int, chunk int, n_ids long, n_planes int, plane_bytes array<int>, planes binary, doc_ids array<long>, lengths array<long>"


def pack_planes(ids) -> tuple[int, list[int], bytes]:
    """Number of bit planes, the compressed size of each, and their bytes."""
    import numpy as np
    import zstandard

    n_planes = int(ids.max()).bit_length() if len(ids) else 0
    blocks = np.zeros((-(-len(ids) // BLOCK_IDS), BLOCK_IDS), "<u4")
    blocks.reshape(-1)[: len(ids)] = ids
    press = zstandard.ZstdCompressor(level=1)
    out = [press.compress(np.packbits((blocks >> p).astype(np.uint8) & 1, axis=1).tobytes()) for p in range(n_planes)]
    return n_planes, [len(x) for x in out], b"".join(out)


def unpack_planes(n_ids: int, plane_bytes: list[int], planes: bytes):
    """The ids of a chunk."""
    import numpy as np
    import zstandard

    open_, out, at = zstandard.ZstdDecompressor(), np.zeros(-(-n_ids // BLOCK_IDS) * BLOCK_IDS, "<u4"), 0
    for p, size in enumerate(plane_bytes):
        bits = np.unpackbits(np.frombuffer(open_.decompress(planes[at : at + size]), np.uint8))
        out |= bits.astype("<u4") << np.uint32(p)
        at += size
    return out[:n_ids]


def _chunks(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    import numpy as np

    held: list = []
    docs: list = []
    part = number = n_ids = 0

    def row() -> pa.RecordBatch:
        ids = np.concatenate(held)
        n_planes, sizes, planes = pack_planes(ids)
        values = [[part], [number], [len(ids)], [n_planes], [sizes], [planes], [docs], [[len(x) for x in held]]]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        names = ["part", "chunk", "n_ids", "n_planes", "plane_bytes", "planes", "doc_ids", "lengths"]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names)

    for batch in batches:
        if batch.num_rows:
            part = batch.column("part")[0].as_py()
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoded((x.as_py() for x in batch.column("text")), path), strict=True):
            held.append(np.append(ids, np.uint32(0)))
            docs.append(doc_id)
            n_ids += len(held[-1])
            if n_ids >= CHUNK_IDS:
                yield row()
                held, docs, n_ids, number = [], [], 0, number + 1
    if held:
        yield row()


def write(docs: DataFrame, vocabulary: str, folder: str | None = None, n_parts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode docs, end each document with id 0 and write the chunk table and the chunk index; returns their folder."""
    import uuid

    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    n_parts = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ranged = base.repartitionByRange(n_parts, F.col("doc_id").asc_nulls_first())
    ranged = ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.length("text"), F.crc32(F.col("text").cast("binary")))
    rows = ranged.select("doc_id", "text", F.spark_partition_id().alias("part"))
    rows.mapInArrow(lambda batches: _chunks(batches, vocabulary), CHUNK_TYPE).write.parquet(f"{folder}/chunks")
    chunks = spark.read.parquet(f"{folder}/chunks")
    index = chunks.select("part", "chunk", "n_ids", F.size("doc_ids").alias("n_docs"), F.element_at("doc_ids", 1).alias("first_doc"), F.element_at("doc_ids", -1).alias("last_doc"))
    index.write.parquet(f"{folder}/index")
    return folder


def chunk_starts(spark: SparkSession, folder: str) -> DataFrame:
    """part, chunk, start: the ids before each chunk, by sums per part and then over the parts (one row each)."""
    index = spark.read.parquet(f"{folder}/index")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = index.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return index.join(parts, "part").select("part", "chunk", (F.col("base") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("start"))


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np

    for batch in batches:
        for x in batch.to_pylist():
            ids, lengths = unpack_planes(x["n_ids"], x["plane_bytes"], x["planes"]), np.array(x["lengths"], np.int64)
            at = np.concatenate([[0], np.cumsum(lengths)])
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x["doc_ids"], pa.int64()), pa.array(at[:-1] + x["start"], pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    chunks = spark.read.parquet(f"{folder}/chunks").select("part", "chunk", "n_ids", "plane_bytes", "planes", "doc_ids", "lengths")
    starts = chunk_starts(spark, folder)
    keyed = chunks.join(starts, ["part", "chunk"])
    return keyed.mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")

