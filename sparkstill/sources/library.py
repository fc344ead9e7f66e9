"""A library with fingerprints, built block by block.

The texts are numbered and written first. Then each block of BLOCK rows is a commit of its own: a
folder `block=k` below `rows`, and after it an entry in the ledger. A build that is cut off goes on
with the blocks that the ledger lacks; what such a block had written is written over. The settings of the
fingerprints are in the ledger and in the metadata of the Parquet files, and both are checked.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.features import TextPairs, made_with
from .tables import build_library, delete, exists, load_json, save_json

#: Rows of a block.
BLOCK = 1_000_000


class LibraryError(ValueError):
    """A library of other settings, or one that is not whole."""


def _ledger(spark: SparkSession, out: str) -> dict:
    return load_json(spark, f"{out}/ledger") if exists(spark, f"{out}/ledger") else {}


def build(spark: SparkSession, path: str, out: str, key: str | None = None, distinct: bool = False, limit: int | None = None, width: int = 2048, block_rows: int = BLOCK, after_block: Callable[[int], None] | None = None) -> DataFrame:
    """Write a library (row_id, text, pairs) and return it; goes on where an earlier call with the same settings was cut off."""
    stage = TextPairs("text", "pairs", width)
    asked = {"fingerprint": stage.describe(), "source": path, "key": key, "distinct": distinct, "limit": limit, "block_rows": block_rows}
    ledger = _ledger(spark, out)
    if ledger and ledger["settings"] != asked:
        raise LibraryError(f"{out} was begun with other settings: {ledger['settings']}")
    if not ledger:
        delete(spark, f"{out}/texts")
        n = build_library(spark, path, f"{out}/texts", key, distinct, limit).count()
        ledger = {"settings": asked, "n_rows": n, "done": []}
        save_json(spark, f"{out}/ledger", ledger)
    texts = spark.read.parquet(f"{out}/texts")
    for k in range(-(-ledger["n_rows"] // block_rows)):
        if k in ledger["done"]:
            continue
        rows = texts.where((F.col("row_id") >= k * block_rows) & (F.col("row_id") < (k + 1) * block_rows))
        stage.transform(rows).write.mode("overwrite").parquet(f"{out}/rows/block={k}")
        ledger["done"].append(k)
        save_json(spark, f"{out}/ledger", ledger)
        if after_block:
            after_block(k)
    return read(spark, out, width)


def read(spark: SparkSession, out: str, width: int | None = None) -> DataFrame:
    """The library (row_id, text, pairs); one that is not whole, or of another fingerprint, is refused."""
    ledger = _ledger(spark, out)
    if not ledger:
        raise LibraryError(f"{out} is no library")
    missing = set(range(-(-ledger["n_rows"] // ledger["settings"]["block_rows"]))) - set(ledger["done"])
    if missing:
        raise LibraryError(f"{out}: {len(missing)} blocks are missing; build it again to go on")
    if not ledger["done"]:
        return TextPairs("text", "pairs", ledger["settings"]["fingerprint"]["width"]).transform(spark.read.parquet(f"{out}/texts"))
    rows = spark.read.parquet(*(f"{out}/rows/block={k}" for k in sorted(ledger["done"])))
    found = made_with(rows)
    if found != ledger["settings"]["fingerprint"]:
        raise LibraryError(f"{out}: the files have fingerprints {found}, the ledger names {ledger['settings']['fingerprint']}")
    wanted = TextPairs("text", "pairs", width or found["width"]).describe()
    if found != wanted:
        raise LibraryError(f"{out} has fingerprints {found}; {wanted} are asked for")
    return rows
