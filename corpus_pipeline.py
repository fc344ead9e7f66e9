"""A corpus pipeline: quality rules, language, line dedup, near-duplicates, packing.

Every stage gets what its predecessor kept, as a written table, and all but the last
return the columns of documents. Further columns pass through, whatever their names. An
empty table, or one that a stage leaves empty, gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkstill.llm import langid, lines, near, packing, rules
from sparkstill.llm.common import cut, documents, free, scope
from sparkstill.llm.queries import VOCABULARY

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Tables that the stage before wrote for itself and its result reads.
_LEFT: list[str] = []


def stage(f: Stage) -> Stage:
    """f, which first deletes what the stage before wrote for itself: its result is a table by then (if docs still reads from there, nothing is deleted)."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = free(spark, _LEFT, (docs,))
        with scope() as tables:
            out = f(spark, docs, sf_dir)
        _LEFT[:] = left + tables
        return out

    return run


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the rules reject.

    A null text has no words and goes; null languages and sources are groups of their own;
    repeated rows are judged alike, each stays or goes with the others.
    """
    return rules.accept(docs)


@stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that are not in a language that the labelled ones teach.

    A text that is null or has no letter goes; a null language does not teach; repeated rows
    are judged alike, and so are ties, by the order of the languages' names. Where nothing
    teaches a language, all documents go.
    """
    return langid.accept(docs, langid.train(docs))


@stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes later similar lines; a document that has no word left goes.

    n_chars follows the text. A null text goes; a null id comes before all others; rows that
    repeat an id and a text keep or lose lines alike.
    """
    left = lines.dedup(docs).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.select(*(F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that five-word Jaccard similarities of 0.8 or more connect.

    The smallest id stays, a null id only where there is no other; of repeated rows one stays.
    """
    return near.keep_first(docs)


@stage
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences; null texts are packed as empty ones, repeated rows each."""
    return packing.pack(docs, VOCABULARY)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("language", language),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_duplicates),
    ("best_fit_packing", best_fit_packing),
]

#: SQL has no hashes and no tokenizer for these stages; the tests compare with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, name)
    return docs
