"""Every operator on an empty table, and on rows that are null in every column."""

import public_tokenizers as P
import pytest

import corpus_pipeline
from sparkstill.llm import binary, bpe, langid, lines, packing, quality, queries, rules, sharding, simhash, winnowing

APPLY = {
    "packing": lambda s, d: packing.pack(d, queries.VOCABULARY),
    "rules": lambda s, d: rules.judge(d),
    "rules_accept": lambda s, d: rules.accept(d),
    "quality": lambda s, d: quality.classify(d, s.createDataFrame([(1, 1), (None, 0)], "doc_id long, quality int")),
    "lines": lambda s, d: lines.dedup(d),
    "bpe": lambda s, d: bpe.round_trip(d, queries.RANKS, P.PATTERN),
    "winnowing": lambda s, d: winnowing.next_edits(d),
    "langid": lambda s, d: langid.predict(d, langid.train(d)),
    "sharding": lambda s, d: sharding.shard(d, 3, 64)[0],
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "binary": lambda s, d: binary.read(s, binary.write(d, queries.VOCABULARY)),
}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", list(APPLY))
def test_of_nothing(spark, name):
    assert APPLY[name](spark, spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("name", list(APPLY))
def test_of_null_rows(spark, name):
    rows = [(None, None, None, None, None)] * 2 + [(1, "a b c d e f", "en", None, 11), (2, None, None, "s", None), (None, "a b c d e f", None, None, 11)]
    want = {"rules_accept": 0}.get(name, 5)
    assert APPLY[name](spark, spark.createDataFrame(rows, SCHEMA)).count() == want


def test_pipeline_of_little(spark):
    for rows in ([], [(None, None, None, None, None), (1, "a b", "en", "s", 3)]):
        docs = spark.createDataFrame(rows, SCHEMA)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "")
        assert docs.count() == 0
