"""The Merkle manifest against a plain recomputation."""

import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkstill.llm import merkle


def _hash(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def _leaf(row):
    parts = [b"-" if v is None else b"%d:%b" % (len(str(v).encode()), str(v).encode()) for v in row]
    return _hash(b"".join(parts))


def _levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([_hash("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def _path(levels, p):
    out = []
    for nodes in levels[:-1]:
        run = p - p % 3
        out.append(("".join(nodes[run:p]), "".join(nodes[p + 1 : run + 3])))
        p //= 3
    return out


def plain(rows):
    by = {}
    for r in map(tuple, rows):
        by.setdefault(r[1], []).append((-(1 << 70) if r[0] is None else r[0], _leaf(r), r))
    names = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    tries = {}
    for n in names:
        by[n].sort(key=lambda x: x[:2])
        tries[n] = _levels([x[1] for x in by[n]])
    top = _levels([tries[n][-1][0] for n in names]) if names else [[None]]
    root, out = top[-1][0], Counter()
    for j, n in enumerate(names):
        for p, (_, own, r) in enumerate(by[n]):
            path = _path(tries[n], p) + _path(top, j)
            changed = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            h = _leaf((*r[:4], r[4].replace("\n", ""))) if changed else own
            for a, b in path:
                h = _hash(a + h + b)
            out[r[0], own, tries[n][-1][0], root, _hash("".join(a + b for a, b in path)), h, h == root] += 1
    return out


def _found(docs):
    return Counter(tuple(r) for r in merkle.verify(merkle.manifest(docs)).collect())


def test_manifest_equals_a_plain_one(docs):
    found = _found(docs)
    assert found == plain(docs.select(*merkle.FIELDS).collect())
    assert {x[-1] for x in found} == {True, False}


def test_deep_tries_far_ids_and_repeats(spark):
    """More than one pass of groups; ids of both signs, far apart; many rows of one id, of no id and alike in all fields."""
    far = [(k * 0x1D3F5A7B9C2E4F61 + 5) % (1 << 64) - (1 << 63) for k in range(900)]
    rows = [(i, "hot", "en", 3, f"a\nb{k}") for k, i in enumerate(far)]
    rows += [(7, "hot", "en", 1, f"text {k % 5}") for k in range(60)] + [(None, "hot", None, None, f"none {k % 4}") for k in range(20)] + [(9, None, None, None, None)] * 30
    rows += [(1, "one", "en", 0, "")] + [(k, f"s{k}é", "en", 0, "x\n") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    assert _found(docs) == plain(rows)


def test_nothing_gives_nothing(nothing):
    assert merkle.verify(merkle.manifest(nothing)).count() == 0


@pytest.mark.parametrize("low", [0, -3, (1 << 63) - 2000])
def test_ranks_are_counts_of_smaller_keys(spark, low):
    ids = [low + (k * k) % 1500 for k in range(400)] + [None] * 3
    rows = spark.createDataFrame([(k % 3, i) for k, i in enumerate(ids)], "g int, i long")
    got = merkle.radix_ranks(rows, ["g"], "i", "rank", "same").collect()
    for r in got:
        mine = [x for k, x in enumerate(ids) if k % 3 == r["g"]]
        small = 0 if r["i"] is None else sum(x is None or x < r["i"] for x in mine)
        assert (r["rank"], r["same"]) == (small, sum(x == r["i"] for x in mine))


def test_one_changed_character_is_found(docs):
    """Any other field breaks the proof as well: the root depends on each row."""
    def root(df):
        return merkle.manifest(df).first()["root"]

    assert root(docs) != root(docs.withColumn("lang", F.when(F.col("doc_id") == 3, F.lit("xx")).otherwise(F.col("lang"))))
