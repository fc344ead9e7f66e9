"""The pipeline's stages against brute force, each on what the stage before left."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from sparkstill.llm import langid, queries, rules
from sparkstill.llm.common import cut, documents

from .test_documents import _brute_lines

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]")


@pytest.fixture(scope="module")
def stages(spark):
    """The documents before the first stage and after each."""
    out = [documents(spark, SF)]
    for name, stage in corpus_pipeline.STAGES:
        out.append(cut(stage(spark, out[-1], SF), name))
    return out


def _rows(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect())


def test_columns_stay(stages):
    for df in stages[:-1]:
        assert df.columns == stages[0].columns
    assert [x[0] for x in corpus_pipeline.STAGES] == ["quality_rules", "language", "line_dedup", "simhash_near_dedup", "best_fit_packing"]


def test_quality_and_language_drop_what_they_reject(spark, stages):
    kept = {r["doc_id"] for r in rules.judge(stages[0]).where("kept").collect()}
    assert {i for i, _ in _rows(stages[1])} == kept and 0 < len(kept) < 200
    found = langid.predict(stages[1], langid.train(stages[1])).join(stages[1].select("doc_id", "lang"), "doc_id").collect()
    want = set()
    for r in found:
        taught = [x for x in found if x["lang"] == x["lang_pred"] == r["lang_pred"] and zlib.crc32(str(x["doc_id"]).encode()) % 5]
        rate, lead = (sorted(x[c] for x in taught) for c in ("rate", "lead"))
        at = lambda v, q: v[int(np.ceil(q * len(v))) - 1]
        most = at(rate, 0.5) + max(langid.SLACK * at(rate, 0.5), langid.SPREAD * (at(rate, 0.75) - at(rate, 0.5)))
        if r["lang_pred"] != "und" and r["score"] >= 0.5 and r["rate"] <= most and r["lead"] >= langid.LEAD * at(lead, 0.5):
            want.add(r["doc_id"])
    assert {i for i, _ in _rows(stages[2])} == want


def test_lines_against_brute_force(stages):
    want = [(i, x) for i, x in _brute_lines(_rows(stages[2])) if WORD.search(x)]
    assert _rows(stages[3]) == want
    assert all(r["n_chars"] == len(r["text"]) for r in stages[3].collect())


def _brute_groups(rows):
    """The first document of each group that a five-word Jaccard similarity of 0.8 connects; rows are (id, text) by id."""
    sets = []
    for _, text in rows:
        w = [x.lower() for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(sets):
        for j, b in enumerate(sets[:k]):
            if a == b or len(a & b) >= 0.8 * len(a | b):
                x, y = find(k), find(j)
                root[max(x, y)] = min(x, y)
    return [rows[k] for k in range(len(rows)) if find(k) == k]


def test_near_duplicates_against_brute_force(stages):
    assert _rows(stages[4]) == _brute_groups(_rows(stages[3]))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, n string, stats string, lines string, c0 string, root string"


def _odd_rows(spark):
    """Rows with null ids, repeated rows, one id with two texts, and further columns whose names the stages use themselves."""
    texts = [r["text"] for r in documents(spark, SF).where("lang = 'en' and n_chars between 600 and 3000").orderBy("doc_id").limit(40).collect()]
    rows = [(k, x) for k, x in enumerate(texts)] + [(None, texts[0]), (None, texts[30] + " more words than before"), (3, texts[3]), (3, texts[3]), (5, texts[9]), (None, None), (77, None), (78, ""), (79, "  \n")]
    return spark.createDataFrame([(i, x, "en", "s", len(x) if x is not None else None, *["clash"] * 6) for i, x in rows], SCHEMA), rows


def test_stages_on_odd_rows(spark):
    docs, rows = _odd_rows(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and {r["root"] for r in out.collect()} <= {"clash"}, name
    left = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()]
    ordered = sorted(rows, key=lambda x: (x[0] is None, x[0] or 0))
    want = _brute_groups(ordered)
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    assert sorted((x for x in left if (x[1] or "").strip()), key=key) == sorted((x for x in want if (x[1] or "").strip()), key=key)
    assert sum(not (x[1] or "").strip() for x in left) == 1
    assert corpus_pipeline.best_fit_packing(spark, docs, SF).select("doc_id", "sequence_id").count() >= len(rows)


def test_line_dedup_of_rows_that_share_an_id(spark):
    """One id with two texts: lines of each are judged by their own places."""
    long_ = lambda k: " ".join(f"w{k}x{j}" for j in range(12))
    rows = [(5, f"{long_(1)}\n{long_(2)}"), (5, f"{long_(3)}\n{long_(4)}"), (6, f"{long_(4)}\n{long_(5)}"), (None, long_(5)), (None, long_(6)), (4, long_(3))]
    docs = spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = sorted((r["doc_id"] or 0, r["text"]) for r in corpus_pipeline.line_dedup(spark, docs, SF).collect())
    assert left == sorted([(5, rows[0][1]), (5, long_(4)), (0, long_(5)), (0, long_(6)), (4, long_(3))])


def test_packing_holds_every_token_once(stages):
    t = Tokenizer.from_file(queries.VOCABULARY)
    t.encode_special_tokens = True
    want = Counter({i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in _rows(stages[4])})
    got, filled = Counter(), Counter()
    for r in stages[5].collect():
        got[r["doc_id"]] += r["length"]
        filled[r["sequence_id"]] += r["length"]
    assert got == want and max(filled.values()) <= 2048
    assert len(filled) <= np.ceil(1.02 * sum(want.values()) / 2048) + 2
