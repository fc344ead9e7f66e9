"""The n-gram join against all pairs."""

import random
import re

import pytest

from sparkstill.llm import ngrams

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall((text or "").encode().lower())
    return frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])


def plain(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            if x and 100 * len(x & sets[j]) >= 85 * len(x | sets[j]):
                parent[find(i)] = find(j)
    out = []
    for i, x in enumerate(sets):
        ids = [d for k, (d, _) in enumerate(rows) if d is not None and find(k) == find(i)]
        out.append((rows[i][0], len(x), min(ids, default=None)))
    return sorted(out, key=repr)


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, root string, n int").repartition(3)
    return sorted(map(tuple, ngrams.near_duplicates(df, **options).collect()), key=repr)


def changed(r, words, share):
    return [f"x{r.random()}" if r.random() < share else w for w in words]


def corpus(seed, n=40):
    """Texts of all lengths with copies at all distances around the threshold, chains of edits and passages in common."""
    r = random.Random(seed)
    license_ = [f"lic{k}" for k in range(60)]
    rows = []
    for _ in range(n):
        words = [f"w{r.randrange(3000)}" for _ in range(r.choice([2, 4, 6, 9, 12, 20, 45, 80, 150, 300, 700]))]
        if r.random() < 0.4:
            words = words + license_
        rows.append(words)
        for _ in range(r.choice([0, 1, 4])):
            rows.append(changed(r, words, r.choice([0, 0.003, 0.01, 0.02, 0.03, 0.05])))
        for cut in (0.95, 0.9, 0.86, 0.84):
            if r.random() < 0.3:
                rows.append(words[: int(len(words) * cut)])
        chain = words
        for _ in range(r.choice([0, 0, 6])):
            chain = changed(r, chain, 0.012)
            rows.append(chain)
    r.shuffle(rows)
    return [(1000 - k, r.choice([" ", "\n", "\t "]).join(w)) for k, w in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(spark, seed):
    rows = corpus(seed)
    want = plain(rows)
    assert sum(a != c for a, _, c in want) > 30 and found(spark, rows) == want


def test_nulls_empties_repeats_and_case(spark, docs):
    rows = [(5, None), (4, ""), (3, " \n\t"), (2, "A b"), (9, "a B"), (None, "a b"), (None, "alone here now yes"), (7, "One two three four five"), (7, "one TWO three four five"), (8, "É one two three"), (1, "é one two three"), (5, None)]
    assert found(spark, rows) == plain(rows)
    some = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, ngrams.near_duplicates(docs).collect()), key=repr) == plain(some)
    assert ngrams.near_duplicates(docs.where("false")).count() == 0


def test_signatures_of_similar_sets_meet():
    """Without a join: any pair that is similar shares a signature, at sizes of all bands."""
    import numpy as np

    r = np.random.default_rng(3)
    for n in [3, 6, 7, 8, 9, 11, 13, 17, 25, 40, 70, 130, 260, 520, 1100]:
        for _ in range(60):
            d = int(r.integers(0, ngrams.differing(n, n) + 1))
            take = r.integers(0, d + 1)
            whole = np.unique(r.integers(0, (1 << 64) - 1, n + d, dtype=np.uint64))
            x, y = whole[: n + d - take] if take else whole, np.concatenate([whole[d - take :]])
            common = len(np.intersect1d(x, y))
            if 100 * common < 85 * (len(x) + len(y) - common) or len(x) == len(y) == common:
                continue
            mine, other = ({p: (spare, set(v.tolist())) for p, spare, v in ngrams.signatures(z)} for z in (x, y))
            # under one hash at least one of them has segments to spare, and more than those are shared
            assert any(spare >= 0 and len(v & other[p][1]) > spare for p, (spare, v) in mine.items() if p in other) or any(spare >= 0 and len(v & mine[p][1]) > spare for p, (spare, v) in other.items() if p in mine)
            assert ngrams.apart(ngrams.sketch(x), ngrams.sketch(y)) <= len(x) + len(y) - 2 * common


def test_signatures_grow_with_the_text():
    """A signature has a fixed size, and there are fewer than tokens."""
    import numpy as np

    for n in (1000, 10_000, 100_000):
        t = np.unique(np.random.default_rng(n).integers(0, (1 << 64) - 1, n, dtype=np.uint64))
        assert sum(len(v) for _, _, v in ngrams.signatures(t)) < 0.7 * n


def _counted(monkeypatch):
    seen = []
    real = ngrams._linked.__wrapped__

    def counted(pairs, *args):
        seen.append(pairs.count())
        return real(pairs, *args)

    monkeypatch.setattr(ngrams, "_linked", counted)
    return seen


def test_a_large_group_meets_few_times(spark, monkeypatch):
    """Pairs that are held against sketches grow with a group, not with its square."""
    seen = _counted(monkeypatch)
    r = random.Random(4)
    base = [f"w{r.randrange(5000)}" for _ in range(200)]
    for n in (60, 240):
        rows = [(k, " ".join(changed(r, base, 0.004))) for k in range(n)]
        assert found(spark, rows) == plain(rows)
    small, large = sum(seen[:3]), sum(seen[3:])
    assert large <= 8 * small and large < 240 * 30


def test_a_shared_passage_makes_few_pairs(spark, monkeypatch):
    """A third of each text is one passage: its segments are in all lists, and pairs grow with the texts, not with their square."""
    seen = _counted(monkeypatch)
    r = random.Random(6)
    passage = [f"p{k}" for k in range(60)]
    for n in (60, 240):
        rows = [(k, " ".join(passage + [f"w{r.randrange(10**6)}" for _ in range(120)])) for k in range(n)]
        rows += [(1000 + k, rows[k][1] + " more") for k in range(3)]
        assert found(spark, rows) == plain(rows)
    assert sum(seen[3:]) <= 7 * sum(seen[:3])


def test_a_set_that_shares_too_little_is_not_listed():
    """Texts with a passage in common share fewer segments than similar ones must; their segments stay where they are."""
    import numpy as np
    import pyarrow as pa

    r = random.Random(8)
    passage = [f"p{k}" for k in range(60)]
    texts = [" ".join(passage + [f"w{r.randrange(10**6)}" for _ in range(240)]) for _ in range(20)]
    texts.append(texts[0] + " more")
    batch = lambda: iter([pa.RecordBatch.from_pydict({"text": texts})])
    filed = pa.Table.from_batches(ngrams._filed(batch(), 4, 85)).to_pandas()
    many = filed.groupby("value").a.nunique()
    table = np.zeros(1 << 16, np.uint64)
    at = many[many > 1].index.to_numpy().view(np.uint64) & np.uint64((1 << 22) - 1)
    np.bitwise_or.at(table, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    listed = pa.Table.from_batches(ngrams._filed(batch(), 4, 85, table)).to_pandas()
    of = [ngrams._class(ngrams.tokens(t, 4)) for t in texts]
    assert filed.a.nunique() == 21 and filed[filed.value.isin(many[many > 1].index)].a.nunique() > 10
    assert {of[0], of[20]} <= set(listed.a) and listed.a.nunique() <= 4
