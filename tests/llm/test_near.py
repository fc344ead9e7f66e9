"""The near-duplicate stage of the pipeline against brute force."""

import random

import corpus_pipeline
from sparkstill.llm import near, simhash

SCHEMA = "doc_id long, text string"


def _set(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def _brute(rows):
    """Ids that stay: the smallest of each group of linked documents."""
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, _set(x)) for i, x in rows]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if len(a & b) >= 0.8 * len(a | b) - 1e-9:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i for i in root if find(i) == i}


def _texts():
    """Random texts of 20 to 400 words with copies that have 1 to 5 words changed, chains of copies of copies, and texts that share half."""
    r = random.Random(5)
    vocabulary = [f"w{k}" for k in range(3000)]
    out = []
    for n in [20, 60, 100, 150, 200, 300, 400] * 4:
        base = r.choices(vocabulary, k=n)
        out.append(base)
        for changes in (1, 2, 3, 5):
            copy = list(base)
            for k in r.sample(range(n), changes):
                copy[k] = r.choice(vocabulary)
            out.append(copy)
        for _ in range(3):
            copy = list(out[-1])
            copy[r.randrange(n)] = "new"
            out.append(copy)
        out.append(base[: n // 2] + r.choices(vocabulary, k=n - n // 2))
    r.shuffle(out)
    return [(k, " ".join(x)) for k, x in enumerate(out)]


def test_long_texts_whose_parities_have_different_lengths(spark):
    """Pairs around 512, 1024 and 2048 shingles, similar ones and ones that share two thirds; the first of each list is unlike them."""
    r = random.Random(7)
    out = []
    for n in (512, 1024, 2048):
        for _ in range(4):
            base = [f"v{r.randrange(10**6)}" for _ in range(n + 10)]
            out += [base, base[: n - 8], base[20:], [*base[: n // 2], *(f"u{r.randrange(10**6)}" for _ in range(n // 6)), *base[n // 2 + n // 6 :]], base[: 2 * n // 3]]
            out.append([*base[:60], *(f"x{r.randrange(10**6)}" for _ in range(n))])
    r.shuffle(out)
    rows = [(k, " ".join(x)) for k, x in enumerate(out)]
    got = [x["doc_id"] for x in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect()]
    assert sorted(got) == sorted(_brute(rows))


def test_near_copies_go_and_the_others_stay(spark):
    rows = _texts()
    want = _brute(rows)
    got = [x["doc_id"] for x in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect()]
    assert sorted(got) == sorted(want) and 28 < len(want) < len(rows) - 60


def test_simhash_finds_the_links_that_it_can_and_the_join_compares_what_is_left(spark, monkeypatch):
    """Similar sets within two bits are connected by their fingerprints; the result is that of all links."""
    r = random.Random(8)
    texts = []
    for _ in range(12):
        base = [f"v{r.randrange(10**6)}" for _ in range(400)]
        texts += [base, base[:399], [*base, "one", "more"], [*base[:200], *(f"u{r.randrange(10**6)}" for _ in range(10)), *base[210:]]]
    rows = [(k, " ".join(x)) for k, x in enumerate(texts)]
    prints = [simhash.majority(near.tokens(x)) for _, x in rows]
    close = {(i, j) for i in range(len(rows)) for j in range(i) if ((prints[i] ^ prints[j]) & (2**64 - 1)).bit_count() <= 2}
    seen = []
    plain = near.simhash_links

    def counted(*a):
        out = plain(*a)
        seen.append(out.count())
        return out

    monkeypatch.setattr(near, "simhash_links", counted)
    got = [x["doc_id"] for x in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect()]
    assert sorted(got) == sorted(_brute(rows))
    assert len({i for i, _ in close}) >= 12 and len({i for i, _ in close}) <= seen[0] <= len(close)
