"""Packing, encoding and the id files against the libraries themselves."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from sparkstill.llm import binary, bpe, packing, queries, tokens


@pytest.fixture(scope="module")
def ids(texts):
    t = Tokenizer.from_file(queries.VOCABULARY)
    t.encode_special_tokens = True
    return [(i, np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")) for i, x in texts]


def test_units_give_the_ids_of_whole_texts():
    parts = [" ", "  ", "   ", "a", "b'", "'s", "'r", "e", "1", "23", ".", "\n", "\t", "\xa0", "　", "é", "日本", "!!", "<|endoftext|>", "\x1c", "\x85", "\r\n"]
    r = random.Random(5)
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(3000)]
    use = tokens.UnitEncoder(queries.VOCABULARY)
    assert use.whole(texts) == [x.tobytes() for x in tokens.encoded(texts, queries.VOCABULARY, 4000)]


def test_ranks_are_those_of_the_rank_file():
    import base64

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        assert tokens.merge_ranks(queries.VOCABULARY) == {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@pytest.mark.parametrize("rows_of", [lambda b: packing._pieces(b, queries.VOCABULARY, 2048), lambda b: binary._chunks(b, queries.VOCABULARY)], ids=["packing", "binary"])
def test_encoding_holds_few_texts_at_a_time(monkeypatch, rows_of):
    """Texts of a batch are made one by one and encoded in runs of a million characters."""
    text, made, runs, encode = "alpha beta gamma delta " * 40, [], [], tokens.UnitEncoder.encode

    class Text:
        def as_py(self):
            made.append(1)
            return text

    class Column(list):
        def __getitem__(self, k):
            return Text()

        def to_pylist(self):
            return [x.as_py() if isinstance(x, Text) else x for x in self]

    class Batch:
        num_rows = 0

        def column(self, name):
            return Column([Text() for _ in range(4000)] if name == "text" else range(4000))

    monkeypatch.setattr(tokens.UnitEncoder, "encode", lambda self, texts: (runs.append((len(texts), len(made))), encode(self, texts))[1])
    assert sum(x.num_rows for x in rows_of(iter([Batch()]))) > 0
    assert [n for _, n in runs] == np.cumsum([n for n, _ in runs]).tolist() and sum(n for n, _ in runs) == 4000
    assert max(n for n, _ in runs) * len(text) < 1_100_000


def test_packing(docs, ids):
    found = packing.pack(docs, queries.VOCABULARY).collect()
    got = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found)
    want = Counter()
    for i, x in ids:
        head = (len(x) - 1) % 2048 + 1
        at = [0, *range(head, len(x) + 1, 2048)]
        want.update((i, k, a, b - a, zlib.crc32(x[a:b].tobytes())) for k, (a, b) in enumerate(zip(at, at[1:], strict=False)))
    assert got == want
    rows = defaultdict(list)
    for r in found:
        rows[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in rows.values():
        x.sort()
        assert x[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(x, x[1:], strict=False)) and sum(x[-1]) <= 2048
    assert len(rows) <= 1.02 * sum(len(x) for _, x in ids) / 2048 + 2


@pytest.mark.parametrize("n", [1, 40, 3000, 200_000])
def test_plan_covers_the_histogram_once(n):
    x = np.clip(np.exp(np.random.default_rng(n).normal(6, 1.2, n)).astype(int), 1, 2048)
    want, got = Counter(x.tolist()), Counter()
    by_program, by_best_fit, bound = packing.solve(dict(want))
    for holds, m in by_program + by_best_fit:
        assert m > 0 and sum(k * c for k, c in holds.items()) <= 2048
        for k, c in holds.items():
            got[k] += c * m
    assert got == want
    n_sequences = sum(m for _, m in by_program + by_best_fit)
    assert -(-int(x.sum()) // 2048) <= bound <= n_sequences <= 1.002 * bound + 2
    if n >= 3000:  # the program places the bulk
        assert sum(m for _, m in by_best_fit) <= 0.1 * n_sequences


def test_plan_of_a_tiny_capacity_is_the_best():
    first, second, bound = packing.solve({6: 4, 4: 4, 3: 6, 2: 6, 5: 2}, 10)
    assert sum(m for _, m in first + second) == bound == 8


def test_bound_is_more_than_the_sum_over_the_capacity():
    """Pieces of more than half a sequence are one each, whatever their sum."""
    first, second, bound = packing.solve({1100: 50, 1500: 20}, 2048)
    assert sum(m for _, m in first + second) == 70 and 70 >= bound >= 65 > (1100 * 50 + 1500 * 20) / 2048


def test_id_files(spark, docs, ids):
    found = binary.read(spark, binary.write(docs, queries.VOCABULARY)).orderBy("start").collect()
    want, at = [], 0
    for i, x in sorted(ids, key=lambda y: y[0]):
        want.append((i, at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    assert [tuple(r) for r in found] == want


def test_planes_round_trip():
    for n in (0, 1, 8192, 8193, 100_000):
        x = np.random.default_rng(n).integers(0, 50257, n).astype("<u4")
        assert (binary.unpack_planes(n, *binary.pack_planes(x)[1:]) == x).all()


@pytest.mark.parametrize(("chunk", "overlap", "spread"), [(bpe.CHUNK, bpe.OVERLAP, bpe.SPREAD), (300, 40, 1 << 16), (300, 40, 500), (64, 8, 0)])
def test_chunked_encoding(docs, texts, chunk, overlap, spread):
    use = bpe.codec(queries.RANKS, P.PATTERN)
    some = docs.where("doc_id >= 995 or doc_id < 20")
    found = bpe.round_trip(some, queries.RANKS, P.PATTERN, chunk, overlap, spread).collect()
    want = Counter()
    for i, x in texts:
        if i >= 995 or i < 20:
            y = use.encode_ordinary(x or "")
            want[i, len(y), hashlib.sha256(",".join(map(str, y)).encode()).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, found)) == want


def test_ordinary_documents_are_chunked(spark):
    import regex

    match = regex.compile(P.PATTERN)
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()
    pieces = [len(bpe.piece_starts(r["text"], match, bpe.CHUNK, bpe.OVERLAP)) for r in rows]
    chunks = [len(bpe.chunk_places(len(r["text"]), bpe.CHUNK, bpe.OVERLAP)) for r in rows]
    assert sum(n > 1 for n in pieces) >= 300 and pieces == chunks


@pytest.mark.parametrize("spread", [0, 1 << 16])
def test_chunks_of_hard_texts(spark, spread):
    r = random.Random(9)
    parts = ["'", "'re", "'v", "e", " ", "  ", "\n", "x" * 70, "9" * 90, "é", "!?", " " * 50, "l", "d"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 120))) for _ in range(150)]
    use = bpe.codec(queries.RANKS, P.PATTERN)
    found = bpe.round_trip(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), queries.RANKS, P.PATTERN, 32, 12, spread).collect()
    got = {x["doc_id"]: (x["n_tokens"], x["ids_sha256"]) for x in found}
    for i, x in enumerate(texts):
        y = use.encode_ordinary(x)
        assert got[i] == (len(y), hashlib.sha256(",".join(map(str, y)).encode()).hexdigest())


def test_empty_tables(spark, nothing):
    assert packing.pack(nothing, queries.VOCABULARY).count() == 0
    assert binary.read(spark, binary.write(nothing, queries.VOCABULARY)).count() == 0
    assert bpe.round_trip(nothing, queries.RANKS, P.PATTERN).count() == 0
