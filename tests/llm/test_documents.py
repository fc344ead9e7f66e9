"""Document operators against brute force and held-out labels."""

import hashlib
import re
import zlib
from collections import Counter

import pytest
from xxhash import xxh64_intdigest

from sparkstill.llm import langid, lines, quality, queries, rules, sharding, simhash, winnowing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BIG = "/root/testdata/sf0.01"


def test_rules_statistics(docs, texts):
    found = rules.judge(docs).collect()
    want = Counter()
    for i, x in texts:
        w = WORD.findall(x or "")
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {k + d for k, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for d in range(3)}
        seen: set = set()
        dup = 0
        for line in (x or "").split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        want[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x or "")), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)] += 1
    assert Counter(tuple(r)[:7] for r in found) == want
    assert all(not r["kept"] for r in found if r["base_failed"])


def test_rules_keep_good_texts_and_drop_junk(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    labels = spark.read.parquet(f"{BIG}/labels.parquet").select("doc_id", "quality")
    rows = rules.judge(docs).where("not base_failed").join(labels, "doc_id").collect()
    good, bad = [r["kept"] for r in rows if r["quality"] == 1], [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.2 * len(bad)


def test_rules_accept_the_rows_they_judge(docs):
    kept = {r["doc_id"] for r in rules.judge(docs).where("kept").collect()}
    out = rules.accept(docs)
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == kept


def test_rules_inverse(spark):
    import numpy as np
    from pyspark.sql import functions as F

    a = np.random.default_rng(0).normal(size=(6, 6))
    a = a @ a.T + np.eye(6)
    got = spark.range(1).select(rules.swept(F.array(*(F.array(*(F.lit(float(v)) for v in r)) for r in a))).alias("i")).first()["i"]
    assert np.allclose(np.array(got["inverse"]), np.linalg.inv(a)) and got["log_det"] == pytest.approx(np.linalg.slogdet(a)[1])


def _plain_estimate(x):
    """The estimate of one group in plain NumPy: mean and inverse of the covariance."""
    import numpy as np

    floor = np.diag(np.array(list(rules.FLOOR.values())) ** 2)
    far = lambda x, mu, inv: np.einsum("ni,ij,nj->n", x - mu, inv, x - mu)
    quartiles = np.sort(x, 0)[[int(np.ceil(q * len(x))) - 1 for q in (0.25, 0.5, 0.75)]]
    spread = np.diag(((quartiles[2] - quartiles[0]) / 1.349) ** 2)
    best = None
    for mu, cov in ((quartiles[1], spread + floor), (quartiles[1], floor), (x.mean(0), np.cov(x.T, bias=True) + floor)):
        for _ in range(rules.STEPS):
            bins = np.floor(16 * np.log2(1 + far(x, mu, np.linalg.inv(cov))))
            kept = x[[np.sum(bins < v) < rules.KEEP * len(x) for v in bins]]
            mu, cov = kept.mean(0), rules.consistent(rules.KEEP) * np.cov(kept.T, bias=True) + floor
        if best is None or np.linalg.slogdet(cov)[1] < best[0] - 1e-9:
            best = np.linalg.slogdet(cov)[1], mu, cov
    fits = x[far(x, best[1], np.linalg.inv(best[2])) <= rules.chi_square_at(rules.FITS, 6)]
    return fits.mean(0), np.linalg.inv(rules.consistent(rules.FITS) * np.cov(fits.T, bias=True) + floor)


def test_rules_estimates_against_numpy(spark):
    """A group of its own with a third of far rows, one that uses its language's estimate, and one that uses that of all."""
    import numpy as np

    r = np.random.default_rng(3)
    x = r.normal(size=(560, 6)) @ r.normal(size=(6, 6)) + 2
    x[:100] = r.normal(size=(100, 6)) * 0.1 + 40
    of = [("en", "a")] * 300 + [("en", "b")] * 90 + [("fr", "a")] * 150 + [(None, "a")] * 20
    schema = "lang string, source string, base_failed boolean, " + ", ".join(f"{k} double" for k in rules.X)
    rows = spark.createDataFrame([(*k, False, *map(float, v)) for k, v in zip(of, x, strict=True)] + [("en", "a", True, *[9.0] * 6)], schema)
    got = {(e["lang"], e["source"]): (e["mu"], e["inv"]) for e in rules.estimates(rows.repartition(3))[0].collect()}
    lang = np.array([k[0] or "" for k in of])
    want = {("en", "a"): x[:300], ("en", "b"): x[lang == "en"], ("fr", "a"): x, (None, "a"): x}
    assert set(got) == set(want)
    for k, v in want.items():
        mu, inv = _plain_estimate(v)
        assert np.allclose(got[k][0], mu) and np.allclose(np.array(got[k][1]), inv)
    assert all(np.linalg.norm(got["en", "a"][0] - y) > 20 for y in x[:100])


def test_rules_reject_junk_that_fills_a_third_of_a_group_or_is_a_language_of_its_own(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "text", "lang", "source")
    junk = "BUY $$$ NOW!!! " + " ".join(f"#win{k} *free*" for k in range(60)) + " !!!"
    many = [(100_000 + k, junk, "en", "src0") for k in range(docs.where("lang = 'en' and source = 'src0'").count() // 2)]
    more = spark.createDataFrame([*many, (99_999, junk, "xx", "src1")], docs.schema)
    kept = {r["doc_id"]: r["kept"] for r in rules.judge(docs.union(more)).collect()}
    assert not any(v for k, v in kept.items() if k >= 99_999) and sum(kept.values()) > 800


def test_quality_on_held_out_labels(spark):
    rows = quality.classify(spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet"))
    rows = rows.where("held_out").join(spark.read.parquet(f"{BIG}/labels.parquet"), "doc_id").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.93 * len(rows)


def test_quality_against_plain_numpy(spark):
    """Scores of every document from densities that are computed one by one."""
    import numpy as np

    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")
    x = {r["doc_id"]: np.array(quality.statistics(r["text"])) for r in docs.collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    taught = [(r["doc_id"], r["quality"]) for r in labels.collect() if r["quality"] in (0, 1) and r["doc_id"] in x and not held(r["doc_id"])]
    sets = [np.array([x[i] for i, y in taught if y == c]) for c in (0, 1)]
    own = [np.cov(s.T, bias=True) for s in sets]
    pooled = sum(len(s) * c for s, c in zip(sets, own, strict=True)) / len(taught)
    d = len(quality.NAMES)
    classes = []
    for s, c in zip(sets, own, strict=True):
        c = (1 - quality.SHRINK_POOLED - quality.SHRINK_DIAGONAL) * c + quality.SHRINK_POOLED * pooled
        c += quality.SHRINK_DIAGONAL * np.diag(np.diag(pooled) + quality.RIDGE**2) + quality.RIDGE**2 * np.eye(d)
        classes.append((s.mean(0), np.linalg.inv(c), np.linalg.slogdet(c)[1]))
    share = len(sets[1]) / len(taught)
    for r in quality.classify(docs, labels).collect():
        low, high = (-0.5 * (x[r["doc_id"]] - m) @ i @ (x[r["doc_id"]] - m) - 0.5 * g for m, i, g in classes)
        want = 1 / (1 + np.exp(-np.clip(quality.TEMPER * (high - low) + np.log(share / (1 - share)), -700, 700)))
        assert r["score"] == pytest.approx(want, abs=1e-6) and r["held_out"] == held(r["doc_id"]) and r["predicted"] == (r["score"] >= 0.7)


def test_quality_edges(spark, docs, nothing):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (5, 7)], "doc_id long, quality int")
    found = quality.classify(docs, labels).collect()
    assert len(found) == docs.count() and all(0 <= r["score"] <= 1 for r in found)
    assert quality.classify(nothing, labels).count() == 0
    assert {r["score"] for r in quality.classify(docs, labels.where("false")).collect()} == {0.5}


def _brute_lines(rows, threshold=lines.THRESHOLD):
    """Lines left, by comparing each line with all before it."""
    seen, left = [], []
    for doc_id, text in sorted(rows):
        out = []
        for line in text.split("\n"):
            w = WORD.findall(line)
            s = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
            if not s:
                out.append(line)
                continue
            if not any(len(s & t) >= threshold * len(s | t) for t in seen):
                out.append(line)
            seen.append(s)
        left.append((doc_id, "\n".join(out)))
    return left


def test_lines_against_brute_force(spark):
    import random

    r = random.Random(4)
    vocabulary = [f"w{k}" for k in range(60)]
    base = [[r.choice(vocabulary) for _ in range(r.choice([1, 2, 4, 5, 6, 30, 60, 90]))] for _ in range(40)]
    rows = []
    for i in range(120):
        chosen = []
        for _ in range(r.randint(0, 5)):
            line = list(r.choice(base))
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                line[r.randrange(len(line))] = r.choice(vocabulary)
            chosen.append(" ".join(line))
            if r.random() < 0.1:
                chosen.append(" ")
        rows.append((i, "\n".join(chosen)))
    got = lines.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).select("doc_id", "text").collect()
    assert sorted(map(tuple, got)) == _brute_lines(rows)


def test_line_counts_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in lines.dedup_counts(docs).collect()}
    for i, left in _brute_lines(rows):
        n = len(dict(rows)[i].split("\n"))
        n_left = 0 if found[i][2] == n else len(left.split("\n"))
        assert found[i] == (left, n, n - n_left)


def test_lines_edges(docs, texts, nothing):
    out = lines.dedup(docs)
    assert out.columns == docs.columns and out.count() == len(texts)
    assert lines.dedup(nothing).count() == 0
    assert [r["text"] for r in out.select("doc_id", "text").where("doc_id = 1000").collect()] == [None]


def _brute_print(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, texts):
    found = simhash.near_duplicates(docs).collect()
    want = [(i, _brute_print(x)) for i, x in texts]
    assert Counter((r["doc_id"], r["fp"] % (1 << 64)) for r in found) == Counter(want)
    root = {i: i for i, _ in want}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(want):
        for j, b in want[:k]:
            if (a ^ b).bit_count() <= 2:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    assert {(r["doc_id"], r["component_id"]) for r in found} == {(i, find(i)) for i, _ in want}


def test_simhash_links_are_complete(spark):
    import random

    r = random.Random(2)
    prints = {r.getrandbits(64) for _ in range(200)}
    for x in list(prints):
        for _ in range(4):
            for b in r.sample(range(64), r.randint(1, 3)):
                x ^= 1 << b
            prints.add(x)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in prints]
    got = {tuple(x) for x in simhash.links(spark.createDataFrame(signed, "fp long")).collect()}
    want = {(min(a, b), max(a, b)) for (a,) in signed for (b,) in signed if a != b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2}
    assert got == want


def test_winnowing(docs, texts):
    """Every column against a plain version; one id is there twice, with one text."""
    found = winnowing.next_edits(docs).collect()
    rows = sorted(((i, x or "") for i, x in texts), reverse=True)
    chosen = lambda x: {y.split(":")[1] for y in winnowing.fingerprint(x)[0].split()}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    want = Counter()
    for k, (i, x) in enumerate(rows):
        other = rows[(k + 1) % len(rows)][1]
        half = len(x) // 2
        edited = x[: len(x) - half] + other[:half]
        near = (round(like(chosen(x), chosen(edited)), 9), round(like(chosen(x), chosen(other)), 9))
        want[i, len(x), hashlib.sha256(edited.encode()).hexdigest(), winnowing.fingerprint(x)[0], winnowing.fingerprint(edited)[0], *near] += 1
    assert Counter((*tuple(r)[:5], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in found) == want


def test_winnowing_guarantee():
    """A run of GRAM + WINDOW - 1 code points in two texts gives a chosen hash that both have."""
    import random

    r = random.Random(5)
    make = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    for _ in range(200):
        run = make(winnowing.GRAM + winnowing.WINDOW - 1)
        a, b = (make(r.randint(0, 200)) + run + make(r.randint(0, 200)) for _ in range(2))
        (_, x), (_, y) = winnowing.fingerprint(a), winnowing.fingerprint(b)
        assert winnowing.likeness(x, y) > 0


@pytest.mark.parametrize("text", ["", "a", "abcdef" * 3, "abc " * 200, "".join(chr(97 + k * k % 26) for k in range(700))])
def test_winnowing_against_a_loop(text):
    h = []
    gram = min(winnowing.GRAM, len(text))
    for k in range(len(text) - gram + 1 if text else 0):
        v = 0
        for c in text[k : k + gram]:
            v = (v * winnowing._BASE + ord(c) + 1) % (1 << 64)
        v ^= v >> 29
        h.append(v * winnowing._MIX % (1 << 64) >> 32)
    w = min(winnowing.WINDOW, len(h))
    chosen = []
    for k in range(len(h) - w + 1 if h else 0):
        least = min(h[k : k + w])
        at = max(j for j in range(k, k + w) if h[j] == least)
        if not chosen or chosen[-1] != at:
            chosen.append(at)
    assert winnowing.fingerprint(text)[0] == " ".join(f"{p:x}:{h[p]:08x}" for p in chosen)


def test_winnowing_of_one_and_none(spark, nothing):
    one = winnowing.next_edits(spark.createDataFrame([(3, "abcd")], "doc_id long, text string")).collect()
    assert one[0]["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and one[0]["near_next"] == 1
    assert winnowing.next_edits(nothing).count() == 0


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    model = langid.train(docs)
    rows = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    own = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["lang_pred"] != "und"]
    assert sum(r["lang"] == r["lang_pred"] for r in own) >= 0.99 * len(own)


def test_language_edges(docs, texts, nothing):
    model = langid.train(docs)
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert {got[i]["lang_pred"] for i in (1000, 1001, 1002, 1005)} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.train(nothing)["langs"] == [] and langid.predict(nothing, model).count() == 0
    assert langid.accept(docs, model).columns == docs.columns and langid.accept(docs, model).where("doc_id in (1000, 1005)").count() == 0


def test_language_accepts_only_what_it_knows(spark):
    import random

    r = random.Random(6)
    docs = spark.read.parquet(f"{BIG}/documents.parquet").where("n_chars > 400 and lang in ('en', 'fr')")
    model = langid.train(docs)
    one = {x["lang"]: x["text"] for x in docs.where("doc_id % 5 = 2").collect()}
    half = min(len(one["en"].encode()), len(one["fr"].encode())) // 2
    odd = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz   ") for _ in range(800)), "Съешь ещё этих мягких французских булок да выпей чаю. " * 15, one["en"][:half] + " " + one["fr"][:half]]
    rows = spark.createDataFrame([(900_000 + k, x, "en", "s", len(x)) for k, x in enumerate(odd)], docs.schema)
    kept = {x["doc_id"] for x in langid.accept(docs.union(rows), model).collect()}
    assert not kept & {900_000, 900_001, 900_002} and len(kept) >= 0.99 * docs.count()


def test_code_lengths_are_those_of_the_trees():
    """Against a slow walk through dictionaries of counts."""
    import math

    import pandas as pd

    corpus = {"aa": b"abracadabra abra", "bb": b"hello world hello"}
    rows = []
    for lang, raw in corpus.items():
        for size in range(1, 5):
            for g, n in Counter(int.from_bytes(raw[k : k + size], "big") for k in range(len(raw) - size + 1)).items():
                rows.append((lang, size, g, n))
    model = langid.costs(pd.DataFrame(rows, columns=["lang", "size", "gram", "n"]), 3)

    def cost(raw, context, byte):
        for k in range(len(context), -1, -1):
            tail = context[len(context) - k :]
            next_ = Counter(raw[j + k] for j in range(len(raw) - k) if raw[j : j + k] == tail)
            if not next_:
                continue
            total, kinds = sum(next_.values()), len(next_)
            if byte in next_:
                return math.log2((total + kinds) / next_[byte]) + sum(cost.escapes)
            cost.escapes.append(math.log2((total + kinds) / kinds))
        return 8 + sum(cost.escapes)

    for text in ("abra hello", "x", "abracadabrz", "wor"):
        raw = text.encode()
        want = []
        for lang in ("aa", "bb"):
            bits = 0.0
            for k in range(len(raw)):
                cost.escapes = []
                bits += cost(corpus[lang], raw[max(0, k - 3) : k], raw[k])
            want.append(bits)
        assert langid.code_lengths(model, text) == pytest.approx(want, rel=1e-4)
        assert langid._batch_lengths(model, ["zz", text])[1] == pytest.approx(want, rel=1e-4)


def test_rows_without_an_id_are_sampled_one_by_one(spark):
    rows = spark.range(4000).selectExpr("cast(null as long) doc_id", "concat('text ', id) text", "if(id % 4 = 0, 'a', 'b') lang")
    got = {r["lang"]: r["count"] for r in langid.sample(rows, 300).groupBy("lang").count().collect()}
    assert got.keys() == {"a", "b"} and all(200 < n < 400 for n in got.values())
    assert langid.sample(rows, 5000).count() == 4000 and langid.sample(rows.where("false")).count() == 0


def test_sharding(docs, texts):
    rows, slot_map = sharding.shard(docs, n_shards=5, n_slots=256)
    found = rows.collect()
    want = Counter((i, len((x or "").encode()) + 16, zlib.crc32((x or "").encode())) for i, x in texts)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == want
    for s in range(5):
        assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(sum(r["shard"] == s for r in found)))
    load = Counter()
    for r in found:
        load[r["shard"]] += r["size"]
    assert max(load.values()) - min(load.values()) <= max(n for _, n, _ in want)
    assert slot_map.count() == 256


def test_forty_shards_of_heavy_and_repeated_records(spark):
    """Sizes near equal by the production parameters, with a third of the rows alike, and a few heavy ones."""
    rows = [(k, "x" * (k * 7919 % 3000)) for k in range(9000)] + [(5, "y" * 900)] * 4500 + [(20_000 + k, "z" * 60_000) for k in range(6)]
    found = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"))[0].groupBy("shard").agg({"size": "sum", "slot": "max", "*": "count"}).collect()
    load = [r["sum(size)"] for r in found]
    assert len(found) == 40 and sum(load) == sum(len(x) + 16 for _, x in rows)
    assert max(load) <= 1.02 * min(load) and all(r["max(slot)"] == r["count(1)"] - 1 for r in found)


def test_maps_are_kept_by_version(spark, docs, tmp_path):
    folder = str(tmp_path / "map")
    rows, first = sharding.shard(docs, 5, 256, folder=folder)
    slots = sharding.slot_bytes(sharding.records(docs, 256), 256)
    sharding.save_map(sharding.grow(first, slots, 5, 1), folder)
    sharding.save_map(sharding.move(sharding.load_map(spark, folder), {3: 0, 9: 0}, 2), folder)
    latest = {r["vslot"]: (r["version"], r["shard"]) for r in sharding.load_map(spark, folder).collect()}
    assert latest[3] == latest[9] == (2, 0) and {v for v, _ in latest.values()} == {2}
    assert {tuple(r) for r in sharding.load_map(spark, folder, 0).collect()} == {tuple(r) for r in first.collect()}
    placed = sharding.place(sharding.records(docs, 256), sharding.load_map(spark, folder))
    assert all(r["shard"] == latest[r["vslot"]][1] for r in placed.collect())
    with pytest.raises(Exception, match="(?i)already exists"):
        sharding.save_map(first, folder)


def test_growing_moves_slots_into_the_new_shard_only(docs):
    rows = sharding.records(docs, 256)
    slots = sharding.slot_bytes(rows, 256)
    old = sharding.first_map(slots, 5)
    new = {r["vslot"]: r["shard"] for r in sharding.grow(old, slots, 5, 1).collect()}
    before = {r["vslot"]: r["shard"] for r in old.collect()}
    moved = [k for k in before if before[k] != new[k]]
    assert moved and {new[k] for k in moved} == {5}


def test_sharding_of_nothing(nothing):
    assert sharding.shard(nothing, 5, 256)[0].count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_parts_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{BIG}/documents.parquet'")
    got, want = queries.QUERIES[name](spark, BIG), con.sql(queries.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(tuple(r[k] for k in at) for r in want.fetchall())


def test_lines_are_made_tokens_of_only_where_pairs_are_left(spark, monkeypatch):
    """Lines whose lengths are too far apart, and lists that their first line settles, are not read again."""
    import random

    r, seen, real = random.Random(9), [], lines.tokens_of
    monkeypatch.setattr(lines, "tokens_of", lambda docs, positions: (seen.append(positions.distinct().count()), real(docs, positions))[1])
    new = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    base, rows = new(60), []
    for k in range(8):  # a rare passage alone, and with a long rest: too far apart to be similar
        passage = new(6)
        rows += [(k, " ".join(passage)), (50 + k, " ".join(passage + r.sample(base, 40)))]
    rows += [(100 + k, " ".join([*base, f"end{k}"])) for k in range(30)]  # all settled by the first
    got = lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "text").collect()
    assert sorted(map(tuple, got)) == _brute_lines(rows)
    assert seen[0] == 30 and sum(seen[1:]) == 0


def test_long_unlike_lines_that_share_a_token_are_told_apart_by_their_parities(spark, monkeypatch):
    """Lines of 200 words with one rare passage in common: no pair of them is joined with tokens, and a similar one is still found."""
    import random

    r, seen, real = random.Random(5), [], lines._verified
    monkeypatch.setattr(lines, "_verified", lambda pairs, *more: (seen.append(pairs.count()), real(pairs, *more))[1])
    vocabulary, passage = [f"w{k}" for k in range(50)], [f"rare{k}" for k in range(5)]
    unlike = [passage + [r.choice(vocabulary) for _ in range(200 + k)] for k in range(12)]
    rows = [(k, " ".join(w)) for k, w in enumerate(unlike)]
    got = lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "text").collect()
    assert sorted(map(tuple, got)) == sorted(rows) and sum(seen) == 0
    rows += [(50, " ".join([*unlike[7][:-1], "end"]))]
    got = lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "text").collect()
    assert sorted(map(tuple, got)) == _brute_lines(rows) and sum(seen) > 0
