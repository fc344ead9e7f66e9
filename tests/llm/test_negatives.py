"""Hard negatives against a plain search over all pairs."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkstill.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<double>, uid string, j int, v string, score double"


def plain(rows):
    """The result over (vec_id, label, vector) tuples, each row its own."""
    fine = [(i, (l + 1) % 10 if i is not None and i % 7 == 0 else l, [math.floor(256 * x) for x in v]) for i, l, v in rows if l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    last = lambda i: (i is None, i or 0)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = Counter()
    for a, (i, l, v) in enumerate(fine):
        if i is None or i % 50:
            continue
        scored = sorted(((dot(v, w), j, m, b) for b, (j, m, w) in enumerate(fine) if b != a), key=lambda x: (-x[0], last(x[1])))
        for p in [x for x in scored if x[2] == l][:5]:
            found = [x for x in scored if x[2] != l and 50 * p[0] <= 100 * x[0] <= 95 * p[0]][:3]
            for k, x in enumerate(found):
                out[i, p[1], k + 1, x[1], p[0], x[0]] += 1
    return out


def found(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 1, "clash", 0.5) for r in rows], SCHEMA).repartition(3)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return Counter(tuple(r) for r in negatives.mine(df, label, F.col("vec_id") % 50 == 0).collect())


def vectors(n, width, seed, spread=0.12, labels=4):
    r = random.Random(seed)
    base = [[r.gauss(0, spread) for _ in range(width)] for _ in range(labels)]
    out = []
    for i in range(n):
        l = r.randrange(labels)
        out.append((i, l, [x + r.gauss(0, spread / 2) for x in base[l]]))
    return out


def test_equals_a_plain_search(spark):
    rows = vectors(700, 16, 1)
    # ties and repeats: one vector in a third of the rows, of several labels
    same = rows[3][2]
    rows = [(i, l, same if i % 3 == 0 else v) for i, l, v in rows]
    # an anchor that is there twice, rows that take no part, a row without an id, short and empty vectors
    rows += [rows[50], rows[50], (None, 1, rows[7][2]), (900, None, same), (950, 1, None), (1001, 2, [float("nan")] * 16), (1002, 2, [float("inf")] * 16), (1003, 2, [0.1, None]), (1004, 1, [0.5] * 3), (1050, 2, [])]
    want = plain(rows)
    assert want and found(spark, rows) == want


@pytest.mark.parametrize("scale", [3000.0, 3e6])
def test_large_components(spark, scale):
    """Sums beyond 24 and beyond 53 bits."""
    rows = [(i, l, [x * scale for x in v]) for i, l, v in vectors(150, 6, 2)]
    want = plain(rows)
    assert want and found(spark, rows) == want


def test_scores_that_do_not_fit_are_refused(spark):
    with pytest.raises(ValueError, match="62 bits"):
        found(spark, [(50, 1, [1e12, 1.0]), (2, 1, [1e12, 1.0])])


def test_nothing_gives_nothing(spark):
    assert not found(spark, []) and not found(spark, [(50, 1, [0.5])]) and not found(spark, [(1, 1, [0.5]), (2, 2, [0.5])])


def test_planes_add_up_and_intervals_hold():
    import numpy as np

    r = np.random.default_rng(0)
    v, a = r.integers(-200, 200, (50, 8)), r.integers(-90, 90, (1, 8))
    sliced, worth = negatives.planes(v, 8)
    assert (sum(w * p for p, w in zip(sliced, worth, strict=True)) == v).all()
    part, whole = np.zeros(50, int), (a @ v.T)[0]
    for p, w in zip(sliced, worth, strict=True):
        part = part + w * (a @ p.T)[0]
        left = abs(w) - 1
        assert (part + left * np.minimum(a, 0).sum() <= whole).all() and (whole <= part + left * np.maximum(a, 0).sum()).all()


def test_few_rows_are_scored_to_the_last_plane():
    """Rows whose intervals cannot qualify are dropped on the way, and none that qualifies is."""
    import numpy as np

    rows = vectors(3000, 32, 5)
    v = np.array([[math.floor(256 * x) for x in r[2]] for r in rows])
    labels = np.array([r[1] for r in rows])
    own = np.arange(64)
    seen = []

    def counted(at, low, high, stay):
        keep = negatives.same_label(labels[:64], labels, own, 5)(at, low, high, stay)
        seen.append(keep.mean())
        return keep

    x, y, s = negatives.best_rows(v[:64], v, int(np.abs(v).max()).bit_length(), counted)
    assert len(x) < 0.01 * 64 * 3000 and seen[0] > seen[-1]
    scores = v[:64] @ v.T
    for a in range(64):
        fits = np.where((labels == labels[a]) & (np.arange(3000) != a), scores[a], -(1 << 60))
        assert set(np.argsort(-fits, kind="stable")[:5]) <= set(y[x == a])
    assert (s == scores[x, y]).all()
