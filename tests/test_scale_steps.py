"""Steps that grow with the input: texts are looked at once, and no task gets a whole table."""

import re
from collections import Counter
from hashlib import md5

from pyspark.sql import functions as F

from sparkstill.functions import features
from sparkstill.operators import labels
from sparkstill.plans import registry


def test_fingerprints_against_plain_python(spark):
    texts = [None, "", "one", "One two", "a" * 27 + " " + "b" * 27, "a" * 27 + " " + "b" * 28, "x" * 300 + " y z", "é a-b KK İ9", "a b " * 400]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(2)
    for size in (1, 2, 3):
        found = {r["id"]: [tuple(p) for p in r["p"]] for r in rows.select("id", features.pairs(F.col("text"), 512, size).alias("p")).collect()}
        for k, x in enumerate(texts):
            w = re.findall("[a-z0-9]+", (x or "").lower())
            n = Counter(int(md5(" ".join(s).encode()).hexdigest()[:8], 16) % 512 for s in zip(*(w[j:] for j in range(size)), strict=False))
            assert found[k] == [(i, min(c, 255)) for i, c in sorted(n.items())], (size, k)
    assert rows.where("false").select(features.pairs(F.col("text"))).collect() == []


def test_prepared_labels_are_a_table(spark):
    """The checks and the result read what was written: fingerprints are not made again for each."""
    docs = spark.createDataFrame([(k, f"some words of text {k}") for k in range(8)], "doc_id long, text string")
    library = features.fingerprint(docs, "doc_id", "text").withColumnRenamed("row_id", "doc_id")
    found = labels.prepare_binary(docs.select("doc_id", (F.col("doc_id") % 2).alias("q")), library, "doc_id", "q")
    assert found.count() == 8 and found.inputFiles() and all("prepared-" in f for f in found.inputFiles())


def test_a_library_of_several_files_keeps_their_order(spark, tmp_path):
    """Files are read in the order of their names, not as Spark deals them to one task (large ones first)."""
    for k, n in enumerate((1, 40, 400)):
        rows = [(1000 * k + j, " ".join(f"w{k}x{j}y{i}" for i in range(n))) for j in range(2)]
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / f"part-{k}"))
    (tmp_path / "documents.parquet").mkdir()
    for k in range(3):
        next((tmp_path / f"part-{k}").glob("part-*.parquet")).rename(tmp_path / "documents.parquet" / f"{k}.parquet")
    found = registry.library_fingerprints(spark, str(tmp_path)).groupBy("row_id").agg(F.sum("c").alias("n")).collect()
    assert {r["row_id"]: r["n"] for r in found} == {2: 39, 3: 39, 4: 399, 5: 399}  # texts of one word have no pair


def test_many_anchors_are_looked_up_in_batches(spark):
    """By a search over batches (the plan has no filter over the anchors), with the values of the plain formula."""
    import numpy as np

    from sparkstill.functions.scalars import interpolate

    xs = np.sort(np.random.default_rng(5).normal(size=200))
    ys = np.sort(np.random.default_rng(6).normal(size=200))
    asked = [None, float("nan"), float("inf"), -float("inf"), *xs[[0, 7, 199]].tolist(), *np.linspace(-4, 4, 50).tolist()]
    for sign in (1, -1):
        df = spark.createDataFrame([(x,) for x in asked], "x double").withColumn("y", interpolate(F.col("x"), xs.tolist(), ys.tolist(), sign))
        assert "ArrowEvalPython" in df._jdf.queryExecution().toString()
        for r in df.collect():
            if r["x"] is None:
                assert r["y"] is None
            else:
                want = ys[-1] if r["x"] != r["x"] else np.interp(sign * r["x"], xs, ys)
                assert abs(r["y"] - want) < 1e-12
