import random

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    """The sf0.001 documents with a null text, an empty one, white space, a long text, an exact copy and a repeated row; further columns clash."""
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    long_ = " ".join(random.Random(1).choice(["alpha", "beta,", "gamma\n", "Δelta", "42", "  ", "it's"]) for _ in range(30_000))
    copied = base.where("doc_id = 7").first()
    extra = [
        (1000, None, "en", "src1", None),
        (1001, "", None, "src1", 0),
        (1002, " \n\t ", "en", None, 4),
        (1003, long_, "en", "src1", len(long_)),
        (1004, copied["text"], "en", "src2", copied["n_chars"]),
        (1004, copied["text"], "en", "src2", copied["n_chars"]),
        (1005, "12345 !!! ...", "fr", "src2", 13),
        (1006, "日本語 text’s  a   b\r\n\r\n x", "fr", "src2", 25),
    ]
    from pyspark.sql import functions as F

    more = spark.createDataFrame(extra, base.schema)
    out = base.union(more)
    for name in ("size", "piece", "fp", "row", "k", "cell", "shard", "slot", "part", "x", "letter", "stats", "lines", "_id", "key", "n", "length", "bin", "a", "b"):
        out = out.withColumn(name, F.lit("clash"))
    return out.cache()


@pytest.fixture(scope="session")
def texts(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.where("false")
