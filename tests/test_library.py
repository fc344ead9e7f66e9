"""Libraries with fingerprints: blocks, ledger and settings."""

import pytest

from sparkstill.functions import features
from sparkstill.sources import library, tables


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('lib')}/in.parquet"
    rows = [(f"text {k} of the {k % 7} kinds",) for k in range(95)] + [("",), (None,), ("text 3 of the 3 kinds",)]
    spark.createDataFrame(rows, "smiles string").coalesce(1).write.parquet(path)
    return path


def _all(df):
    return sorted((r["row_id"], r["text"], tuple(map(tuple, r["pairs"]))) for r in df.collect())


def test_a_build_that_is_cut_off_goes_on(spark, source, tmp_path):
    whole = _all(library.build(spark, source, f"{tmp_path}/a", distinct=True, width=64, block_rows=20))
    assert [r[0] for r in whole] == list(range(95)) and all(r[2] for r in whole)

    class Off(Exception):
        pass

    def cut_off(k):
        if k == 1:
            raise Off

    with pytest.raises(Off):
        library.build(spark, source, f"{tmp_path}/b", distinct=True, width=64, block_rows=20, after_block=cut_off)
    with pytest.raises(library.LibraryError, match="3 blocks are missing"):
        library.read(spark, f"{tmp_path}/b")
    made = []
    again = library.build(spark, source, f"{tmp_path}/b", distinct=True, width=64, block_rows=20, after_block=made.append)
    assert made == [2, 3, 4] and _all(again) == whole


def test_other_settings_are_refused(spark, source, tmp_path):
    library.build(spark, source, f"{tmp_path}/a", width=64, block_rows=50)
    with pytest.raises(library.LibraryError, match="other settings"):
        library.build(spark, source, f"{tmp_path}/a", width=128, block_rows=50)
    with pytest.raises(library.LibraryError, match="asked for"):
        library.read(spark, f"{tmp_path}/a", 128)
    # files of another fingerprint under the same ledger
    rows = spark.read.parquet(f"{tmp_path}/a/texts")
    for k in (0, 1):
        features.TextPairs("text", "pairs", 32).transform(rows.where(f"row_id div 50 = {k}")).write.mode("overwrite").parquet(f"{tmp_path}/a/rows/block={k}")
    with pytest.raises(library.LibraryError, match="the files have"):
        library.read(spark, f"{tmp_path}/a")
    with pytest.raises(library.LibraryError, match="no library"):
        library.read(spark, f"{tmp_path}/none")


def test_an_empty_library(spark, tmp_path):
    spark.createDataFrame([("",)], "smiles string").write.parquet(f"{tmp_path}/in.parquet")
    assert library.build(spark, f"{tmp_path}/in.parquet", f"{tmp_path}/a", width=8).count() == 0
    assert tables.load_json(spark, f"{tmp_path}/a/ledger")["n_rows"] == 0
