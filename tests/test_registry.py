"""Every query with SQL against DuckDB, and the repository without the corpus operators."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from sparkstill.plans import registry

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).parent.parent


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def _norm(v):
    return ("nan" if v != v else v + 0.0) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    found = duck.sql(registry.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    at = [found.columns.index(c) for c in columns]
    got = sorted(repr([_norm(r[c]) for c in columns]) for r in df.collect())
    assert got == sorted(repr([_norm(r[k]) for k in at]) for r in found.fetchall())


def test_entry_without_the_corpus_operators(tmp_path):
    """The guard: neither corpus_pipeline.py nor the llm folder is there."""
    for p in ROOT.iterdir():
        if p.name in ("__spark_entry__.py",):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "sparkstill").mkdir()
    for p in (ROOT / "sparkstill").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "sparkstill" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') for k in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
