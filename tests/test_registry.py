"""Every registered query against its SQL, over the smallest tables."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from parcelspark.plans.registry import ORACLE_SQL, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    v = v.tolist() if hasattr(v, "tolist") else v
    return repr(v + 0.0) if isinstance(v, float) else repr(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    rows = [r.asDict() for r in df.collect()]
    if name not in ORACLE_SQL:
        assert rows
        return
    cur = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in cur.description]
    want = [dict(zip(columns, r, strict=True)) for r in cur.fetchall()]
    assert sorted(df.columns) == sorted(columns)
    key = lambda r: tuple(plain(r[c]) for c in sorted(columns))
    assert sorted(map(key, rows)) == sorted(map(key, want))


def _names(folder, before=""):
    """The queries' names that a copy of the repository gives."""
    code = f"import sys; sys.path[0] = {str(folder)!r}; {before}import __spark_entry__ as e; print(*e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    out = subprocess.run([sys.executable, "-c", code], cwd=folder, env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True, check=True)
    return set(out.stdout.split())


def test_without_corpus_operators(spark, tmp_path):
    """The other queries are there without the corpus operators' folders and file, and without a library of theirs."""
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["id", "ranking_score"]
    root = Path(__file__).parents[1]
    shutil.copytree(root / "parcelspark", tmp_path / "parcelspark", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    if (root / "parcelspark/llm").exists() and (root / "corpus_pipeline.py").exists():
        shutil.copy(root / "corpus_pipeline.py", tmp_path)
        assert _names(tmp_path) == set(e.queries()) and "pipeline" in e.queries()
        assert set(QUERIES) < _names(tmp_path, "sys.modules['tiktoken'] = None; ") < set(e.queries())
        (tmp_path / "corpus_pipeline.py").unlink()
        shutil.rmtree(tmp_path / "parcelspark/llm")
    assert _names(tmp_path) == set(QUERIES)
