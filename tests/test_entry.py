"""The driver's contract: every query against its SQL in DuckDB, on the smallest tables; and the library without its text operators."""

import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return round(v, 9) + 0.0
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql()))
def test_equals_sql(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    sql = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in sql.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    got = sorted((tuple(norm(r[c]) for c in order) for r in df.collect()), key=str)
    assert got == sorted((tuple(norm(r[columns.index(c)]) for c in order) for r in sql.fetchall()), key=str)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_without_text_operators(tmp_path):
    """The rest imports when the subpackage and the pipeline are gone."""
    import shutil
    from pathlib import Path

    home = Path(entry.__file__).parent
    shutil.copytree(home / "tidepool", tmp_path / "tidepool", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(home / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'hybrid_rrf' in q and not any(n.startswith('op') for n in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
