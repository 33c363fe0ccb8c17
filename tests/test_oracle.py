"""Every registered query against its SQL, on the smallest data."""

import duckdb
import pytest

import __spark_entry__ as registry
from newsloom.plans import queries as engine

TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def shown(v):
    return round(v, 6) if isinstance(v, float) else v


def rows(names, tuples):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(shown(t[k]) for k in order) for t in tuples), key=repr)


@pytest.mark.parametrize("name", sorted(engine.ORACLE_SQL))
def test_query_equals_sql(spark, con, sf_dir, name):
    df = engine.QUERIES[name](spark, sf_dir)
    want = con.sql(engine.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_registry(spark):
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert registry.entry(spark).count() > 0


def test_import_without_corpus_folders(tmp_path):
    """The registry works where the corpus subpackage and its pipeline are gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(registry.__file__).parent
    shutil.copytree(root / "newsloom", tmp_path / "newsloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'top_scored' in q and not any(n.startswith('op1_') for n in q); e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True).returncode == 0
