"""Every registered query of the library against its SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from pantryline.plans import registry

SF = "/root/testdata/sf0.001"


def plain(df: pd.DataFrame) -> list[str]:
    """Rows as sorted texts, numbers rounded."""

    def one(v):
        if v is None or (not isinstance(v, (list, dict)) and pd.isna(v)):
            return None
        return round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v)

    return sorted(str([one(v) for v in r]) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in os.listdir(SF):
        con.execute(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, tables, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name not in registry.SQL:
        assert len(got.columns)
        return
    want = tables.sql(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_flagship_and_entry(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert 0 < len(rows) <= 10 and set(rows[0].asDict()) == {"category", "n"}
    assert set(e.oracle_sql()) <= set(e.queries()) and set(registry.QUERIES) <= set(e.queries())


def test_the_entry_stands_alone(tmp_path):
    """Without the corpus operators and their pipeline, or with what is left of a deleted folder, all other queries are there."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/pantryline", tmp_path / "pantryline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and set(e.oracle_sql()) <= set(q) and not any(x.startswith('op') or x == 'pipeline' for x in q)"
    for left in ((), ("pantryline/llm/__pycache__",)):
        for x in left:
            (tmp_path / x).mkdir(parents=True)
        env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env)
