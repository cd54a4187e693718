"""Registered queries against DuckDB on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from foliant.plans.queries import ORACLE_SQL, QUERIES

TABLES = "events documents embeddings pages benchmark labels conversations".split()


def rows(df: pd.DataFrame):
    own = df[sorted(df.columns)]
    plain = lambda x: None if x is None or x is pd.NaT or (isinstance(x, float) and math.isnan(x)) else x if isinstance(x, int | bool | float) else str(x)
    return sorted((tuple(map(plain, r)) for r in own.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toArrow()
    if name not in ORACLE_SQL:
        assert got.num_rows
        return
    want = duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.column_names) == sorted(want.columns)
    assert rows(got.to_pandas(integer_object_nulls=True)) == rows(want.astype(object).where(want.notna(), None))


def test_entry_stands_without_the_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    top = Path(__file__).parents[1]
    shutil.copytree(top / "foliant", tmp_path / "foliant", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(top / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'bm25_topk' in e.queries() and not [k for k in e.queries() if k.startswith('op') or k == 'pipeline']; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
