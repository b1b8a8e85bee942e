"""Every registered query of the alignment operators: against its SQL, or for rows and a stable schema."""

import os

import duckdb
import pytest

from loomspan.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    def value(v):
        if isinstance(v, float):
            return round(v, 9) + 0.0
        return [value(x) for x in v] if isinstance(v, list) or hasattr(v, "tolist") and not hasattr(v, "dtype") else v

    return sorted(repr([value(x) for x in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    got = df.collect()
    assert got and len(set(df.columns)) == len(df.columns)
    if name in registry.ORACLE_SQL:
        con = duckdb.connect()
        for t in TABLES:
            if os.path.exists(f"{sf}/{t}.parquet"):
                con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        cols = sorted(df.columns)
        rel = con.sql(registry.ORACLE_SQL[name])
        at = [rel.columns.index(c) for c in cols]
        assert sorted(rel.columns) == cols
        assert plain([[r[c] for c in cols] for r in got]) == plain([[r[i] for i in at] for r in rel.fetchall()])


def test_entry_imports_without_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert len(e.queries()) > 40 and set(e.oracle_sql()) <= set(e.queries())"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0
