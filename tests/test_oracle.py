"""Every registered query against its DuckDB statement on the sf0.001 tables,
the same comparison the driver makes at sf0.01."""

import os

import duckdb
import pytest

from marketlens.plans import load_all
from tools.check_oracle import TABLES, canon, type_mismatches

SF_DIR = "/root/testdata/sf0.001"
REGISTRY = load_all()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        path = f"{SF_DIR}/{t}.parquet"
        if os.path.exists(path):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return c


@pytest.mark.parametrize("name", sorted(n for n, q in REGISTRY.items() if q.sql))
def test_query_matches_duckdb(spark, con, name):
    q = REGISTRY[name]
    df = q.build(spark, SF_DIR)
    s_cols, s_rows = df.columns, [tuple(r) for r in df.collect()]
    rel = con.sql(q.sql)
    d_cols, d_types = rel.columns, rel.types
    d_rows = rel.fetchall()
    assert sorted(s_cols) == sorted(d_cols)
    assert type_mismatches(df.dtypes, d_cols, d_types) == []
    assert len(s_rows) == len(d_rows)
    assert canon(s_cols, s_rows) == canon(d_cols, d_rows)


def test_every_query_has_a_check():
    no_sql = {n for n, q in REGISTRY.items() if not q.sql}
    assert no_sql == set()


def test_entry_smoke(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() >= 0 and df.columns == ["category", "orders", "units_sold", "revenue"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
