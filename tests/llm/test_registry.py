import duckdb
import pytest

from marketlens.llm.registry import load_all
from tools.check_oracle import canon

SF = "/root/testdata/sf0.001"
NAMES = ["op1_", "op2_", "op3_", "op4_", "op5_", "op6_", "op7_", "op8_", "op9_", "op10_"]


def test_each_operator_has_one_query():
    names = list(load_all()[0])
    assert all(sum(n.startswith(p) for n in names) == 1 for p in NAMES)


@pytest.mark.parametrize("name", sorted(load_all()[1]))
def test_query_matches_duckdb(spark, name):
    queries, sql = load_all()
    con = duckdb.connect()
    for t in ("pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries[name](spark, SF)
    rel = con.sql(sql[name])
    cols, rows = rel.columns, rel.fetchall()
    assert sorted(cols) == sorted(df.columns)
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon(cols, rows)
