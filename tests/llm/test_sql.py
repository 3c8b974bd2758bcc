"""Queries of operators that SQL can express against that SQL in DuckDB."""

import duckdb
import pytest

from lanewise.llm.queries import ORACLE_SQL, QUERIES


def test_ten_queries():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 11)] and ORACLE_SQL.keys() <= QUERIES.keys()


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    cursor = con.execute(ORACLE_SQL[name])
    found = [d[0] for d in cursor.description]
    assert sorted(found) == sorted(df.columns)
    at = [found.index(c) for c in sorted(found)]
    assert sorted(str(tuple(r[c] for c in sorted(found))) for r in df.collect()) == sorted(str(tuple(r[i] for i in at)) for r in cursor.fetchall())
