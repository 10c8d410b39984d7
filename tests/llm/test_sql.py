"""Queries of training-data operators that SQL can express, against DuckDB."""

import duckdb
import pytest

from strandline.llm import entries


@pytest.mark.parametrize("name", sorted(entries.oracle_sql()))
def test_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    theirs = con.execute(entries.oracle_sql()[name])
    columns = sorted(d[0] for d in theirs.description)
    wanted = con.execute(f"SELECT {', '.join(columns)} FROM ({entries.oracle_sql()[name]})").fetchall()
    ours = entries.queries()[name](spark, sf)
    assert sorted(ours.columns) == columns
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(map(tuple, ours.select(*columns).collect()), key=key) == sorted(wanted, key=key)
