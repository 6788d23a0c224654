"""The SQL of the queries that SQL can express, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from tessella.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(name, spark, small):
    con = duckdb.connect()
    for p in Path(small).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    a, b = QUERIES[name](spark, small).toPandas(), con.execute(ORACLE_SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    full = [c for c in sorted(a.columns) if a[c].notna().any()]  # a column of nulls has no common type
    rows = lambda df: sorted(map(str, df[full].itertuples(index=False, name=None)))
    assert rows(a) == rows(b) and b.drop(columns=full).isna().all(axis=None)


def test_names():
    assert [sum(n.startswith(f"op{k}_") for n in QUERIES) for k in range(1, 14)] == [1] * 13
