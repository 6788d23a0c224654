"""Every query of the library against its SQL in DuckDB, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from tessella.plans.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for p in Path(small).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def rows(df):
    def one(x):
        return "NULL" if x is None or x is pd.NaT or isinstance(x, float) and math.isnan(x) else f"{x:.12g}" if isinstance(x, float) else str(x)

    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(map(one, r)) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(name, spark, small, duck):
    assert rows(QUERIES[name](spark, small).toPandas()) == rows(duck.execute(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_others_give_rows(name, spark, small):
    assert QUERIES[name](spark, small).limit(1).count() == 1


def test_entry_smoke(spark, small):
    import __spark_entry__ as e

    assert [f.name for f in e.entry(spark).schema] == ["id", "path", "score", "result_rank"]
    assert set(e.oracle_sql()) <= set(e.queries())
