"""Each registered query with SQL agrees with DuckDB on the small tables."""

import os

import pandas as pd
import pytest

duckdb = pytest.importorskip("duckdb")
from barline import catalog  # noqa: E402


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{small}/{f}'")
    return con


def canonical(frame):
    def one(v):
        if not hasattr(v, "__len__") and pd.isna(v):
            return ""
        if isinstance(v, float):
            return f"{v:.9g}"
        return str(v)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(one(v) for v in row) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_agrees_with_sql(spark, small, duck, name):
    got = catalog.queries()[name](spark, small).toPandas()
    want = duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)
