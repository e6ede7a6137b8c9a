"""Every registered query of the library itself gives the rows that its SQL gives in DuckDB."""

import os

import pytest

from filmloom.plans import chunks as _chunks, entities as _entities, grounding as _grounding, queries as _queries, retrieval as _retrieval, scripts as _scripts, vectors as _vectors  # noqa: F401
from filmloom.plans.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    # In sorting, as in comparing, -0.0 and 0.0 are one value.
    return sorted(map(tuple, df.where(df.notna(), None).values.tolist()), key=lambda r: str([x + 0.0 if isinstance(x, float) else x for x in r]))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(ORACLE[name]).df())
