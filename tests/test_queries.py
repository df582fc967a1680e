"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from conftest import SF
from siftmark.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(rows):
    def value(x):
        if isinstance(x, float):
            return None if x != x else round(x, 6)
        return x

    return sorted((tuple(map(value, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, duck, name):
    mine = QUERIES[name](spark, SF)
    columns = sorted(mine.columns)
    theirs = duck.sql(ORACLE_SQL[name])
    assert sorted(theirs.columns) == columns
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert plain(mine.select(*columns).collect()) == plain(want)


#: Columns and rows of the queries that SQL can't express; what they give is tested in test_procedures.
WITHOUT_SQL = {"cp7_best_first": 8, "cp7_review_traversal": 8, "cp8_review_context": 7, "cp8_traversal_fusion": 5, "jn12_match_cascade": 4, "sc1_walk": 3, "sf15_text_chunks": 5, "sf17_python_symbols": 5, "sf29_middle_cut": 2}


def test_all_queries_have_a_check():
    assert QUERIES.keys() - ORACLE_SQL.keys() == WITHOUT_SQL.keys()


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert len(df.columns) == WITHOUT_SQL[name] and df.count() > 0
