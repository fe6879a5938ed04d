"""Every registered library query gives the rows of its SQL twin on the smallest tables."""

import datetime
import math
import re

import duckdb
import pytest

from crateflow.plans import registry, views

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in views.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return str(v.replace(tzinfo=None))
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    if name not in SQL:  # beyond SQL: tests of its operator check it; here it must run and keep its columns
        assert df.columns and df.count() >= 0
        return
    cursor = duck.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, cursor.fetchall())


def test_entry_works_without_the_corpus_operators(monkeypatch):
    import sys

    import __spark_entry__

    monkeypatch.setitem(sys.modules, "crateflow.llm", None)
    monkeypatch.setitem(sys.modules, "crateflow.llm.queries", None)
    assert set(__spark_entry__.queries()) == set(QUERIES)
    assert set(__spark_entry__.oracle_sql()) == set(SQL)


def test_views_come_before_the_views_that_name_them():
    assert views.with_views("SELECT 1") == "SELECT 1"
    views_with = {n: views.with_views(f"SELECT * FROM {n}") for n in views.VIEWS}
    for name, text in views_with.items():
        first = {n: m.start() for n in views.VIEWS if (m := re.search(rf"\b{n} AS \(", text))}
        assert name in first and all(first[n] <= first[name] for n in first), name
