"""Every query that SQL can express gives the rows of its SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    got = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    wanted = sorted(tuple(plain(r[names.index(c)]) for c in df.columns) for r in got.fetchall())
    assert sorted(tuple(map(plain, r)) for r in df.collect()) == wanted


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_catalogue_query_has_sql():
    assert {n for n in entry.queries() if n[0] == "q"} <= set(entry.oracle_sql())


def test_nothing_else_imports_the_corpus_operators():
    root = os.path.dirname(entry.__file__)
    for folder, _, names in os.walk(os.path.join(root, "snapledger")):
        for n in names:
            if n.endswith(".py") and os.sep + "llm" not in folder:
                assert "llm" not in open(os.path.join(folder, n)).read()
