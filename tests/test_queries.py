"""Every query with SQL against DuckDB, and the entry module's contract."""

import datetime
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    want = duck.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in want.description]
    assert sorted(cols) == sorted(got.columns)
    kinds = {c: k for c, k in got.dtypes}
    duck_kinds = dict(zip(cols, [str(d[1]) for d in want.description]))
    for c in cols:
        assert {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}.get(kinds[c], kinds[c]) == duck_kinds[c], (c, kinds[c], duck_kinds[c])
    rows = want.fetchall()
    assert rows
    order = sorted(cols)
    mine = sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=str)
    theirs = sorted((tuple(plain(r[cols.index(c)]) for c in order) for r in rows), key=str)
    assert mine == theirs


def test_entry(spark):
    if not os.path.isdir(entry.SMOKE):
        pytest.skip("no test tables here")
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_without_sql_run(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    from tagloom.queries import ORACLE_SQL, QUERIES

    for name in set(QUERIES) - set(ORACLE_SQL):
        assert QUERIES[name](spark, SF).count() > 0


def test_plain_documents_are_whole_texts(spark):
    """Every line of every document, in plain Python."""
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    want = set()
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        at = 0
        for k, line in enumerate(r.text.split("\n")):
            value = line if k == 0 else line.lstrip("".join(map(chr, range(33))))
            if value:
                want.add((r.doc_id, value, at + len(line.encode()) - len(value.encode())))
            at += len(line.encode()) + 1
    got = entry.queries()["plain_documents"](spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(want) and any(r.byte_start > 0 for r in got)
