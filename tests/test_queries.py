"""Every query of the catalogue against its SQL on the smallest tables."""

import glob

import duckdb
import pytest

from corpuscle.plans import catalogue

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {f.split('/')[-1][:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(x):
    if isinstance(x, float):
        return round(x, 6)
    return [plain(y) for y in x] if isinstance(x, (list, tuple)) else x


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, db, name):
    df = catalogue.queries()[name](spark, DIR)
    got = df.collect()
    if name not in catalogue.oracle_sql():
        return
    result = db.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    order = [df.columns.index(c) for c in columns]
    want = sorted((plain(r) for r in result.fetchall()), key=repr)
    assert sorted((plain([r[i] for i in order]) for r in got), key=repr) == want


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize(("name", "units"), [("cer", list), ("wer", str.split)])
def test_error_rates(spark, name, units):
    turns = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{DIR}/conversations.parquet").collect()}
    got = {(r.conv_id, r.turn): (r.errors, r[name]) for r in catalogue.queries()[name](spark, DIR).collect()}
    want = {}
    for (c, t), truth in turns.items():
        if (c, t + 1) in turns:
            a, b = units(truth), units(turns[c, t + 1])
            n = edits(a, b)
            want[c, t] = (n, round(n / len(a), 6) if a else float(n > 0))
    assert got == want and want


def test_entry_without_the_training_operators(spark, monkeypatch):
    import sys

    import __spark_entry__

    monkeypatch.setitem(sys.modules, "corpuscle.llm", None)
    monkeypatch.delitem(sys.modules, "corpuscle.llm.queries", raising=False)
    assert set(__spark_entry__.queries()) == set(catalogue.queries())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
