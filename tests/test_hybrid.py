"""Hybrid search against plain Python, where queries are texts that share words with most of the corpus."""

import duckdb
import numpy as np
import pytest
from test_core import plain_bm25
from test_queries import plain

from corpuscle.operators import search
from corpuscle.plans import catalogue


def shuffled_rows(spark, of="shuffleWriteRecords"):
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    none = jvm.java.util.ArrayList()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, gateway.new_array(jvm.double, 0), none)
    return sum(getattr(stages.apply(i), of)() for i in range(stages.size()))


def plain_hybrid(docs, vectors, t, v, k):
    lexical = [round(s, 6) for s in plain_bm25(docs, t)] if t else [0.0] * len(docs)
    a = np.array(vectors)
    dense = np.round(a / np.linalg.norm(a, axis=1, keepdims=True) @ (np.array(v) / np.linalg.norm(v)), 6) if v else None
    best = lambda s: set(sorted(range(len(docs)), key=lambda i: (-s[i], i))[: 5 * k])
    near = best(dense) if v else set()
    total = {i: round(lexical[i] + (dense[i] if i in near else 0), 6) for i in best(lexical) | near}
    return sorted(total.items(), key=lambda x: (-x[1], x[0]))[:k]


def test_hybrid_of_long_queries(spark, monkeypatch):
    monkeypatch.setattr(search, "TEXTS", 37)
    monkeypatch.setattr(search, "PRODUCTS", 1000)
    r = np.random.default_rng(3)
    common, rare = [f"c{i}" for i in range(40)], [f"r{i}" for i in range(400)]
    docs = [" ".join([*r.choice(common, 30), *r.choice(rare, r.integers(0, 9))]) for _ in range(300)]
    docs[7:11] = ["", docs[50], docs[50], "only words of its own"]
    vectors = r.standard_normal((300, 6)).tolist()
    spark_docs = spark.createDataFrame(list(zip(range(300), docs, vectors, strict=True)), "id long, body string, embedding array<double>").repartition(4)
    index = search.build(spark_docs, "id", "body", spark_docs.selectExpr("id AS pos", "embedding"))
    asked = [(i, docs[i], vectors[i]) for i in range(0, 300, 3)] + [(1000, "", vectors[5]), (1001, "unknown", None), (1002, docs[4], None), (1003, None, vectors[6])]
    before = shuffled_rows(spark)
    got = {}
    for x in search.hybrid_topk(index, spark.createDataFrame(asked, "query_id long, query string, embedding array<double>"), 3).collect():
        got.setdefault(x.query_id, {})[x.rank] = (x.pos, x.score)
    for q, t, v in asked:
        want = plain_hybrid(docs, vectors, t, v, 3)
        assert [got[q][i + 1][1] for i in range(3)] == [pytest.approx(s, abs=3e-6) for _, s in want]
        assert all(got[q][i + 1][0] == p for i, (p, s) in enumerate(want) if sum(abs(s - z) < 5e-6 for _, z in want) == 1)
    assert shuffled_rows(spark) - before < 30_000  # not one for each text of each query


@pytest.mark.parametrize("name", ["ask_end_to_end", "prompt_build", "rerank_overlap"])
def test_queries_shuffle_no_row_for_each_pair(spark, tmp_path, name):
    r = np.random.default_rng(4)
    common, rare = [f"c{i}" for i in range(40)], [f"r{i}" for i in range(400)]
    ids = [100 * i for i in range(100)] + list(range(1, 100)) + list(range(101, 200))
    docs = spark.createDataFrame([(i, " ".join([*r.choice(common, 30), *r.choice(rare, 5)])) for i in ids], "doc_id long, text string")
    docs.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, r.standard_normal(6).tolist()) for i in ids], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    before = shuffled_rows(spark)
    df = catalogue.queries()[name](spark, str(tmp_path))
    got = df.collect()
    assert shuffled_rows(spark) - before < 60_000, shuffled_rows(spark) - before
    db = duckdb.connect()
    for x in ("documents", "embeddings"):
        db.execute(f"CREATE VIEW {x} AS SELECT * FROM '{tmp_path}/{x}.parquet/*.parquet'")
    result = db.execute(catalogue.oracle_sql()[name])
    order = [df.columns.index(d[0]) for d in result.description]
    assert sorted([plain([x[i] for i in order]) for x in got], key=repr) == sorted([plain(x) for x in result.fetchall()], key=repr)


@pytest.mark.parametrize("name", ["ask_end_to_end", "prompt_build", "rerank_overlap"])
def test_texts_without_vectors_are_not_shuffled(spark, tmp_path, name):
    r = np.random.default_rng(5)
    common = [f"word{i}" for i in range(40)]
    docs = [(i, " ".join(r.choice(common, 3000))) for i in [*range(200), *range(10_000, 11_000)]] + [(None, "no number")]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    vectors = [(i, r.standard_normal(6).tolist()) for i in [*range(200), *range(20_000, 20_050)]] + [(None, [1.0] * 6)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    before = shuffled_rows(spark, "shuffleWriteBytes")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of any size
    try:
        df = catalogue.queries()[name](spark, str(tmp_path))
        got = df.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    written = shuffled_rows(spark, "shuffleWriteBytes") - before
    assert written < 0.75 * sum(len(x) for _, x in docs[:200]), written
    db = duckdb.connect()
    for x in ("documents", "embeddings"):
        db.execute(f"CREATE VIEW {x} AS SELECT * FROM '{tmp_path}/{x}.parquet/*.parquet'")
    result = db.execute(catalogue.oracle_sql()[name])
    order = [df.columns.index(d[0]) for d in result.description]
    assert sorted([plain([x[i] for i in order]) for x in got], key=repr) == sorted([plain(x) for x in result.fetchall()], key=repr)


@pytest.mark.parametrize("numbers", [[], [7], [None, -5, 1 << 40, 3, 3], list(range(0, 60_000, 3))])
def test_likely_in_loses_no_partner(spark, numbers):
    rows = spark.range(-10, 60_000, 1, 3).union(spark.sql("VALUES (1L << 40), (NULL)")).withColumnRenamed("id", "k").selectExpr("k", "-k AS v")
    keys = spark.createDataFrame([(x,) for x in numbers], "k int" if max([0, *filter(None, numbers)]) < 1 << 31 else "k long")
    left = catalogue._likely_in(rows, "k", keys)
    assert left.columns == ["k", "v"]
    got = [x.k for x in left.collect()]
    want = [x.k for x in rows.join(keys.distinct(), "k").collect()]
    assert set(want) <= set(got) and len(got) == len(set(got))
    assert len(got) - len(want) < 6000


@pytest.mark.parametrize("name", ["rerank_overlap"])
def test_texts_with_vectors_are_neither_shuffled_nor_stored(spark, tmp_path, monkeypatch, name):
    r = np.random.default_rng(6)
    words = [f"word{i}" for i in range(5000)]
    docs = [(i, " ".join(r.choice(words[:40] if i % 100 else words, 3000))) for i in range(1, 401)] + [(None, "no number")]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    vectors = [(i, r.standard_normal(6).tolist()) for i in [*range(1, 401), 900]] + [(None, [1.0] * 6)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    before = shuffled_rows(spark, "shuffleWriteBytes")
    monkeypatch.setattr(catalogue, "new_path", lambda spark, name: f"{tmp_path}/shared/{name}")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of any size
    try:
        df = catalogue.queries()[name](spark, str(tmp_path))
        got = df.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    written = shuffled_rows(spark, "shuffleWriteBytes") - before
    stored = sum(p.stat().st_size for p in (tmp_path / "shared").rglob("*.parquet"))
    size = sum(len(x) for _, x in docs)
    assert written < 0.2 * size and stored < 0.1 * size, (written, stored, size)
    db = duckdb.connect()
    for x in ("documents", "embeddings"):
        db.execute(f"CREATE VIEW {x} AS SELECT * FROM '{tmp_path}/{x}.parquet/*.parquet'")
    result = db.execute(catalogue.oracle_sql()[name])
    order = [df.columns.index(d[0]) for d in result.description]
    assert sorted([plain([x[i] for i in order]) for x in got], key=repr) == sorted([plain(x) for x in result.fetchall()], key=repr)


@pytest.mark.parametrize("numbers", [[], [7], [None, -5, 1 << 40, 3, 3], list(range(0, 6000, 3)) * 2])
def test_met_is_the_join(spark, numbers):
    rows = spark.range(-10, 6000, 1, 3).union(spark.sql("VALUES (1L << 40), (3L), (NULL)")).withColumnRenamed("id", "k").selectExpr("k", "-k AS v")
    keys = spark.createDataFrame([(x,) for x in numbers], "k int" if max([0, *filter(None, numbers)]) < 1 << 31 else "k long")
    got = catalogue._met(spark, rows, "k", keys)
    assert got.columns == ["k", "v"] and got.schema == rows.schema
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(keys, "k").collect()))
