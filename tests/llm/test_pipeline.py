"""The pipeline's stages on the smallest tables against plain versions."""

import os
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from corpuscle.llm.components import forest
from corpuscle.llm import shared
from corpuscle.llm.neardup import shingle_set, similarity_of
from tests.llm.plain import words

DIR = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    seen = [docs.toPandas()]
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DIR).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        seen.append(docs.toPandas())
        if i < 3:
            assert docs.columns == columns, name
    whole, good, single, cut, packed = seen

    labels = spark.read.parquet(f"{DIR}/labels.parquet").toPandas().merge(whole[["doc_id"]], on="doc_id")
    kept = labels.doc_id.isin(good.doc_id)
    assert (kept == (labels.quality == 1)).mean() > 0.95
    assert kept[labels.quality == 1].mean() > 0.98

    sets = [shingle_set(t, 5) for t in good.text]
    close = [(i, j, similarity_of(sets[i], sets[j])) for i in range(len(sets)) for j in range(i)]
    ids = good.doc_id.tolist()
    group = forest((ids[i], ids[j]) for i, j, s in close if s >= 0.8)
    assert set(ids) - set(single.doc_id) == {x for x, least in group.items() if x != least}
    assert single.set_index("doc_id").text.to_dict() == good[good.doc_id.isin(single.doc_id)].set_index("doc_id").text.to_dict()

    raw = {d: (t or "").encode() for d, t in zip(single.doc_id, single.text, strict=True)}
    n, count = corpus_pipeline.PASSAGE, {}
    for t in raw.values():
        for p in range(len(t) - n + 1):
            count[t[p : p + n]] = count.get(t[p : p + n], 0) + 1
    for d, text in zip(cut.doc_id, cut.text, strict=True):
        t, lost = raw[d], np.zeros(len(raw[d]), bool)
        for p in range(len(t) - n + 1):
            if count[t[p : p + n]] > 1:
                lost[p : p + n] = True
        edges = np.flatnonzero(np.diff(np.r_[0, lost, 0]))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            lost[a:b] = len(t[a:b].split()) >= corpus_pipeline.PASSAGE_WORDS
        assert text == np.frombuffer(t, np.uint8)[~lost].tobytes().decode("utf-8", "ignore")
    assert (cut.n_chars == cut.text.str.len()).all() and len(cut) == len(single)

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by = {(r.doc_id, r.piece): r for r in packed.itertuples()}
    pieces = 0
    for d, text in zip(cut.doc_id, cut.text, strict=True):
        tokens = tokenizer.encode(text, add_special_tokens=False).ids + [1]
        for k in range(0, len(tokens), 4096):
            r = by[d, k // 4096]
            assert (r.start, r.length, r.ids_crc32) == (k, len(tokens[k : k + 4096]), zlib.crc32(np.array(tokens[k : k + 4096], "<u4").tobytes()))
            pieces += 1
    assert pieces == len(packed)
    assert packed.sequence_id.nunique() <= np.ceil(packed.length.sum() / 4096) * 1.1 + 1
    for _, own in packed.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == np.concatenate([[0], own.length.cumsum()])[:-1].tolist() and own.length.sum() <= 4096


ODD = [
    (1, None), (2, ""), (3, " "), (4, "one"), (5, "one"), (None, "one"), (6, None), (7, words(1, 9000)), (8, words(2, 80)), (9, words(2, 80) + " more"),
    *((10 + i, f"{words(20 + i, 70)} {words(3, 60)} {words(40 + i, 70)}") for i in range(4)), (20, f"{words(50, 70)} {words(4, 45)}"), (21, f"{words(51, 70)} {words(4, 45)}"),
]


def test_stages_on_odd_rows(spark):
    """Null and empty texts, repeats, ties, a null key, a very long text, and columns with clashing names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(*r, None, None, None) for r in ODD], schema).withColumn("id", F.lit(1)).withColumn("z", F.lit("z"))
    labels = "/root/testdata/sf0.001"
    for frame in (docs, docs.where("false")):
        rows = frame.count()
        good = corpus_pipeline.quality(spark, frame, labels)
        assert good.columns == corpus_pipeline.COLUMNS and good.count() <= rows
        single = corpus_pipeline.near_duplicates(spark, frame, labels)
        cut = corpus_pipeline.repeated_passages(spark, single, labels)
        packed = corpus_pipeline.packed(spark, cut, labels).collect()
        if not rows:
            assert single.collect() == [] and cut.collect() == [] and packed == []
    single = corpus_pipeline.near_duplicates(spark, docs, labels)
    kept = {r.doc_id: r.text for r in single.collect()}
    assert set(kept) == {1, 4, 7, 8, 10, 11, 12, 13, 20, 21} and kept[1] == ""
    cut = {r.doc_id: r.text for r in corpus_pipeline.repeated_passages(spark, single, labels).collect()}
    assert all(words(3, 60)[10:-10] not in cut[10 + i] and words(20 + i, 70) in cut[10 + i] for i in range(4))
    assert cut[20] == kept[20] and cut[7] == kept[7]  # forty-five words may repeat


def test_nothing_is_left_behind(spark):
    before = len(spark.catalog.listTables())
    with shared.scratch(spark):
        paths = [shared.new_path(spark, "x")]
        made = shared.bucketed(spark.range(10).withColumnRenamed("id", "k"), "k", "y")
        assert made.count() == 10 and len(spark.catalog.listTables()) == before
        spark.range(3).write.parquet(paths[0])
    assert not os.path.exists(paths[0].removeprefix("file://"))
