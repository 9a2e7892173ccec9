"""Every opN query on a folder of odd tables, against plain versions; and on empty tables."""

import base64
import glob
import hashlib
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from corpuscle.llm import jpeg, queries
from corpuscle.llm.components import forest
from tests.llm.plain import plain_removal, words

LONG = words(1, 30_000)
BASE = words(2, 400)
TEXTS = [
    "", None, "one", "two  words\n", " \t ", BASE, BASE, BASE.replace("a", "A", 3), BASE + " tail", LONG, words(3, 90) + BASE[:900] + words(4, 90), words(5, 100) + BASE[:900],
    "naïve café Ωmega 日本語 <|endoftext|> it's 12345 I'LL x", "x" * 5000, "ab" * 700, "İstanbul ẞ é \U0001f600", "&&& %%% " * 80, "Permission is hereby granted, free of charge",
]
SHA = lambda x: hashlib.sha256(x).hexdigest()
RAW = [(t or "").encode() for t in TEXTS]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    r = np.random.default_rng(3)
    put = lambda name, **columns: pq.write_table(pa.table(columns), f"{path}/{name}.parquet")
    n = len(TEXTS)
    put("documents", doc_id=pa.array(range(n), pa.int64()), text=pa.array(TEXTS, pa.string()), lang=pa.array([None] * n, pa.string()), source=pa.array(["s"] * n), n_chars=pa.array([len(t or "") for t in TEXTS], pa.int64()))
    put("labels", doc_id=pa.array(range(n), pa.int64()), quality=pa.array([i % 2 for i in range(n)], pa.int32()), toxic=pa.array([0] * n, pa.int32()))
    vectors = [r.standard_normal(8).round(2).tolist() for _ in range(90)] + [None, [float("nan")] * 8, [None] + [1.0] * 7, [0.0] * 8] + [[0.5] * 8] * 30
    put("embeddings", vec_id=pa.array(range(len(vectors)), pa.int64()), embedding=pa.array(vectors, pa.list_(pa.float32())), label=pa.array([0] * len(vectors), pa.int32()))
    pages = ["same", "same", None, "", "é" * 70_000, "<p>x</p>", "same"]
    put("pages", page_id=pa.array([5, 3, 8, 9, 1, 2, 4], pa.int64()), url=pa.array(["http://a", None, "http://ü\n", "u", "v", "w", "x"]), html=pa.array(pages, pa.string()))
    turns = [(1, 0, "system", "be <|kind|>"), (1, 1, "user", "hi \\ <\\| |>"), (1, 2, "assistant", None), (1, 3, "assistant", words(6, 3000)), (1, 4, "user", "ok"), (2, 0, "user", None), (2, 1, "assistant", "<|im_end|>")]
    turns += [(3, i, "assistant" if i % 2 else "user", words(100 + i, 60)) for i in range(70)]
    put("conversations", conv_id=pa.array([t[0] for t in turns], pa.int64()), turn=pa.array([t[1] for t in turns], pa.int64()), role=pa.array([t[2] for t in turns]), text=pa.array([t[3] for t in turns], pa.string()))
    put("benchmark", item_id=pa.array([1], pa.int64()), text=pa.array(["x"]))
    return str(path)


@pytest.fixture(scope="module")
def nothing(folder, tmp_path_factory):
    path = tmp_path_factory.mktemp("empty")
    for f in glob.glob(f"{folder}/*.parquet"):
        pq.write_table(pq.read_table(f).slice(0, 0), f"{path}/{f.split('/')[-1]}")
    return str(path)


def made(spark, name, folder, key="doc_id"):
    rows = queries.queries()[name](spark, folder).collect()
    by = {r[key]: r for r in rows}
    assert len(by) == len(rows)
    return by


def test_empty_tables(spark, nothing):
    for name, query in queries.queries().items():
        rows = query(spark, nothing).collect()
        assert [r.conv_id for r in rows] == [-1] if name.startswith("op4_") else rows == [], name


def test_op1(spark, folder):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.BYTE_BPE, "rb"))}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = made(spark, "op1_bpe", folder)
    for i, t in enumerate(TEXTS):
        ids = other.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), SHA(",".join(map(str, ids)).encode()), SHA(RAW[i])), t


def test_op2(spark, folder):
    got = made(spark, "op2_suffix_dedup", folder)
    for i, want in enumerate(plain_removal(TEXTS, 400)):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == want
        assert got[i].n_removed or got[i].text == (TEXTS[i] or "")


def test_op2_passages(spark, tmp_path):
    short, less, long = words(11, 53), words(12, 40), words(13, 120)
    assert 150 < len(short) < 400 < len(long)
    own = [words(20 + i, 70) for i in range(10)]
    texts = [f"{own[0]} {short} {own[1]}", f"{own[2]}\n{short} {own[3]}", f"{short} {own[4]} {long}", f"{own[5]} {less}", f"{less} {own[6]}", f"{long} {own[7]}", own[8], own[9], short + " x", None, less, less]
    pq.write_table(pa.table({"doc_id": range(len(texts)), "text": texts}), f"{tmp_path}/documents.parquet")
    got = made(spark, "op2_suffix_dedup", str(tmp_path))
    for i, want in enumerate(plain_removal(texts, 400)):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == want
    assert [got[i].n_passages for i in range(len(texts))] == [1, 1, 2, 0, 0, 1, 0, 0, 1, 0, 0, 0]
    assert all(short not in got[i].text and long not in got[i].text for i in range(len(texts)))
    assert all(got[i].text == (texts[i] or "") for i in (3, 4, 6, 7, 9, 10, 11))
    assert own[0] in got[0].text and own[3] in got[1].text and own[4] in got[2].text and own[7] in got[5].text


def test_op3(spark, folder):
    assert all(r.doc_id == 17 for r in queries.op3_license_scan(spark, folder).collect())


@pytest.mark.parametrize("name", ["op4_chat_formatting", "op6_top_k"])
def test_sql(spark, folder, name):
    for path in (folder, "/root/testdata/sf0.001"):
        db = duckdb.connect()
        for f in glob.glob(f"{path}/*.parquet"):
            db.execute(f"CREATE VIEW {f.split('/')[-1][:-8]} AS SELECT * FROM '{f}'")
        df = queries.queries()[name](spark, path)
        result = db.execute(queries.oracle_sql()[name])
        columns = [d[0] for d in result.description]
        want = sorted(result.fetchall())
        assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == want and want


def test_op5(spark, folder):
    prints = []
    for t in RAW:
        w = t.lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    group = forest((i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4)
    got = made(spark, "op5_simhash", folder)
    assert all((got[i].fingerprint, got[i].component_id) == (f"{p:016x}", group.get(i, i)) for i, p in enumerate(prints))


def test_op7(spark, folder):
    pages = pq.read_table(f"{folder}/pages.parquet").to_pylist()
    raw = {p["page_id"]: (p["html"] or "").encode() for p in pages}
    first = {}
    for i in sorted(raw):
        first.setdefault(raw[i], i)
    got = made(spark, "op7_warc", folder, "page_id")
    assert set(got) == set(raw)
    for i, x in raw.items():
        other = first[x] if first[x] != i else None
        want = (len(x), base64.b32encode(hashlib.sha1(x).digest()).decode(), "response" if other is None else "revisit", other)
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == want


def test_op8(spark, folder):
    got = made(spark, "op8_quality", folder)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i].score <= 1 and got[i].predicted == (got[i].score >= 0.7) for i in range(len(TEXTS)))
    assert got[5].score == got[6].score


def test_op8_held_out(spark):
    path = "/root/testdata/sf0.01"
    got = made(spark, "op8_quality", path)
    labels = [(r["doc_id"], r["quality"]) for r in pq.read_table(f"{path}/labels.parquet").to_pylist()]
    held = [(got[d].score, y, got[d].predicted) for d, y in labels if d in got and got[d].held_out]
    good, bad = ([s for s, y, _ in held if y == k] for k in (1, 0))
    assert len(good) > 20 and len(bad) > 10
    assert np.mean([a > b for a in good for b in bad]) > 0.97 and np.mean([p == y for _, y, p in held]) > 0.93


def test_op9(spark, folder):
    tokenizer = Tokenizer.from_file(queries.WORD_BPE)
    want = {}
    for i, t in enumerate(TEXTS):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want[i, k // 4096] = (k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    rows = queries.op9_best_fit_packing(spark, folder).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    of = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert r.offset == of.get(r.sequence_id, 0)
        of[r.sequence_id] = r.offset + r.length
    assert max(of.values()) <= 4096 and len(of) <= -(-sum(of.values()) // 4096) + 1


def test_op10(spark, folder):
    got = made(spark, "op10_progressive_jpeg", folder)
    for i, x in enumerate(RAW):
        full = x + bytes(-len(x) % 64 or 64 * (not x))
        file = jpeg.store([full])[0]
        want = (len(x), len(full), SHA(full), zlib.crc32(full[-64:]), len(file), SHA(file), jpeg.feature(jpeg.decode([file])[0]))
        assert tuple(got[i])[1:] == want


def test_media_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumnRenamed("lang", "rgb")
    rows = jpeg.media(docs, "text").collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        assert r.payload[: r.n_bytes] == RAW[r.doc_id] and len(r.rgb) == 3 * r.height * r.width
    again = spark.createDataFrame([(r.doc_id, bytes(r.media)) for r in rows] + [(-1, None), (-2, b"no picture"), (-3, bytes(rows[0].media)[:300])], "doc_id long, media binary")
    back = {r.doc_id: r for r in jpeg.tensors(again).collect()}
    assert all(back[r.doc_id].rgb == r.rgb and back[r.doc_id].height == r.height for r in rows)
    assert all(back[i].rgb is None and back[i].width is None for i in (-1, -2, -3))
