"""Operators on small tables with nulls, empty and long texts, ties, repeated rows, no rows, and clashing names."""

import gzip
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from corpuscle.llm import bpe, chat, components, mil, mtree, neardup, packing, simhash, suffix, warc
from corpuscle.llm.queries import PATTERN
from tests.llm.plain import plain_removal

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def words(seed, n):
    r = np.random.default_rng(seed)
    return " ".join("".join(r.choice(list("abcdefgh"), 5)) for _ in range(n))


TEXTS = [None, "", "short", words(1, 400), words(1, 400), words(2, 300) + " " + words(3, 120), words(4, 200) + " " + words(3, 120), "z" * 2000, words(5, 9000), None]


@pytest.fixture
def docs(spark):
    rows = [(i if i else None, t, "en", "src", i, "x") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, id string, n long, name string")


def empty(df):
    return df.where("false")


def test_bpe_tables(docs):
    made = bpe.decode(bpe.encode(docs, RANKS, PATTERN), RANKS, PATTERN)
    assert [(r.text or "") == r.decoded for r in made.collect()] == [True] * len(TEXTS)
    assert bpe.encode(empty(docs), RANKS, PATTERN).collect() == []
    assert set(bpe.encode(docs, RANKS, PATTERN, ids="name").columns) == set(docs.columns)


def test_packing_tables(docs):
    made = packing.pack(packing.pieces(docs, WORDS, 1, 512), 512).collect()
    by = {}
    for r in made:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length and 0 < r.length <= 512
    for own in by.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= 512
    assert sum(r.piece == 0 for r in made) == len(TEXTS)
    assert packing.pack(packing.pieces(empty(docs), WORDS, 1, 512), 512).collect() == []


@pytest.mark.parametrize("crowd", [20_000, 1])
def test_suffix_dedup(docs, crowd, monkeypatch):
    monkeypatch.setattr(suffix.covered, "__defaults__", (400, suffix.GRAM, crowd))
    made = {r.n: r for r in suffix.deduplicated(docs, length=400).collect()}
    for i, want in enumerate(plain_removal(TEXTS, 400)):
        r = made[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256
    assert suffix.deduplicated(empty(docs)).collect() == []


@pytest.mark.parametrize("crowd", [20_000, 1])
def test_suffix_dedup_passages(docs, crowd, monkeypatch):
    monkeypatch.setattr(suffix.covered, "__defaults__", (400, suffix.GRAM, crowd))
    made = {r.n: r for r in suffix.deduplicated(docs, length=400, passages=(150, 60, 51)).collect()}
    for i, want in enumerate(plain_removal(TEXTS, 400)):
        r = made[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want
        assert r.rest == r.kept  # of these texts 400 bytes repeat wherever a passage does
    assert [made[i].n_passages for i in range(len(TEXTS))] == [0, 0, 0, 1, 1, 1, 1, 0, 0, 0]
    assert suffix.deduplicated(empty(docs), passages=(150, 60, 51)).collect() == []


def test_suffix_dedup_without_repeats(spark):
    df = spark.createDataFrame([(1, words(7, 200)), (2, None)], "doc_id long, text string")
    assert {r.n_removed for r in suffix.deduplicated(df, keep_bytes=False).collect()} == {0}


CHATS = [
    ("a", 0, "system", "be kind"), ("a", 1, "user", "hi <|im_end|> \\ <\\| |>"), ("a", 2, "assistant", "hello\n\n<|im_start|>"), ("a", 3, "user", None),
    ("a", 4, "assistant", "x" * 6000), ("a", 5, "user", "more"), ("a", 6, "assistant", ""), (None, 1, None, "no role"), (None, None, "assistant", "<"),
    ("b", 0, "assistant", "|>"), ("b", 0, "assistant", "|>"), ("c", 0, "system", "alone"), ("d", 0, "ro\nle|\\p", "odd"),
    *(("e", i, "user" if i % 2 else "assistant", f"turn {i} " * 40) for i in range(60)),
]


@pytest.mark.parametrize(("budget", "history"), [(2048, 256), (64, 32), (200, 0)])
def test_chat_round_trip(spark, budget, history):
    df = spark.createDataFrame([(*c, 1) for c in CHATS], "conv_id string, turn int, role string, text string, window int")
    made = chat.windows(df, budget, history)
    got = {}
    for r in chat.read_back(made).orderBy("window").collect():
        own = got.setdefault(r.conv_id, ([], ""))
        got[r.conv_id] = (own[0] + [(t.role, t.text) for t in r.turns], own[1] + r.loss_text)
    for c in {c[0] for c in CHATS}:
        turns = sorted(((x[1] if x[1] is not None else -1, x[2] or "", x[3] or "") for x in CHATS if x[0] == c))
        assert got[c][0] == [t[1:] for t in turns]
        assert got[c][1] == "".join(t[2] for t in turns if t[1] == "assistant")
    for r in made.collect():
        count = lambda x: len(re.findall(chat.PIECE, x))
        turns = [chat.START + x for x in r.formatted.split(chat.START)[1:]]
        system = count(turns[0]) if "<|im_start|>system" in turns[0] else 0
        assert r.tokens == sum(map(count, turns))
        own = turns[r.context_turns :]
        if r.tokens > budget:  # one turn that does not fit beside the system turn
            assert len(own) == 1 and system + count(own[0]) > budget and r.context_turns == bool(system)
    assert chat.read_back(chat.windows(empty(df))).collect() == []


def test_chat_repeats_system_and_history(spark):
    rows = [("a", 0, "system", "S"), *(("a", i, "user", f"u{i} " * 20) for i in range(1, 9))]
    made = chat.windows(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string"), 200, 80).orderBy("window").collect()
    assert len(made) > 2 and all(r.formatted.startswith("<|im_start|>system\nS") for r in made)
    assert all(r.context_turns >= 2 for r in made[1:])


def test_simhash_classes(docs):
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.classes(docs, 4).collect()}
    prints = [np.uint64(simhash.fingerprint(t, 4)).astype(np.int64).item() for t in TEXTS]
    links = components.forest((a, b) for a in prints for b in prints if bin((a ^ b) & (2**64 - 1)).count("1") <= 4)
    least = {}
    for i, p in enumerate(prints):
        if i:
            least[links[p]] = min(least.get(links[p], 99), i)
    assert all(got[(i or None, p)] == least.get(links[p]) for i, p in enumerate(prints))
    assert simhash.classes(empty(docs), 4).collect() == []


def test_crowded_keys_are_dealt_to_blocks(spark):
    r = np.random.default_rng(8)
    base = int(r.integers(0, 1 << 62))
    prints = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in r.integers(0, 62, (300, 2))} | {int(x) for x in r.integers(0, 1 << 62, 50)})
    df = spark.createDataFrame([(p,) for p in prints], "fingerprint long")
    want = components.forest((a, b) for a in prints for b in prints if a != b and bin(a ^ b).count("1") <= 4)
    for block in (16, 8192):
        found = components.components(simhash.links(df, block), "a", "b").collect()
        assert {r.node: r.component for r in found} == want


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 50), (50, 60), (7, 7), (None, 3)]
    found = components.components(spark.createDataFrame(chain, "a long, b long"), "a", "b").collect()
    assert {r.node: r.component for r in found} == {**{i: 1 for i in range(1, 41)}, 50: 50, 60: 50, 100: 50}
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


def test_components_of_links_in_tasks_of_their_own(spark):
    def found(links):
        df = spark.createDataFrame(spark.sparkContext.parallelize(links, len(links)), "a long, b long")
        return sorted((r.node, r.component) for r in components.components(df, "a", "b").collect())

    assert found([(5, 4), (4, 3), (3, 1), (5, 2)]) == [(x, 1) for x in range(1, 6)]
    r = random.Random(8)
    for _ in range(2):
        ids = r.sample(range(100), 12)
        links = [*zip(ids[:5], ids[1:6], strict=True), *zip(ids[6:11], ids[7:], strict=True)]
        assert found(links) == sorted(components.forest(links).items())


@pytest.mark.parametrize("block", [8192, 4])
def test_near_duplicates(spark, block):
    base = words(9, 300).split()
    near = [" ".join([*base[:i], "changed", *base[i + 1 :]]) for i in range(10, 290, 20)]
    rows = [(i, t) for i, t in enumerate([" ".join(base), *near, " ".join(base), words(10, 300), None, "", "two words", "two  WORDS"])]
    rows.append((99, " ".join(base[:150] + words(11, 150).split())))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("x")).withColumn("group", F.lit(1)).withColumn("z", F.lit(2))
    kept = neardup.one_of_each(df, block=block).collect()
    n = len(near)
    assert {r.doc_id for r in kept} == {0, n + 2, n + 3, n + 5, 99}
    assert {r.text for r in kept} >= {rows[0][1], "", "two words"} and kept[0].id == "x"
    assert neardup.one_of_each(empty(df)).collect() == []


def test_chat_takes_given_token_counts(spark):
    rows = [("a", i, "user", "x", 10) for i in range(20)]
    made = chat.windows(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string, n int"), 60, 20, tokens="n").collect()
    assert max(r.tokens for r in made) <= 60 and sum(r.formatted.count(chat.START) - r.context_turns for r in made) == 20
    assert all(r.context_turns == 2 for r in made if r.window)


def near_copies(seed: int) -> list[str]:
    """Groups of texts with edits on both sides of the limit, a chain, and texts around one common passage."""
    r = random.Random(seed)
    passage, out = words(seed, 60), []
    for g in range(12):
        base = words(100 * seed + g, 90).split()
        for _ in range(12):
            own = base[:]
            for _ in range(r.randint(0, 5)):
                own[r.randrange(len(own))] = f"edit{r.randrange(10**6)}"
            out.append(" ".join(own))
    step = words(50 + seed, 300).split()
    out += [" ".join(step[i : i + 90]) for i in range(0, 120, 4)]
    out += [f"{passage} {words(1000 + i, r.choice([3, 15, 40]))}" for i in range(40)]
    return out


@pytest.mark.parametrize("block", [8192, 16])
def test_near_duplicates_lose_no_link(spark, block):
    texts = near_copies(4)
    sets = [neardup.shingle_set(t, 5) for t in texts]
    similar = [(i, j) for i in range(len(sets)) for j in range(i) if neardup.similarity_of(sets[i], sets[j]) >= 0.8]
    group = components.forest(similar)
    assert len(similar) > 150 and sum(neardup.similarity_of(sets[i], sets[j]) < 0.85 for i, j in similar) > 30
    kept = {r.doc_id for r in neardup.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), block=block).collect()}
    assert kept == {i for i in range(len(texts)) if group.get(i, i) == i}


def test_top_k_tables(spark):
    r = np.random.default_rng(12)
    vectors = r.standard_normal((300, 6)).round(3)
    vectors[50:90] = vectors[3]
    rows = [(i, v.tolist(), i) for i, v in enumerate(vectors)] + [(300, None, 0), (301, [float("nan")] * 6, 0), (302, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (None, [1.0] * 6, 0), (5, vectors[5].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    whole = np.floor(64 * vectors.astype(np.float32).astype(float))
    for block in (None, 40):
        got = {}
        for x in mtree.top_k(df, df.where("vec_id % 20 = 0"), 20, block=block).collect():
            got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
        assert set(got) == set(range(0, 300, 20))
        for q, own in got.items():
            scores = whole @ whole[q]
            want = sorted(((-int(s), i) for i, s in enumerate(scores) if i != q))[:20]
            assert sorted(own) == [(n + 1, i, -s) for n, (s, i) in enumerate(want)]
    assert mtree.top_k(empty(df), df, 20).collect() == [] and mtree.top_k(df, empty(df), 20).collect() == []


def test_top_k_of_mixed_lengths_and_large_components(spark):
    rows = [(0, [1.0, 2.0]), (1, [3.0, 1.0]), (2, [1.0]), (3, [5.0]), (4, []), (20, [2.0]), (40, [1e6, 1.0]), (5, [1e6, -1.0]), (6, [-1e12, 0.0]), (60, []), (80, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in mtree.top_k(df, df.where("vec_id % 20 = 0"), 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    dot = lambda a, b: max(-(2**63), sum(int(64 * x) * int(64 * y) for x, y in zip(a, b, strict=True)))
    by = dict(rows)
    for q in (0, 20, 40, 60, 80):
        want = sorted(((-dot(by[q], v), i) for i, v in rows if i != q and len(v) == len(by[q])))[:4]
        assert got.get(q, []) == [(i, -s) for s, i in want], q


def test_packing_of_lengths_without_a_place(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([None, 0, -1, 11, 10, 4, 6, 5])], "i long, length long")
    got = {r.i: (r.sequence_id, r.offset) for r in packing.pack(df, 10).collect()}
    assert {i for i, x in got.items() if x == (None, None)} == {0, 1, 2, 3}
    assert len({got[i][0] for i in (4, 5, 6, 7)}) == 3 and got[5][0] == got[6][0]


def test_warc_round_trip(spark, tmp_path):
    warc.register(spark)
    rows = [(3, "http://a/\r\nb", "same", 0), (1, None, "same", 0), (2, "http://c", None, 0), (4, "http://d", "", 0), (5, "http://ü", "é" * 300_000, 0), (None, "http://n", "same", 0), (1, "http://again", "same", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, record_type int")
    path = f"file://{tmp_path}/archives"
    warc.deduplicated(df, "page_id", "url", "html").write.format("warc").mode("append").save(path)
    back = spark.read.format("warc").option("verify", "true").load(path)
    got = sorted((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest == warc.digest((r.payload or b"same"))) for r in back.collect())
    same = [(0, "revisit", 1, 4, True), (1, "response", None, 4, True), (1, "response", None, 4, True)]
    assert got[:3] == same and got[4] == (3, "revisit", 1, 4, True)
    assert got[3][:4] == (2, "response", None, 0) and got[5][:4] == (4, "revisit", 2, 0) and got[6] == (5, "response", None, 600_000, True)
    only = back.where((F.col("record_type") == "revisit") & (F.col("page_id") == 3))
    assert [r.target_uri for r in only.collect()] == ["http://a/%0D%0Ab"] and only.collect()[0].payload is None
    empty_path = f"file://{tmp_path}/none"
    warc.deduplicated(empty(df), "page_id", "url", "html").write.format("warc").mode("append").save(empty_path)
    assert spark.read.format("warc").load(empty_path).collect() == []


def test_warc_overwrite_and_append(spark, tmp_path):
    warc.register(spark)
    path = f"file://{tmp_path}/a"
    save = lambda n, mode: warc.deduplicated(spark.range(n).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.col("id").cast("string").alias("html")), "page_id", "url", "html").write.format("warc").mode(mode).save(path)
    read = lambda: sorted(r.page_id for r in spark.read.format("warc").load(path).collect())
    save(3, "overwrite")
    save(2, "overwrite")
    assert read() == [0, 1]
    save(1, "append")
    assert read() == [0, 0, 1]


class Counting:
    """A source that counts what is read of it."""

    def __init__(self, data):
        self.data, self.at, self.read_bytes = data, 0, 0

    def seek(self, at):
        self.at = at

    def read(self, n):
        out = self.data[self.at : self.at + n]
        self.at, self.read_bytes = self.at + len(out), self.read_bytes + len(out)
        return out


def test_warc_steps_over_what_is_not_wanted(monkeypatch):
    monkeypatch.setattr(warc, "READ", 1 << 10)
    made = [warc.record("response", i, f"http://{i}", random.Random(i).randbytes(200_000), None, "2024-01-01T00:00:00Z") for i in range(5)]
    for zipped in (False, True):
        parts = [gzip.compress(m) for m in made] if zipped else made
        places = np.cumsum([0, *map(len, parts[:-1])]) if zipped else None
        source = Counting(b"".join(parts))
        found = [headers["x-page-id"] if i != 3 else hashlib.sha256(block()).hexdigest() for i, (headers, block) in enumerate(warc.records(source, 0, len(source.data), zipped, places))]
        assert found == ["0", "1", "2", hashlib.sha256(made[3].partition(b"\r\n\r\n")[2][:-4]).hexdigest(), "4"]
        assert source.read_bytes < 200_000 + 30_000


def test_warc_damaged_archives(spark, tmp_path):
    warc.register(spark)
    made = [warc.record("response", i, f"http://{i}", b"x" * 1000, None, "2024-01-01T00:00:00Z") for i in range(3)]
    (tmp_path / "a.warc").write_bytes(b"".join(made)[:-500])
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, made))[:-30])
    (tmp_path / "c.warc").write_bytes(b"")
    read = spark.read.format("warc").load(str(tmp_path))
    assert sorted(r.page_id for r in read.collect()) == [0, 0, 1, 1]
    with pytest.raises(Exception, match="ends inside"):
        spark.read.format("warc").option("strict", "true").load(str(tmp_path)).collect()


def test_warc_plain_archives(spark, tmp_path):
    warc.register(spark)
    data = warc.record("response", 7, "http://x", b"body", None, "2024-01-01T00:00:00Z") + b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "own.warc").write_bytes(data)
    got = {r.record_type: bytes(r.payload) for r in spark.read.format("warc").load(str(tmp_path)).collect()}
    assert got == {"response": b"body", "warcinfo": b"abc"}


def test_quality_tables(spark, docs):
    r = np.random.default_rng(13)
    texts = [words(100 + i, 120) for i in range(80)] + ["&&& %%% " * int(r.integers(50, 90)) for _ in range(80)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 80), 0) for i in range(160)] + [(3, None, 0), (None, 1, 0), (999, 1, 0)], "doc_id long, quality int, score int")
    model = mil.fit(df, labels, "quality")
    scored = mil.score(df.withColumn("score", F.lit("old")), model).collect()
    assert all((x.score >= 0.5) == (x.doc_id < 80) for x in scored)
    assert all(0 <= x.score <= 1 for x in mil.score(docs, model).collect())
    assert mil.score(empty(docs), model).collect() == []
    blank = mil.fit(df, empty(labels), "quality")
    assert {x.score for x in mil.score(df, blank).collect()} == {0.5}
