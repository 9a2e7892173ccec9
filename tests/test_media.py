"""Recordings, books, uploads, model slots, pages as a parser reads them, and choices."""

import io
import itertools
import random
import wave
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle.functions import folds, text
from corpuscle.operators import models, optimize, search, signal, speech
from corpuscle.sources import readers, writers


def put_wav(path, samples, rate=16_000, channels=1, width=2):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels), w.setsampwidth(width), w.setframerate(rate)
        w.writeframes(samples)


def test_html_as_a_parser_reads_it(spark):
    cases = {
        "a&#39;b &eacute; &#xe9;": "a'b é é", "<p>a</p><script>var x=1;": "a", "<a title='1>2'>t</a>": "t", "x < y & z": "x < y & z", "<p>one<br>two</p>": "one two",
        "<!DOCTYPE html><title>t</title><style>p{}</style><!-- c --><script>if (a<b) { '</p>' }</script>body &amp;lt;": "t body &lt;", "a&nbsp;b &copy": "a b ©", "": "",
        '<img alt="a > b" src=x>after': "after", "<?php echo 1 ?>z": "z",
    }
    rows = spark.createDataFrame([(k,) for k in cases] + [(None,)], "html string").withColumn("text", text.clean_html(F.col("html"))).collect()
    assert {r.html: r.text for r in rows} == {**cases, None: None}


def test_packing_is_linear(spark):
    words = [f"w{i}" * (1 + i % 5) for i in range(5000)]
    got = spark.createDataFrame([(" ".join(words),)], "t string").select(folds.pack_words(F.col("t"), 80).alias("c")).first().c
    assert " ".join(got).split() == words and all(len(c) <= 80 for c in got)
    packed = spark.range(1).select(folds.pack_words(F.col("id").cast("string")).alias("c"))
    plan = packed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1  # the text is split once, not for every chunk


def test_recordings_as_samples(spark, tmp_path):
    ramp = np.arange(-8000, 8000, dtype="<i2")
    put_wav(tmp_path / "a.wav", ramp.tobytes())
    put_wav(tmp_path / "b.wav", np.repeat(ramp, 2).tobytes(), channels=2)
    put_wav(tmp_path / "c.wav", bytes([0, 128, 255]), rate=8000, width=1)
    put_wav(tmp_path / "d.wav", (np.arange(6, dtype="<i4") << 24).astype("<i4").tobytes()[1:19], width=3)
    (tmp_path / "e.wav").write_bytes(b"RIFFnothing")
    got = {r.id: r for r in readers.wav_samples(spark, str(tmp_path)).collect()}
    assert np.allclose(got["a"].samples, ramp / 32768) and np.allclose(got["b"].samples, ramp / 32768, atol=1e-6)
    assert len(got["c"].samples) == 6 and np.allclose(got["c"].samples[::2], [-1, 0, 127 / 128]) and len(got["d"].samples) == 6 and got["e"].samples is None
    assert signal.features(readers.wav_samples(spark, str(tmp_path)).where("id = 'a'")).count() == 101
    heads = {r.path[-5]: r for r in readers.wav_headers(spark, str(tmp_path)).collect()}
    assert heads["a"].accepted and not heads["b"].accepted and heads["e"].frames is None and heads["e"].accepted is False


def test_recordings_need_transcripts(spark):
    wavs = spark.createDataFrame([("a", "p"), ("b", "q")], "id string, path string")
    texts = spark.createDataFrame([("a", "x"), ("b", None), ("c", "y")], "id string, text string")
    assert sorted((r.id, r.text) for r in readers.with_transcripts(wavs, texts).collect()) == [("a", "x"), ("b", None)]
    with pytest.raises(Exception, match="no transcript for b"):
        readers.with_transcripts(wavs, texts.where("id <> 'b'")).collect()


def test_written_recordings(spark, tmp_path):
    rows = [("a", 1, b"\1\0" * 5), ("a", 0, b"\2\0" * 3), ("b", 0, None)]
    path = f"file://{tmp_path}/out"
    made = sorted(writers.wav(spark.createDataFrame(rows, "doc string, idx int, samples binary"), "doc", path, rate=100).collect())
    assert [(r.doc, r.frames) for r in made] == [("a", 48), ("b", 20)]
    with wave.open(f"{tmp_path}/out/a.wav") as w:
        x = np.frombuffer(w.readframes(100), "<i2")
    assert w.getframerate() == 100 and x.tolist() == [2] * 3 + [0] * 20 + [1] * 5 + [0] * 20
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.wav", "b.wav"]


def test_books_in_the_order_of_their_manifest(spark, tmp_path):
    def book(name, files):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            for k, v in files.items():
                z.writestr(k, v)
        (tmp_path / name).write_bytes(data.getvalue())

    box = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>'
    items = '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item href="z%20z.xhtml" media-type="application/xhtml+xml"/><item href="a.css" media-type="text/css"/><item href="b.html" media-type="text/html"/></manifest></package>'
    book("a.epub", {"META-INF/container.xml": box, "O/p.opf": items, "O/b.html": "<p>second", "O/z z.xhtml": "<p>first</p>", "O/c.html": "not listed"})
    book("b.epub", {"2.HTM": "two", "1.xhtml": "one", "x.txt": "no"})
    got = sorted((r.path[-6], r.idx, r.text) for r in readers.book_items(spark, str(tmp_path)).collect())
    assert got == [("a", 0, "first"), ("a", 1, "second"), ("b", 0, "one"), ("b", 1, "two")]
    (tmp_path / "c.epub").write_bytes(b"no book")
    assert readers.book_items(spark, str(tmp_path)).count() == 4
    with pytest.raises(Exception, match="no text in"):
        readers.book_items(spark, str(tmp_path), strict=True).collect()


def test_uploads_and_paths(spark, tmp_path):
    for name in ("a.PNG", "b.wav", "c.xyz"):
        (tmp_path / name).write_bytes(b"x")
    got = {r.filename: (r.content_type, bytes(r.content)) for r in readers.uploads(spark, str(tmp_path)).collect()}
    assert got == {"a.PNG": ("image/png", b"x"), "b.wav": ("audio/wav", b"x"), "c.xyz": ("application/octet-stream", b"x")}
    assert readers.existing(spark, [f"{tmp_path}/b.wav"]) == [f"file:{tmp_path}/b.wav"]
    with pytest.raises(FileNotFoundError):
        readers.existing(spark, [f"{tmp_path}/none"])


def test_slots_and_dispatch(spark, tmp_path):
    loud, quiet = np.full(4000, 3000, "<i2"), np.zeros(4000, "<i2")
    put_wav(tmp_path / "a.wav", np.concatenate([loud, loud, quiet, loud[:10]]).tobytes())
    content = (tmp_path / "a.wav").read_bytes()
    rows = spark.createDataFrame([(1, "VOSK", content, None), (2, None, content, "vi"), (3, "other", content, None), (4, "", None, None)], "id int, stt string, content binary, language string")
    got = {r.id: r for r in models.dispatched(rows, "stt", "whisper", models.speech_slots(), ["content", "language"]).collect()}
    assert got[1].text == "loud loud quiet loud" and got[1].lines == ["loud loud quiet", "loud"] and not got[1].refused
    assert got[2].text == "12010 samples" and got[2].language == "vi" and got[2].segments[0].end == 12010 / 16_000
    assert got[3].refused and got[3].text is None and got[4].text == "0 samples" and got[4].language == "en"
    assert models.recognised(np.zeros(0), models.LevelRecogniser()) == []
    read = models.reading_standin("x").over(spark.createDataFrame([(b"one\n\ntwo\xff",)], "content binary").withColumn("language", F.lit(None).cast("string")), ["content", "language"]).first()
    assert read.text == "one\n\ntwo" and read.lines == ["one", "two"]
    voice = models.silent_voice(1000, 0.1).over(spark.createDataFrame([("a", 0, "abc")], "doc string, idx int, text string"), ["text"], "samples binary, rate int").first()
    assert len(voice.samples) == 600 and voice.text == "abc"
    frames = spark.createDataFrame([("a", t, [float(t)] * 3) for t in range(5)], "id string, frame int, mel array<float>")
    logits = models.hashed_logits(frames, "id", "mel", 4)
    assert logits.count() == 5 and len(logits.first().logits) == 4


def test_choices(spark):
    r = random.Random(1)
    for n in (0, 1, 7, 12):
        items = [(i + 1, r.randint(0, 12), r.randint(0, 30)) for i in range(n)]
        df = spark.createDataFrame(items, "item_id long, w long, v long")
        best = max((sum(x[2] for x in own) for k in range(n + 1) for own in itertools.combinations(items, k) if sum(x[1] for x in own) <= 25), default=0)
        own = optimize.chosen_items(df, 25).collect()
        assert sum(x.v for x in own) == best and sum(x.w for x in own) <= 25 and len({x.item_id for x in own}) == len(own)
        final = optimize.final_choice(optimize.greedy(df, 25), optimize.chosen_items(df, 25), 25).first()
        assert final.value >= sum(x.v for x in optimize.greedy(df, 25).collect()) and (final.value == best or final.source == "heuristic")


def test_colony_phases():
    r = np.random.default_rng(2)
    w, v = r.integers(1, 30, 60), r.integers(1, 100, 60)
    best = np.zeros(301, int)
    for a, b in zip(w, v, strict=True):
        best[a:] = np.maximum(best[a:], best[:-a] + b)
    x = optimize.Colony(w, v, 300, 80, 5).run(60)
    assert w[x].sum() <= 300 and 0.97 * best[-1] <= v[x].sum() <= best[-1]
    assert (optimize.Colony(w, v, 300, 80, 5).run(60) == x).all()
    assert not len(optimize.Colony(w[:0], v[:0], 5, 10, 1).run(3))


def test_fill_of_short_rankings(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", "c", "c d", "c e", "a", "f", None, "g"])], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a"), (2, "zz"), (3, None), (4, "c a")], "query_id long, query string")
    got = {}
    for r in search.bm25_topk(search.build(docs, "doc_id", "text"), asked, 3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.pos)
    assert got == {1: [4, 0, 1], 2: [0, 1, 2], 3: [0, 1, 2], 4: got[4]} and set(got[4]) <= {0, 1, 2, 3, 4}


def test_dense_packs_and_ties(spark):
    r = np.random.default_rng(3)
    v = r.standard_normal((50, 4)).round(1)
    v[10:30] = v[5]
    v[40] = 0
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)]
    df = spark.createDataFrame(rows, "pos long, embedding array<double>").repartition(3)
    index = search.Index(None, None, None, df.select("pos", search.unit(F.col("embedding")).alias("embedding")))
    asked = df.where("pos % 10 = 5").withColumnRenamed("pos", "query_id")
    unit = v / np.maximum(np.linalg.norm(v, axis=1), 1e-300)[:, None]
    for block in (7, 1024):
        got = {}
        for x in search.dense_topk(index, asked, 8, block).orderBy("query_id", "rank").collect():
            got.setdefault(x.query_id, []).append(x.pos)
        assert got == {q: sorted(range(50), key=lambda i: (-round(float(unit[i] @ unit[q]), 6), i))[:8] for q in (5, 15, 25, 35, 45)}


def test_characters_beyond_the_vocabulary(spark):
    vocab = speech.vocabulary(spark.createDataFrame([("ab\U0001f600",)], "t string"), "t")
    df = spark.createDataFrame([(" AB \U0001f600c\U0010ffff ",), (None,), ("",)], "t string")
    assert [r.ids for r in speech.encode(df, vocab, "t").collect()] == [[2, 3, 1, 4, 1, 1], [], []]
