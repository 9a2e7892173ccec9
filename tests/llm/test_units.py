"""Operators' parts against plain versions, without Spark."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpuscle.llm import components, jpeg, mil, mtree, neardup, packing, simhash, suffix
from corpuscle.llm.bpe import Codec, Utf8Stream
from corpuscle.llm.components import forest

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
CODEC = Codec(RANKS, public_tokenizers.PATTERN)
OTHER = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=CODEC.ranks, special_tokens={})
ODD = ["", " ", "a", "  a  b ", "a" * 4000, "é" * 900, "x\n\n\n y\tz", "日本語 テキスト", "👩‍👩‍👧 ok", "it's WE'LL 's", "1234567 8 9", "<|endoftext|>", "\x00\x1c\x85 \xa0", "word " * 500, " \n" * 300]


@pytest.mark.parametrize("text", ODD)
def test_bpe_is_as_tiktoken(text):
    ids = CODEC.encode(text)
    assert ids == OTHER.encode_ordinary(text)
    assert CODEC.decode(ids) == text
    assert CODEC.decode_bytes(ids) == text.encode()


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(max_codepoint=0x10FFFF), max_size=60))
def test_bpe_any_text(text):
    assert CODEC.encode(text) == OTHER.encode_ordinary(text)


def test_bpe_null_is_empty():
    assert CODEC.encode(None) == []


def test_transducer_emits_before_the_end():
    t = CODEC.transducer
    piece = b"thetionereding" * 3000
    assert t.encode(piece) == OTHER.encode_ordinary(piece.decode())


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=40), st.lists(st.integers(1, 5), max_size=40))
def test_utf8_stream_in_any_steps(data, steps):
    stream, out, at = Utf8Stream(), "", 0
    for n in steps:
        out += stream.feed(data[at : at + n])
        at += n
    out += stream.feed(data[at:]) + stream.end()
    if data.decode("utf-8", "ignore").encode() == data:
        assert out == data.decode()
    assert out.replace("�", "") == data.decode("utf-8", "ignore").replace("�", "")


def test_word_tokenizer_is_as_tokenizers():
    path = public_tokenizers.path("word_bpe_49k.json")
    plain, own = Tokenizer.from_file(path), packing.WordTokenizer(path)
    texts = [*ODD, "İstanbul ΣΑΣ ς", "²½ Ünï á", "x" * 300 + " y"]
    for text, ids in zip(texts, own.encode_batch(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


@settings(max_examples=120, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=30))
def test_plan_places_every_piece_once(counts):
    slots = packing.Planner(counts, 40).plan()
    ranks = collections.defaultdict(list)
    spans = collections.defaultdict(list)
    for length, first, n, sequence, offset in slots.tolist():
        ranks[length] += range(first, first + n)
        for i in range(n):
            spans[sequence + i].append((offset, length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
    for own in spans.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 40
    assert len(spans) <= 2 * sum(k * n for k, n in counts.items()) / 40 + 1


def test_plan_prefers_exact_complements():
    slots = packing.Planner({30: 2, 6: 2, 4: 2, 25: 1, 15: 1, 20: 1, 9: 1, 8: 1, 3: 1}, 40).plan()
    assert slots[:, 3].max() + 1 == 4  # 30+6+4 twice, 25+15, 20+9+8+3


def test_plan_refuses_lengths_out_of_range():
    with pytest.raises(ValueError):
        packing.Planner({41: 1}, 40)


def test_golay_is_perfect_and_links_within_four():
    words = np.random.default_rng(1).integers(0, 1 << 23, 500)
    near, count = simhash.GOLAY.nearby(words)
    assert set(count.tolist()) <= {1, 6}
    r = random.Random(2)
    for _ in range(400):
        a = r.getrandbits(64)
        b = a
        for i in r.sample(range(64), r.randint(1, 4)):
            b ^= 1 << i
        row, key, side = simhash.keys(np.array([a, b], np.uint64).view(np.int64))
        own = [{(k, s) for k, s in zip(key[row == i], side[row == i], strict=True)} for i in (0, 1)]
        assert any((k, {0: 1, 1: 0, 2: 2}[s]) in own[1] for k, s in own[0])


def test_fingerprint_of_few_words():
    assert simhash.fingerprint(None, 4) == simhash.fingerprint(" \n", 4) == 0
    assert simhash.fingerprint("A b", 4) == simhash.fingerprint("a  B", 4) != 0


def test_joining_connects_what_links_connect():
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 62, 6)
    prints = np.array([b ^ (1 << int(r.integers(60))) ^ (1 << int(r.integers(60))) for b in base for _ in range(30)], np.int64)
    a, b = simhash._joining(np.zeros(len(prints), np.int64), np.full(len(prints), 2), prints)
    got = forest(zip(a.tolist(), b.tolist(), strict=True))
    want = forest((int(x), int(y)) for x in prints for y in prints if x != y and bin(int(x ^ y)).count("1") <= 4)
    assert got == want


def plain_repeats(texts, length):
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    return [{i for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1} for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=8, max_size=60), min_size=1, max_size=8), st.integers(4, 8))
def test_suffix_order_finds_repeats(texts, length):
    data = sorted({t.encode() for t in texts})
    n = len(data)
    # All windows in one group and in their own columns: only strings in equal columns are compared.
    found = suffix.repeated_windows(np.zeros(n, np.int64), data, np.zeros(n, np.int64), np.array([len(t) - length + 1 for t in data]), np.zeros(n, bool), length)
    for i, t in enumerate(data):
        want = [p for p in range(len(t) - length + 1) if any(u[p : p + length] == t[p : p + length] for j, u in enumerate(data) if j != i and len(u) >= p + length)]
        assert found[i].tolist() == want


@settings(max_examples=60, deadline=None)
@given(st.text("ab", min_size=0, max_size=120), st.integers(6, 12), st.integers(2, 5))
def test_named_runs_cover_windows_and_agree(text, length, gram):
    data = np.frombuffer(text.encode(), np.uint8)
    names = {}
    seen = set()
    for name, first, windows, place in zip(*suffix.named_runs(data, length, gram), strict=True):
        for p in range(first, first + windows):
            assert p not in seen and p <= place <= p + length - gram
            seen.add(p)
            names.setdefault(text[p : p + length], set()).add((int(name), int(place - p)))
    assert seen == set(range(len(text) - length + 1))
    assert all(len(x) == 1 for x in names.values())


def test_tree_search_is_exact():
    r = np.random.default_rng(4)
    for n in (0, 1, 5, 700):
        vectors = r.integers(-64, 65, (n, 8)).astype(float)
        if n > 10:
            vectors[100:200] = vectors[7]
        ids = r.permutation(n).astype(np.int64)
        tree = mtree.Tree(ids, vectors, 20)
        for q in range(0, n, 37):
            scores = vectors @ vectors[q]
            want = sorted(((int(s), int(i)) for s, i in zip(scores, ids, strict=True) if i != ids[q]), key=lambda x: (-x[0], x[1]))[:20]
            assert tree.search(vectors[q], int(ids[q]), 20) == want


@pytest.mark.parametrize("payload", [bytes(64), bytes(range(256)) * 3, b"\x80" * 640, b"\x81\x7f\x80\x80" * 160, b"plain text " * 64, bytes(random.Random(5).randrange(256) for _ in range(64 * 101))])
def test_payload_round_trip(payload):
    files = jpeg.store([payload, b"x" * 64, payload])
    back, pictures = jpeg.restore(files)
    assert back == [payload, b"x" * 64, payload]
    assert files[0] == files[2] and jpeg.feature(pictures[0]) == jpeg.feature(pictures[2])
    assert pictures[0].shape[2] == 3
    alone = jpeg.restore(files[:1])[1][0]
    assert (alone == pictures[0]).all()


@settings(max_examples=30, deadline=None)
@given(st.lists(st.sampled_from([0, 0, 0, 0, 0, 1, -1, 2, -3, 100, -128]), min_size=64, max_size=64 * 14))
def test_sparse_coefficients_round_trip(values):
    blocks = np.array(values[: len(values) // 64 * 64], np.int32).reshape(-1, 64)
    frame = jpeg.picture_frame(len(blocks), b"x")
    coefs = np.zeros((jpeg.place([frame]), 64), np.int32)
    coefs[: len(blocks)] = blocks
    assert (jpeg.read_coefficients(jpeg.write_coefficients([frame], coefs))[1] == coefs).all()


def test_texts_take_few_entries(monkeypatch):
    entries = []
    plain = jpeg.Entropy

    def counted(value, bits, lane_entries):
        entries.append(len(value))
        return plain(value, bits, lane_entries)

    monkeypatch.setattr(jpeg, "Entropy", counted)
    payload = b"plain text " * 64 * 20
    assert jpeg.restore(jpeg.store([payload]))[0] == [payload]
    assert sum(entries) < len(payload) / 2


@pytest.mark.parametrize("first", [True, False])
def test_full_and_empty_blocks_have_the_bits_of_others(first):
    r = np.random.default_rng(8)
    for width in (20, 43, 63):
        band = r.choice([*range(-128, -1), *range(2, 128)], (40, width)).astype(np.int8)
        band[5:9], band[20:30, 3] = 0, 1
        full, empty = (np.abs(band.astype(int)) > 1).all(1), ~band.any(1)
        made = []
        for f, e in ((full, empty), (full & False, empty & False)):
            value, size, counts = jpeg.band_entries(band, f, e, first)
            made.append(jpeg.Entropy(value, size, counts.reshape(8, 5).sum(1)))
        assert made[0].data == made[1].data and (made[0].ends == made[1].ends).all()


def test_stored_form_is_the_same_as_ever():
    """Files of texts, of bytes about 128, and of 255 at ends of lanes, as first written."""
    r = random.Random(11)
    payloads = [b"plain text " * 64, "слово ÀÁ 例 ".encode() * 64, bytes(r.randrange(256) for _ in range(64 * 50)), b"\xff" * 640, bytes(64)]
    digest = hashlib.sha256(b"".join(jpeg.store(payloads))).hexdigest()
    assert digest == "8d79fa7dedbb432fd5fec02db51ff8a46735d965294330fff68a1152cd011761"


def test_flat_picture_has_its_colour():
    frame = jpeg.picture_frame(6, b"x")
    coefs = np.zeros((jpeg.place([frame]), 64), np.int32)
    coefs[:4, 0] = 8 * 50
    made = jpeg.decode(jpeg.write_coefficients([frame], coefs))[0]
    assert made.shape == (16, 16, 3) and (made == 178).all()


def test_not_a_progressive_file():
    with pytest.raises(ValueError):
        jpeg.parse(b"no picture")


def test_attention_learns_a_passage():
    r = np.random.default_rng(6)
    good = [" ".join(r.choice(["alpha", "beta", "gamma", "delta", "omega"], 200)) for _ in range(120)]
    bad = [x + " " + "&&& %%% $$$ " * 40 for x in good[:60]]
    texts = [t.encode() for t in good[60:] + bad]
    label = np.array([1] * 60 + [0] * 60, np.float32)
    x, owner = mil.passages(texts)
    model = mil.train(x, owner, label, epochs=12)
    scores = model.scores([t.encode() for t in good[:60]] + [b"", b"&&& %%% $$$ " * 300])
    assert (scores[:60] > 0.7).all() and scores[-1] < 0.3 and 0 <= scores[-2] <= 1


def test_passages_of_odd_texts():
    x, owner = mil.passages([b"", b" \n ", b"one", b"w " * 130])
    assert owner.tolist() == [0, 1, 2, 3, 3, 3] and np.isfinite(x).all()


def test_training_without_two_classes():
    x, owner = mil.passages([b"a", b"b"])
    assert mil.train(x, owner, np.array([1, 1], np.float32)).scores([b"c"]).tolist() == [1.0]


def test_merged_spans():
    begin, stop = suffix.merged(np.array([5, 0, 3, 20]), np.array([9, 4, 6, 21]))
    assert list(zip(begin.tolist(), stop.tolist(), strict=True)) == [(0, 9), (20, 21)]
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.one_of(st.integers(1, 400), st.sampled_from([500, 515, 1020, 1100, 3000])))
def test_similar_sets_share_a_prefix_and_pass_the_bounds(seed, n):
    r = np.random.default_rng(seed)
    base = r.integers(0, 2**63, 3 * n + 4, np.uint64) << np.uint64(1) | r.integers(0, 2, 3 * n + 4).astype(np.uint64)
    sets = [np.unique(base[:n])] + [np.unique(np.concatenate([base[k : n + int(r.integers(0, n // 8 + 1))], base[2 * n : 2 * n + int(r.integers(0, n // 8 + 1))]])) for k in r.integers(0, n // 8 + 1, 5).tolist()]
    counts = r.integers(0, 3, neardup.BUCKETS)
    z = np.zeros(len(sets), np.int64)
    bits = np.empty(len(sets), object)
    bits[:] = [neardup.parities(x) for x in sets]
    rows = neardup.Rows(z, z, np.arange(len(sets)), np.arange(len(sets)), np.array([len(x) for x in sets]), bits)
    met = {tuple(p) for p in neardup.meetings(rows, 0.8, False).tolist()}
    for i, j in ((i, j) for j in range(len(sets)) for i in range(j)):
        if neardup.similarity_of(sets[i], sets[j]) >= 0.8:
            assert set(neardup.prefix(sets[i], counts, 0.8).tolist()) & set(neardup.prefix(sets[j], counts, 0.8).tolist())
            assert (i, j) in met


def test_a_crowd_loses_no_pair_to_links_that_fail():
    # 0-1 and 1-2 would join 0 and 2; once they have failed, 0-2 must still come.
    n, z = 40, np.zeros(40, np.int64)
    bits = np.empty(n, object)
    bits[:] = [bytes(neardup.PARITIES // 8)] * n
    rows = lambda label: neardup.Rows(z, z, np.arange(n), label, np.full(n, 100), bits)
    joined = neardup.meetings(rows(np.arange(n)), 0.8, True)
    assert len(joined) == n - 1 and components.forest(map(tuple, joined.tolist())) == dict.fromkeys(range(n), 0)
    assert len(neardup.meetings(rows(np.arange(n)), 0.8, False)) == n * (n - 1) // 2
    halves = np.arange(n) % 2
    assert {tuple(p) for p in neardup.meetings(rows(halves), 0.8, False).tolist()} == {(a, b) for b in range(n) for a in range(b) if a % 2 != b % 2}


def test_parities_keep_large_sets_apart():
    r = np.random.default_rng(6)
    passage = r.integers(0, 2**63, 60, np.uint64)
    for n in (300, 700, 1500, 5000, 40_000):
        a, b = (np.unique(np.concatenate([passage, r.integers(0, 2**63, k, np.uint64)])) for k in (n, n + n // 8))
        both, limit = neardup.Parities([neardup.parities(a), neardup.parities(b)]), np.array([(len(a) + len(b)) / 9])
        assert not both.within(np.array([0]), np.array([1]), limit).any()
        near = np.unique(np.concatenate([a[: len(a) - len(a) // 20], b[: len(a) // 30]]))
        both = neardup.Parities([neardup.parities(a), neardup.parities(near)])
        assert both.within(np.array([0]), np.array([1]), limit).all() and neardup.similarity_of(a, near) > 0.9


def test_rows_that_meet_are_numbered_across_batches():
    r = np.random.default_rng(4)
    key = np.sort(r.integers(0, 60, 400))
    batch = lambda a, b: pa.RecordBatch.from_arrays([pa.array(key[a:b]), pa.array(np.arange(a, b))], ["key", "unit"])
    cuts = [0, 0, *np.sort(r.integers(0, 400, 30)).tolist(), 399, 400]
    out = pa.Table.from_batches(neardup._met(4)([batch(a, b) for a, b in zip(cuts, cuts[1:])])).to_pylist()
    first, size = np.searchsorted(key, key), np.bincount(key)[key]
    want = [(int(key[i]), i, int(i - first[i]) // 4) for i in range(400) if size[i] > 1]
    assert [(x["key"], x["unit"], x["block"]) for x in out] == want


def test_simhash_counts_bits():
    r = np.random.default_rng(5)
    for n in (0, 1, 2, 254, 255, 256, 1000):
        x = r.integers(0, 2**64 - 1, n, np.uint64)
        assert neardup.simhash_of(x) == sum(1 << b for b in range(64) if 2 * sum(int(v) >> b & 1 for v in x.tolist()) > n)


def test_shingles_are_those_of_words():
    a, b = neardup.shingle_sets([b"One  two three four five six averyveryverylongwordindeed x", b"one two\tthree\nfour FIVE six averyveryverylongwordindeed y"], 5)
    assert len(a) == len(b) == 4 and len(np.intersect1d(a, b)) == 3
    c, d, e = neardup.shingle_sets([b"a b", b"b a", b""], 5)
    assert len(c) == len(d) == 1 and c[0] != d[0] and len(e) == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(st.characters(max_codepoint=0x400, exclude_categories=["Cs"]), max_size=60), max_size=8), st.sampled_from([4, 1 << 20]))
def test_word_table_forgets_no_result(texts, entries):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain, own = _PLAIN.setdefault(0, Tokenizer.from_file(path)), _PLAIN.setdefault(entries, packing.WordTokenizer(path, words=entries))
    for _ in range(2):
        assert own.encode_batch(texts) == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


_PLAIN: dict = {}


def foreign_jpeg(coefs: np.ndarray) -> bytes:
    """A progressive file of one component, 8 pixels high, by other rules than ours: no restarts, long end-of-band
    runs, and two refinements of the band 1..63."""
    n = len(coefs)
    table = jpeg.code_lengths(list(range(256)), [(255, 8), (1, 9)])
    word = {symbol: (code, bits) for symbol, code, bits in jpeg.codes(table)}

    def scan(first, last, high, low, bits):
        text = "".join(f"{v:0{n}b}" for v, n in bits if n)
        raw = int(text + "1" * (-len(text) % 8), 2).to_bytes(-(-len(text) // 8), "big") if text else b""
        return jpeg._segment(0xDA, bytes([1, 1, 0, first, last, high << 4 | low])) + raw.replace(b"\xff", b"\xff\0")

    def number(v):  # category and its bits
        size = abs(v).bit_length()
        return size, (v if v > 0 else v + (1 << size) - 1, size)

    dc, before = [], 0
    for v in coefs[:, 0].tolist():
        size, bits = number(v - before)
        dc += [word[size], bits]
        before = v
    run, ac = 0, []

    def flush(out, run, tail=()):
        if run:
            k = run.bit_length() - 1
            out += [word[k << 4], (run - (1 << k), k), *tail]

    for block in coefs.tolist():
        kept = [(k, (abs(v) >> 2) * (1 if v > 0 else -1)) for k, v in enumerate(block) if k and abs(v) >> 2]
        if kept:
            flush(ac, run)
            run, at = 0, 1
            for k, v in kept:
                while k - at > 15:
                    ac.append(word[0xF0])
                    at += 16
                size, bits = number(v)
                ac += [word[(k - at) << 4 | size], bits]
                at = k + 1
            if at <= 63:
                run = 1
        else:
            run += 1
    flush(ac, run)
    scans = [scan(0, 0, 0, 0, dc), scan(1, 63, 0, 2, ac)]
    for low in (1, 0):
        out, run, tail = [], 0, []
        for block in coefs.tolist():
            new = [k for k in range(1, 64) if abs(block[k]) >> low == 1]
            at, fix, zeros = 1, [], 0
            if new:
                flush(out, run, tail)
                run, tail = 0, []
            for k in range(1, (new[-1] if new else 0) + 1):
                size = abs(block[k]) >> low
                if size > 1:
                    fix.append((size & 1, 1))
                elif size == 1:
                    out += [word[zeros << 4 | 1], (int(block[k] > 0), 1), *fix]
                    fix, zeros = [], 0
                elif (zeros := zeros + 1) == 16:
                    out += [word[0xF0], *fix]
                    fix, zeros = [], 0
                at = k + 1
            if at <= 63:
                run += 1
                tail += [(abs(block[k]) >> low & 1, 1) for k in range(at, 64) if abs(block[k]) >> low > 1]
        flush(out, run, tail)
        scans.append(scan(1, 63, low + 1, low, out))
    sof = jpeg.struct.pack(">BHHB", 8, 8, 8 * n, 1) + bytes([1, 0x11, 0])
    head = jpeg._segment(0xDB, b"\0" + b"\1" * 64) + jpeg._segment(0xC2, sof) + jpeg._segment(0xC4, b"\0" + table[0] + table[1]) + jpeg._segment(0xC4, b"\x10" + table[0] + table[1])
    return b"\xff\xd8" + head + b"".join(scans) + b"\xff\xd9"


@pytest.mark.parametrize("seed", range(6))
def test_reads_files_of_other_writers(seed):
    r = np.random.default_rng(seed)
    coefs = np.where(r.random((50, 64)) < (0.02, 0.3)[seed % 2], r.integers(-40, 40, (50, 64)), 0)
    coefs[10:30, 1:] *= seed % 3 != 0  # long runs of empty blocks
    frames, back = jpeg.read_coefficients([foreign_jpeg(coefs)])
    assert (back[:50] == coefs).all() and (frames[0].width, frames[0].height) == (400, 8)
