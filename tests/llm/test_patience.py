"""Patience alignment against plain versions."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from corpuscle.llm import patience
from corpuscle.llm.patience import Scanner, align, longest_rising, words


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 12), max_size=10))
def test_longest_rising(numbers):
    best = 0
    for mask in range(1 << len(numbers)):
        own = [x for i, x in enumerate(numbers) if mask >> i & 1]
        if all(a < b for a, b in zip(own, own[1:])):
            best = max(best, len(own))
    got = [numbers[i] for i in longest_rising(numbers)]
    assert len(got) == best and all(a < b for a, b in zip(got, got[1:]))


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abcdefgh"), max_size=14), st.lists(st.sampled_from("abcdefgh"), max_size=14))
def test_align_pairs_equal_words_in_order(a, b):
    pairs = align(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and len(pairs) <= common(a, b)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))


@settings(max_examples=60, deadline=None)
@given(st.permutations(list("abcdefghij")), st.permutations(list("abcdefghij")))
def test_align_of_unique_words_is_a_longest_common_subsequence(a, b):
    assert len(align(a, b)) == common(a, b) or a[0] == b[0] or a[-1] == b[-1]


def test_notices_are_found_wherever_they_stand():
    r = random.Random(1)
    filler = lambda n: " ".join("".join(r.choices("xyzuvw", k=6)) for _ in range(n))
    for name, text in patience.TEMPLATES.items():
        own = words(text)
        torn = own[:]
        for i in r.sample(range(len(own)), len(own) // 10):
            torn[i] = "changed"
        doc = f"{filler(700)} {text} {filler(300)} {' '.join(torn)} {filler(50)} {text}"
        found = [x for x in Scanner(patience.TEMPLATES).scan(doc) if x[0] == name]
        assert len(found) == 3, name
        assert found[0][4] == 1.0 and found[0][2] == len(own)
        # Plain comparison: the share of a longest common subsequence is no smaller.
        assert found[1][4] <= common(torn, own) / len(own) + 1e-9


def test_adjacent_notices():
    scanner = Scanner(patience.TEMPLATES)
    for name, text in patience.TEMPLATES.items():
        own = words(text)
        for gap in range(9):
            for copies in (2, 3, 8):
                doc = [w for i in range(copies) for w in [*(f"file{i}x{g}" for g in range(gap)), *own]]
                # Plain comparison: wherever the whole notice stands.
                want = [(name, i, len(own), len(own), 1.0) for i in range(len(doc)) if doc[i : i + len(own)] == own]
                assert [x for x in scanner.scan(" ".join(doc)) if x[0] == name] == want, (name, gap, copies)


def test_no_notice_in_plain_texts():
    scanner = Scanner(patience.TEMPLATES)
    for text in (None, "", "license", "the the the of under version", "software " * 5000, "permission is granted to walk under the tree"):
        assert scanner.scan(text) == []


def test_tables(spark):
    mit = patience.TEMPLATES["mit-notice"]
    df = spark.createDataFrame([(1, f"a {mit}. b", 0), (1, f"a {mit}. b", 0), (2, None, 0), (None, mit.upper(), 0), (3, "", 0)], "doc_id long, text string, coverage int")
    got = sorted((r.doc_id or 0, r.license, r.first_word, r.n_words, r.coverage) for r in patience.scan(df).collect())
    assert got == [(0, "mit-notice", 0, 5, 1.0), (1, "mit-notice", 1, 5, 1.0), (1, "mit-notice", 1, 5, 1.0)]
    assert patience.scan(df.where("false")).collect() == []


def test_whole_texts_of_licences():
    r = random.Random(5)
    filler = lambda n: " ".join("".join(r.choices("xyzuvw", k=6)) for _ in range(n))
    scanner = Scanner(patience.TEMPLATES)
    for name, template in patience.TEMPLATES.items():
        own = words(template)
        text = f"{filler(200)} {' '.join(own)} {filler(50)}"
        assert (name, 200, len(own), len(own), 1.0) in scanner.scan(text), name
    full = {x[0] for x in scanner.scan(patience.TEMPLATES["bsd-3-clause-full"])}
    assert {"bsd-2-clause", "bsd-3-clause-full"} <= full and "isc-full" not in full and "mit-full" not in full


def test_a_copy_within_the_bound_is_met():
    own = words(patience.TEMPLATES["apache-2-header"])
    scanner = Scanner(patience.TEMPLATES)
    every = lambda n: [x for i, w in enumerate(own) for x in ((w, "foreign") if i % n == n - 1 else (w,))]
    assert len(every(4)) - len(own) <= len(own) // 4
    assert [x[3] for x in scanner.scan(" ".join(every(4))) if x[0] == "apache-2-header"] == [len(own)]
