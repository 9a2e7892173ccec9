"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding.

Encoding. A text is cut into pieces by a pattern, and each piece is read byte by byte. The BPE encoding of
every prefix of a piece ends in exactly one token, and that token may follow the token before it only if no
merge across their border comes first (`Merges.adjacent`). The transducer's state holds the boundaries at which
a token that is still growing may have begun, each with a trie node for the bytes since and the token that ends
there. Tokens on which all of them agree are emitted, so the lookahead is bounded by the longest tokens. States
and their transitions are made when first met and kept.

Decoding. Ids are turned into bytes in steps of any size; `Utf8Stream` holds back the bytes of a character that
has not ended yet, so text comes out character by character and never has to be complete.

Rows: a null text counts as empty, and an empty text gives no ids. Each row is handled alone, so repeated rows,
ties and rows of any length need nothing special; an empty table gives an empty table. Only the named columns
are read; a result column replaces an input column of the same name.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator, Sequence
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpuscle.llm.words import SPACE, LongMap, WordTable

#: Entries after which a memo is emptied, so that a worker's memory stays bounded.
MEMO, WORDS = 500_000, 1 << 20
#: Bytes of text that a query encodes at once.
STEP = 1 << 20
#: Longer pieces are encoded but not remembered.
LONGEST_KEPT = 48


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Merges:
    """The merge rules that a table of ranks implies."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._borders: dict[int, bool] = {}
        self._spines: tuple[dict, dict] = ({}, {})

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge gives this one; None for a byte or a token that no merge reaches."""
        if token not in self._parts:
            text, rank_of = self.bytes_of[token], self.ranks.get
            pieces = [text[i : i + 1] for i in range(len(text))]
            while len(pieces) > 2:
                ranks = [rank_of(a + b, token) for a, b in pairwise(pieces)]
                least = min(ranks)
                if least >= token:
                    break
                best = ranks.index(least)
                pieces[best : best + 2] = [pieces[best] + pieces[best + 1]]
            ok = len(pieces) == 2 and all(x in self.ranks for x in pieces)
            self._parts[token] = (self.ranks[pieces[0]], self.ranks[pieces[1]]) if ok else None
        return self._parts[token]

    def reachable(self, token: int) -> bool:
        return len(self.bytes_of[token]) == 1 or self.parts(token) is not None

    def _spine(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """Tokens at one end of a token while it is built up, each with the rank of the merge that ends it."""
        known = self._spines[side].get(token)
        if known is None:
            parts = self.parts(token) if len(self.bytes_of[token]) > 1 else None
            inner = [] if parts is None else self._spine(parts[side], side)
            inner = [(inner[0][0], token), *inner[1:]] if inner else []
            known = self._spines[side][token] = [(self.bytes_of[token], 1 << 62), *inner]
        return known

    def adjacent(self, left: int, right: int) -> bool:
        """Whether BPE leaves these two tokens side by side: no merge across the border comes in time."""
        key = left << 32 | right
        known = self._borders.get(key)
        if known is None:
            if len(self._borders) > MEMO:
                self._borders.clear()
            known = self._borders[key] = self._apart(left, right)
        return known

    def _apart(self, left: int, right: int) -> bool:
        rank_of, starts = self.ranks.get, self._spine(right, 0)
        for a, end_a in self._spine(left, 1):
            for b, end_b in starts:
                rank = rank_of(a + b)
                # Of equal ranks the leftmost merge goes first: left of the border before it, right of it after.
                if rank is not None and rank < end_a and rank <= end_b:
                    return False
        return True


class Transducer:
    """Bytes in, token ids out; states are determinised when first met.

    A state is the tuple of open boundaries, each packed into one number: the trie node of the bytes since it and
    the token that ends at it. A step tells the token that ends at the byte just read; tokens wait in a buffer
    until all open boundaries lead back to them.
    """

    START = 0

    def __init__(self, ranks: dict[bytes, int]):
        self.merges = Merges(ranks)
        self.length = {rank: len(token) for token, rank in ranks.items()}
        self._sizes = np.zeros(max(self.length, default=0) + 1, np.int64)
        self._sizes[list(self.length)] = list(self.length.values())
        self.lookahead = max(self.length.values(), default=1)
        self._child: dict[int, int] = {}
        self._token_at, self._depth = [-1], [0]
        self._open = [True]
        for token, rank in ranks.items():
            node = 0
            for depth, byte in enumerate(token, 1):
                self._open[node] = True
                key = node << 8 | byte
                node = self._child.get(key)
                if node is None:
                    node = self._child[key] = len(self._depth)
                    self._token_at.append(-1)
                    self._depth.append(depth)
                    self._open.append(False)
            self._token_at[node] = rank
        self.reset()

    def reset(self) -> None:
        self._states: list[tuple[int, ...]] = [(0,)]  # token + 1 in the low 32 bits: 0 where no token is before
        self._ids = {(0,): self.START}
        self._steps: dict[int, int] = {}  # the next state, and the token in the low 32 bits
        self._known = LongMap()  # the same steps, for many pieces at once

    def step(self, state: int, byte: int) -> int:
        """The next state, and in the low 32 bits the last token of the encoding of what was read so far."""
        key = state << 8 | byte
        known = self._steps.get(key)
        if known is None:
            known = self._steps[key] = self._determinise(state, byte)
        return known

    def _determinise(self, state: int, byte: int) -> int:
        child, token_at, open_, merges = self._child, self._token_at, self._open, self.merges
        grown, ending = [], -1
        for x in self._states[state]:
            node = child.get((x >> 32) << 8 | byte)
            if node is None:
                continue
            if ending < 0 and (token := token_at[node]) >= 0:
                before = (x & 0xFFFFFFFF) - 1
                if merges.reachable(token) and (before < 0 or merges.adjacent(before, token)):
                    ending = token
            if open_[node]:
                grown.append(node << 32 | x & 0xFFFFFFFF)
        if ending < 0:
            raise ValueError("the ranks lack a byte")
        grown.append(ending + 1)
        state_ = tuple(grown)
        known = self._ids.get(state_)
        if known is None:
            known = self._ids[state_] = len(self._states)
            self._states.append(state_)
        return known << 32 | ending

    def _back(self, ends: list[int], at: int) -> list[int]:
        """The tokens of the encoding of the first `at` buffered bytes."""
        out, length = [], self.length
        while at > 0:
            token = ends[at - 1]
            out.append(token)
            at -= length[token]
        return out[::-1]

    def _settled(self, state: int, ends: list[int]) -> list[int]:
        """The tokens that every continuation shares."""
        paths = [self._back(ends, len(ends) - self._depth[x >> 32]) for x in self._states[state]]
        n = 0
        while all(len(p) > n and p[n] == paths[0][n] for p in paths):
            n += 1
        return paths[0][:n]

    def encode_many(self, pieces: list[bytes]) -> list[bytes]:
        """Ids as unsigned 32-bit numbers, of pieces within the lookahead: all of them take each step together, and
        their tokens are told from the end."""
        if self._known.size > 2 * MEMO:
            self.reset()
        out: list[bytes] = [b""] * len(pieces)
        sizes = np.array([len(p) for p in pieces], np.int64)
        order = np.argsort(sizes, kind="stable")
        for at in range(0, len(order), 8192):
            own = order[at : at + 8192]
            for i, x in zip(own.tolist(), self._together([pieces[i] for i in own.tolist()], sizes[own]), strict=True):
                out[i] = x
        return out

    def _together(self, pieces: list[bytes], sizes: np.ndarray) -> list[bytes]:
        width = int(sizes.max(initial=0))
        data = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), np.uint8).reshape(len(pieces), -1)
        ends, state = np.zeros((len(pieces), width), np.int64), np.full(len(pieces), self.START)
        for at in range(width):
            rows = slice(int(np.searchsorted(sizes, at, "right")), None)  # pieces come by size
            keys = state[rows] << 8 | data[rows, at]
            found = self._known.find(keys)
            if (found < 0).any():
                new = np.unique(keys[found < 0])
                self._known.add(new, np.array([self._determinise(k >> 8, k & 255) for k in new.tolist()], np.int64))
                found = self._known.find(keys)
            state[rows], ends[rows, at] = found >> 32, found & 0xFFFFFFFF
        made, at, rows = [], sizes.copy(), np.arange(len(pieces))
        while len(rows := rows[at[rows] > 0]):
            token = ends[rows, at[rows] - 1]
            made.append((rows, token))
            at[rows] -= self._sizes[token]
        who, tokens = (np.concatenate(x[::-1]) for x in zip(*made, strict=True)) if made else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        flat = tokens[np.argsort(who, kind="stable")].astype("<u4").tobytes()
        cuts = [0, *(4 * np.cumsum(np.bincount(who, minlength=len(pieces)))).tolist()]
        return [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def encode(self, piece: bytes) -> list[int]:
        if len(self._steps) > 2 * MEMO:
            self.reset()
        state, ends, out, known_steps = self.START, [], [], self._steps.get
        limit = 8 * self.lookahead
        for byte in piece:
            known = known_steps(state << 8 | byte) or self.step(state, byte)
            state = known >> 32
            ends.append(known & 0xFFFFFFFF)
            if len(ends) >= limit:
                sure = self._settled(state, ends)
                out += sure
                del ends[: sum(map(self.length.__getitem__, sure))]
        return out + self._back(ends, len(ends))


#: Code points below this have the pattern's classes spelled out for the standard library's matcher.
SPELLED_OUT = 0x250


def spelled_out(pattern: str) -> str:
    """The pattern with \\p{L}, \\p{N} and white space as ranges, the same for texts below SPELLED_OUT."""

    def ranges(kind: str) -> str:
        points = [c for c in range(SPELLED_OUT) if unicodedata.category(chr(c))[0] == kind]
        return "".join(map(re.escape, map(chr, points)))

    classes = {r"\p{L}": ranges("L"), r"\p{N}": ranges("N"), r"\s": "\t-\r \x85\xa0"}
    out, inside = [], False
    for part in re.split(r"(\\p\{.\}|\\.|[\[\]])", pattern):
        if part in "[]" and part:
            inside = part == "["
        if part == r"\S":
            out.append(f"[^{classes[chr(92) + 's']}]")
        elif part in classes:
            out.append(classes[part] if inside else f"[{classes[part]}]")
        else:
            out.append(part)
    return "".join(out)


def _utf8(text: str) -> bytes:
    """The text's bytes; pairs of surrogates are one character, single ones U+FFFD, as in tiktoken."""
    try:
        return text.encode()
    except UnicodeEncodeError:
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace").encode()


class Codec:
    """Encodes and decodes texts by one table of ranks and one pattern.

    by_words: a piece of the pattern begins wherever ASCII white space follows other characters, so that a run of white
    space with the word after it can be cut and remembered by itself.
    """

    def __init__(self, path: str, pattern: str, by_words: bool = True, words: int = WORDS):
        self._by_words = by_words
        self.ranks = read_ranks(path)
        self.transducer = Transducer(self.ranks)
        self._cut_any, self._cut_low = regex.compile(pattern).findall, re.compile(spelled_out(pattern)).findall
        self._high = re.compile(f"[^\0-{chr(SPELLED_OUT - 1)}]").search
        self._one_each = {rank: rank for rank in self.ranks.values()}  # one object for each id
        # Words that begin or end with white space beyond ASCII are no words by themselves.
        self._odd = re.compile(r"(?:^[ \t\n\r\x0b\x0c]*(?![ \t\n\r\x0b\x0c])[\s\x1c-\x1f])|[\s\x1c-\x1f]$").search
        self._blank = re.compile(r"[ \t\n\r\x0b\x0c]*").fullmatch
        self._pieces: dict[str, tuple[int, ...]] = {}
        self._table = WordTable(self._learn, "<u4", words)

    def _piece(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode("utf-8", "replace")
        whole = self.ranks.get(raw)  # a piece that is itself a token is that token
        ids = (whole,) if whole is not None else tuple(map(self._one_each.__getitem__, self.transducer.encode(raw)))
        if len(piece) <= LONGEST_KEPT:
            if len(self._pieces) >= MEMO:
                self._pieces.clear()
            self._pieces[piece] = ids
        return ids

    def cut(self, text: str) -> list[str]:
        return self._cut_any(text) if self._high(text) else self._cut_low(text)

    def _span(self, text: str) -> list[int]:
        known, make, out = self._pieces.get, self._piece, []
        for piece in self.cut(text):
            out += known(piece) or make(piece)
        return out

    def _learn(self, words: list[bytes]) -> list[bytes | None]:
        """Ids of runs of white space with the word after them; None where the text around has to be seen."""
        cut: list[list[str] | None] = []
        for raw in words:
            word = raw.decode("utf-8", "replace")
            cut.append(None if self._odd(word) and not self._blank(word) else self.cut(word))
        known: dict[str, bytes] = {}
        fresh, whole = [], self.ranks.get
        for piece in {p for parts in cut if parts for p in parts}:
            raw = piece.encode("utf-8", "replace")
            token = whole(raw)  # a piece that is itself a token is that token
            if token is not None:
                known[piece] = token.to_bytes(4, "little")
            elif len(raw) > LONGEST_KEPT:
                known[piece] = array("I", self._piece(piece)).tobytes()
            else:
                fresh.append((piece, raw))
        known.update((p, x) for (p, _), x in zip(fresh, self.transducer.encode_many([raw for _, raw in fresh]), strict=True))
        return [None if parts is None else b"".join([known[p] for p in parts]) for parts in cut]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def encode_batch(self, texts: list[str | bytes | None]) -> list[np.ndarray]:
        """The ids of each text."""
        raw = [_utf8(t) if isinstance(t, str) else t or b"" for t in texts]
        if not self._by_words:
            return [np.array(self._span(t.decode("utf-8", "replace")), np.uint32) for t in raw]
        whole, ends = b"".join(raw), np.cumsum([len(t) for t in raw], dtype=np.int64)
        data = np.frombuffer(whole, np.uint8)
        begins = SPACE[data]
        begins[1:] &= ~begins[:-1]
        begins[np.concatenate([[0], ends[:-1]])[[len(t) > 0 for t in raw]]] = True
        starts = np.flatnonzero(begins)
        entries = self._table.entries(whole, data, starts, np.append(starts[1:], len(data))[: len(starts)])
        counts, ids = self._table.counts(entries), self._table.ids(entries)
        last = np.concatenate([[0], np.searchsorted(starts, ends)])
        cuts = np.concatenate([[0], np.cumsum(np.maximum(counts, 0))])[last].tolist()
        odd = np.concatenate([[0], np.cumsum(counts < 0)])[last]
        out = [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        for i in np.flatnonzero(np.diff(odd)).tolist():
            out[i] = np.array(self._span(raw[i].decode("utf-8", "replace")), np.uint32)
        return out

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        token = self.transducer.merges.bytes_of
        return b"".join([token[i] for i in ids])

    def stream(self, ids: Sequence[int] | np.ndarray, errors: str = "replace", step: int = 1024) -> Iterator[str]:
        """The text of ids, `step` tokens at a time; what has not ended waits for the next step."""
        state = Utf8Stream(errors)
        for at in range(0, len(ids), step):
            part = ids[at : at + step]
            yield state.feed(self.decode_bytes(part.tolist() if isinstance(part, np.ndarray) else part))
        yield state.end()

    def decode(self, ids: Sequence[int], errors: str = "replace") -> str:
        return "".join(self.stream(ids, errors))


class Utf8Stream:
    """UTF-8 in steps of any size; a character that has not ended stays in the state."""

    def __init__(self, errors: str = "replace"):
        self.errors, self.held = errors, b""

    @staticmethod
    def open_tail(data: bytes) -> int:
        """How many bytes at the end begin a character without ending it."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte < 0x80:
                return 0
            if byte >= 0xC0:
                need = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                return back if byte >= 0xC2 and byte < 0xF5 and need > back else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        keep = self.open_tail(data)
        self.held = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", self.errors)

    def end(self) -> str:
        held, self.held = self.held, b""
        return held.decode("utf-8", self.errors)


@cache
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _with(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in df.schema.fields if f.name != name), T.StructField(name, kind)])


def _mapped(df: DataFrame, name: str, kind: T.DataType, source: str, f) -> DataFrame:
    schema = _with(df, name, kind)
    keep = [x.name for x in schema.fields if x.name != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = f(b.column(b.schema.get_field_index(source)).to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(x)) for x in keep), made], [*keep, name])

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with a column of token ids (array of int)."""
    return _mapped(df, ids, T.ArrayType(T.IntegerType()), text, lambda xs: pa.array(codec(path, pattern).encode_batch(xs), pa.list_(pa.int32())))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text of a column of ids (null: empty); bytes that are no UTF-8 come out as U+FFFD."""
    return _mapped(df, text, T.StringType(), ids, lambda xs: pa.array([codec(path, pattern).decode(x or ()) for x in xs], pa.string()))


def decode_bytes(df: DataFrame, path: str, pattern: str, ids: str = "ids", data: str = "decoded") -> DataFrame:
    """df with the bytes of a column of ids (null: empty)."""
    return _mapped(df, data, T.BinaryType(), ids, lambda xs: pa.array([codec(path, pattern).decode_bytes(x or ()) for x in xs], pa.binary()))
