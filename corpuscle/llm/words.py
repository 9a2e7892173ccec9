"""Words of many texts at once, and a table from words to what was made of them.

Texts are laid end to end and cut at ASCII white space in numpy. A word of up to 16 bytes is its own key: its bytes in
two numbers, and its length; nothing depends on a hash but the place of a row. Longer words are looked up one by one.
The table holds a run of small numbers (ids) for each word. When it is full, words that were not met since it was
last full make room.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: ASCII letters in lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of a word that is its own key.
SHORT = 16
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def laid_out(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The texts end to end, each followed by a line feed, and where each one ends."""
    return b"\n".join(texts) + b"\n", np.cumsum([len(t) + 1 for t in texts])


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of laid out texts begin and stop."""
    edges = np.flatnonzero(np.diff(SPACE[data], prepend=True))
    return edges[::2], edges[1::2]


def packed_words(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first 16 bytes of each word in two numbers."""
    padded = np.concatenate([data, np.zeros(SHORT, np.uint8)])
    at = np.ndarray((len(padded) - 7,), "<u8", padded.data, strides=(1,))
    return at[starts] & _MASK[np.minimum(sizes, 8)], at[starts + 8] & _MASK[np.clip(sizes - 8, 0, 8)]


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... for each i, sizes[i] numbers, end to end."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


class LongMap:
    """Numbers to numbers, both at least 0, for many at once."""

    def __init__(self, bits: int = 16):
        self._key, self._value, self.size = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64), 0

    def _home(self, keys: np.ndarray) -> np.ndarray:
        bits = len(self._key).bit_length() - 1
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where there is none."""
        slot = self._home(keys)
        there = self._key[slot]
        out = np.where(there == keys, self._value[slot], -1)
        todo = np.flatnonzero((there >= 0) & (there != keys))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & (len(self._key) - 1)
            there, wanted = self._key[slot], keys[todo]
            same = there == wanted
            out[todo[same]] = self._value[slot[same]]
            on = (there >= 0) & ~same
            todo, slot = todo[on], slot[on]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """New, distinct keys."""
        self.size += len(keys)
        if 2 * self.size > len(self._key):
            own = self._key >= 0
            keys, values = np.concatenate([self._key[own], keys]), np.concatenate([self._value[own], values])
            bits = (4 * self.size - 1).bit_length()
            self._key, self._value = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        slot = self._home(keys)
        while len(keys):
            free = np.flatnonzero(self._key[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            mine = free[first]
            self._key[slot[mine]], self._value[slot[mine]] = keys[mine], values[mine]
            rest = np.ones(len(keys), bool)
            rest[mine] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & (len(self._key) - 1)


class WordTable:
    """Word -> ids; entries are numbered, so a batch is looked up once and its ids are gathered once.

    learn(words) gives the ids of words that were not met before, or None where a word stands for nothing by itself.
    """

    def __init__(self, learn: Callable[[list[bytes]], list[bytes | None]], kind: str = "<u2", entries: int = 1 << 20):
        self.learn, self.kind, self.most = learn, kind, entries
        self._bits = max(4, (2 * entries - 1).bit_length())
        self._reset()

    def _reset(self) -> None:
        self._slot = np.full(1 << self._bits, -1, np.int32)
        self._a, self._b = np.zeros(1024, np.uint64), np.zeros(1024, np.uint64)
        self._n, self._at, self._ids = np.zeros(1024, np.uint8), np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self._met = np.zeros(1024, bool)
        self._pool, self._used, self.size = np.zeros(4096, self.kind), 0, 0
        self._long: dict[bytes, int] = {}

    def _home(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        h = (a ^ b * np.uint64(0x9E3779B97F4A7C15)) + n.astype(np.uint64)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return (h >> np.uint64(64 - self._bits)).astype(np.int64)

    def _find(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Entries of short words, -1 for new ones."""
        out, todo, slot = np.full(len(a), -1, np.int64), np.arange(len(a)), self._home(a, b, n)
        while len(todo):
            e = self._slot[slot]
            same = (e >= 0) & (self._a[e] == a[todo]) & (self._b[e] == b[todo]) & (self._n[e] == n[todo])
            out[todo[same]] = e[same]
            on = (e >= 0) & ~same
            todo, slot = todo[on], (slot[on] + 1) & (len(self._slot) - 1)
        return out

    def _place(self, entries: np.ndarray) -> None:
        slot = self._home(self._a[entries], self._b[entries], self._n[entries])
        while len(entries):
            free = np.flatnonzero(self._slot[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            mine = free[first]
            self._slot[slot[mine]] = entries[mine]
            rest = np.ones(len(entries), bool)
            rest[mine] = False
            entries, slot = entries[rest], (slot[rest] + 1) & (len(self._slot) - 1)

    def _grown(self, name: str, n: int) -> None:
        x = getattr(self, name)
        if len(x) < n:
            more = np.zeros(max(n, 2 * len(x)), x.dtype)
            more[: len(x)] = x
            setattr(self, name, more)

    def _add(self, words: list[bytes]) -> None:
        made = self.learn(words)
        first, n = self.size, len(words)
        for name in ("_a", "_b", "_n", "_at", "_ids", "_met"):
            self._grown(name, first + n)
        own = slice(first, first + n)
        sizes = np.array([len(w) for w in words])
        short = sizes <= SHORT
        data = np.frombuffer(b"".join([w.ljust(SHORT, b"\0")[:SHORT] for w in words]), "<u8").reshape(-1, 2)
        self._a[own], self._b[own], self._n[own] = data[:, 0], data[:, 1], np.minimum(sizes, 255)
        width = np.dtype(self.kind).itemsize
        counts = np.array([-1 if x is None else len(x) // width for x in made])
        self._ids[own] = counts
        counts = np.maximum(counts, 0)
        self._at[own] = self._used + np.cumsum(counts) - counts
        new = np.frombuffer(b"".join([x for x in made if x]), self.kind)
        self._grown("_pool", self._used + len(new))
        self._pool[self._used : self._used + len(new)] = new
        self._used += len(new)
        self.size += n
        self._met[own] = True
        self._place(first + np.flatnonzero(short))
        for i in np.flatnonzero(~short).tolist():
            self._long[words[i]] = first + i

    def _make_room(self) -> None:
        """Keeps the words met since this was done last, if that frees half of the table."""
        kept = np.flatnonzero(self._met[: self.size])
        old, longs = {k: getattr(self, k) for k in ("_a", "_b", "_n", "_at", "_ids", "_pool")}, self._long
        self._reset()
        if len(kept) > self.most // 2:
            return
        new = np.full(len(old["_n"]), -1, np.int64)
        new[kept] = np.arange(len(kept))
        for name in ("_a", "_b", "_n", "_at", "_ids", "_met"):
            self._grown(name, len(kept))
        for name in ("_a", "_b", "_n", "_ids"):
            getattr(self, name)[: len(kept)] = old[name][kept]
        counts = np.maximum(self._ids[: len(kept)], 0).astype(np.int64)
        self._at[: len(kept)] = np.cumsum(counts) - counts
        self._pool = old["_pool"][ranges(old["_at"][kept], counts)]
        self._used, self.size = len(self._pool), len(kept)
        self._long = {w: int(new[i]) for w, i in longs.items() if new[i] >= 0}
        ours = np.ones(len(kept), bool)
        ours[list(self._long.values())] = False
        self._place(np.flatnonzero(ours))

    def entries(self, raw: bytes, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """The entry of each word data[start:stop]; raw: the same bytes. They hold until the next call."""
        if self.size > self.most:
            self._make_room()
        sizes = stops - starts
        a, b = packed_words(data, starts, sizes)
        n = np.minimum(sizes, 255).astype(np.uint8)
        short = sizes <= SHORT
        out = np.full(len(starts), -1, np.int64)
        rows = np.flatnonzero(short)
        out[rows] = self._find(a[rows], b[rows], n[rows])
        long_rows = np.flatnonzero(~short).tolist()
        known = self._long.get
        words_of = {i: raw[starts[i] : stops[i]] for i in long_rows}
        for i, w in words_of.items():
            out[i] = known(w, -1)
        missing = np.flatnonzero(out < 0)
        if len(missing):
            fresh = list({raw[x:y] for x, y in zip(starts[missing].tolist(), stops[missing].tolist(), strict=True)})
            self._add(fresh)
            rows = missing[short[missing]]
            out[rows] = self._find(a[rows], b[rows], n[rows])
            for i in long_rows:
                out[i] = self._long[words_of[i]]
        self._met[out] = True
        return out

    def counts(self, entries: np.ndarray) -> np.ndarray:
        """How many ids each entry has; -1 where its word stands for nothing by itself."""
        return self._ids[entries].astype(np.int64)

    def ids(self, entries: np.ndarray) -> np.ndarray:
        """The ids of these entries end to end."""
        return self._pool[ranges(self._at[entries], np.maximum(self._ids[entries], 0).astype(np.int64))]
