"""Progressive JPEG as a media column, in numpy.

Decoding: the scans of many files are read together. Their restart intervals are the lanes of a vector: each step
reads one symbol of every lane. Spectral selection and successive approximation accumulate in coefficient arrays;
then come the inverse transform (in whole numbers held by floats, so results do not depend on how files are dealt
to batches), the upsampling of chroma and the conversion to full-resolution RGB tensors.

Writing: any coefficients, by a fixed script (DC in two steps, AC in two bands and a refinement), with three components
at 4:2:0, quantisation by one, fixed code tables, and a restart every eight blocks. A payload of bytes is stored
losslessly as coefficients (byte less 128), 64 to a block: luma blocks first, then Cb and Cr; a comment tells its length.
Most blocks of texts are full: of bytes, none of them 127 to 129. These need no runs of zeros, so that tables give the bits
of several coefficients at once; their files are those that any other block's way of writing would give.

Columns: `media` stores texts as pictures and returns files, payloads and RGB tensors; `tensors` decodes a column of files.

Rows: a null file, and one that is no whole progressive JPEG, has null for its tensor. A null text counts as empty; an empty text is one block of zero bytes. Long texts are large pictures; their
lanes are their own. Repeated rows give equal values, an empty table an empty one. Other columns are carried along, those
with the names of results are replaced.
"""

from __future__ import annotations

import re
import struct
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpuscle.llm.shared import lean, small_batches

#: Blocks (or sets of interleaved blocks) between restarts, and bytes of payload that are worth a step of their own.
INTERVAL, BATCH = 8, 3 << 20


def zigzag() -> np.ndarray:
    """The place in a block (row by row) of each coefficient in scan order."""
    return np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))


ZIGZAG = zigzag()


# --- code tables


def code_lengths(symbols: list[int], sizes: list[tuple[int, int]]) -> tuple[bytes, bytes]:
    """(codes of each length 1..16, symbols): the first n symbols get codes of one length, and so on."""
    counts = [0] * 16
    left = len(symbols)
    for n, bits in sizes:
        counts[bits - 1] += min(n, left)
        left -= min(n, left)
    return bytes(counts), bytes(symbols)


#: DC: categories 0 to 11. AC: a run of zeros and a category; then ends of blocks.
DC_TABLE = code_lengths(list(range(12)), [(12, 4)])
_LIKELY = [0x05, 0x04, 0x06, 0x03, 0x02, 0x01, 0x07, 0x00, 0x15, 0x14, 0x16, 0x13, 0x12, 0x11, 0x17, 0xF0]
AC_TABLE = code_lengths([*_LIKELY, *(s for s in range(256) if s not in _LIKELY and s & 15 <= 10)], [(8, 4), (8, 6), (240, 10)])


def codes(table: tuple[bytes, bytes]) -> Iterator[tuple[int, int, int]]:
    """(symbol, code, bits)."""
    code, at = 0, 0
    for bits, n in enumerate(table[0], 1):
        for _ in range(n):
            yield table[1][at], code, bits
            code, at = code + 1, at + 1
        code <<= 1


def encoder(table: tuple[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
    code, bits = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for s, c, n in codes(table):
        code[s], bits[s] = c, n
    return code, bits


_LOOKUPS: dict[tuple[bytes, bytes], np.ndarray] = {}


def lookup(table: tuple[bytes, bytes]) -> np.ndarray:
    """By the next 16 bits: the symbol, times 32, and the code's length (0: no code)."""
    if table not in _LOOKUPS:
        out = np.zeros(1 << 16, np.int64)
        for s, c, n in codes(table):
            out[c << (16 - n) : (c + 1) << (16 - n)] = s << 5 | n
        if len(_LOOKUPS) > 64:
            _LOOKUPS.clear()
        _LOOKUPS[table] = out
    return _LOOKUPS[table]


DC_CODE, AC_CODE = encoder(DC_TABLE), encoder(AC_TABLE)

#: In steps(): the bits taken, and what is to be done.
_TAKEN, _PUT, _END_RUN = 31, 1 << 10, 1 << 11
_STEPS: dict[tuple, np.ndarray] = {}


def step(found: np.ndarray, extra: np.ndarray, low: int) -> np.ndarray:
    """What codes (of lookup) and the bits that follow them do in a first AC scan: places to go on (times 32), a flag, and
    (times 65536) the value to put or the number of blocks that end."""
    symbol = found >> 5
    run, n = symbol >> 4, symbol & 15
    ends = (n == 0) & (run < 15)
    value = np.where(ends, (1 << run) + extra, np.where(n > 0, extend(extra, n) << low, 0))
    return value << 16 | np.where(ends, _END_RUN, run + 1 << 5 | np.where(n > 0, _PUT, 0))


def steps(table: tuple[bytes, bytes], low: int) -> np.ndarray:
    """By the next 16 bits: step() and the bits it takes (0: there is no code, or it takes more than 16)."""
    if (table, low) not in _STEPS:
        found, ahead = lookup(table), np.arange(1 << 16)
        more = extra_bits(found)
        bits = (found & 31) + more
        whole = np.flatnonzero((found > 0) & (bits <= 16))
        out = np.zeros(1 << 16, np.int64)
        out[whole] = step(found[whole], ahead[whole] >> 16 - bits[whole] & (1 << more[whole]) - 1, low) | bits[whole]
        if len(_STEPS) > 16:
            _STEPS.clear()
        _STEPS[table, low] = out
    return _STEPS[table, low]


def extra_bits(found: np.ndarray) -> np.ndarray:
    """The bits that follow the codes of an AC scan: of a value, or of a number of blocks that end."""
    symbol = found >> 5
    run, n = symbol >> 4, symbol & 15
    return np.where((n == 0) & (run < 15), run, n)


# --- frames


@dataclass
class Component:
    name: int
    h: int
    v: int
    quant: int
    wide: int = 0  # blocks, without padding
    high: int = 0
    padded_wide: int = 0
    padded_high: int = 0
    base: int = 0  # of its blocks among all blocks of the batch


@dataclass
class Frame:
    width: int
    height: int
    components: list[Component]
    quants: dict[int, np.ndarray] = field(default_factory=dict)
    comment: bytes = b""
    scans: list[Scan] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.hmax, self.vmax = max(c.h for c in self.components), max(c.v for c in self.components)
        self.mcus = -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))
        for c in self.components:
            c.wide = -(-(-(-self.width * c.h // self.hmax)) // 8)
            c.high = -(-(-(-self.height * c.v // self.vmax)) // 8)
            c.padded_wide, c.padded_high = self.mcus[0] * c.h, self.mcus[1] * c.v

    def order(self, members: list[int]) -> np.ndarray:
        """Block rows in the order of a scan of these components."""
        if len(members) == 1:
            c = self.components[members[0]]
            if c.wide == c.padded_wide:
                return np.arange(c.base, c.base + c.high * c.wide)
            return (c.base + np.arange(c.high)[:, None] * c.padded_wide + np.arange(c.wide)).ravel()
        parts = []
        for i in members:
            c = self.components[i]
            grid = c.base + np.arange(c.padded_high * c.padded_wide).reshape(self.mcus[1], c.v, self.mcus[0], c.h)
            parts.append(grid.transpose(0, 2, 1, 3).reshape(-1, c.v * c.h))
        return np.concatenate(parts, axis=1).ravel()


@dataclass
class Scan:
    members: list[int]
    tables: list[tuple]  # for each member its DC and its AC table
    first: int
    last: int
    high: int
    low: int
    interval: int
    data: bytes


def place(frames: list[Frame]) -> int:
    """Gives all components their place among the blocks of a batch; the number of blocks."""
    at = 0
    for f in frames:
        for c in f.components:
            c.base = at
            at += c.padded_wide * c.padded_high
    return at


# --- reading

_END = re.compile(rb"\xff[^\x00\xff\xd0-\xd7]")


def parse(data: bytes) -> Frame:
    """The frame and its scans, still encoded."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at, tables, quants, interval, frame, comment = 2, {}, {}, 0, None, b""
    while True:
        while data[at : at + 2] == b"\xff\xff":
            at += 1
        kind = data[at + 1]
        if kind == 0xD9:
            break
        size = struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if kind == 0xDB:
            while body:
                n = 128 if body[0] >> 4 else 64
                quants[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if n == 128 else np.uint8).astype(np.int64)
                body = body[1 + n :]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif kind == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif kind == 0xFE:
            comment = body
        elif kind == 0xC2:
            height, width, n = struct.unpack_from(">HHB", body, 1)
            frame = Frame(width, height, [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)])
        elif 0xC0 <= kind <= 0xCF and kind != 0xCC:
            raise ValueError("not a progressive JPEG file with Huffman codes")
        elif kind == 0xDA:
            names = [c.name for c in frame.components]
            n = body[0]
            members = [names.index(body[1 + 2 * i]) for i in range(n)]
            used = [(tables.get(body[2 + 2 * i] >> 4), tables.get(16 | body[2 + 2 * i] & 15)) for i in range(n)]
            end = _END.search(data, at).start()
            frame.scans.append(Scan(members, used, body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15, interval, data[at:end]))
            at = end
    frame.quants, frame.comment = quants, comment
    return frame


class Bits:
    """The lanes' bytes, to be read at any bit; starts are in bytes."""

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        raw = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.int64)
        n = len(raw) - 4
        self._words = raw[:n] << 32 | raw[1 : n + 1] << 24 | raw[2 : n + 2] << 16 | raw[3 : n + 3] << 8 | raw[4 : n + 4]
        self.starts = 8 * starts

    def peek(self, at: np.ndarray, n: int = 16) -> np.ndarray:
        return self._words[at >> 3] >> (40 - n - (at & 7)) & ((1 << n) - 1)

    def read(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """n bits of each lane, 32 at most."""
        return self._words[at >> 3] >> (40 - n - (at & 7)) & ((1 << n) - 1)


def extend(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The signed value that n bits stand for."""
    return np.where(x >> np.maximum(n - 1, 0) & 1 | (n == 0), x, x - (1 << n) + 1)


@dataclass
class Layout:
    """Blocks in the order of a scan of several files, where each lane (restart interval) begins, and each file's lanes."""

    order: np.ndarray
    start: np.ndarray
    count: np.ndarray
    lanes: np.ndarray


def layout(frames: list[Frame], members: list[int], intervals: list[int]) -> Layout:
    orders = [f.order(members) for f in frames]
    sizes = np.array([len(x) for x in orders])
    per = np.array([sum(f.components[i].h * f.components[i].v for i in members) if len(members) > 1 else 1 for f in frames])
    step = np.array(intervals) * per
    step = np.where(step > 0, step, np.maximum(sizes, 1))
    lanes = -(-sizes // step)
    nth = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    within = nth * np.repeat(step, lanes)
    start = np.repeat(np.cumsum(sizes) - sizes, lanes) + within
    return Layout(np.concatenate(orders), start, np.minimum(np.repeat(step, lanes), np.repeat(sizes, lanes) - within), lanes)


class Lanes:
    """The restart intervals of a scan of several files: blocks in order, where each lane begins, and its bits."""

    def __init__(self, scans: list[Scan], of: Layout):
        self.order, self.start, self.count = of.order, of.start, of.count
        raw = np.frombuffer(b"".join(x for s in scans for x in (s.data, bytes(8))), np.uint8)
        begins = np.cumsum([0, *(len(s.data) + 8 for s in scans)])
        full = np.flatnonzero(raw == 0xFF)
        after = raw[full + 1]
        stuffed, marks = full[after == 0] + 1, full[after & 0xF8 == 0xD0]
        own = np.diff(np.searchsorted(marks, begins)) + 1
        if (own < of.lanes).any():
            raise ValueError("a scan has too few restart intervals")
        first = np.sort(np.concatenate([begins[:-1], marks + 2]))
        first = first[np.arange(len(first)) - np.repeat(np.cumsum(own) - own, own) < np.repeat(of.lanes, own)]
        data, times = raw.copy(), np.ones(len(raw), np.int64)
        data[marks] = data[marks + 1] = times[stuffed] = 0
        times[marks] = times[marks + 1] = 4  # eight zeros after each lane
        self.bits = Bits(np.repeat(data, times), first - np.searchsorted(stuffed, first) + 6 * np.searchsorted(marks, first))


def read_dc(lanes: Lanes, coefs: np.ndarray, frame: Frame, scan: Scan) -> None:
    members = [m for i, m in enumerate(scan.members) for _ in range(frame.components[m].h * frame.components[m].v if len(scan.members) > 1 else 1)]
    tables = {m: lookup(t[0]) for m, t in zip(scan.members, scan.tables, strict=True)} if not scan.high else {}
    at, before = lanes.bits.starts.copy(), {m: np.zeros(len(lanes.start), np.int64) for m in scan.members}
    alive = np.arange(len(lanes.start))
    for i in range(int(lanes.count.max(initial=0))):
        if (lanes.count[alive] <= i).any():
            alive = alive[lanes.count[alive] > i]
        m, pos = members[i % len(members)], at[alive]
        row = lanes.order[lanes.start[alive] + i]
        if scan.high:
            coefs[row, 0] |= (lanes.bits.peek(pos, 1) << scan.low).astype(coefs.dtype)
            at[alive] = pos + 1
            continue
        found = tables[m][lanes.bits.peek(pos)]
        n, pos = found >> 5, pos + (found & 31)
        before[m][alive] += extend(lanes.bits.read(pos, n), n)
        coefs[row, 0] = before[m][alive] << scan.low
        at[alive] = pos + n


def read_ac(lanes: Lanes, coefs: np.ndarray, scan: Scan) -> None:
    table, codes_of, bits, flat = steps(scan.tables[0][1], scan.low), lookup(scan.tables[0][1]), lanes.bits, coefs.reshape(-1)
    at, block, end = lanes.bits.starts.copy(), lanes.start.copy(), lanes.start + lanes.count
    k, before = np.full(len(at), scan.first), lanes.order[block] * 64 - 1
    while len(at):
        found = table[bits.peek(at)]
        length = found & _TAKEN
        if not length.all():  # what takes more than 16 bits
            some = np.flatnonzero(length == 0)
            code = codes_of[bits.peek(at[some])]
            more = extra_bits(code)
            found[some], length[some] = step(code, bits.read(at[some] + (code & 31), more), scan.low), (code & 31) + more
        at = at + length
        k = k + (found >> 5 & 31)
        kind = found & (_PUT | _END_RUN)
        if (kind == _PUT).all():
            flat[before + np.minimum(k, 64)] = found >> 16
            over = k > scan.last
        else:
            put = np.flatnonzero(kind == _PUT)
            flat[before[put] + np.minimum(k[put], 64)] = found[put] >> 16
            over = (kind == _END_RUN) | (k > scan.last)
        if over.any():
            block = block + np.where(kind == _END_RUN, found >> 16, over)
            k = np.where(over, scan.first, k)
            done = block >= end
            if done.any():
                keep = ~done
                at, block, end, k = at[keep], block[keep], end[keep], k[keep]
            before = lanes.order[block] * 64 - 1


def refine_ac(lanes: Lanes, coefs: np.ndarray, scan: Scan) -> None:
    """Events (block, from, to, bit) say which coefficients have their next bits where; they are read afterwards.

    Blocks whose coefficients are all known, and blocks that have none, share a row of places each; of the former, all
    next bits are one string, read as such.
    """
    table, bits, width = lookup(scan.tables[0][1]), lanes.bits, scan.last + 1 - scan.first
    band = coefs[lanes.order, scan.first : scan.last + 1]
    old = band != 0
    known = old.sum(1)
    rest = np.flatnonzero((known > 0) & (known < width))
    slot = np.where(known == width, 0, 1)
    slot[rest] = np.arange(2, 2 + len(rest))
    old = old[rest]
    zeros = np.zeros((2 + len(rest), width + 1), np.int16)  # before each place
    zeros[1] = np.arange(width + 1)
    np.cumsum(~old, axis=1, out=zeros[2:, 1:])
    place_of = np.full((2 + len(rest), 65), width, np.int16)  # of each zero
    place_of[1, :width] = np.arange(width)
    row, col = np.nonzero(~old)
    place_of[2 + row, zeros[2 + row, col]] = col
    at, block, end = bits.starts.copy(), lanes.start.copy(), lanes.start + lanes.count
    k, runs = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    events: list[tuple[np.ndarray, ...]] = []
    new: list[tuple[np.ndarray, ...]] = []
    while len(at):
        within = runs > 0  # a run of ended blocks goes on
        found = np.where(within, 0, table[bits.peek(at)])
        symbol = found >> 5
        run, n = symbol >> 4, symbol & 15
        at = at + (found & 31)
        ends = ~within & (n == 0) & (run < 15)
        extra = np.where(ends, run, n)
        value = bits.read(at, extra)
        at = at + extra
        runs = np.where(ends, (1 << run) + value, runs)
        whole, own = within | ends, slot[block]
        target = np.where(whole, width, place_of[own, np.minimum(zeros[own, k] + run, 64)])
        passed = (target - k) - (zeros[own, target] - zeros[own, k])
        some = np.flatnonzero(passed)
        events.append((block[some], k[some], passed[some], at[some]))
        at = at + passed
        put = np.flatnonzero(n)
        new.append((block[put], target[put], value[put]))
        runs = runs - whole
        k = target + 1
        over = k >= width
        if over.any():
            block = block + over
            k = np.where(over, 0, k)
            done = block >= end
            if done.any():
                keep = ~done
                at, block, end, k, runs = at[keep], block[keep], end[keep], k[keep], runs[keep]
    if events:
        b, first, n, at = (np.concatenate(x) for x in zip(*events, strict=True))
        full = slot[b] == 0
        one = np.flatnonzero(full)
        if len(one):
            word = (bits.peek(at[one], 32) << 32 | bits.peek(at[one] + 32, 32)).astype(">i8")
            next_bits = np.unpackbits(word.view(np.uint8).reshape(-1, 8), axis=1)[:, :width]
            found = band[b[one]]
            band[b[one]] = found + np.where(found > 0, next_bits, -next_bits.astype(np.int8)).astype(band.dtype) * (1 << scan.low)
        b, first, n, at = b[~full], first[~full], n[~full], at[~full]
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        row_of, col_of = np.nonzero(old)
        begins = np.cumsum(old.sum(1)) - old.sum(1)  # of each block among the old ones
        one = np.repeat(begins[slot[b] - 2] + first - zeros[slot[b], first], n) + nth
        one = one[bits.peek(np.repeat(at, n) + nth, 1) == 1]
        r, c = rest[row_of[one]], col_of[one]
        band[r, c] += np.where(band[r, c] > 0, 1 << scan.low, -1 << scan.low).astype(band.dtype)
        b, c, sign = (np.concatenate(x) for x in zip(*new, strict=True))
        band[b, c] = np.where(sign == 1, 1 << scan.low, -1 << scan.low)
    coefs[lanes.order, scan.first : scan.last + 1] = band


def read_coefficients(files: list[bytes]) -> tuple[list[Frame], np.ndarray]:
    """The frames, and the blocks of all of them with coefficients in scan order."""
    frames = [parse(x) for x in files]
    coefs = np.zeros((place(frames), 64), np.int32)
    layouts: dict[tuple, Layout] = {}
    for i in range(max((len(f.scans) for f in frames), default=0)):
        alike = defaultdict(list)
        for f in frames:
            if i < len(f.scans):
                s = f.scans[i]
                shape = tuple((f.components[m].h, f.components[m].v) for m in s.members)
                alike[(tuple(s.members), shape, tuple(s.tables), s.first, s.last, s.high, s.low)].append((f, s))
        for group in alike.values():
            frame, scan = group[0]
            own = (tuple(scan.members), *((id(f), s.interval) for f, s in group))
            if own not in layouts:
                layouts[own] = layout([f for f, _ in group], scan.members, [s.interval for _, s in group])
            lanes = Lanes([s for _, s in group], layouts[own])
            if scan.first == 0:
                read_dc(lanes, coefs, frame, scan)
            elif scan.high:
                refine_ac(lanes, coefs, scan)
            else:
                read_ac(lanes, coefs, scan)
    return frames, coefs


# --- pictures

_SCALE = 12
_BASIS = np.rint(np.array([[(0.5 if u else 0.125**0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for u in range(8)] for x in range(8)]) * (1 << _SCALE))


_WHOLE = np.ascontiguousarray(np.kron(_BASIS, _BASIS)[:, ZIGZAG].T)  # from coefficients in scan order to samples


def samples(coefs: np.ndarray, quant: np.ndarray | None) -> np.ndarray:
    """8 x 8 samples of blocks; all sums are whole numbers below 2^53, so their order does not matter."""
    out = np.empty((len(coefs), 8, 8), np.int16)
    for i in range(0, len(coefs), 2048):
        own = coefs[i : i + 2048]
        both = (own if quant is None or (quant == 1).all() else own * quant).astype(np.float64) @ _WHOLE
        both *= 0.5 ** (2 * _SCALE)
        both += 128.5
        out[i : i + 2048] = np.clip(np.floor(both, out=both), 0, 255, out=both).reshape(-1, 8, 8)
    return out


def plane(c: Component, blocks: np.ndarray) -> np.ndarray:
    """A component at its own resolution."""
    return blocks.reshape(c.padded_high, c.padded_wide, 8, 8).transpose(0, 2, 1, 3).reshape(c.padded_high * 8, c.padded_wide * 8)


def spread(frame: Frame, c: Component, own: np.ndarray) -> np.ndarray:
    """A component's plane at the resolution of the picture."""
    v, h = frame.vmax // c.v, frame.hmax // c.h
    if v > 1 or h > 1:
        own = own.repeat(v, axis=0).repeat(h, axis=1)
    return own[: frame.height, : frame.width]


def pictures(frames: list[Frame], coefs: np.ndarray) -> Iterator[np.ndarray]:
    """RGB tensors (height, width, 3) of 8 bits."""
    made = None
    if all((q == 1).all() for f in frames for q in f.quants.values()):
        made = samples(coefs, None)
    for f in frames:
        planes = []
        for c in f.components:
            span = slice(c.base, c.base + c.padded_wide * c.padded_high)
            planes.append(plane(c, made[span] if made is not None else samples(coefs[span], f.quants.get(c.quant))))
        out = np.empty((f.height, f.width, 3), np.uint8)
        if len(planes) == 1:
            out[:] = spread(f, f.components[0], planes[0])[:, :, None]
        else:
            luma, blue, red = f.components[:3]
            y, cb, cr = spread(f, luma, planes[0]), planes[1].astype(np.int32) - 128, planes[2].astype(np.int32) - 128
            wide = (blue.h, blue.v) == (red.h, red.v)  # then what chroma adds is spread, and not chroma itself
            if not wide:
                cb, cr = spread(f, blue, cb), spread(f, red, cr)
            for i, add in enumerate((91881 * cr + 32768 >> 16, -(22554 * cb + 46802 * cr + 32768 >> 16), 116130 * cb + 32768 >> 16)):
                add = add.astype(np.int16)
                out[:, :, i] = np.clip(y + (spread(f, blue, add) if wide else add), 0, 255)
        yield out


def decode(files: list[bytes]) -> list[np.ndarray]:
    return list(pictures(*read_coefficients(files)))


# --- writing


def category(x: np.ndarray) -> np.ndarray:
    """The bits that |x| needs."""
    return np.frexp(np.abs(x).astype(np.float64))[1].astype(np.int64)


def low_bits(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(x < 0, x + (1 << n) - 1, x)


class Entropy:
    """Packs (value, bits) entries, in order; lanes end at whole bytes, filled with ones."""

    def __init__(self, value: np.ndarray, bits: np.ndarray, lane_entries: np.ndarray):
        """lane_entries: how many entries each lane has."""
        before = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])
        cuts = np.concatenate([[0], np.cumsum(lane_entries)])
        sizes = before[cuts[1:]] - before[cuts[:-1]]
        fill = -sizes % 8
        self.ends = np.cumsum(sizes + fill) >> 3
        shift = (self.ends << 3) - sizes - fill - before[cuts[:-1]]
        used = np.flatnonzero(bits)
        lane = np.repeat(np.arange(len(sizes)), lane_entries)[used]
        at = before[used] + shift[lane]
        self._words = np.zeros(int(self.ends[-1] // 8 + 2) if len(self.ends) else 2, np.uint64)
        self._add(at, value[used], bits[used])
        some = np.flatnonzero(fill)
        self._add((self.ends[some] << 3) - fill[some], (1 << fill[some]) - 1, fill[some])
        self.data = self._words.astype(">u8").tobytes()

    def _add(self, at: np.ndarray, value: np.ndarray, bits: np.ndarray) -> None:
        if not len(at):
            return
        word, room = at >> 6, 64 - (at & 63) - bits
        value = value.astype(np.uint64)
        here = np.where(room >= 0, value << np.maximum(room, 0).astype(np.uint64), value >> np.maximum(-room, 0).astype(np.uint64))
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        self._words[word[first]] |= np.bitwise_or.reduceat(here, first)
        over = np.flatnonzero(room < 0)  # one entry of a word at most goes on in the next
        self._words[word[over] + 1] |= value[over] << (64 + room[over]).astype(np.uint64)


def dc_entries(values: np.ndarray, lane_of: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Differences to the block before of the same component and lane."""
    diff = values.copy()
    for m in np.unique(member):
        own = np.flatnonzero(member == m)
        v, lane = values[own], lane_of[own]
        diff[own[1:]] = np.where(lane[1:] == lane[:-1], v[1:] - v[:-1], v[1:])
    n = category(diff)
    code, bits = DC_CODE
    return code[n] << n | low_bits(diff, n), bits[n] + n


def ac_entries(band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An entry for each coefficient and one for the end of the block, block by block."""
    code, bits = AC_CODE
    blocks, width = band.shape
    value, size = np.zeros((blocks, width + 1), np.int64), np.zeros((blocks, width + 1), np.int64)
    row, col = np.nonzero(band)
    first = np.concatenate([[True], row[1:] != row[:-1]])[: len(row)]
    before = np.where(first, -1, np.concatenate([[0], col[:-1]])[: len(row)])
    run = col - before - 1
    x = band[row, col].astype(np.int64)
    n = category(x)
    symbol = (run & 15) << 4 | n
    v, s = code[symbol] << n | low_bits(x, n), bits[symbol] + n
    for i in range(3):  # runs of 16 zeros go ahead of the symbol
        long = np.flatnonzero(run >> 4 > i)
        v[long] |= code[0xF0] << s[long]
        s[long] += bits[0xF0]
    value[row, col], size[row, col] = v, s
    open_ = np.flatnonzero(band[:, -1] == 0)
    value[open_, width], size[open_, width] = code[0], bits[0]
    return value.ravel(), size.ravel()


def refinement_entries(band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last bit of coefficients of which all others are known; two entries a place and two at the end."""
    code, bits = AC_CODE
    blocks, width = band.shape
    size_of, old = np.abs(band), np.abs(band) > 1
    value, size = np.zeros((blocks, width + 1, 2), np.int64), np.zeros((blocks, width + 1, 2), np.int64)
    value[:, :width, 1], size[:, :width, 1] = size_of & 1, old
    value[:, :width, 1] *= old
    new_row, new_col = np.nonzero(size_of == 1)
    after = np.zeros(blocks, np.int64)  # where the rest of each block begins
    if len(new_row):
        still = ~old & (size_of == 0)
        zeros = np.zeros((blocks, width + 1), np.int64)
        np.cumsum(still, axis=1, out=zeros[:, 1:])
        place_of = np.zeros((blocks, 65), np.int64)
        r, c = np.nonzero(still)
        place_of[r, zeros[r, c]] = c
        first = np.concatenate([[True], new_row[1:] != new_row[:-1]])
        start = np.where(first, 0, np.concatenate([[0], new_col[:-1] + 1]))
        run = zeros[new_row, new_col] - zeros[new_row, start]
        for i in range(3):  # a run of 16 zeros is a symbol of its own, and what it passes follows it
            long = np.flatnonzero(run >> 4 > i)
            at = start[long]
            value[new_row[long], at, 0], size[new_row[long], at, 0] = code[0xF0], bits[0xF0]
            start[long] = place_of[new_row[long], zeros[new_row[long], at] + 15] + 1
        symbol = (run & 15) << 4 | 1
        value[new_row, start, 0] = code[symbol] << 1 | (band[new_row, new_col] > 0)
        size[new_row, start, 0] = bits[symbol] + 1
        np.maximum.at(after, new_row, new_col + 1)
    rest = np.flatnonzero(after < width)
    value[rest, after[rest], 0], size[rest, after[rest], 0] = code[0], bits[0]
    return value.ravel(), size.ravel()


def pair_entries(low: int) -> np.ndarray:
    """By two coefficients of a byte each, none between and none left out: the bits of both, times 32, and their number. 0
    has none."""
    x = np.arange(256).astype(np.uint8).view(np.int8).astype(np.int64)
    v, s = ac_entries((np.sign(x) * (np.abs(x) >> low))[:, None])
    value, size = v.reshape(-1, 2)[:, 0], s.reshape(-1, 2)[:, 0]
    return ((value << size[:, None] | value[:, None]) << 5 | size + size[:, None]).astype(np.int32).ravel()  # the later one is the high byte


#: Components, first and last coefficient, and the high and low bit of each scan.
SCRIPT = [((0, 1, 2), 0, 0, 0, 1), *(((m,), a, b, 0, 1) for m in range(3) for a, b in ((1, 20), (21, 63))), ((0, 1, 2), 0, 0, 1, 0), *(((m,), 1, 63, 1, 0) for m in range(3))]
_PAIRS = pair_entries(1)


def full_ac_entries(band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ac_entries(of the halves) of bytes that are 2 or more in size: four coefficients to an entry."""
    blocks, width = band.shape
    padded = np.zeros((blocks, -(-width // 4) * 4), np.int8)
    padded[:, :width] = band
    pairs = _PAIRS[padded.view("<u2")]
    value, size = pairs >> 5, pairs & 31
    return value[:, ::2].astype(np.int64) << size[:, 1::2] | value[:, 1::2], (size[:, ::2] + size[:, 1::2]).astype(np.int64)


def full_refinement_entries(band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """refinement_entries of blocks whose coefficients are all known: the end of the block, and all bits at once."""
    code, bits = AC_CODE
    blocks, width = band.shape
    value, size = np.empty((blocks, 2), np.int64), np.empty((blocks, 2), np.int64)
    word = np.zeros((blocks, 8), np.uint8)
    word[:, : -(-width // 8)] = np.packbits((band & 1).astype(np.uint8), axis=1)
    value[:, 0], size[:, 0] = code[0], bits[0]
    value[:, 1], size[:, 1] = word.view(">u8").ravel() >> np.uint64(64 - width), width
    return value, size


def band_entries(band: np.ndarray, full: np.ndarray, empty: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of a first scan or of a refinement, and how many each block has. Blocks that are full (bytes, all 2 or more
    in size) or empty need few, all others one or two for each coefficient."""
    some, none, rest = np.flatnonzero(full), np.flatnonzero(empty), np.flatnonzero(~full & ~empty)
    made = [(some, *(full_ac_entries if first else full_refinement_entries)(band[some]))]
    own = band[rest].astype(np.int32)
    value, size = ac_entries(np.sign(own) * (np.abs(own) >> 1)) if first else refinement_entries(own)
    made.append((rest, value.reshape(len(rest), -1), size.reshape(len(rest), -1)) if len(rest) else (rest, own, own))
    made.append((none, np.full((len(none), 1), AC_CODE[0][0]), np.full((len(none), 1), AC_CODE[1][0])))
    counts = np.zeros(len(band), np.int64)
    for rows, v, _ in made:
        counts[rows] = v.shape[1]
    begins = np.cumsum(counts) - counts
    values, sizes = np.empty(counts.sum(), np.int64), np.empty(counts.sum(), np.int64)
    for rows, v, n in made:
        at = begins[rows][:, None] + np.arange(v.shape[1])
        values[at], sizes[at] = v, n
    return values, sizes, counts


def _segment(kind: int, body: bytes) -> bytes:
    return b"\xff" + bytes([kind]) + struct.pack(">H", len(body) + 2) + body


def _head(frame: Frame) -> bytes:
    sof = struct.pack(">BHHB", 8, frame.height, frame.width, len(frame.components)) + b"".join(bytes([c.name, c.h << 4 | c.v, 0]) for c in frame.components)
    tables = b"".join(bytes([k]) + a + b for k, (a, b) in ((0, DC_TABLE), (16, AC_TABLE)))
    return b"\xff\xd8" + _segment(0xFE, frame.comment) + _segment(0xDB, b"\0" + b"\1" * 64) + _segment(0xC2, sof) + _segment(0xC4, tables) + _segment(0xDD, struct.pack(">H", INTERVAL))


def write_coefficients(frames: list[Frame], coefs: np.ndarray) -> list[bytes]:
    """Files of frames that place() has placed, with three components at 4:2:0."""
    if not frames:
        return []
    out = [[_head(f)] for f in frames]
    layouts = {m: layout(frames, list(m), [INTERVAL] * len(frames)) for m in dict.fromkeys(x[0] for x in SCRIPT)}
    small = coefs if coefs.dtype == np.int8 else np.clip(coefs, -128, 127).astype(np.int8)
    full = ((small[:, 1:].view(np.uint8) + np.uint8(1)) > 2).all(1)  # all but -1, 0, 1
    if coefs.dtype != np.int8:
        full &= (small == coefs).all(1)
    empty = ~small[:, 1:].any(1)
    for members, first, last, high, low in SCRIPT:
        of = layouts[members]
        if first == 0:
            v = coefs[of.order, 0].astype(np.int64)
            if high:
                value, bits = v >> low & 1, np.ones(len(v), np.int64)
            else:
                value, bits = dc_entries(v >> low, np.repeat(np.arange(len(of.count)), of.count), np.tile([0, 0, 0, 0, 1, 2], len(v) // 6))
            entries = of.count
        else:
            value, bits, each = band_entries(coefs[of.order, first : last + 1], full[of.order], empty[of.order], not high)
            entries = np.add.reduceat(each, of.start)
        packed = Entropy(value, bits, entries)
        sos = bytes([len(members)]) + b"".join(bytes([frames[0].components[m].name, 0]) for m in members) + bytes([first, last, high << 4 | low])
        head, start = _segment(0xDA, sos), 0
        data, ends = marked(packed, of.lanes)
        for parts, end in zip(out, ends, strict=True):
            parts += (head, data[start:end])
            start = end
    return [b"".join([*parts, b"\xff\xd9"]) for parts in out]


def marked(packed: Entropy, lanes: np.ndarray) -> tuple[bytes, list[int]]:
    """The lanes' bytes with a zero after each 255 and marks between the lanes of a file; where each file ends."""
    last = np.cumsum(lanes)
    ends = packed.ends[last - 1]
    data = np.frombuffer(packed.data, np.uint8)[: ends[-1]]
    nth = np.arange(last[-1]) - np.repeat(last - lanes, lanes)
    inner = np.flatnonzero(nth)
    full, begins = np.flatnonzero(data == 0xFF), packed.ends[inner - 1]
    marks = np.stack([np.full(len(inner), 0xFF), 0xD0 + (nth[inner] - 1) % 8], axis=1)
    at = np.concatenate([full + 1, np.repeat(begins, 2)])
    made = np.insert(data, at, np.concatenate([np.zeros(len(full), np.uint8), marks.ravel().astype(np.uint8)]))
    return made.tobytes(), (ends + np.searchsorted(full, ends) + 2 * np.searchsorted(begins, ends)).tolist()


def picture_frame(blocks: int, comment: bytes) -> Frame:
    """A nearly square frame of three components that has room for so many blocks."""
    mcus = max(1, -(-blocks // 6))
    wide = int(np.ceil(np.sqrt(mcus)))
    high = -(-mcus // wide)
    if wide > 4095:
        raise ValueError("a payload is larger than a picture can be")
    return Frame(16 * wide, 16 * high, [Component(1, 2, 2, 0), Component(2, 1, 1, 0), Component(3, 1, 1, 0)], comment=comment)


# --- payloads


def store(payloads: list[bytes]) -> list[bytes]:
    """Pictures whose coefficients are the payloads' bytes; each payload is a multiple of 64 bytes."""
    frames = [picture_frame(len(p) // 64, b"payload %d" % len(p)) for p in payloads]
    coefs = np.zeros((place(frames), 64), np.int8)
    for f, p in zip(frames, payloads, strict=True):
        at = f.components[0].base
        coefs[at : at + len(p) // 64] = (np.frombuffer(p, np.uint8) ^ 128).view(np.int8).reshape(-1, 64)
    return write_coefficients(frames, coefs)


def restore(files: list[bytes]) -> tuple[list[bytes], list[np.ndarray]]:
    """The payloads of pictures that store() made, and the pictures' RGB tensors."""
    frames, coefs = read_coefficients(files)
    out = []
    for f in frames:
        size, at = int(f.comment.split()[1]), f.components[0].base
        out.append((coefs[at : at + size // 64] + 128).astype(np.uint8).tobytes())
    return out, list(pictures(frames, coefs))


def feature(picture: np.ndarray) -> str:
    """Height, width, and for each channel the mean and the mean square, in thousandths."""
    flat = picture.reshape(-1, 3)
    n = len(flat)
    means = [int(x) * 1000 // n for x in flat.sum(0, dtype=np.int64)]
    squares = [int(np.dot(c := np.ascontiguousarray(flat[:, i], np.float64), c)) * 1000 // n for i in range(3)]
    return f"{picture.shape[0]}x{picture.shape[1]}:{','.join(map(str, means + squares))}"


# --- columns

_TENSOR = [T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("rgb", T.BinaryType())]
_MEDIA = [T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType()), T.StructField("payload", T.BinaryType()), *_TENSOR]


def _in_batches(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of batches with a bounded number of bytes in a column, or one row; and the column's values."""
    for b in batches:
        values = b.column(b.schema.get_field_index(column)).cast(pa.binary()).to_pylist()
        at = 0
        while at < len(values):
            end, size = at, 0
            while end < len(values) and (end == at or size + len(values[end] or b"") <= BATCH):
                size += len(values[end] or b"")
                end += 1
            yield b.slice(at, end - at), values[at:end]
            at = end


def _tensor_columns(made: list[np.ndarray | None]) -> list[pa.Array]:
    size = lambda i: pa.array([None if x is None else x.shape[i] for x in made], pa.int32())
    return [size(0), size(1), pa.array([None if x is None else x.tobytes() for x in made], pa.binary())]


def media(df: DataFrame, text: str = "text", derive: Callable[..., list[pa.Array]] | None = None, derived: list[T.StructField] | None = None) -> DataFrame:
    """df with its texts as pictures, read back: n_bytes of the text, media (the file), payload (the text and zero
    bytes up to a multiple of 64, as read from the file), and the tensor: height, width, rgb (height x width x 3 bytes).

    derive(n_bytes, files, payloads, tensors) may give other columns (`derived`) in their place, if a query needs
    no tensor but what is computed from it: the tensors then stay in the task.
    """
    small_batches(df.sparkSession)
    made = derived if derive else _MEDIA
    kept = [f for f in df.schema.fields if f.name not in {x.name for x in made}]

    def columns(sizes: list[int], files: list[bytes], back: list[bytes], tensors: list[np.ndarray]) -> list[pa.Array]:
        return [pa.array(sizes, pa.int64()), pa.array(files, pa.binary()), pa.array(back, pa.binary()), *_tensor_columns(tensors)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, values in _in_batches(batches, text):
            raw = [v or b"" for v in values]
            files = store([t + bytes(-len(t) % 64 or 64 * (not t)) for t in raw])
            out = (derive or columns)([len(t) for t in raw], files, *restore(files))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(f.name)) for f in kept), *out], [f.name for f in (*kept, *made)])

    return df.mapInArrow(lean(run), T.StructType([*kept, *made]))


def decoded(files: list[bytes | None]) -> list[np.ndarray | None]:
    """The tensor of each file; None for null and for what is no whole progressive JPEG."""
    try:
        if None not in files:
            return list(decode(files))
    except (ValueError, LookupError, AttributeError, TypeError, struct.error):
        pass
    if len(files) == 1:
        return [None]
    return [x for f in files for x in (decoded([f]) if f is not None else [None])]


def tensors(df: DataFrame, column: str = "media") -> DataFrame:
    """df with height, width and rgb of a column of progressive JPEG files."""
    small_batches(df.sparkSession)
    kept = [f for f in df.schema.fields if f.name not in {x.name for x in _TENSOR}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, values in _in_batches(batches, column):
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(f.name)) for f in kept), *_tensor_columns(decoded(values))], [f.name for f in (*kept, *_TENSOR)])

    return df.mapInArrow(lean(run), T.StructType([*kept, *_TENSOR]))
