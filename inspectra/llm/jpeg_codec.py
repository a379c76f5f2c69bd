"""Progressive JPEG in numpy: many images at once, one lane for each restart interval.

The decoder takes any Huffman-coded progressive image of 8 bits and 1 or 3 components: spectral-selection and successive-
approximation scans are gathered in coefficient arrays (blocks x 64, in zigzag order). In a loop over steps all lanes of a group of
scans read one symbol each. The encoder writes given coefficients of 3 components, chroma at half the width and height, in SCRIPT's scans.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass, field

import numpy as np

from inspectra.llm.common import pack_bits, peek_table
from inspectra.llm.huffman_ids import canonical_codes, code_lengths

RESTART = 16
#: Scans that the encoder writes: first and last coefficient, bit already sent (0: first scan), lowest bit sent now.
BANDS = ((1, 20, 0, 0), (21, 63, 0, 1), (21, 63, 1, 0))
_MARKER = re.compile(rb"\xff+[^\x00\xff\xd0-\xd7]", re.S)


def zigzag() -> np.ndarray:
    """Row-major place in the 8x8 block of each coefficient in zigzag order."""
    cells = sorted(((i, j) for i in range(8) for j in range(8)), key=lambda c: (sum(c), c[0] if sum(c) % 2 else c[1]))
    return np.array([8 * i + j for i, j in cells])


@dataclass
class Component:
    key: int
    h: int
    v: int
    table: int
    wide: int = 0  # blocks in a row, padded to whole MCUs
    columns: int = 0  # blocks in a row and in a column, not padded
    rows: int = 0
    base: int = 0  # its first block among the image's


@dataclass
class Scan:
    parts: list[tuple[int, int, int]]  # component's number, DC and AC table
    first: int
    last: int
    high: int
    low: int
    restart: int
    tables: dict[int, bytes]  # by class << 4 | number
    data: tuple[int, int]  # where the entropy-coded bytes are in the file


@dataclass
class Image:
    width: int = 0
    height: int = 0
    components: list[Component] = field(default_factory=list)
    quants: dict[int, np.ndarray] = field(default_factory=dict)
    scans: list[Scan] = field(default_factory=list)
    blocks: int = 0
    mcus: tuple[int, int] = (0, 0)


def parse(raw: bytes) -> Image:
    image, tables, restart, at = Image(), {}, 0, 2
    if raw[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    while True:
        while raw[at] == 0xFF and raw[at + 1] == 0xFF:
            at += 1
        kind = raw[at + 1]
        if kind == 0xD9:
            return image
        size = int.from_bytes(raw[at + 2 : at + 4], "big")
        body = raw[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xC2:
            if body[0] != 8:
                raise ValueError("8 bits a sample are asked for")
            image.height, image.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            image.components = [Component(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
            _lay_out(image)
        elif kind in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)) and kind != 0xCC:
            raise ValueError("not a progressive JPEG file")
        elif kind == 0xDB:
            while body:
                wide = body[0] >> 4
                image.quants[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.int64)
                body = body[65 + 64 * wide :]
        elif kind == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                tables = tables | {body[0]: body[1:n]}
                body = body[n:]
        elif kind == 0xDD:
            restart = int.from_bytes(body, "big")
        elif kind == 0xDA:
            keys = {c.key: i for i, c in enumerate(image.components)}
            parts = [(keys[body[i]], body[i + 1] >> 4, body[i + 1] & 15) for i in range(1, 1 + 2 * body[0], 2)]
            end = _MARKER.search(raw, at).start()
            first, last, high_low = body[1 + 2 * body[0] :]
            image.scans.append(Scan(parts, first, last, high_low >> 4, high_low & 15, restart, tables, (at, end)))
            at = end


def _lay_out(image: Image) -> None:
    h, v = max(c.h for c in image.components), max(c.v for c in image.components)
    image.mcus = -(-image.width // (8 * h)), -(-image.height // (8 * v))
    for c in image.components:
        c.wide = image.mcus[0] * c.h
        c.columns, c.rows = -(-(-(-image.width * c.h // h)) // 8), -(-(-(-image.height * c.v // v)) // 8)
        c.base = image.blocks
        image.blocks += c.wide * image.mcus[1] * c.v


@functools.lru_cache(maxsize=4096)
def _mcu_order(mcus: tuple[int, int], parts: tuple[tuple[int, int, int, int], ...]) -> np.ndarray:
    """Blocks of an interleaved scan in turn; parts: (h, v, wide, base) of each component."""
    y, x = np.divmod(np.arange(mcus[0] * mcus[1]), mcus[0])
    columns = [base + (y * v + j) * wide + x * h + i for h, v, wide, base in parts for j in range(v) for i in range(h)]
    return np.stack(columns, 1).ravel()


@functools.lru_cache(maxsize=4096)
def _raster(columns: int, rows: int, wide: int, base: int) -> np.ndarray:
    return (base + np.arange(rows)[:, None] * wide + np.arange(columns)).ravel()


def scan_order(image: Image, scan: Scan) -> tuple[np.ndarray, int]:
    """The scan's blocks in turn, and how many make a unit of restart intervals."""
    parts = [image.components[i] for i, _, _ in scan.parts]
    if len(parts) > 1:
        return _mcu_order(image.mcus, tuple((c.h, c.v, c.wide, c.base) for c in parts)), sum(c.h * c.v for c in parts)
    c = parts[0]
    return _raster(c.columns, c.rows, c.wide, c.base), 1


@functools.lru_cache(maxsize=256)
def lookup(table: bytes) -> np.ndarray:
    """For each 16 bits: symbol << 8 | code length."""
    out, at, code = np.zeros(1 << 16, np.int64), 16, 0
    for n in range(1, 17):
        for symbol in table[at : at + table[n - 1]]:
            out[code << (16 - n) : (code + 1) << (16 - n)] = symbol << 8 | n
            code += 1
        at += table[n - 1]
        code <<= 1
    return out


class Lanes:
    """The restart intervals of several scans: their bits without stuffing, and the blocks they cover."""

    def __init__(self, work: list[tuple[bytes, Image, Scan, int]]):
        pieces, orders, counts, bands, owner = [], [], [], [], []
        books: dict[bytes, int] = {}
        self.tables: list[np.ndarray] = []
        self.forms: list[bytes] = []
        seg_ends, total = [], 0
        for n, (raw, image, scan, base) in enumerate(work):
            order, unit = scan_order(image, scan)
            per = scan.restart * unit or len(order)
            full, rest = divmod(len(order), per)
            size = [per] * full + [rest] * (rest > 0)
            pieces.append(raw[slice(*scan.data)])
            total += len(pieces[-1])
            seg_ends.append(total)
            orders.append(order + base)
            counts += size
            pattern = [j for j, (i, _, _) in enumerate(scan.parts) for _ in range(image.components[i].h * image.components[i].v if len(scan.parts) > 1 else 1)]
            ids = []
            for j in pattern:
                _, dc, ac = scan.parts[j]
                form = scan.tables.get(dc if scan.first == 0 else 16 | ac, b"\0" * 16)
                if form not in books:
                    books[form] = len(self.tables)
                    self.tables.append(lookup(form))
                    self.forms.append(form)
                ids.append(books[form])
            bands += [(scan.first, scan.last, scan.low, len(pattern), tuple(ids), tuple(pattern))] * len(size)
            owner += [n] * len(size)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        after = np.append(data[1:], 0)
        ff = data == 0xFF
        ends = np.array(seg_ends) - 1
        ff[ends] = False
        restart = ff & (after >= 0xD0) & (after <= 0xD7)
        stuffed = ff & (after == 0)
        drop = restart.copy()
        drop[1:] |= (restart | stuffed)[:-1]
        keep = ~drop
        place = np.cumsum(keep) - keep
        cut = np.zeros(len(data) + 1, bool)
        cut[np.flatnonzero(restart) + 2] = True
        begins = np.concatenate([[0], np.array(seg_ends[:-1], np.int64)]).astype(np.int64)
        cut[begins] = True
        starts = np.flatnonzero(cut[: len(data)])
        self.pos = 8 * place[starts].astype(np.int64)
        if len(self.pos) != len(counts):
            raise ValueError("restart intervals are missing")
        self.window = peek_table(data[keep])
        self.order = np.concatenate(orders)
        self.count = np.array(counts, np.int64)
        self.begin = np.cumsum(self.count) - self.count
        self.bands, self.owner = bands, np.array(owner)
        self.book = np.concatenate(self.tables)

    def bits(self, pos: np.ndarray) -> np.ndarray:
        """The 57 bits or more from each position, at the upper end."""
        return self.window[np.minimum(pos >> 3, len(self.window) - 1)] << (pos & 7).astype(np.uint64)


def _extend(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The signed value that `size` bits stand for."""
    return np.where(bits < (1 << size >> 1), bits - (1 << size) + 1, bits)


def _take(word: np.ndarray, skip: np.ndarray, size: np.ndarray) -> np.ndarray:
    return (((word << skip.astype(np.uint64)) >> np.uint64(1)) >> (63 - size).astype(np.uint64)).astype(np.int64)


def decode_dc(lanes: Lanes, coefficients: np.ndarray) -> None:
    pattern = np.array([b[3] for b in lanes.bands])
    widest = pattern.max()
    ids = np.array([b[4] + (0,) * (widest - b[3]) for b in lanes.bands], np.int64)
    low = np.array([b[2] for b in lanes.bands])
    diff = np.zeros(len(lanes.order), np.int64)
    active, pos = np.arange(len(lanes.pos)), lanes.pos.copy()
    for j in range(int(lanes.count.max())):
        active = active[lanes.count[active] > j]
        word = lanes.bits(pos[active])
        entry = lanes.book[(ids[active, j % pattern[active]] << 16) + (word >> np.uint64(48)).astype(np.int64)]
        skip, size = entry & 255, entry >> 8
        diff[lanes.begin[active] + j] = _extend(_take(word, skip, size), size)
        pos[active] += skip + size
    # sums by lane and component
    lane = np.repeat(np.arange(len(lanes.count)), lanes.count)
    inside = np.arange(len(diff)) - lanes.begin[lane]
    which = np.array([b[5] + (0,) * (widest - b[3]) for b in lanes.bands], np.int64)[lane, inside % pattern[lane]]
    order = np.lexsort((inside, which, lane))
    run = np.cumsum(diff[order])
    new = np.ones(len(order), bool)
    new[1:] = (lane[order][1:] != lane[order][:-1]) | (which[order][1:] != which[order][:-1])
    before = (run - diff[order])[new]
    coefficients[lanes.order[order], 0] = (run - np.repeat(before, np.diff(np.append(np.flatnonzero(new), len(order))))) << low[lane[order]]


def refine_dc(lanes: Lanes, coefficients: np.ndarray) -> None:
    lane = np.repeat(np.arange(len(lanes.count)), lanes.count)
    at = lanes.pos[lane] + np.arange(len(lane)) - lanes.begin[lane]
    low = np.array([b[2] for b in lanes.bands])[lane]
    coefficients[lanes.order, 0] |= ((lanes.bits(at) >> np.uint64(63)).astype(np.int64) << low).astype(coefficients.dtype)


@functools.lru_cache(maxsize=256)
def _ac_lookup(table: bytes, low: int) -> np.ndarray:
    """For each 16 bits all that a symbol says, if it and its bits fit in them: in bytes from the lowest its bits, its step in k,
    1 for a value, 2 for the block's end, 4 if they don't fit; from bit 32 the value, shifted by low, or how many blocks end."""
    book, code = lookup(table), np.arange(1 << 16)
    n, symbol = book & 255, book >> 8
    run, size = symbol >> 4, symbol & 15
    end = (size == 0) & (run < 15)
    size = np.where(end, run, size)
    room = 16 - n - size
    bits = (code >> np.maximum(room, 0)) & ((1 << size) - 1)
    value = np.where(end, (1 << size) + bits, _extend(bits, size) << low)
    flags = np.where(end, 2, (size > 0).astype(np.int64)) | np.where(room < 0, 4, 0)
    return (n + size) | np.where(end, 0, run + 1) << 8 | flags << 16 | value << 32


def _read(lanes: Lanes, book: np.ndarray, table: np.ndarray, low: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each lane's next symbol: its bits, step in k, whether it has a value, whether it ends the block, value."""
    word = lanes.bits(pos)
    code = (word >> np.uint64(48)).view(np.int64)
    entry = book[table + code]
    flags, value = (entry >> 16) & 7, entry >> 32
    if (flags & 4).any():  # symbol and bits are longer than 16
        far = np.flatnonzero(flags & 4)
        total = entry[far] & 255
        n = lanes.book[(lanes.first_book[table[far] >> 16] << 16) + code[far]] & 255
        bits = _take(word[far], n, total - n)
        value[far] = np.where(flags[far] & 2, (1 << (total - n)) + bits, _extend(bits, total - n) << low[far])
    return entry & 255, (entry >> 8) & 255, (flags & 1) > 0, (flags & 2) > 0, value


def _ac_setup(lanes: Lanes) -> tuple[np.ndarray, ...]:
    """One table for each (Huffman table, lowest bit) of the scans; lane by lane first, last, low and where its table begins."""
    kinds = sorted({(b[4][0], b[2]) for b in lanes.bands})
    at = {k: i for i, k in enumerate(kinds)}
    lanes.first_book = np.array([t for t, _ in kinds])
    book = np.concatenate([_ac_lookup(lanes.forms[t], low) for t, low in kinds])
    first, last, low = (np.array([b[i] for b in lanes.bands], np.int64) for i in range(3))
    return book, first, last, low, np.array([at[b[4][0], b[2]] << 16 for b in lanes.bands], np.int64)


def decode_ac(lanes: Lanes, coefficients: np.ndarray) -> None:
    book, first, last, low, table = _ac_setup(lanes)
    flat = np.append(coefficients.ravel(), np.zeros(1, coefficients.dtype))
    spare = len(flat) - 1
    order = np.append(lanes.order, 0) * 64 - 1
    pos, block, end, k = lanes.pos.copy(), lanes.begin.copy(), lanes.begin + lanes.count, first.copy()
    while len(pos):
        n, step, has, ends, value = _read(lanes, book, table, low, pos)
        pos += n
        k += step
        at = order[block] + k
        at[~has | (k > 64)] = spare
        flat[at] = value
        over = ends | (k > last)
        if over.any():
            block += np.where(ends, value, over)
            k = np.where(over, first, k)
            going = block < end
            if not going.all():
                pos, block, end, k, table, first, last, low = (x[going] for x in (pos, block, end, k, table, first, last, low))
    coefficients[:] = flat[:-1].reshape(coefficients.shape)


def refine_ac(lanes: Lanes, coefficients: np.ndarray) -> None:
    """What is in the scans' order: cells (block in the order, k). Bits of cells that are set follow each other in that order."""
    book, first, last, low, table = _ac_setup(lanes)
    lane = np.repeat(np.arange(len(lanes.count)), lanes.count)
    k = np.arange(64, dtype=np.int8)
    inside = (k >= first.astype(np.int8)[lane][:, None]) & (k <= last.astype(np.int8)[lane][:, None])
    own = coefficients[lanes.order]
    set_before = (own != 0) & inside
    n_set = np.concatenate([[0], np.cumsum(set_before.ravel())])
    zeros = np.append(np.flatnonzero((~set_before & inside).ravel()), 64 * len(own))
    zero_at = np.searchsorted(zeros, 64 * np.arange(len(own) + 1))
    start = np.full(n_set[-1] + 1, -(1 << 62), np.int64)  # of a run of correction bits: its bit position less its first number
    fresh_at, fresh = [], []
    lane_low = low
    pos, block, end = lanes.pos.copy(), lanes.begin.copy(), lanes.begin + lanes.count
    cell, zero = 64 * block + first, zero_at[block]
    while len(pos):
        n, step, has, ends, value = _read(lanes, book, table, low, pos)
        pos += n
        nearest = np.minimum(zero + step - 1, len(zeros) - 1)
        nearest = np.minimum(nearest, np.maximum(zero_at[block + 1] - 1, zero))  # stays in the block even if the file is damaged
        after = np.where(ends, block + value, block)
        after = np.minimum(after, end)
        to = np.where(ends, 64 * after, np.minimum(zeros[nearest], 64 * (block + 1)))
        mine = n_set[cell]
        start[mine] = np.where(n_set[to] > mine, pos - mine, start[mine])
        pos += n_set[to] - mine
        fresh_at.append(to[has])
        fresh.append(value[has])
        over = ~ends & (to >= 64 * block + last)
        block = np.where(over, block + 1, after)
        moved = ends | over
        going = block < end
        inner = np.minimum(block, len(own) - 1)
        cell = np.where(moved, 64 * inner + first, to + 1)
        zero = np.where(moved, zero_at[inner], nearest + 1)
        if not going.all():
            pos, block, end, table, cell, zero, first, last, low = (x[going] for x in (pos, block, end, table, cell, zero, first, last, low))
    number = np.arange(n_set[-1])
    known = np.maximum.accumulate(np.where(start[:-1] > -(1 << 62), number, 0))
    at = start[known] + number
    bit = (lanes.bits(at) >> np.uint64(63)).astype(np.int64)
    where = np.flatnonzero(set_before.ravel())
    flat = own.ravel()
    by_lane = lane_low[lane[where >> 6]]
    flat[where] += (np.sign(flat[where]) * (bit << by_lane)).astype(flat.dtype)
    if fresh_at:
        flat[np.concatenate(fresh_at)] = np.concatenate(fresh)
    coefficients[lanes.order] = flat.reshape(own.shape)


def decode(files: list[bytes]) -> tuple[np.ndarray, list[Image], np.ndarray]:
    """Coefficients of all blocks of all files, the files' forms, and where each file's blocks begin."""
    images = [parse(f) for f in files]
    base = np.cumsum([0] + [i.blocks for i in images])
    coefficients = np.zeros((int(base[-1]), 64), np.int16)
    # scans that don't depend on each other go together: each file's scans in turn, first scans of different bands at once
    todo = [list(i.scans) for i in images]
    while any(todo):
        groups: dict[str, list] = {}
        for n, scans in enumerate(todo):
            taken = 0  # a bit for each coefficient of each component
            while scans:
                s = scans[0]
                spread = sum(((1 << s.last + 1) - (1 << s.first)) << 64 * i for i, _, _ in s.parts)
                if taken & spread:
                    break
                taken |= spread
                kind = ("refine" if s.high else "decode") + ("_dc" if s.first == 0 else "_ac")
                groups.setdefault(kind, []).append((files[n], images[n], scans.pop(0), int(base[n])))
        for kind, work in groups.items():
            {"decode_dc": decode_dc, "refine_dc": refine_dc, "decode_ac": decode_ac, "refine_ac": refine_ac}[kind](Lanes(work), coefficients)
    return coefficients, images, base


@functools.cache
def _transform() -> np.ndarray:
    """The inverse transform of a block in zigzag order as one matrix of whole numbers, times 2^26: its sums are exact."""
    u, x = np.mgrid[:8, :8]
    m = np.rint(np.where(u == 0, np.sqrt(0.125), 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) * 8192)
    return np.kron(m, m)[zigzag()]


def samples(coefficients: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """8x8 samples (0 to 255) of each block."""
    out = (coefficients * quant.astype(np.float64)) @ _transform()
    out *= 2.0**-26
    out += 128.5
    np.clip(out, 0, 255, out=out)
    return out.astype(np.uint8).reshape(-1, 8, 8)


@functools.cache
def _chroma() -> tuple[np.ndarray, ...]:
    """What each value of Cr adds to red, of Cb and Cr to green, of Cb to blue."""
    x, half = np.arange(256) - 128, 1 << 15
    return tuple(t.astype(np.int16) for t in ((91881 * x + half) >> 16, (-22554 * x) >> 16, (-46802 * x + half) >> 16, (116130 * x + half) >> 16))


def rgb(coefficients: np.ndarray, image: Image, ready: np.ndarray | None = None) -> np.ndarray:
    """height x width x 3, chroma repeated to full resolution. ready: the blocks' samples, if known."""
    h, v = max(c.h for c in image.components), max(c.v for c in image.components)

    def plane(c: Component, change: tuple[np.ndarray, ...] = ()) -> list[np.ndarray]:
        rows = image.mcus[1] * c.v
        at = slice(c.base, c.base + rows * c.wide)
        s = samples(coefficients[at], image.quants[c.table]) if ready is None else ready[at]
        s = s.reshape(rows, c.wide, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, c.wide * 8)
        out = [t[s] for t in change] or [s]
        return [x.repeat(v // c.v, 0).repeat(h // c.h, 1)[: image.height, : image.width] if (h, v) != (c.h, c.v) else x[: image.height, : image.width] for x in out]

    y = plane(image.components[0])[0]
    if len(image.components) == 1:
        return np.repeat(y[:, :, None], 3, 2)
    red, green_b, green_r, blue = _chroma()
    from_b, from_r = plane(image.components[1], (green_b, blue)), plane(image.components[2], (red, green_r))
    out = np.empty((*y.shape, 3), np.uint8)
    for i, add in enumerate((from_r[0], from_b[0] + from_r[1], from_b[1])):
        np.clip(y + add, 0, 255, out=out[:, :, i], casting="unsafe")
    return out


# ---- the encoder


def _book(weights: dict[int, float]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """A table's form, and by symbol its code and code length. The code of all ones stays free."""
    counts = np.zeros(257, np.int64)
    for s, w in weights.items():
        counts[s] = max(2, round(w * 1e9))
    counts[256] = 1
    n = code_lengths(counts)
    order = sorted((s for s in range(256) if n[s]), key=lambda s: (n[s], s))
    codes = canonical_codes(n)
    form = bytes(int((n[:256] == k).sum()) for k in range(1, 17)) + bytes(order)
    return form, codes[:256], n[:256]


@functools.cache
def books() -> dict[str, tuple[bytes, np.ndarray, np.ndarray]]:
    """Tables from a model: a coefficient is 0 with some chance, and its bit length has the shares given."""
    share = {1: 0.18, 2: 0.27, 3: 0.27, 4: 0.12, 5: 0.03, 6: 0.01, 7: 0.01, 8: 0.001}

    def ac(zero: float, share: dict[int, float]) -> dict[int, float]:
        return {r << 4 | s: zero**r * p for r in range(16) for s, p in share.items()} | {0xF0: zero**15 * 0.5 + 1e-6, 0: 0.03}

    later = {s - 1: p for s, p in share.items() if s > 1}
    dc = {0: 0.05, 1: 0.1, 2: 0.2, 3: 0.25, 4: 0.25, 5: 0.1, 6: 0.04, 7: 0.02, 8: 0.01, 9: 0.001}
    fine = {r << 4 | 1: 0.5 * 0.5**r for r in range(16)} | {0xF0: 1e-4, 0: 0.08}
    return {k: _book(w) for k, w in (("dc", dc), ("ac0", ac(0.17, share)), ("ac1", ac(0.35, later)), ("fine", fine))}


class Writer:
    """Bits of one scan of all images, lane by lane."""

    def __init__(self, lane_of_item: np.ndarray, nbits: np.ndarray, n_lanes: int):
        ends = np.cumsum(nbits)
        self.total = np.bincount(lane_of_item, nbits, n_lanes).astype(np.int64)
        size = (self.total + 7) // 8
        self.byte = np.cumsum(size) - size
        self.size = size
        first = np.cumsum(self.total) - self.total
        self.at = ends - nbits + (8 * self.byte - first)[lane_of_item]
        self.n_bytes = int(size.sum())

    def finish(self, values: np.ndarray, nbits: np.ndarray, at: np.ndarray, last_lane: np.ndarray, restart: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bytes with stuffing and restart markers, and where each lane ends in them. last_lane: no marker follows; restart: its number."""
        spare = 8 * self.size - self.total
        pad = spare > 0
        values = np.concatenate([values, (1 << spare[pad]) - 1])
        at = np.concatenate([at, 8 * self.byte[pad] + self.total[pad]])
        raw = pack_bits(values, np.concatenate([nbits, spare[pad]]), at, self.n_bytes)
        ff = raw == 0xFF
        before = np.cumsum(ff) - ff
        lane = np.repeat(np.arange(len(self.size)), self.size)
        marked = ~last_lane
        marks = np.cumsum(marked) - marked
        out = np.zeros(self.n_bytes + int(ff.sum()) + 2 * int(marked.sum()), np.uint8)
        place = np.arange(self.n_bytes) + before + 2 * marks[lane]
        out[place] = raw
        ends = np.cumsum(self.size)
        stuffed = np.concatenate([[0], np.cumsum(ff)])[ends]
        done = ends + stuffed + 2 * marks
        out[done[marked]], out[done[marked] + 1] = 0xFF, 0xD0 + restart[marked] % 8
        return out.tobytes(), done + 2 * marked


_LENGTHS = np.array([i.bit_length() for i in range(4096)])


def _bit_length(x: np.ndarray) -> np.ndarray:
    return _LENGTHS[x]


def _signed_bits(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(v < 0, v + (1 << size) - 1, v)


def _items_first(own: np.ndarray, band: tuple[int, int, int, int]) -> tuple[np.ndarray, ...]:
    """(block, value, bits) of a first scan's items in order; own: blocks in the scan's order."""
    first, last, _, low = band
    code, n = books()[f"ac{low}"][1:]
    v = own[:, first : last + 1]
    v = np.sign(v) * (np.abs(v) >> low)
    width = last - first + 1
    block, k = np.nonzero(v)
    val = v[block, k].astype(np.int64)
    new = np.ones(len(block), bool)
    new[1:] = block[1:] != block[:-1]
    run = k - np.where(new, 0, np.append(0, k[:-1] + 1)[: len(k)])
    size = _bit_length(np.abs(val))
    # a value's item: its code and bits; what skips sixteen zeros comes before it, what ends a block after its last
    far = run >> 4
    symbol = (run & 15) << 4 | size
    final = np.full(len(own), -1, np.int64)
    final[block] = k  # the last one wins
    ended = final < width - 1
    skipped, ends_before = np.cumsum(far), np.cumsum(ended) - ended
    at = np.arange(len(block)) + skipped + ends_before[block]
    value = np.full(len(block) + int(ended.sum()) + (int(skipped[-1]) if len(far) else 0), code[0xF0])
    bits, b = np.full(len(value), n[0xF0]), np.zeros(len(value), np.int64)
    value[at], bits[at], b[at] = code[symbol] << size | _signed_bits(val, size), n[symbol] + size, block
    many = np.flatnonzero(far)
    for i in range(int(far.max(initial=0))):
        some = many[far[many] > i]
        b[at[some] - 1 - i] = block[some]
    of = np.flatnonzero(ended)
    upto = np.searchsorted(block, of, "right")
    done = upto + np.append(0, skipped)[upto] + ends_before[of]
    value[done], bits[done], b[done] = code[0], n[0], of
    return b, value, bits


def _items_fine(own: np.ndarray, band: tuple[int, int, int, int]) -> tuple[np.ndarray, ...]:
    """The same of a refining scan: an item's code and sign, then the correction bits of the set cells that it passes."""
    first, last, _, low = band
    code, n = books()["fine"][1:]
    mag = np.abs(own[:, first : last + 1]).astype(np.int16) >> low
    width = last - first + 1
    was = mag > 1
    fresh = mag == 1
    zero = ~was
    n_zero = np.cumsum(zero, 1, dtype=np.int8)
    rest = np.where(fresh.any(1), width - 1 - np.argmax(fresh[:, ::-1], 1), -1)  # the last fresh cell
    done = np.maximum.accumulate(n_zero * fresh, 1)
    since = n_zero - np.concatenate([np.zeros((len(own), 1), np.int8), done[:, :-1]], 1)  # zeros since the last fresh cell, this one too
    skip = zero & ~fresh & (since % 16 == 0) & (since > 0) & (np.arange(width) < rest[:, None])
    stops = np.concatenate([fresh | skip, (rest < width - 1)[:, None]], 1)  # cells at which an item's reach ends; then the block's end
    before = np.cumsum(stops.ravel()) - stops.ravel()
    stop_b, stop_k = np.nonzero(stops)
    symbol = np.zeros(len(stop_b), np.int64)
    cell = stop_k < width
    kk = np.minimum(stop_k, width - 1)
    new = cell & fresh[stop_b, kk]
    symbol[cell & ~new] = 0xF0
    symbol[new] = (since[stop_b, kk][new].astype(np.int64) - 1) % 16 << 4 | 1
    sign = (own[:, first : last + 1][stop_b, kk] > 0).astype(np.int64)
    item_value = np.where(new, code[symbol] << 1 | sign, code[symbol])
    item_bits = n[symbol] + new
    fix_b, fix_k = np.nonzero(was)
    group = before.reshape(stops.shape)[fix_b, fix_k]
    # each group: the item, then its correction bits in order
    many = np.bincount(group, minlength=len(stop_b))
    size = many + 1
    begin = np.cumsum(size) - size
    total = int(size.sum())
    b, value, bits = np.zeros(total, np.int64), np.zeros(total, np.int64), np.ones(total, np.int64)
    b[begin], value[begin], bits[begin] = stop_b, item_value, item_bits
    at = begin[group] + 1 + np.arange(len(group)) - np.repeat(np.cumsum(many) - many, many)
    b[at], value[at] = fix_b, mag[fix_b, fix_k] & 1
    return b, value, bits


def encode(coefficients: np.ndarray, sizes: list[tuple[int, int]]) -> list[bytes]:
    """Files of images with sizes (columns, rows) in MCUs of 16x16 samples, whose blocks lie in `coefficients` in turn: Y, Cb, Cr."""
    images = []
    for columns, rows in sizes:
        image = Image(16 * columns, 16 * rows, [Component(1, 2, 2, 0), Component(2, 1, 1, 0), Component(3, 1, 1, 0)])
        _lay_out(image)
        images.append(image)
    base = np.cumsum([0] + [i.blocks for i in images])
    segment = lambda kind, body: bytes([0xFF, kind]) + (len(body) + 2).to_bytes(2, "big") + body
    heads = [b"\xff\xd8" + segment(0xDB, b"\0" + b"\x01" * 64) + segment(0xC2, b"\x08" + i.height.to_bytes(2, "big") + i.width.to_bytes(2, "big") + b"\x03\x01\x22\0\x02\x11\0\x03\x11\0") for i in images]
    forms = books()
    tables = segment(0xC4, b"\x00" + forms["dc"][0] + b"\x10" + forms["ac0"][0] + b"\x11" + forms["ac1"][0] + b"\x12" + forms["fine"][0])
    parts: list[list[bytes]] = [[h, tables + segment(0xDD, RESTART.to_bytes(2, "big"))] for h in heads]
    scans = [((0, 1, 2), (0, 0, 0, 1))] + [((c,), band) for band in BANDS for c in range(3)] + [((0, 1, 2), (0, 0, 1, 0))]
    for which, band in scans:
        first, last, high, low = band
        table = 0 if first == 0 else 2 if high else low
        sos = segment(0xDA, bytes([len(which)]) + b"".join(bytes([c + 1, table if first else 0]) for c in which) + bytes([first, last, high << 4 | low]))
        got = [scan_order(i, Scan([(c, 0, 0) for c in which], first, last, high, low, RESTART, {}, (0, 0))) for i in images]
        order = np.concatenate([o + b for (o, _), b in zip(got, base)])
        per = RESTART * got[0][1]
        n_blocks = np.array([len(o) for o, _ in got])
        n_lanes = -(-n_blocks // per)
        inside = np.arange(len(order)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
        lane_of_block = np.repeat(np.cumsum(n_lanes) - n_lanes, n_blocks) + inside // per
        own = coefficients[order]
        if first == 0 and not high:
            v = own[:, 0].astype(np.int64) >> low
            position = (inside % per) % got[0][1]
            which_of = np.maximum(position - 3, 0)  # four blocks of Y, then the others
            by = np.lexsort((np.arange(len(v)), which_of, lane_of_block))
            diff = v[by].copy()
            same = (lane_of_block[by][1:] == lane_of_block[by][:-1]) & (which_of[by][1:] == which_of[by][:-1])
            diff[1:] -= np.where(same, v[by][:-1], 0)
            d = np.empty_like(diff)
            d[by] = diff
            size = _bit_length(np.abs(d))
            code, n = forms["dc"][1:]
            block, value, bits = np.arange(len(v)), code[size] << size | _signed_bits(d, size), n[size] + size
        elif first == 0:
            block, value, bits = np.arange(len(own)), (own[:, 0].astype(np.int64) >> low) & 1, np.ones(len(own), np.int64)
        else:
            block, value, bits = (_items_fine if high else _items_first)(own, band)
        w = Writer(lane_of_block[block], bits, int(n_lanes.sum()))
        ends = np.cumsum(n_lanes)
        last_lane = np.zeros(int(n_lanes.sum()), bool)
        last_lane[ends - 1] = True
        raw, done = w.finish(value, bits, w.at, last_lane, np.arange(len(last_lane)) - np.repeat(ends - n_lanes, n_lanes))
        cuts = [0, *done[ends - 1].tolist()]
        for p, a, b in zip(parts, cuts, cuts[1:]):
            p += [sos, raw[a:b]]
    return [b"".join([*p, b"\xff\xd9"]) for p in parts]
