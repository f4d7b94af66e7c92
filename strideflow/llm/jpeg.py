"""Media columns: progressive JPEG.

``decode_files`` reads progressive files (spectral selection and successive approximation, any sampling factors and
restart intervals, one or three components): its scans accumulate in coefficient arrays, which are inverse-transformed
in numpy; chroma is brought to full resolution and stored as RGB tensors. All restart segments of all files of a batch
that share tables and scan script are decoded side by side, one symbol of each at a time.

``encode_payloads`` stores bytes losslessly in the format's own unit: with a quantiser of ones, each byte less 128 is
one coefficient, 64 to a block in zigzag order, over a 4:2:0 image; blocks past the payload are zero, and a comment
holds the unpadded length. Every block is a restart segment, so reading is fully parallel.

Null texts are empty: one block of zero bytes. Equal texts give equal media and features (integer arithmetic only).
Repeated rows are treated alike, an empty table gives no rows, columns beside doc_id and text are ignored. A file that
is cut short or not progressive raises an error.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strideflow.llm.common import buffer_of, slices

#: Zigzag order from its rule: diagonals of a block, walked in turn upwards and downwards.
ZIGZAG = np.array([r * 8 + c for d in range(15) for r, c in sorted(((r, d - r) for r in range(8) if 0 <= d - r < 8), key=lambda x: x[d % 2])])
_BITS = 13
#: Integer cosine matrix: sample = sum over u of BASIS[u, x] * coefficient, scaled by 2 ** _BITS.
BASIS = np.rint([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) * (1 << _BITS) for x in range(8)] for u in range(8)])
SIZES = np.array([0] + [int(x).bit_length() for x in range(1, 1 << 12)], np.int64)


# --- Huffman tables ----------------------------------------------------------------------------


def table_segment(kind: int, lengths: dict[int, int]) -> bytes:
    """A DHT segment (class and id in ``kind``) for symbols of given code lengths."""
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    counts = bytes(sum(n == k for n in lengths.values()) for k in range(1, 17))
    return b"\xff\xc4" + struct.pack(">HB", 19 + len(symbols), kind) + counts + bytes(symbols)


def codes_of(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Code and length of each symbol (length 0: none)."""
    code, at = 0, 0
    codes, lengths = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for n, count in enumerate(counts, 1):
        for s in symbols[at : at + count]:
            codes[s], lengths[s] = code, n
            code += 1
        at += count
        code <<= 1
    return codes, lengths


def lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """For any 16 bits: the symbol they begin with, shifted by 5, and its length; 0 where no code fits."""
    codes, lengths = codes_of(counts, symbols)
    out = np.zeros(1 << 16, np.int32)
    for s in set(symbols):
        n = int(lengths[s])
        first = int(codes[s]) << (16 - n)
        out[first : first + (1 << (16 - n))] = s << 5 | n
    return out


DC_LENGTHS = {s: 4 for s in range(12)}
AC_LENGTHS = {s: 4 for s in range(1, 9)} | {r << 4 | s: 8 for r in range(1, 16) for s in range(1, 9) if r < 15} | {0x00: 8, 0xF0: 8} | {0xF0 | s: 8 for s in range(1, 9)}


def _own_table(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    raw = table_segment(0, lengths)
    return codes_of(raw[5:21], raw[21:])


DC_CODES, AC_CODES = _own_table(DC_LENGTHS), _own_table(AC_LENGTHS)
#: Scans of each component: first and last coefficient, bits known before, bits after.
SCRIPT = ((0, 0, 0, 1), (1, 20, 0, 1), (21, 63, 0, 1), (0, 0, 1, 0), (1, 63, 1, 0))


# --- writing -----------------------------------------------------------------------------------


def pack(values: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each row of ``values`` end to end, every row padded to whole bytes with ones; bytes and row bounds."""
    total = lengths.sum(axis=1)
    spare = -total % 8
    values = np.concatenate([values, ((1 << spare) - 1)[:, None]], axis=1).ravel().astype(np.uint64)
    lengths = np.concatenate([lengths, spare[:, None]], axis=1).ravel()
    stops = np.cumsum(lengths)
    bounds = np.concatenate([[0], np.cumsum((total + spare) // 8)])
    some = lengths > 0
    values, lengths, starts = values[some], lengths[some], (stops - lengths)[some]
    word, room = starts >> 6, 64 - (starts & 63) - lengths
    out = np.zeros((int(bounds[-1]) >> 3) + 2, np.uint64)
    if len(word):
        shift = np.abs(room).astype(np.uint64)
        head = np.where(room >= 0, values << (shift & np.uint64(63)), values >> (shift & np.uint64(63)))
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[first]] += np.add.reduceat(head, first)
        over = np.flatnonzero(room < 0)  # at most one item crosses into each word
        out[word[over] + 1] += values[over] << (np.uint64(64) - shift[over])
    return out.astype(">u8").view(np.uint8)[: int(bounds[-1])], bounds


def _scan_items(block: np.ndarray, scan: tuple[int, int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Bit strings and lengths that code each block's part of a scan on its own."""
    low, high, known, left = scan
    if low == 0:
        if known:
            return (block[:, :1] >> left) & 1, np.ones((len(block), 1), np.int64)
        v = block[:, :1] >> left
        size = SIZES[np.abs(v)]
        return (DC_CODES[0][size] << size) | np.where(v < 0, v + (1 << size) - 1, v), DC_CODES[1][size] + size
    part = block[:, low : high + 1]
    place = np.arange(part.shape[1], dtype=np.int32)
    now = np.abs(part) >> left
    codes, sizes = AC_CODES
    new = (now == 1) if known else (now > 0)
    old = now > 1 if known else np.zeros_like(new)
    # coefficients without history up to here
    zeros = np.cumsum(~old, axis=1) if known else np.broadcast_to(place + 1, part.shape)
    before = np.where(new, zeros, 0)
    last = np.maximum.accumulate(before, axis=1)
    run = zeros - 1 - np.concatenate([np.zeros((len(part), 1), last.dtype), last[:, :-1]], axis=1)
    size = np.where(new, 1 if known else SIZES[np.minimum(now, len(SIZES) - 1)], 0)
    bits = np.where(part > 0, now, (1 << size) - 1 - now) if not known else (part > 0).astype(np.int64)
    symbol = (run & 15) << 4 | size
    value = np.where(new, codes[symbol] << size | bits, 0)
    length = np.where(new, sizes[symbol] + size, 0)
    if not known:
        for k in range(1, 1 + (int(run.max(initial=0)) >> 4)):  # runs of sixteen zeros
            longer = new & (run >= 16 * k)
            if longer.any():
                value = np.where(longer, value | codes[0xF0] << length, value)
                length = np.where(longer, length + sizes[0xF0], length)
        end = last[:, -1] < zeros[:, -1]
        return np.concatenate([value, np.where(end, codes[0], 0)[:, None]], axis=1), np.concatenate([length, np.where(end, sizes[0], 0)[:, None]], axis=1)
    return _refinement(now, new, old, run, value, length, place)


def _refinement(now, new, old, run, value, length, place) -> tuple[np.ndarray, np.ndarray]:
    """A symbol comes before the correction bits of the coefficients that it passes, so items are put in that order.

    Each symbol stands at the first coefficient it passes. Runs over fifteen need symbols of their own.
    """
    codes, sizes = AC_CODES
    n, width = now.shape
    symbols, lengths = np.zeros((n, width + 1), np.int64), np.zeros((n, width + 1), np.int64)
    previous = np.concatenate([np.full((n, 1), -1), np.maximum.accumulate(np.where(new, place, -1), axis=1)], axis=1)
    row, col = np.nonzero(new)
    simple = run[row, col] < 16
    symbols[row[simple], previous[row, col][simple] + 1] = value[row, col][simple]
    lengths[row[simple], previous[row, col][simple] + 1] = length[row, col][simple]
    for r, c in zip(row[~simple].tolist(), col[~simple].tolist(), strict=True):
        at, left = int(previous[r, c]) + 1, int(run[r, c])
        while left >= 16:
            symbols[r, at], lengths[r, at] = codes[0xF0], sizes[0xF0]
            passed = 0
            while passed < 16:
                passed += not old[r, at]
                at += 1
            left -= 16
        symbols[r, at], lengths[r, at] = value[r, c], length[r, c]
    tail = previous[:, -1] + 1  # after the last new one
    rest = tail < width
    symbols[rest, tail[rest]], lengths[rest, tail[rest]] = codes[0], sizes[0]
    correct, one = np.where(old, now & 1, 0), old.astype(np.int64)
    both = (symbols[:, :width] << one) | correct
    return both, lengths[:, :width] + one


def geometry(n_blocks: int) -> tuple[int, int]:
    """Columns and rows of 16x16 units (six blocks each) that hold the blocks."""
    units = -(-n_blocks // 6)
    columns = min(4095, max(1, round(units**0.5)))
    return columns, -(-units // columns)


_TABLES = b"\xff\xdb\x00\x43\x00" + b"\x01" * 64
_CODES = table_segment(0x00, DC_LENGTHS) + table_segment(0x10, AC_LENGTHS) + b"\xff\xdd\x00\x04\x00\x01"
_COMMENT = b"strideflow bytes "


def encode_payloads(texts: pa.Array) -> list[bytes]:
    """One progressive file per text."""
    data, bounds = buffer_of(texts)
    sizes = np.diff(bounds)
    blocks = np.maximum(1, -(-sizes // 64))
    shapes = [geometry(int(n)) for n in blocks]
    total = np.array([6 * c * r for c, r in shapes])
    first = np.concatenate([[0], np.cumsum(total)])
    coefficients = np.zeros((int(first[-1]), 64), np.int32)
    flat = coefficients.reshape(-1)
    for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        at = int(first[k]) * 64
        flat[at : at + int(blocks[k]) * 64] = -128
        flat[at : at + b - a] += data[a:b]
    parts = np.stack([first[:-1], first[:-1] + total * 4 // 6, first[:-1] + total * 5 // 6], axis=1).ravel()
    ends_part = np.zeros(len(coefficients), bool)
    ends_part[np.concatenate([parts[1:], first[-1:]]) - 1] = True
    number = np.arange(len(coefficients)) - np.repeat(parts, np.diff(np.append(parts, first[-1])))
    streams = []
    for scan in SCRIPT:
        raw, rows = pack(*_scan_items(coefficients, scan))
        # a zero after each 0xFF, a restart marker after each block but a component's last
        escape = raw == 0xFF
        extra = np.concatenate([[0], np.cumsum(escape)])
        marks = np.where(ends_part, 0, 2)
        marked = np.concatenate([[0], np.cumsum(marks)])
        owner = np.repeat(np.arange(len(coefficients)), np.diff(rows))
        place = np.arange(len(raw)) + extra[:-1] + marked[owner]
        out = np.zeros(len(raw) + int(extra[-1]) + int(marked[-1]), np.uint8)
        out[place] = raw
        stop = rows[1:] + extra[rows[1:]] + marked[:-1]
        out[stop[~ends_part]] = 0xFF
        out[stop[~ends_part] + 1] = 0xD0 + (number[~ends_part] & 7)
        starts = rows[:-1] + extra[rows[:-1]] + marked[:-1]
        streams.append((out.tobytes(), np.append(starts[parts], len(out)).tolist()))
    files = []
    for k, (columns, lines) in enumerate(shapes):
        note = _COMMENT + str(int(sizes[k])).encode()
        made = [b"\xff\xd8", b"\xff\xfe" + struct.pack(">H", 2 + len(note)) + note, _TABLES,
                b"\xff\xc2" + struct.pack(">HBHHB", 17, 8, lines * 16, columns * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]), _CODES]
        for (low, high, known, left), (stream, starts) in zip(SCRIPT, streams, strict=True):
            for c in range(3):
                made += [b"\xff\xda\x00\x08\x01", bytes([c + 1, 0x00, low, high, known << 4 | left]), stream[starts[3 * k + c] : starts[3 * k + c + 1]]]
        files.append(b"".join([*made, b"\xff\xd9"]))
    return files


# --- reading -----------------------------------------------------------------------------------


@dataclass
class Frame:
    height: int = 0
    width: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, across, down, quantiser
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    scans: list[tuple] = field(default_factory=list)  # parts, low, high, known, left, interval, tables
    spans: list[tuple[int, int]] = field(default_factory=list)
    comment: bytes = b""

    def grids(self) -> list[tuple[int, int, int, int]]:
        """For each component: whole-unit blocks across and down, and blocks across and down that hold samples."""
        most_h, most_v = max(c[1] for c in self.components), max(c[2] for c in self.components)
        across, down = -(-self.width // (8 * most_h)), -(-self.height // (8 * most_v))
        return [(across * h, down * v, -(-(-(-self.width * h // most_h)) // 8), -(-(-(-self.height * v // most_v)) // 8)) for _, h, v, _ in self.components]


def read_frame(raw: bytes, base: int, markers: list[int]) -> Frame:
    """Headers of a file that stands at ``base`` of a buffer; ``markers`` are the buffer's places where entropy-coded data ends."""
    frame, at, tables, interval = Frame(), 2, {}, 0
    if raw[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    while True:
        if at + 2 > len(raw) or raw[at] != 0xFF:
            raise ValueError("a marker is missing")
        kind = raw[at + 1]
        if kind == 0xD9:
            break
        if kind == 0xFF:
            at += 1
            continue
        (size,) = struct.unpack_from(">H", raw, at + 2)
        body, at = raw[at + 4 : at + 2 + size], at + 2 + size
        if kind == 0xFE:
            frame.comment = body
        elif kind == 0xDB:
            while body:
                wide = body[0] >> 4
                frame.quantisers[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int64)
                body = body[65 + 64 * wide :]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif kind == 0xDD:
            (interval,) = struct.unpack(">H", body)
        elif kind == 0xC2:
            precision, frame.height, frame.width, n = struct.unpack_from(">BHHB", body)
            if precision != 8 or n not in (1, 3) or not frame.height or not frame.width:
                raise ValueError("only 8-bit images of one or three components")
            frame.components = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
        elif 0xC0 <= kind <= 0xCF and kind != 0xC8 and kind != 0xCC:
            raise ValueError("not a progressive JPEG file")
        elif kind == 0xDA:
            ids = [c[0] for c in frame.components]
            low, high, bits = body[-3], body[-2], body[-1]
            parts = tuple((ids.index(body[1 + 2 * k]), tables.get(body[2 + 2 * k] >> 4), tables.get(0x10 | body[2 + 2 * k] & 15)) for k in range(body[0]))
            k = bisect.bisect_left(markers, base + at)
            if k == len(markers):
                raise ValueError("the file is cut short")
            stop = markers[k] - base
            frame.scans.append((parts, low, high, bits >> 4, bits & 15, interval))
            frame.spans.append((base + at, base + stop))
            at = stop
    if not frame.components or not frame.scans:
        raise ValueError("the file holds no image")
    return frame


_tables: dict[tuple[bytes, bytes], np.ndarray] = {}


def _lookup(table) -> np.ndarray:
    if table is None:
        raise ValueError("a scan uses a table that is not there")
    if table not in _tables:
        if len(_tables) > 64:
            _tables.clear()
        _tables[table] = lookup(*table)
    return _tables[table]


class Bits:
    """One read position in each of many bit strings of a common buffer."""

    def __init__(self, words: np.ndarray, start: np.ndarray, stop: np.ndarray):
        self.words, self.at, self.stop = words, start * 8, stop * 8

    def peek(self, lane: np.ndarray) -> np.ndarray:
        """16 bits from each lane's position."""
        at = self.at[lane]
        return (self.words[np.minimum(at >> 3, len(self.words) - 1)] >> (16 - (at & 7))) & 0xFFFF

    def take(self, lane: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        out = self.peek(lane) >> (16 - n)
        self.at[lane] += n
        return out

    def symbol(self, lane: np.ndarray, table: np.ndarray) -> np.ndarray:
        found = table[self.peek(lane)]
        self.at[lane] += found & 31
        if (found == 0).any():
            raise ValueError("a bit string is no code")
        return found >> 5


def _signed(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where((size > 0) & (bits < (1 << np.maximum(size, 1)) >> 1), bits - (1 << size) + 1, bits)


def _first_pass(bits: Bits, lane: np.ndarray, block: np.ndarray, coef: np.ndarray, table: np.ndarray, low: int, high: int, left: int, ends: np.ndarray) -> None:
    wait = ends[lane] > 0
    ends[lane[wait]] -= 1
    lane, block = lane[~wait], block[~wait]
    k = np.full(len(lane), low)
    while len(lane):
        symbol = bits.symbol(lane, table)
        run, size = symbol >> 4, symbol & 15
        stop = (size == 0) & (run < 15)
        if stop.any():
            n = run[stop]
            ends[lane[stop]] = (1 << n) - 1 + np.where(n > 0, bits.take(lane[stop], n), 0)
        k = k + run
        some = np.flatnonzero(size)
        if (k[some] > high).any():
            raise ValueError("a run leaves its scan")
        value = bits.take(lane[some], size[some])
        coef[k[some], block[some]] = _signed(value, size[some]) << left
        k = k + 1
        live = np.flatnonzero(~stop & (k <= high))
        if len(live) < len(lane):
            lane, block, k = lane[live], block[live], k[live]


def _next_pass(bits: Bits, lane: np.ndarray, block: np.ndarray, coef: np.ndarray, table: np.ndarray, low: int, high: int, left: int, ends: np.ndarray) -> None:
    over = ends[lane] > 0
    ends[lane[over]] -= 1
    run, value, step = np.full(len(lane), -1), np.zeros(len(lane), np.int64), 1 << left
    for k in range(low, high + 1):
        now = coef[k, block]
        ask = np.flatnonzero(~over & (run < 0))
        if len(ask):
            symbol = bits.symbol(lane[ask], table)
            n, size = symbol >> 4, symbol & 15
            stop = (size == 0) & (n < 15)
            if stop.any():
                at, n_end = ask[stop], n[stop]
                ends[lane[at]] = (1 << n_end) - 1 + np.where(n_end > 0, bits.take(lane[at], n_end), 0)
                over[at] = True
            go = ~stop
            at = ask[go]
            run[at], value[at] = n[go], 0
            fresh = at[size[go] == 1]
            if len(fresh):
                value[fresh] = np.where(bits.take(lane[fresh], 1) == 1, step, -step)
        old = np.flatnonzero(now)
        if len(old):
            more = bits.take(lane[old], 1)
            coef[k, block[old]] += (np.sign(now[old]) * (more << left)).astype(coef.dtype)
        free = np.flatnonzero((now == 0) & ~over)
        if len(free):
            put = free[run[free] == 0]
            coef[k, block[put]] = value[put]
            run[free] -= 1


def _scan_blocks(frame: Frame, scan: tuple) -> np.ndarray:
    """Blocks (component, place) in coding order, a row per unit of the scan."""
    grids = frame.grids()
    if len(scan[0]) == 1:
        c = scan[0][0][0]
        across, _, own_across, own_down = grids[c]
        place = (np.arange(own_down)[:, None] * across + np.arange(own_across)).reshape(-1, 1)
        return np.stack([np.full_like(place, c), place], axis=2)
    columns, lines = grids[0][0] // frame.components[0][1], grids[0][1] // frame.components[0][2]
    y, x = np.divmod(np.arange(columns * lines), columns)
    out = []
    for c, _, _ in scan[0]:
        _, h, v, _ = frame.components[c]
        for dy in range(v):
            for dx in range(h):
                out.append(np.stack([np.full(len(y), c), (y * v + dy) * grids[c][0] + x * h + dx], axis=1))
    return np.stack(out, axis=1)


def _layout(frames: list[Frame], scan: tuple, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of all files' units in a scan, each restart segment's first unit and number of units, and each file's segments."""
    shapes: dict[tuple[int, int], np.ndarray] = {}
    own, offsets, lengths, needs, at = [], [], [], [], 0
    for k, f in enumerate(frames):
        if (f.width, f.height) not in shapes:
            shapes[f.width, f.height] = _scan_blocks(f, scan)
        units = shapes[f.width, f.height]
        size = scan[5] or len(units)
        begin = np.arange(0, len(units), size)
        own.append(base[k][units[:, :, 0]] + units[:, :, 1])
        offsets.append(at + begin)
        lengths.append(np.minimum(size, len(units) - begin))
        needs.append(len(begin))
        at += len(units)
    return np.concatenate(own), np.concatenate(offsets), np.concatenate(lengths), np.array(needs)


def _decode_group(frames: list[Frame], words: np.ndarray, moved: np.ndarray, restarts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (64 by blocks, zigzag) of files with the same tables and script; each file's and component's first block."""
    counts = np.array([[g[0] * g[1] for g in f.grids()] for f in frames])
    first = np.concatenate([[0], np.cumsum(counts.ravel())])
    base, total = first[:-1].reshape(counts.shape), int(first[-1])
    coef = np.zeros((64, total), np.int32)
    layouts: dict[tuple, tuple] = {}
    for number, (parts, low, high, known, left, interval) in enumerate(frames[0].scans):
        spans = np.array([f.spans[number] for f in frames])
        from_, to = np.searchsorted(restarts, spans[:, 0]), np.searchsorted(restarts, spans[:, 1])
        key = (tuple(p[0] for p in parts), interval)
        if key not in layouts:
            layouts[key] = _layout(frames, frames[0].scans[number], base)
        own, offset, length, need = layouts[key]
        if (to - from_ != need - 1).any():
            raise ValueError("restart markers are missing")
        inner = restarts[np.arange(int((to - from_).sum())) + np.repeat(from_ - np.cumsum(to - from_) + (to - from_), to - from_)]
        start = np.sort(np.concatenate([spans[:, 0], inner + 2]))  # files follow one another in the buffer
        stop = np.sort(np.concatenate([inner, spans[:, 1]]))
        bits = Bits(words, start - moved[start], stop - moved[stop])
        ends = np.zeros(len(start), np.int64)
        guess = np.zeros((len(start), len(frames[0].components)), np.int64)
        for step in range(int(length.max(initial=0))):
            lane = np.flatnonzero(length > step)
            unit = own[offset[lane] + step]
            if low == 0:
                for column in range(unit.shape[1]):
                    c, dc, _ = parts[_part_of(parts, frames[0], column)]
                    if known:
                        coef[0, unit[:, column]] |= (bits.take(lane, 1) << left).astype(np.int32)
                        continue
                    size = bits.symbol(lane, _lookup(dc))
                    guess[lane, c] += _signed(np.where(size > 0, bits.take(lane, size), 0), size)
                    coef[0, unit[:, column]] = guess[lane, c] << left
            else:
                (_, _, ac), run = parts[0], _next_pass if known else _first_pass
                run(bits, lane, unit[:, 0], coef, _lookup(ac), low, high, left, ends)
        if (bits.at > bits.stop).any():
            raise ValueError("a scan is cut short")
    return coef, base


def _part_of(parts: tuple, frame: Frame, column: int) -> int:
    for k, (c, _, _) in enumerate(parts):
        column -= frame.components[c][1] * frame.components[c][2] if len(parts) > 1 else 1
        if column < 0:
            return k
    raise ValueError("no such block")


def samples(coef: np.ndarray, quantiser: np.ndarray) -> np.ndarray:
    """Blocks of 8x8 samples. Products stay whole numbers under 2**53, so every machine rounds alike."""
    natural = np.zeros((coef.shape[1], 64))
    natural[:, ZIGZAG] = (coef * quantiser[:, None]).T
    x = natural.reshape(-1, 8, 8)
    x = BASIS.T @ (x @ BASIS)
    return np.clip(np.floor((x + (1 << (2 * _BITS - 1))) / (1 << 2 * _BITS)) + 128, 0, 255).astype(np.uint8)


def tensor(frame: Frame, blocks: list[np.ndarray]) -> np.ndarray:
    """Height x width x 3 from each component's blocks."""
    planes, most_h, most_v = [], max(c[1] for c in frame.components), max(c[2] for c in frame.components)
    for (across, down, _, _), (_, h, v, _), own in zip(frame.grids(), frame.components, blocks, strict=True):
        plane = own.reshape(down, across, 8, 8).transpose(0, 2, 1, 3).reshape(down * 8, across * 8)
        y, x = np.arange(frame.height) * v // most_v, np.arange(frame.width) * h // most_h
        planes.append(plane if (h, v) == (most_h, most_v) and plane.shape == (frame.height, frame.width) else plane[y[:, None], x])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, axis=2)
    y, b, r = planes[0].astype(np.int32), planes[1].astype(np.int32) - 128, planes[2].astype(np.int32) - 128
    half = 1 << 15
    out = np.empty((*y.shape, 3), np.uint8)
    out[..., 0] = np.clip(y + ((91881 * r + half) >> 16), 0, 255)  # 1.402
    out[..., 1] = np.clip(y - ((22554 * b + 46802 * r + half) >> 16), 0, 255)  # 0.344136, 0.714136
    out[..., 2] = np.clip(y + ((116130 * b + half) >> 16), 0, 255)  # 1.772
    return out


def decode_files(files: list[bytes]) -> Iterator[tuple[int, Frame, np.ndarray, np.ndarray]]:
    """Index, frame, coefficients (blocks by 64, components one after another) and RGB tensor of each file."""
    buffer = np.frombuffer(b"".join(files) + b"\0" * 8, np.uint8)
    base = np.concatenate([[0], np.cumsum([len(f) for f in files])]).tolist()
    at = np.flatnonzero(buffer[:-1] == 0xFF)
    after = buffer[at + 1]
    restarts = at[(after >= 0xD0) & (after <= 0xD7)]
    markers = at[(after != 0) & (after != 0xFF) & ~((after >= 0xD0) & (after <= 0xD7))].tolist()
    escaped = np.zeros(len(buffer) + 1, np.int64)
    escaped[at[after == 0] + 2] = 1
    moved = np.cumsum(escaped)
    plain = np.delete(buffer, at[after == 0] + 1).astype(np.int64)
    plain = np.concatenate([plain, np.full(4, 255)])
    words = plain[:-3] << 24 | plain[1:-2] << 16 | plain[2:-1] << 8 | plain[3:]
    frames = [read_frame(raw, b, markers) for raw, b in zip(files, base, strict=False)]
    groups: dict[tuple, list[int]] = {}
    for k, f in enumerate(frames):
        groups.setdefault((tuple(c[1:3] for c in f.components), tuple(f.scans)), []).append(k)
    for members in groups.values():
        own = [frames[k] for k in members]
        coef, first = _decode_group(own, words, moved, restarts)
        quantised: dict[bytes, np.ndarray] = {}
        for k, f, starts in zip(members, own, first, strict=True):
            counts = [g[0] * g[1] for g in f.grids()]
            tables = [f.quantisers[c[3]] for c in f.components]
            key = b"".join(t.tobytes() for t in tables)
            if len({t.tobytes() for t in tables}) == 1:
                if key not in quantised:  # all blocks of the group at once
                    quantised[key] = samples(coef, tables[0])
                blocks = [quantised[key][a : a + n] for a, n in zip(starts.tolist(), counts, strict=True)]
            else:
                blocks = [samples(coef[:, a : a + n], t) for a, n, t in zip(starts.tolist(), counts, tables, strict=True)]
            yield k, f, coef[:, int(starts[0]) : int(starts[0]) + sum(counts)].T, tensor(f, blocks)


def payload_of(frame: Frame, coef: np.ndarray) -> tuple[int, bytes]:
    """Unpadded length and padded payload of a file that ``encode_payloads`` wrote."""
    if not frame.comment.startswith(_COMMENT):
        raise ValueError("the file holds no payload")
    size = int(frame.comment[len(_COMMENT) :])
    return size, (coef[: max(1, -(-size // 64))] + 128).astype(np.uint8).tobytes()


# --- Spark -------------------------------------------------------------------------------------


def store(docs: DataFrame) -> DataFrame:
    """doc_id, media: each text's bytes as a progressive JPEG file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 19):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(encode_payloads(batch.column("text")), pa.binary())], ["doc_id", "media"])

    rows = docs.select(docs["doc_id"], docs["text"])
    return rows.mapInArrow(run, rows.select("doc_id").schema.add("media", "binary"))


def _decoded(batches: Iterator[pa.RecordBatch]):
    for batch in slices(batches, "media", 1 << 20):
        files = batch.column("media").to_pylist()
        order = sorted(decode_files(files), key=lambda x: x[0])
        yield batch, files, order


def tensors(media: DataFrame) -> DataFrame:
    """doc_id, height, width, rgb: full-resolution tensors, row by row, three bytes a pixel. Rows without media are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, rows in _decoded(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([f.height for _, f, _, _ in rows], pa.int32()), pa.array([f.width for _, f, _, _ in rows], pa.int32()), pa.array([t.tobytes() for *_, t in rows], pa.binary())], ["doc_id", "height", "width", "rgb"])

    rows = media.select(media["doc_id"], media["media"]).where("media is not null")
    return rows.mapInArrow(run, rows.select("doc_id").schema.add("height", "integer").add("width", "integer").add("rgb", "binary"))


def read_back(media: DataFrame) -> DataFrame:
    """The stored payload's facts and the tensor's features, from the media bytes alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, files, rows in _decoded(batches):
            out = {name: [] for name in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for (_, frame, coef, rgb), raw in zip(rows, files, strict=True):
                size, payload = payload_of(frame, coef)
                mean = rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64) * 1000 // (rgb.shape[0] * rgb.shape[1])
                feature = f"{frame.width}x{frame.height} mean {mean[0]} {mean[1]} {mean[2]} crc {zlib.crc32(rgb.tobytes()):08x}"
                for name, value in zip(out, (size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), feature), strict=True):
                    out[name].append(value)
            types = {"payload_sha256": pa.string(), "media_sha256": pa.string(), "feature": pa.string()}
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(v, types.get(n, pa.int64())) for n, v in out.items()]], ["doc_id", *out])

    rows = media.select(media["doc_id"], media["media"])
    schema = rows.select("doc_id").schema
    for name in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"):
        schema = schema.add(name, "string" if name in ("payload_sha256", "media_sha256", "feature") else "long")
    return rows.mapInArrow(run, schema)


def media_round_trip(docs: DataFrame) -> DataFrame:
    """What ``read_back`` gives of the media column of ``store``. (As files of their own, media take twice the room of compressed texts.)"""
    return read_back(store(docs))
