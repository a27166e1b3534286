"""Lossless WebP: a decoder of the whole format and an encoder.

The decoder reads prefix codes (simple, normal, grouped by a meta image),
back-references and the colour cache, and inverts the predictor, cross-colour,
subtract-green and palette transforms. Pixel arrays are uint32 ARGB.

A stream whose pixels vary in one channel only and that has no references is
decoded by array operations: each bit position's symbol and successor are looked
up at once, and jumps of ``_JUMP`` symbols find where every run begins. All other
streams take the general loop.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of the format.
SIGNATURE = 0x2F
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_FACTOR = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
#: Neighbours (columns to the left, rows up) of the distance codes 1 to 120.
NEIGHBOURS = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)

_JUMP = 16
_LARGEST_SIDE = 1 << 14


class Bits:
    """Bits of a byte string, least significant first."""

    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def read(self, n: int) -> int:
        at = self.at
        self.at = at + n
        if self.at > 8 * len(self.raw):
            raise ValueError("the stream ends early")
        return (int.from_bytes(self.raw[at >> 3 : (at + n + 7) >> 3], "little") >> (at & 7)) & ((1 << n) - 1)

    def peek(self, n: int) -> int:
        at = self.at
        return (int.from_bytes(self.raw[at >> 3 : (at + n + 7) >> 3], "little") >> (at & 7)) & ((1 << n) - 1)


class Writer:
    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n


# Prefix codes


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Lengths of a prefix code for these counts, none over ``limit``; a lone symbol gets length 1."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) == 1:
        lengths[used] = 1
        return lengths
    weights = counts[used].astype(np.int64)
    while len(used):
        heap = [(int(c), i, i) for i, c in enumerate(weights)]
        heapq.heapify(heap)
        parent, number = {}, len(used)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            parent[a[2]] = parent[b[2]] = number
            heapq.heappush(heap, (a[0] + b[0], number, number))
            number += 1
        depth = [0] * number
        for node in range(number - 2, -1, -1):
            depth[node] = depth[parent[node]] + 1
        if max(depth[: len(used)]) <= limit:
            lengths[used] = depth[: len(used)]
            break
        weights = (weights + 1) // 2 + int(weights.sum()) // (1 << limit)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The codes, with their first bit lowest."""
    codes, code = np.zeros(len(lengths), np.int64), 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    before = 0
    for symbol in order[np.searchsorted(lengths[order], 1) :]:
        n = int(lengths[symbol])
        code <<= n - before
        before = n
        codes[symbol] = int(f"{code:0{n}b}"[::-1], 2)
        code += 1
    return codes


class Code:
    """A prefix code to read with: ``table`` maps the next ``bits`` bits to symbol << 4 | length."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        self.lone = int(used[0]) if len(used) == 1 else None
        self.bits = 0 if self.lone is not None else int(lengths.max(initial=0))
        if not len(used):
            raise ValueError("a prefix code without symbols")
        if self.lone is None:
            if sum(2.0 ** -lengths[used]) != 1:
                raise ValueError("a prefix code that isn't complete")
            self.table = np.zeros(1 << self.bits, np.int32)
            codes = canonical(lengths)
            for symbol in used:
                self.table[codes[symbol] :: 1 << int(lengths[symbol])] = symbol << 4 | int(lengths[symbol])
            self.lookup = None

    def read(self, bits: Bits) -> int:
        if self.lone is not None:
            return self.lone
        if self.lookup is None:
            self.lookup = self.table.tolist()
        entry = self.lookup[bits.peek(self.bits)]
        bits.at += entry & 15
        return entry >> 4


def read_code(bits: Bits, size: int) -> Code:
    lengths = np.zeros(size, np.int64)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Code(lengths)
    of_lengths = np.zeros(19, np.int64)
    for i in range(4 + bits.read(4)):
        of_lengths[LENGTH_ORDER[i]] = bits.read(3)
    code = Code(of_lengths)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    at, before = 0, 8
    while at < size and left:
        left -= 1
        symbol = code.read(bits)
        if symbol < 16:
            lengths[at] = symbol
            before = symbol or before
            at += 1
            continue
        n, value = {16: (3, 2), 17: (3, 3), 18: (11, 7)}[symbol]
        n += bits.read(value)
        if at + n > size:
            raise ValueError("code lengths beyond the alphabet")
        if symbol == 16:
            lengths[at : at + n] = before
        at += n
    return Code(lengths)


def write_code(out: Writer, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths)
    if len(used) <= 2 and all(used < 256):
        symbols = list(map(int, used)) or [0]
        out.put(1, 1)
        out.put(len(symbols) - 1, 1)
        out.put(1, 1)
        for s in symbols:
            out.put(s, 8)
        return
    items, at, n = [], 0, len(lengths)
    while at < n:
        value, end = int(lengths[at]), at
        while end < n and lengths[end] == value:
            end += 1
        run = end - at
        while value == 0 and run >= 3:
            take = min(run, 138)
            items.append((18, take - 11, 7) if take >= 11 else (17, take - 3, 3))
            run -= take
        items += [(value, 0, 0)] * run
        at = end
    counts = np.bincount([i[0] for i in items], minlength=19)
    of_lengths = code_lengths(counts, 7)
    codes = canonical(of_lengths)
    count = max(4, 1 + max(i for i, s in enumerate(LENGTH_ORDER) if of_lengths[s]))
    out.put(0, 1)
    out.put(count - 4, 4)
    for s in LENGTH_ORDER[:count]:
        out.put(int(of_lengths[s]), 3)
    out.put(0, 1)
    lone = np.count_nonzero(of_lengths) == 1
    for symbol, extra, width in items:
        out.put(0 if lone else int(codes[symbol]), 0 if lone else int(of_lengths[symbol]))
        out.put(extra, width)


# Decoding


def _value(bits: Bits, prefix: int) -> int:
    """A length or distance from its prefix."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _distance(code: int, width: int) -> int:
    if code > len(NEIGHBOURS):
        return code - len(NEIGHBOURS)
    left, up = NEIGHBOURS[code - 1]
    return max(left + up * width, 1)


def _one_channel(bits: Bits, green: Code, n: int) -> np.ndarray:
    """n symbols of one code, by array operations."""
    if green.lone is not None:
        return np.full(n, green.lone, np.uint32)
    first, raw = bits.at >> 3, bits.raw
    data = np.frombuffer(raw[first:] + b"\0\0\0\0", np.uint8).astype(np.uint32)
    window = data[:-3] | data[1:-2] << np.uint32(8) | data[2:-1] << np.uint32(16)
    entry = green.table[((window[:, None] >> np.arange(8, dtype=np.uint32)) & np.uint32((1 << green.bits) - 1)).ravel()]
    size = len(entry)
    after = np.minimum(np.arange(size, dtype=np.int32) + (entry & 15), size - 1)
    far = after
    for _ in range(_JUMP.bit_length() - 1):
        far = far[far]
    runs = -(-n // _JUMP)
    begin, at, jumps = np.empty(runs, np.int32), bits.at & 7, memoryview(far)
    for i in range(runs):
        begin[i] = at
        at = jumps[at]
    places = np.empty((runs, _JUMP), np.int32)
    places[:, 0] = begin
    for i in range(1, _JUMP):
        places[:, i] = after[places[:, i - 1]]
    places = places.ravel()[:n]
    bits.at = 8 * first + int(places[-1]) + int(entry[places[-1]] & 15)
    if bits.at > 8 * len(raw):
        raise ValueError("the stream ends early")
    return (entry[places] >> 4).astype(np.uint32)


def _entropy_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """width * height pixels; main: the image itself, whose codes can differ by block."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache of a wrong size")
    block, groups, group_of = 0, 1, None
    if main and bits.read(1):
        block = bits.read(3) + 2
        across = -(-width // (1 << block))
        group_of = (_entropy_image(bits, across, -(-height // (1 << block)), False) >> np.uint32(8)) & np.uint32(0xFFFF)
        groups = int(group_of.max()) + 1
    cache_size = 1 << cache_bits if cache_bits else 0
    codes = [[read_code(bits, size) for size in (280 + cache_size, 256, 256, 256, 40)] for _ in range(groups)]
    n = width * height
    if groups == 1 and not cache_bits and all(c.lone is not None for c in codes[0][1:4]):
        green = codes[0][0]
        if (green.lone if green.lone is not None else int(green.table.max()) >> 4) < 256:
            red, blue, alpha = (c.lone for c in codes[0][1:4])
            return _one_channel(bits, green, n) << np.uint32(8) | np.uint32(alpha << 24 | red << 16 | blue)
    pixels, at = [0] * n, 0
    cache, shift = [0] * cache_size, 32 - cache_bits
    own = codes[0]
    while at < n:
        if group_of is not None:
            own = codes[int(group_of[(at // width >> block) * across + (at % width >> block)])]
        symbol = own[0].read(bits)
        if symbol < 256:
            red = own[1].read(bits)
            blue = own[2].read(bits)
            run = [own[3].read(bits) << 24 | red << 16 | symbol << 8 | blue]
        elif symbol < 280:
            length = _value(bits, symbol - 256)
            back = _distance(_value(bits, own[4].read(bits)), width)
            if back > at or at + length > n:
                raise ValueError("a reference to what isn't there")
            run = [pixels[at - back + i % back] for i in range(length)]
        else:
            run = [cache[symbol - 280]]
        pixels[at : at + len(run)] = run
        at += len(run)
        if cache_bits:
            for p in run:
                cache[((CACHE_FACTOR * p) & 0xFFFFFFFF) >> shift] = p
    return np.array(pixels, np.uint32)


def _add(a, b):
    """Sums of the four channels, each mod 256."""
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00) | ((a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF)


def _mean(a: int, b: int) -> int:
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def _channels(p: int) -> tuple[int, int, int, int]:
    return p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255


def _pixel(channels) -> int:
    a, r, g, b = (min(max(c, 0), 255) for c in channels)
    return a << 24 | r << 16 | g << 8 | b


def predicted(mode: int, left: int, top: int, right: int, corner: int) -> int:
    """The predictor's pixel; right: top right, corner: top left."""
    if mode in (1, 2, 3, 4):
        return (left, top, right, corner)[mode - 1]
    if mode in (5, 6, 7, 8, 9, 10):
        return (
            lambda: _mean(_mean(left, right), top), lambda: _mean(left, corner), lambda: _mean(left, top),
            lambda: _mean(corner, top), lambda: _mean(top, right), lambda: _mean(_mean(left, corner), _mean(top, right)),
        )[mode - 5]()
    if mode in (11, 12, 13):
        ls, ts, cs = _channels(left), _channels(top), _channels(corner)
        if mode == 11:
            to_left = sum(abs(t - c) for t, c in zip(ts, cs))
            to_top = sum(abs(x - c) for x, c in zip(ls, cs))
            return left if to_left < to_top else top
        if mode == 12:
            return _pixel(x + t - c for x, t, c in zip(ls, ts, cs))
        return _pixel(m + int((m - c) / 2) for m, c in zip(_channels(_mean(left, top)), cs))
    return 0xFF000000


def _neighbours(pixels: list, at: int, width: int, modes: list, block: int, across: int) -> int:
    """The predicted pixel at a place whose earlier pixels are known."""
    x, y = at % width, at // width
    if not at:
        return 0xFF000000
    if not y:
        return pixels[at - 1]
    if not x:
        return pixels[at - width]
    mode = modes[(y >> block) * across + (x >> block)] >> 8 & 15
    return predicted(mode, pixels[at - 1], pixels[at - width], pixels[at - width + 1], pixels[at - width - 1])


def _signed(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.int64) & 255 ^ 128) - 128


def _cross(pixels: np.ndarray, elements: np.ndarray, width: int, block: int, sign: int) -> np.ndarray:
    """Adds (sign 1) or takes off (-1) what green and red tell of red and blue."""
    at = np.arange(len(pixels))
    e = elements[(at // width >> block) * -(-width // (1 << block)) + (at % width >> block)]
    green = _signed(pixels >> np.uint32(8))
    red = pixels.astype(np.int64) >> 16 & 255
    new = red + sign * (_signed(e) * green >> 5) & 255
    whole = new if sign > 0 else red
    blue = (pixels.astype(np.int64) & 255) + sign * ((_signed(e >> np.uint32(8)) * green >> 5) + (_signed(e >> np.uint32(16)) * _signed(whole) >> 5)) & 255
    return (pixels & np.uint32(0xFF00FF00)) | (new << 16 | blue).astype(np.uint32)


def decode_stream(raw: bytes) -> np.ndarray:
    """(height, width) uint32 ARGB pixels of a lossless bitstream."""
    bits = Bits(raw)
    if bits.read(8) != SIGNATURE:
        raise ValueError("no lossless bitstream")
    whole, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("an unknown version")
    width, undo = whole, []
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            block = bits.read(3) + 2
            undo.append((kind, width, block, _entropy_image(bits, -(-width // (1 << block)), -(-height // (1 << block)), False)))
        elif kind == SUBTRACT_GREEN:
            undo.append((kind, width, 0, None))
        else:
            size = bits.read(8) + 1
            deltas = _entropy_image(bits, size, 1, False)
            colours = sum((np.cumsum(deltas >> np.uint32(s) & np.uint32(255)).astype(np.uint32) & np.uint32(255)) << np.uint32(s) for s in (0, 8, 16, 24))
            packed = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            undo.append((kind, width, packed, colours))
            width = -(-width // (1 << packed))
    pixels = _entropy_image(bits, width, height, True)
    for kind, width, block, told in reversed(undo):
        if kind == SUBTRACT_GREEN:
            green = pixels >> np.uint32(8) & np.uint32(255)
            pixels = _add(pixels, green << np.uint32(16) | green)
        elif kind == CROSS_COLOUR:
            pixels = _cross(pixels, told, width, block, 1)
        elif kind == PALETTE:
            index = pixels.reshape(height, -1) >> np.uint32(8) & np.uint32(255)
            if block:
                size = 8 >> block
                index = (index[:, :, None] >> (np.arange(1 << block, dtype=np.uint32) * np.uint32(size)) & np.uint32((1 << size) - 1)).reshape(height, -1)[:, :width]
            table = np.zeros(256, np.uint32)
            table[: len(told)] = told
            pixels = table[index.ravel()]
        else:
            out, modes, across = pixels.tolist(), told.tolist(), -(-width // (1 << block))
            for at in range(len(out)):
                out[at] = _add(out[at], _neighbours(out, at, width, modes, block, across))
            pixels = np.array(out, np.uint32)
    return pixels.reshape(height, whole)


def decode(raw: bytes) -> np.ndarray:
    """(height, width) uint32 ARGB pixels of a WebP file with a lossless image."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"WEBP":
        raise ValueError("no WebP file")
    at = 12
    while at + 8 <= len(raw):
        size = int.from_bytes(raw[at + 4 : at + 8], "little")
        if raw[at : at + 4] == b"VP8L":
            return decode_stream(raw[at + 8 : at + 8 + size])
        at += 8 + size + (size & 1)
    raise ValueError("no lossless image in the file")


# Encoding


def _pack(codes: np.ndarray, lengths: np.ndarray, head: Writer) -> bytes:
    """The head's bits, then the codes, as bytes."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    place = np.arange(total, dtype=np.int64) - np.repeat(ends - lengths, lengths)
    body = (np.repeat(codes, lengths) >> place).astype(np.uint8) & np.uint8(1)
    lead = np.unpackbits(np.frombuffer(head.value.to_bytes((head.n + 7) // 8, "little"), np.uint8), bitorder="little")[: head.n]
    return np.packbits(np.concatenate([lead, body]), bitorder="little").tobytes()


def _file(stream: bytes) -> bytes:
    padded = stream + b"\0" * (len(stream) & 1)
    return b"RIFF" + (len(padded) + 12).to_bytes(4, "little") + b"WEBPVP8L" + len(stream).to_bytes(4, "little") + padded


def _head(width: int, height: int) -> Writer:
    out = Writer()
    for value, n in ((SIGNATURE, 8), (width - 1, 14), (height - 1, 14), (0, 1), (0, 3)):
        out.put(value, n)
    return out


def encode_grey(samples: np.ndarray) -> bytes:
    """A WebP file of (height, width) 8-bit grey samples: subtract-green, then one prefix code."""
    height, width = samples.shape
    flat = samples.ravel()
    lengths = code_lengths(np.bincount(flat, minlength=280), 12)
    out = _head(width, height)
    for value, n in ((1, 1), (SUBTRACT_GREEN, 2), (0, 1), (0, 1), (0, 1)):
        out.put(value, n)
    write_code(out, lengths)
    for symbol in (0, 0, 255, 0):
        write_code(out, np.eye(1, 256, symbol, dtype=np.int64)[0])
    if np.count_nonzero(lengths) == 1:
        return _file(out.value.to_bytes((out.n + 7) // 8, "little"))
    return _file(_pack(canonical(lengths)[flat], lengths[flat], out))


def encode(pixels: np.ndarray, predictor: int | None = None, cross: tuple[int, int, int] | None = None, green: bool = False, palette: bool = False, cache_bits: int = 0, references: bool = False, block: int = 2) -> bytes:
    """A WebP file of (height, width) uint32 ARGB pixels with the chosen transforms, colour cache and references.

    Meant for small images: pixels are coded one by one. predictor: the mode of all
    blocks; cross: (green to red, green to blue, red to blue) of all blocks, signed.
    """
    height, width = pixels.shape
    out, flat = _head(width, height), pixels.ravel().astype(np.uint32)

    def blocks(kind: int, colour: int) -> None:
        out.put(1, 1)
        out.put(kind, 2)
        out.put(block - 2, 3)
        _write_image(out, np.full(-(-width // (1 << block)) * -(-height // (1 << block)), colour, np.uint32), -(-width // (1 << block)), False, 0, False)

    if predictor is not None:
        blocks(PREDICTOR, 0xFF000000 | predictor << 8)
        old, modes = flat.tolist(), [predictor << 8] * (-(-width // (1 << block)) * -(-height // (1 << block)))
        minus = lambda a, b: ((a | 0x00FF00FF) - (b & 0xFF00FF00) & 0xFF00FF00) | ((a | 0xFF00FF00) - (b & 0x00FF00FF) & 0x00FF00FF)
        flat = np.array([minus(p, _neighbours(old, i, width, modes, block, -(-width // (1 << block)))) for i, p in enumerate(old)], np.uint32)
    if cross:
        element = 0xFF000000 | (cross[2] & 255) << 16 | (cross[1] & 255) << 8 | cross[0] & 255
        blocks(CROSS_COLOUR, element)
        flat = _cross(flat, np.full(-(-width // (1 << block)) * -(-height // (1 << block)), element, np.uint32), width, block, -1)
    if green:
        out.put(1, 1)
        out.put(SUBTRACT_GREEN, 2)
        g = flat >> np.uint32(8) & np.uint32(255)
        flat = (flat & np.uint32(0xFF00FF00)) | ((flat >> np.uint32(16)) - g & np.uint32(255)) << np.uint32(16) | (flat - g & np.uint32(255))
    if palette:
        colours, index = np.unique(flat, return_inverse=True)
        if len(colours) > 256:
            raise ValueError("more than 256 colours")
        out.put(1, 1)
        out.put(PALETTE, 2)
        out.put(len(colours) - 1, 8)
        deltas = sum((np.diff((colours >> np.uint32(s) & np.uint32(255)).astype(np.int64), prepend=0) & 255).astype(np.uint32) << np.uint32(s) for s in (0, 8, 16, 24))
        _write_image(out, deltas, len(colours), False, 0, False)
        packed = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
        rows = np.zeros((height, -(-width // (1 << packed)) << packed), np.uint32)
        rows[:, :width] = index.reshape(height, width)
        rows = rows.reshape(height, -1, 1 << packed) << (np.arange(1 << packed, dtype=np.uint32) * np.uint32(8 >> packed))
        flat = np.uint32(0xFF000000) | rows.sum(2, dtype=np.uint32).ravel() << np.uint32(8)
        width = -(-width // (1 << packed))
    out.put(0, 1)
    _write_image(out, flat, width, True, cache_bits, references)
    return _file(out.value.to_bytes((out.n + 7) // 8, "little"))


def _prefix(value: int) -> tuple[int, int, int]:
    """(prefix, extra bits' value, their number) of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    value -= 1
    top = value.bit_length() - 1
    half = value >> (top - 1) & 1
    return 2 * top + half, value & ((1 << (top - 1)) - 1), top - 1


def _write_image(out: Writer, pixels: np.ndarray, width: int, main: bool, cache_bits: int, references: bool) -> None:
    pixels = [int(p) for p in pixels]
    out.put(1 if cache_bits else 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(0, 1)
    size = 1 << cache_bits if cache_bits else 0
    cache, seen, items, at = [0] * size, {}, [], 0
    while at < len(pixels):
        length, back = 0, 0
        if references and (found := seen.get(tuple(pixels[at : at + 3]))) is not None and at + 3 <= len(pixels):
            back = at - found
            while at + length < len(pixels) and length < 4096 and pixels[at + length] == pixels[at + length - back]:
                length += 1
        if length >= 3:
            near = next((i + 1 for i, (x, y) in enumerate(NEIGHBOURS) if max(x + y * width, 1) == back), back + len(NEIGHBOURS))
            items.append(("copy", length, near))
        else:
            length = 1
            slot = ((CACHE_FACTOR * pixels[at]) & 0xFFFFFFFF) >> (32 - cache_bits) if size else 0
            items.append(("cache", slot, 0) if size and cache[slot] == pixels[at] else ("pixel", pixels[at], 0))
        for i in range(at, at + length):
            if size:
                cache[((CACHE_FACTOR * pixels[i]) & 0xFFFFFFFF) >> (32 - cache_bits)] = pixels[i]
            seen[tuple(pixels[i : i + 3])] = i
        at += length
    streams: list[list[tuple[int, int, int, int]]] = []
    for kind, a, b in items:
        if kind == "pixel":
            streams.append([(0, a >> 8 & 255, 0, 0), (1, a >> 16 & 255, 0, 0), (2, a & 255, 0, 0), (3, a >> 24, 0, 0)])
        elif kind == "cache":
            streams.append([(0, 280 + a, 0, 0)])
        else:
            p, extra, n = _prefix(a)
            q, more, m = _prefix(b)
            streams.append([(0, 256 + p, extra, n), (4, q, more, m)])
    counts = [np.zeros(s, np.int64) for s in (280 + size, 256, 256, 256, 40)]
    for s in streams:
        for channel, symbol, _, _ in s:
            counts[channel][symbol] += 1
    lengths = [code_lengths(c, 15) for c in counts]
    for n in lengths:
        write_code(out, n)
    codes = [canonical(n) for n in lengths]
    alone = [np.count_nonzero(n) == 1 for n in lengths]
    for s in streams:
        for channel, symbol, extra, n in s:
            if not alone[channel]:
                out.put(int(codes[channel][symbol]), int(lengths[channel][symbol]))
            out.put(extra, n)


# The operator


def payload(text: bytes) -> bytes:
    """The text, with bytes 0 up to a positive multiple of 64."""
    return text + b"\0" * (64 * max(1, -(-len(text) // 64)) - len(text))


def stored(data: bytes) -> bytes:
    """The payload as grey samples in rows of 64, or of the format's largest side for more than 1 MiB (the last row filled with 0)."""
    width = 64 if len(data) <= 64 * _LARGEST_SIDE else _LARGEST_SIDE
    rows = -(-len(data) // width)
    if rows > _LARGEST_SIDE:
        raise ValueError("a text of over 256 MiB doesn't fit one image")
    samples = np.frombuffer(data + b"\0" * (rows * width - len(data)), np.uint8)
    return encode_grey(samples.reshape(rows, width))


def features(samples: np.ndarray) -> str:
    """Mean, spread and entropy of the samples, and which of 8 x 8 fields are over the mean."""
    counts = np.bincount(samples.ravel(), minlength=256)
    p = counts[counts > 0] / samples.size
    mean = samples.mean()
    edges = np.linspace(0, samples.shape[0], 9).astype(int)
    fields = [samples[a : max(b, a + 1)].reshape(-1, 8, samples.shape[1] // 8).mean((0, 2)) for a, b in zip(np.minimum(edges, samples.shape[0] - 1), edges[1:])]
    bits = np.packbits(np.array(fields).ravel() > mean).tobytes().hex()
    return f"mean={mean:.4f};std={samples.std():.4f};entropy={abs(-(p * np.log2(p)).sum()):.4f};fields={bits}"


RESULT = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def media_columns(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """Each text stored as a lossless WebP image, read back from the stored bytes, with features of the pixels.

    Returns doc_id, the columns of ``RESULT`` and, with ``keep_media``, media (the
    file). Null texts count as empty: one row of 64 zero samples. A row needs
    memory in proportion to its own text; nothing is shuffled. Repeated rows give
    repeated results, an empty table none, other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = [c.split()[0] for c in RESULT.split(", ")] + ["media"] * keep_media
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.binary()] * keep_media

    def one(text: str | None) -> tuple:
        raw = (text or "").encode()
        data = payload(raw)
        media = stored(data)
        pixels = decode(media)
        samples = (pixels >> np.uint32(8)).astype(np.uint8)
        back = samples.tobytes()[: len(data)]
        row = (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(samples))
        return (*row, media) if keep_media else row

    def convert(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [one(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names=["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(convert, f"doc_id {kind}, {RESULT}" + (", media binary" if keep_media else ""))
