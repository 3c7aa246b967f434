"""Lossless WebP: the whole format's decoder, and an encoder for pixel arrays.

Pixels are unsigned 32-bit numbers, alpha highest, then red, green and blue. The decoder
reads prefix codes, back-references, colour cache and several prefix-code groups, and
undoes the predictor, cross-colour, subtract-green and palette transforms. Streams that
hold one group and no colour cache are decoded many at a time: every image is a lane,
and each step takes one pixel of all lanes with array operations.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
PREDICTOR, CROSS_COLOR, SUBTRACT_GREEN, PALETTE = range(4)
OPAQUE_BLACK = 0xFF000000
CACHE_FACTOR = 0x1E35A7BD
#: The nearest 120 pixels above or to the left, by distance, then by column: the short distance codes.
NEAR = sorted(
    ((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0)
)
LONGEST_COPY = 4096
#: Longest prefix code that the encoder writes, so that decoding tables stay small.
CODE_LIMIT = 12


class WebpError(ValueError):
    """The bytes are not a lossless WebP image."""


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)


# Prefix codes


def code_lengths(counts: np.ndarray, limit: int = CODE_LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code; counts are flattened until none exceeds ``limit``."""
    used = np.flatnonzero(counts).tolist()
    lengths = np.zeros(len(counts), dtype=np.int64)
    if len(used) == 1:
        lengths[used[0]] = 1
    if len(used) < 2:
        return lengths
    weights = [int(counts[s]) for s in used]
    while True:
        heap = [(w, i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        parent, n = [0] * (2 * len(used) - 1), len(used)
        while len(heap) > 1:
            a, i = heapq.heappop(heap)
            b, j = heap[0]
            parent[i] = parent[j] = n
            heapq.heapreplace(heap, (a + b, n))
            n += 1
        depth = [0] * n
        for i in range(n - 2, -1, -1):
            depth[i] = depth[parent[i]] + 1
        if max(depth[: len(used)]) <= limit:
            lengths[used] = depth[: len(used)]
            return lengths
        weights = [w // 2 + 1 for w in weights]


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The codes of given lengths, first bit lowest as the stream has them."""
    symbols = np.flatnonzero(lengths)
    symbols = symbols[np.argsort(lengths[symbols], kind="stable")]
    codes = np.zeros(len(lengths), dtype=np.int64)
    code = before = 0
    for s, n in zip(symbols.tolist(), lengths[symbols].tolist(), strict=True):
        code <<= n - before
        codes[s] = int(f"{code:0{n}b}"[::-1], 2)
        code, before = code + 1, n
    return codes


@dataclass
class PrefixCode:
    """A decoding table over the next ``bits`` bits: symbol << 4 | length."""

    table: np.ndarray
    bits: int

    @classmethod
    def of(cls, lengths: np.ndarray) -> PrefixCode:
        used = np.flatnonzero(lengths)
        if len(used) == 0:
            raise WebpError("a prefix code has no symbol")
        if len(used) == 1:
            return cls(used.astype(np.int32) << 4, 0)
        bits = int(lengths.max())
        if np.sum(1 << (bits - lengths[used])) != 1 << bits:
            raise WebpError("a prefix code is not complete")
        # canonical order fills the table of codes read from their highest bit
        used = used[np.argsort(lengths[used], kind="stable")]
        ordered = np.repeat(used << 4 | lengths[used], 1 << (bits - lengths[used])).astype(np.int32)
        return cls(ordered[_reversed(bits)], bits)


_REVERSED: dict[int, np.ndarray] = {}


def _reversed(bits: int) -> np.ndarray:
    if bits not in _REVERSED:
        order = np.zeros(1, dtype=np.int64)
        for _ in range(bits):
            order = np.concatenate((2 * order, 2 * order + 1))
        _REVERSED[bits] = order
    return _REVERSED[bits]


# Reading


class BitReader:
    def __init__(self, data: bytes, at: int = 0):
        self._data, self.at, self._end = data, at, 8 * len(data)

    def read(self, bits: int) -> int:
        at = self.at
        if at + bits > self._end:
            raise WebpError("the stream ends too early")
        self.at = at + bits
        return int.from_bytes(self._data[at >> 3 : (at + bits + 7) >> 3], "little") >> (at & 7) & ((1 << bits) - 1)

    def symbol(self, code: PrefixCode) -> int:
        at = self.at
        window = int.from_bytes(self._data[at >> 3 : (at >> 3) + 3], "little") >> (at & 7)
        entry = int(code.table[window & ((1 << code.bits) - 1)])
        self.at = at + (entry & 15)
        if self.at > self._end:
            raise WebpError("the stream ends too early")
        return entry >> 4


def read_prefix_code(bits: BitReader, alphabet: int) -> PrefixCode:
    lengths = np.zeros(alphabet, dtype=np.int64)
    if bits.read(1):
        two = bits.read(1)
        symbols = [bits.read(8 if bits.read(1) else 1)] + ([bits.read(8)] if two else [])
        if max(symbols) >= alphabet:
            raise WebpError("a symbol lies outside its alphabet")
        if len(symbols) == 1:
            return PrefixCode(np.array([symbols[0] << 4], dtype=np.int32), 0)
        lengths[symbols] = 1
        return PrefixCode.of(lengths)
    own = np.zeros(19, dtype=np.int64)
    for i in range(4 + bits.read(4)):
        own[CODE_LENGTH_ORDER[i]] = bits.read(3)
    code = PrefixCode.of(own)
    left = alphabet
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
        if left > alphabet:
            raise WebpError("too many code lengths")
    table, mask, data, at = code.table.tolist(), (1 << code.bits) - 1, bits._data, bits.at
    symbol, before = 0, 8
    while symbol < alphabet and left:
        left -= 1
        window = int.from_bytes(data[at >> 3 : (at >> 3) + 4], "little") >> (at & 7)
        entry = table[window & mask]
        at += entry & 15
        window >>= entry & 15
        length = entry >> 4
        if length < 16:
            lengths[symbol] = length
            symbol += 1
            before = length or before
            continue
        extra, least = ((2, 3), (3, 3), (7, 11))[length - 16]
        times = least + (window & ((1 << extra) - 1))
        at += extra
        if symbol + times > alphabet:
            raise WebpError("too many code lengths")
        if length == 16:
            lengths[symbol : symbol + times] = before
        symbol += times
    bits.at = at
    return PrefixCode.of(lengths)


@dataclass
class Coded:
    """An entropy-coded image whose codes have been read and whose pixels follow."""

    width: int
    height: int
    cache_bits: int
    groups: list[list[PrefixCode]]
    group_of: np.ndarray | None = None
    group_bits: int = 0


def read_codes(bits: BitReader, width: int, height: int, spatial: bool) -> Coded:
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise WebpError("the colour cache is too large")
    group_of, group_bits, groups = None, 0, 1
    if spatial and bits.read(1):
        group_bits = bits.read(3) + 2
        image = read_image(bits, ceil_div(width, 1 << group_bits), ceil_div(height, 1 << group_bits))
        group_of = (image >> 8 & 0xFFFF).astype(np.int64)
        groups = int(group_of.max()) + 1
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = [[read_prefix_code(bits, n) for n in sizes] for _ in range(groups)]
    return Coded(width, height, cache_bits, codes, group_of, group_bits)


def read_image(bits: BitReader, width: int, height: int, spatial: bool = False) -> np.ndarray:
    return read_pixels(bits, read_codes(bits, width, height, spatial)).reshape(height, width)


def _prefixed(bits: BitReader, prefix: int) -> int:
    """A length or distance from its prefix symbol and extra bits."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def distance(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def read_pixels(bits: BitReader, coded: Coded) -> np.ndarray:
    """Pixel after pixel: for small images and for every feature of the format."""
    total, width, out = coded.width * coded.height, coded.width, []
    cache = [0] * (1 << coded.cache_bits) if coded.cache_bits else None
    shift = 32 - coded.cache_bits
    while len(out) < total:
        group = 0
        if coded.group_of is not None:
            y, x = divmod(len(out), width)
            group = int(coded.group_of[y >> coded.group_bits, x >> coded.group_bits])
        green, red, blue, alpha, dist = coded.groups[group]
        symbol = bits.symbol(green)
        if symbol < 256:
            new = [bits.symbol(red) << 16 | symbol << 8 | bits.symbol(blue) | bits.symbol(alpha) << 24]
        elif symbol < 280:
            length = _prefixed(bits, symbol - 256)
            back = distance(_prefixed(bits, bits.symbol(dist)), width)
            if back > len(out) or len(out) + length > total:
                raise WebpError("a back-reference leaves the image")
            new = out[len(out) - back :][:length]
            new = (new * ceil_div(length, len(new)))[:length]
        else:
            if cache is None:
                raise WebpError("there is no colour cache")
            new = [cache[symbol - 280]]
        out += new
        if cache is not None:
            for pixel in new:
                cache[(CACHE_FACTOR * pixel & 0xFFFFFFFF) >> shift] = pixel
    return np.array(out, dtype=np.uint32)


# Transforms, undone


def _channels(pixels: np.ndarray) -> np.ndarray:
    """Four signed channels, blue first, along a new last axis."""
    return np.ascontiguousarray(pixels, dtype="<u4").view(np.uint8).reshape(*pixels.shape, 4).astype(np.int64)


def _joined(channels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(channels & 255, dtype=np.uint8).view("<u4").reshape(channels.shape[:-1])


def predict(mode: int, left: np.ndarray, top: np.ndarray, top_left: np.ndarray, top_right: np.ndarray) -> np.ndarray:
    """The prediction from neighbouring channels, for one pixel or for many."""
    half = lambda a, b: (a + b) >> 1
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return top_right
    if mode == 4:
        return top_left
    if mode == 5:
        return half(half(left, top_right), top)
    if mode == 6:
        return half(left, top_left)
    if mode == 7:
        return half(left, top)
    if mode == 8:
        return half(top_left, top)
    if mode == 9:
        return half(top, top_right)
    if mode == 10:
        return half(half(left, top_left), half(top, top_right))
    if mode == 11:
        nearer_left = np.abs(top - top_left).sum(-1) < np.abs(left - top_left).sum(-1)
        return np.where(nearer_left[..., None], left, top)
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    if mode == 13:
        mean = half(left, top)
        gap = mean - top_left
        return np.clip(mean + np.where(gap < 0, -(-gap // 2), gap // 2), 0, 255)
    return np.broadcast_to(np.array([0, 0, 0, 255]), np.shape(left))


def undo_predictor(residual: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    height, width = residual.shape
    parts = _channels(residual)
    out = np.zeros_like(parts)
    out[0, 0] = parts[0, 0] + np.array([0, 0, 0, 255])
    out[0, 1:] = parts[0, 1:]
    out[0] = out[0].cumsum(0) & 255
    for y in range(1, height):
        out[y, 0] = (parts[y, 0] + out[y - 1, 0]) & 255
        above, row = out[y - 1], modes[y >> bits]
        for begin in range(0, width, 1 << bits):
            mode = int(row[begin >> bits])
            a, b = max(1, begin), min(width, begin + (1 << bits))
            if a >= b:
                continue
            if mode == 1:
                out[y, a:b] = (parts[y, a:b].cumsum(0) + out[y, a - 1]) & 255
            elif mode in (0, 2, 4, 8) or mode in (3, 9) and b < width:
                beyond = above[a + 1 : b + 1] if b < width else above[a:b]
                out[y, a:b] = (parts[y, a:b] + predict(mode, above[a:b], above[a:b], above[a - 1 : b - 1], beyond)) & 255
            else:
                for x in range(a, b):
                    beyond = above[x + 1] if x + 1 < width else out[y, 0]
                    out[y, x] = (parts[y, x] + predict(mode, out[y, x - 1], above[x], above[x - 1], beyond)) & 255
    return _joined(out)


def _spread(image: np.ndarray, bits: int, shape: tuple[int, int]) -> np.ndarray:
    return image.repeat(1 << bits, 0).repeat(1 << bits, 1)[: shape[0], : shape[1]]


def _delta(factor: np.ndarray, channel: np.ndarray) -> np.ndarray:
    return (factor.astype(np.uint8).view(np.int8).astype(np.int64) * (channel & 255).astype(np.uint8).view(np.int8)) >> 5


def undo_cross_color(pixels: np.ndarray, factors: np.ndarray, bits: int) -> np.ndarray:
    parts, by = _channels(pixels), _channels(_spread(factors, bits, pixels.shape))
    parts[..., 2] += _delta(by[..., 0], parts[..., 1])
    parts[..., 0] += _delta(by[..., 1], parts[..., 1]) + _delta(by[..., 2], parts[..., 2])
    return _joined(parts)


def undo_subtract_green(pixels: np.ndarray) -> np.ndarray:
    parts = _channels(pixels)
    parts[..., 0] += parts[..., 1]
    parts[..., 2] += parts[..., 1]
    return _joined(parts)


def undo_palette(pixels: np.ndarray, colors: np.ndarray, width: int) -> np.ndarray:
    """Unpack the indexes from the green channel and look their colours up."""
    fold = bundle_bits(len(colors))
    index = (pixels >> 8 & 255).astype(np.int64)
    if fold:
        step = 8 >> fold
        index = (index[:, :, None] >> (step * np.arange(1 << fold)) & ((1 << step) - 1)).reshape(len(index), -1)[:, :width]
    table = np.zeros(256, dtype=np.uint32)
    table[: len(colors)] = colors
    return table[index]


def bundle_bits(colors: int) -> int:
    return 3 if colors <= 2 else 2 if colors <= 4 else 1 if colors <= 16 else 0


# Whole images


@dataclass
class Image:
    """What a stream's head says; its pixels start at bit ``at`` of ``data``."""

    data: bytes
    width: int
    height: int
    transforms: list[tuple]
    coded: Coded
    at: int
    pixels: np.ndarray = field(default=None, repr=False)


def chunk(webp: bytes) -> bytes:
    """The lossless chunk of a WebP file."""
    if webp[:4] != b"RIFF" or webp[8:16] != b"WEBPVP8L":
        raise WebpError("not a lossless WebP file")
    return webp[20 : 20 + int.from_bytes(webp[16:20], "little")]


def read_head(data: bytes) -> Image:
    bits = BitReader(data)
    if bits.read(8) != 0x2F:
        raise WebpError("the signature is missing")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise WebpError("the version is unknown")
    transforms, wide = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in [t[0] for t in transforms]:
            raise WebpError("a transform comes twice")
        if kind in (PREDICTOR, CROSS_COLOR):
            size = bits.read(3) + 2
            transforms.append((kind, read_image(bits, ceil_div(wide, 1 << size), ceil_div(height, 1 << size)), size))
        elif kind == PALETTE:
            steps = read_image(bits, bits.read(8) + 1, 1)
            colors = _joined(_channels(steps[0]).cumsum(0))
            transforms.append((kind, colors, wide))
            wide = ceil_div(wide, 1 << bundle_bits(len(colors)))
        else:
            transforms.append((kind,))
    coded = read_codes(bits, wide, height, True)
    return Image(data, width, height, transforms, coded, bits.at)


def _finish(image: Image) -> np.ndarray:
    pixels = image.pixels.reshape(image.height, -1)
    for kind, *rest in reversed(image.transforms):
        if kind == PREDICTOR:
            pixels = undo_predictor(pixels, (rest[0] >> 8 & 15).astype(np.int64), rest[1])
        elif kind == CROSS_COLOR:
            pixels = undo_cross_color(pixels, *rest)
        elif kind == PALETTE:
            pixels = undo_palette(pixels, *rest)
        else:
            pixels = undo_subtract_green(pixels)
    return pixels


def decode(webp: bytes) -> np.ndarray:
    """The pixel array of one file."""
    return decode_batch([webp])[0]


def decode_batch(files: list[bytes]) -> list[np.ndarray]:
    """The pixel arrays of many files."""
    images = [read_head(chunk(f)) for f in files]
    lanes = [i for i in images if len(i.coded.groups) == 1 and not i.coded.cache_bits]
    _read_lanes(lanes)
    for image in images:
        if image.pixels is None:
            image.pixels = read_pixels(BitReader(image.data, image.at), image.coded)
    return [_finish(i) for i in images]


def _read_lanes(images: list[Image]) -> None:
    """Fill ``pixels``: a pixel of every image in each step, the largest images first."""
    if not images:
        return
    images = sorted(images, key=lambda i: -i.coded.width * i.coded.height)
    codes = [i.coded.groups[0] for i in images]
    sizes = np.array([i.coded.width * i.coded.height for i in images])
    base = np.cumsum(sizes) - sizes
    begin = np.cumsum([0] + [len(i.data) for i in images])
    flat = np.frombuffer(b"".join(i.data for i in images) + bytes(8), np.uint8).astype(np.uint32)
    window = flat[:-3] | flat[1:-2] << 8 | flat[2:-1] << 16 | flat[3:] << 24
    limit = 8 * begin[1:]
    at = 8 * begin[:-1] + np.array([i.at for i in images])
    tables, offsets, masks = [], [], []
    for k in range(5):
        own = [c[k].table for c in codes]
        tables.append(np.concatenate(own).astype(np.int64))
        offsets.append(np.cumsum([0] + [len(t) for t in own])[:-1])
        masks.append(np.array([(1 << c[k].bits) - 1 for c in codes]))
    fixed = not any(m.any() for m in masks[1:4])  # every lane has one red, one blue and one alpha
    rest = [tables[k][offsets[k]] >> 4 for k in (1, 2, 3)]
    constant = (rest[0] << 16 | rest[1] | rest[2] << 24).astype(np.uint32)
    out = np.zeros(int(sizes.sum()), dtype=np.uint32)
    copy, back = np.zeros(len(images), dtype=np.int64), np.zeros(len(images), dtype=np.int64)
    near = np.array([[x, y] for x, y in NEAR])
    widths = np.array([i.coded.width for i in images])
    copying = 0

    def take(k: int, lanes: np.ndarray | slice) -> np.ndarray:
        bit = at[lanes]
        entry = tables[k][offsets[k][lanes] + (window[bit >> 3] >> (bit & 7).astype(np.uint32) & masks[k][lanes])]
        at[lanes] = bit + (entry & 15)
        return entry >> 4

    def value(prefix: np.ndarray, lanes: np.ndarray) -> np.ndarray:
        extra = np.maximum(prefix - 2, 0) >> 1
        bit = at[lanes]
        more = window[bit >> 3].astype(np.int64) >> (bit & 7) & ((1 << extra) - 1)
        at[lanes] = bit + extra
        return np.where(prefix < 4, prefix, ((2 + (prefix & 1)) << extra) + more) + 1

    ends = np.searchsorted(-sizes, -np.arange(int(sizes[0])), side="left")  # lanes with more than i pixels
    for i, n in enumerate(ends.tolist()):
        reading: np.ndarray | slice = slice(0, n)
        if copying:
            waiting = copy[:n] > 0
            lanes = np.flatnonzero(waiting)
            copying = len(lanes)
            if copying:
                out[base[lanes] + i] = out[base[lanes] + i - back[lanes]]
                copy[lanes] -= 1
                reading = np.flatnonzero(~waiting)
                if not len(reading):
                    continue
        symbol = take(0, reading)
        if symbol.max() > 255:
            lanes = np.arange(n) if isinstance(reading, slice) else reading
            far = symbol > 255
            moving, prefix = lanes[far], symbol[far] - 256
            copy[moving] = value(prefix, moving)
            code = value(take(4, moving), moving)
            short = near[np.minimum(code, len(NEAR)) - 1]
            back[moving] = np.where(code > len(NEAR), code - len(NEAR), np.maximum(1, short[:, 0] + short[:, 1] * widths[moving]))
            if (back[moving] > i).any() or (i + copy[moving] > sizes[moving]).any():
                raise WebpError("a back-reference leaves the image")
            out[base[moving] + i] = out[base[moving] + i - back[moving]]
            copy[moving] -= 1
            copying = 1
            reading, symbol = lanes[~far], symbol[~far]
        if fixed:
            out[base[reading] + i] = constant[reading] | symbol.astype(np.uint32) << 8
        else:
            red, blue, alpha = (take(k, reading) for k in (1, 2, 3))
            out[base[reading] + i] = red << 16 | symbol << 8 | blue | alpha << 24
    if (at > limit).any():
        raise WebpError("the stream ends too early")
    for image, a, size in zip(images, base.tolist(), sizes.tolist(), strict=True):
        image.pixels = out[a : a + size]


# Writing


class Fields:
    """Bit fields to be written one behind the other."""

    def __init__(self):
        self.values: list[int] = []
        self.bits: list[int] = []

    def put(self, value: int, bits: int) -> None:
        self.values.append(int(value))
        self.bits.append(int(bits))


def pack_fields(values: np.ndarray, bits: np.ndarray, first: np.ndarray) -> list[bytes]:
    """The bytes of several streams; stream k begins with field ``first[k]``."""
    ends = np.cumsum(bits)
    totals = np.diff(np.append(ends[first] - bits[first], ends[-1]))
    words = (totals + 31) // 32
    start = np.cumsum(words) - words
    fields = np.diff(np.append(first, len(bits)))
    at = ends - bits + np.repeat(32 * start - (ends[first] - bits[first]), fields)
    word, shifted = at >> 5, values.astype(np.uint64) << (at & 31).astype(np.uint64)
    n = int(words.sum())
    low = np.bincount(word, weights=(shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=n)
    high = np.bincount(word + 1, weights=(shifted >> np.uint64(32)).astype(np.float64), minlength=n)[:n]
    whole = (low + high).astype(np.uint32).astype("<u4").tobytes()  # bits never overlap, so sums are exact
    return [whole[4 * a : 4 * a + (b + 7) // 8] for a, b in zip(start.tolist(), totals.tolist(), strict=True)]


def file_of(data: bytes) -> bytes:
    body = b"WEBPVP8L" + len(data).to_bytes(4, "little") + data + bytes(len(data) % 2)
    return b"RIFF" + len(body).to_bytes(4, "little") + body


def put_simple_code(fields: Fields, symbols: list[int]) -> None:
    """One or two symbols below 256, ascending."""
    wide = symbols[0] > 1
    fields.put(1, 1)
    fields.put(len(symbols) - 1, 1)
    fields.put(wide, 1)
    fields.put(symbols[0], 8 if wide else 1)
    if len(symbols) == 2:
        fields.put(symbols[1], 8)


def put_prefix_code(fields: Fields, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths).tolist()
    if len(used) <= 2 and all(s < 256 for s in used):
        put_simple_code(fields, used or [0])
        return
    fields.put(0, 1)
    values = lengths[: used[-1] + 1].tolist()
    runs: list[tuple[int, int, int]] = []  # symbol, extra value, extra bits
    i = 0
    while i < len(values):
        j = i
        while j < len(values) and values[j] == values[i]:
            j += 1
        n = j - i
        if values[i]:
            runs.append((values[i], 0, 0))
            n -= 1
        while n >= 3:
            most, least, bits, symbol = (6, 3, 2, 16) if values[i] else (138, 11, 7, 18) if n > 10 else (10, 3, 3, 17)
            step = min(n, most)
            runs.append((symbol, step - least, bits))
            n -= step
        runs += [(values[i], 0, 0)] * n
        i = j
    own = code_lengths(np.bincount([r[0] for r in runs], minlength=19), 7)
    codes = canonical_codes(own)
    last = max(i for i, s in enumerate(CODE_LENGTH_ORDER) if own[s] or i < 4)
    fields.put(last + 1 - 4, 4)
    for s in CODE_LENGTH_ORDER[: last + 1]:
        fields.put(own[s], 3)
    alone = np.count_nonzero(own) == 1
    if len(values) < len(lengths) and len(runs) >= 2:
        fields.put(1, 1)
        bits = max(2, (len(runs) - 2).bit_length() + 1 & ~1)
        fields.put((bits - 2) // 2, 3)
        fields.put(len(runs) - 2, bits)
    else:
        fields.put(0, 1)
        if len(values) < len(lengths):
            raise ValueError("a code of one symbol must be a simple one")
    for symbol, extra, bits in runs:
        fields.put(codes[symbol], 0 if alone else own[symbol])
        if bits:
            fields.put(extra, bits)


def prefix_of(value: int) -> tuple[int, int, int]:
    """Prefix symbol, extra bits and their value of a length or distance code."""
    value -= 1
    if value < 4:
        return value, 0, 0
    extra = value.bit_length() - 2
    return 2 * extra + (value >> extra), extra, value & ((1 << extra) - 1)


def put_pixels(
    fields: Fields, pixels: np.ndarray, cache_bits: int = 0, copies: dict[int, tuple[int, int]] | None = None, spatial: bool = False
) -> None:
    """An entropy-coded image; ``copies[position] = (length, distance code, distance)``."""
    flat, tokens, at = pixels.ravel().tolist(), [], 0
    cache = [0] * (1 << cache_bits) if cache_bits else None

    def remember(some: list[int]) -> None:
        if cache is not None:
            for pixel in some:
                cache[(CACHE_FACTOR * pixel & 0xFFFFFFFF) >> (32 - cache_bits)] = pixel

    while at < len(flat):
        pixel = flat[at]
        slot = (CACHE_FACTOR * pixel & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
        if copies and at in copies:
            length, code = copies[at]
            tokens.append((prefix_of(length), prefix_of(code)))
        elif cache is not None and cache[slot] == pixel:
            length = 1
            tokens.append(280 + slot)
        else:
            length = 1
            tokens.append((pixel >> 8 & 255, pixel >> 16 & 255, pixel & 255, pixel >> 24))
        remember(flat[at : at + length])
        at += length
    counts = [np.zeros(n, dtype=np.int64) for n in (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)]
    for t in tokens:
        if isinstance(t, int):
            counts[0][t] += 1
        elif len(t) == 2:
            counts[0][256 + t[0][0]] += 1
            counts[4][t[1][0]] += 1
        else:
            for k, s in enumerate(t):
                counts[k][s] += 1
    fields.put(cache_bits > 0, 1)
    if cache_bits:
        fields.put(cache_bits, 4)
    if spatial:
        fields.put(0, 1)
    if np.count_nonzero(counts[0]) <= 2 and counts[0][256:].any():
        counts[0][:3] += 1  # so that the code is not a simple one, which has no symbols from 256 on
    lengths = [code_lengths(c) for c in counts]
    codes = [canonical_codes(x) for x in lengths]
    lone = [np.count_nonzero(x) < 2 for x in lengths]
    for x in lengths:
        put_prefix_code(fields, x)

    def put(k: int, symbol: int) -> None:
        if not lone[k]:
            fields.put(codes[k][symbol], lengths[k][symbol])

    for t in tokens:
        if isinstance(t, int):
            put(0, t)
        elif len(t) == 2:
            put(0, 256 + t[0][0])
            fields.put(t[0][2], t[0][1])
            put(4, t[1][0])
            fields.put(t[1][2], t[1][1])
        else:
            for k, s in enumerate(t):
                put(k, s)


def put_head(fields: Fields, width: int, height: int) -> None:
    for value, bits in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        fields.put(value, bits)


def put_palette(fields: Fields, colors: np.ndarray) -> None:
    fields.put(1, 1)
    fields.put(PALETTE, 2)
    fields.put(len(colors) - 1, 8)
    parts = _channels(colors)
    put_pixels(fields, _joined(np.diff(parts, axis=0, prepend=np.zeros((1, 4), np.int64)))[None, :])


def do_palette(pixels: np.ndarray, colors: np.ndarray) -> np.ndarray:
    """Indexes into sorted ``colors``, packed into the green channel."""
    index, fold = np.searchsorted(colors, pixels), bundle_bits(len(colors))
    if fold:
        wide = ceil_div(pixels.shape[1], 1 << fold) << fold
        index = np.pad(index, ((0, 0), (0, wide - pixels.shape[1]))).reshape(len(index), -1, 1 << fold)
        index = (index << (8 >> fold) * np.arange(1 << fold)).sum(-1)
    return (index.astype(np.uint32) << 8) | np.uint32(OPAQUE_BLACK)


def do_predictor(pixels: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    parts = _channels(pixels)
    above = np.concatenate((parts[:1], parts[:-1]))
    left = np.concatenate((parts[:, :1], parts[:, :-1]), axis=1)
    top_left = np.concatenate((above[:, :1], above[:, :-1]), axis=1)
    top_right = np.concatenate((above[:, 1:], parts[:, :1]), axis=1)
    by = _spread(modes, bits, pixels.shape)
    guess = np.zeros_like(parts)
    for mode in np.unique(modes).tolist():
        guess = np.where((by == mode)[..., None], predict(mode, left, above, top_left, top_right), guess)
    guess[:, 0] = above[:, 0]
    guess[0] = left[0]
    guess[0, 0] = (0, 0, 0, 255)
    return _joined(parts - guess)


def do_cross_color(pixels: np.ndarray, factors: np.ndarray, bits: int) -> np.ndarray:
    parts, by = _channels(pixels), _channels(_spread(factors, bits, pixels.shape))
    red = parts[..., 2].copy()
    parts[..., 2] -= _delta(by[..., 0], parts[..., 1])
    parts[..., 0] -= _delta(by[..., 1], parts[..., 1]) + _delta(by[..., 2], red)
    return _joined(parts)


def encode(
    pixels: np.ndarray,
    predictor: tuple[np.ndarray, int] | None = None,
    cross_color: tuple[np.ndarray, int] | None = None,
    subtract_green: bool = False,
    palette: bool = False,
    cache_bits: int = 0,
    copies: dict[int, tuple[int, int]] | None = None,
) -> bytes:
    """One file, with the transforms asked for; block images come with their size in bits."""
    pixels, fields = pixels.astype(np.uint32), Fields()
    height, width = pixels.shape
    put_head(fields, width, height)
    if palette:
        colors = np.unique(pixels)
        if len(colors) > 256:
            raise ValueError("a palette holds at most 256 colours")
        put_palette(fields, colors)
        pixels = do_palette(pixels, colors)
    for kind, how in ((PREDICTOR, predictor), (CROSS_COLOR, cross_color)):
        if how is not None:
            image, bits = how
            fields.put(1, 1)
            fields.put(kind, 2)
            fields.put(bits - 2, 3)
            put_pixels(fields, (image.astype(np.uint32) << 8) if kind == PREDICTOR else image)
            pixels = (do_predictor if kind == PREDICTOR else do_cross_color)(pixels, image, bits)
    if subtract_green:
        fields.put(1, 1)
        fields.put(SUBTRACT_GREEN, 2)
        parts = _channels(pixels)
        parts[..., 0] -= parts[..., 1]
        parts[..., 2] -= parts[..., 1]
        pixels = _joined(parts)
    fields.put(0, 1)
    put_pixels(fields, pixels, cache_bits, copies, spatial=True)
    return file_of(pack_fields(np.array(fields.values), np.array(fields.bits), np.array([0]))[0])
