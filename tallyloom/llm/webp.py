"""Lossless WebP: a decoder of the whole format and an encoder, for 8-bit sample arrays.

Written from RFC 9649. Pixels are ARGB in one 32-bit number. The decoder reads prefix codes (meta codes
too), back-references and the colour cache, and inverts the predictor, cross-colour, subtract-
green and palette transforms. For an image of one code group it finds the tokens of all bit positions at
once and then follows the chain of those that are tokens.
"""

from __future__ import annotations

import struct

import numpy as np

# Fixed values of the format: the order in which lengths of the code-length code are stored ...
LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
# ... and the offsets (x, y) of the 120 short distance codes.
NEAR = [
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
]
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
HASH = 0x1E35A7BD
MAX_SIDE = 1 << 14
#: Tokens of an image from which its bit positions are examined all at once.
BULK = 64


class BitReader:
    def __init__(self, data: bytes):
        self.data = np.frombuffer(data + bytes(16), np.uint8)
        self.bytes = data + bytes(16)
        self.at = 0
        self.end = 8 * len(data)

    def read(self, n: int) -> int:
        at = self.at
        self.at = at + n
        if self.at > self.end:
            raise ValueError("the stream ends early")
        return int.from_bytes(self.bytes[at >> 3 : (at + n + 7 >> 3)], "little") >> (at & 7) & (1 << n) - 1

    def peek(self, n: int) -> int:
        """The next n bits, or as many as there are."""
        return int.from_bytes(self.bytes[self.at >> 3 : self.at + n + 7 >> 3], "little") >> (self.at & 7)

    def skip(self, n: int) -> None:
        self.at += n
        if self.at > self.end:
            raise ValueError("the stream ends early")


class Code:
    """A prefix code as tables over the next `bits` bits: symbol and length."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if len(used) == 1:
            self.bits, self.symbol, self.length = 0, used[:1].astype(np.int32), np.zeros(1, np.uint8)
            return
        n = lengths[used]
        by = np.argsort(n, kind="stable")
        n = n[by]
        self.bits = int(n[-1])
        # canonical codes fill the table from its start, read with their first bit as the highest
        place = np.repeat(by, np.left_shift(1, self.bits - n))
        if len(place) != 1 << self.bits:
            raise ValueError("not a complete prefix code")
        place = place[_reversed(self.bits)]
        self.symbol = used.astype(np.int32)[place]
        self.length = lengths[used].astype(np.uint8)[place]

    def read(self, r: BitReader) -> int:
        if not self.bits:
            return int(self.symbol[0])
        at = r.at
        w = int.from_bytes(r.bytes[at >> 3 : (at >> 3) + 3], "little") >> (at & 7) & (1 << self.bits) - 1
        r.at = at + int(self.length[w])
        if r.at > r.end:
            raise ValueError("the stream ends early")
        return int(self.symbol[w])


_reversals: dict[int, np.ndarray] = {}


def _reversed(bits: int) -> np.ndarray:
    """Each number of `bits` bits with its bits in the other order."""
    if bits not in _reversals:
        x = np.arange(1 << bits)
        y = np.zeros_like(x)
        for i in range(bits):
            y |= (x >> i & 1) << (bits - 1 - i)
        _reversals[bits] = y
    return _reversals[bits]


def _read_code(r: BitReader, alphabet: int) -> Code:
    lengths = np.zeros(alphabet, np.int64)
    if r.read(1):
        two, wide = r.read(1), r.read(1)
        lengths[r.read(8 if wide else 1)] = 1
        if two:
            lengths[r.read(8)] = 1
        return Code(lengths)
    of = [0] * 19
    for i in range(4 + r.read(4)):
        of[LENGTH_ORDER[i]] = r.read(3)
    table, bits = _small_table(of)
    left = 2 + r.read(2 + 2 * r.read(3)) if r.read(1) else alphabet
    found, last = [], 8
    # the lengths take 14 bits each at most; they are read from one number that holds the next 64 of them
    mask, x, at, held = (1 << bits) - 1, 0, 0, 0
    while len(found) < alphabet and left:
        if held - at < 14:
            r.at += at
            x, at, held = r.peek(14 * 64), 0, 14 * 64
        left -= 1
        s, n = table[x >> at & mask]
        at += n
        if s < 16:
            found.append(s)
            last = s or last
        elif s == 16:
            found += [last] * (3 + (x >> at & 3))
            at += 2
        elif s == 17:
            found += [0] * (3 + (x >> at & 7))
            at += 3
        else:
            found += [0] * (11 + (x >> at & 127))
            at += 7
    r.skip(at)
    if len(found) > alphabet:
        raise ValueError("too many code lengths")
    lengths[: len(found)] = found
    if not lengths.any():
        lengths[0] = 1
    return Code(lengths)


def _small_table(lengths: list[int]) -> tuple[list[tuple[int, int]], int]:
    """The code-length code as a list of (symbol, length) over the next bits, and how many bits those are."""
    used = sorted((n, s) for s, n in enumerate(lengths) if n)
    if not used:
        raise ValueError("not a complete prefix code")
    if len(used) == 1:
        return [(used[0][1], 0)], 0
    bits = used[-1][0]
    in_order = [(s, n) for n, s in used for _ in range(1 << bits - n)]
    if len(in_order) != 1 << bits:
        raise ValueError("not a complete prefix code")
    return [in_order[i] for i in _reversed(bits).tolist()], bits


def _number(r: BitReader, prefix: int) -> int:
    """A length or distance code's number."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + r.read(extra) + 1


def _distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def _read_pixels(r: BitReader, width: int, height: int, meta: bool) -> np.ndarray:
    """The entropy-coded pixels of an image; meta: its codes may differ from block to block."""
    cache_bits = r.read(4) if r.read(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache too large")
    groups, block, block_bits = 1, None, 0
    if meta and r.read(1):
        block_bits = r.read(3) + 2
        across = -(-width >> block_bits)
        block = (_read_pixels(r, across, -(-height >> block_bits), False) >> 8 & 0xFFFF).reshape(-1, across)
        groups = int(block.max()) + 1
    size = 280 + (1 << cache_bits if cache_bits else 0)
    codes = [[_read_code(r, n) for n in (size, 256, 256, 256, 40)] for _ in range(groups)]
    for five in codes:
        if np.array_equal(five[1].length, five[2].length):
            five[2].length = five[1].length
    n = width * height
    if groups == 1 and n >= BULK:
        return _read_bulk(r, codes[0], width, n, cache_bits)
    out = np.zeros(n, np.uint32)
    cache = np.zeros(1 << cache_bits, np.uint32) if cache_bits else None
    i = seen = 0
    while i < n:
        if block is not None:
            y, x = divmod(i, width)
            green, red, blue, alpha, far = codes[block[y >> block_bits, x >> block_bits]]
        else:
            green, red, blue, alpha, far = codes[0]
        s = green.read(r)
        if s < 256:
            rr, b, a = red.read(r), blue.read(r), alpha.read(r)
            out[i] = a << 24 | rr << 16 | s << 8 | b
            i += 1
        elif s < 280:
            length = _number(r, s - 256)
            back = _distance(_number(r, far.read(r)), width)
            if back > i or i + length > n:
                raise ValueError("back-reference outside the image")
            _copy(out, i, back, length)
            i += length
        else:
            while seen < i:
                cache[int(out[seen]) * HASH % (1 << 32) >> (32 - cache_bits)] = out[seen]
                seen += 1
            out[i] = cache[s - 280]
            i += 1
    return out


def _copy(out: np.ndarray, i: int, back: int, length: int) -> None:
    done = min(back, length)
    out[i : i + done] = out[i - back : i - back + done]
    while done < length:  # the copy runs into its own output
        step = min(done, length - done)
        out[i + done : i + done + step] = out[i : i + step]
        done += step


def _read_bulk(r: BitReader, codes: list[Code], width: int, n: int, cache_bits: int) -> np.ndarray:
    """The pixels of an image with one code group."""
    start = r.at >> 3
    raw = r.data[start:].astype(np.uint32)
    word = raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16
    window = (word[:, None] >> np.arange(8, dtype=np.uint32)).reshape(-1)  # 17 bits or more from each bit position
    size = len(window)
    green, red, blue, alpha, far = codes
    key = window & np.uint32((1 << green.bits) - 1)
    symbol = green.symbol[key]
    # where the symbols from each bit position end; past the end of the stream all stay at `size`
    end = np.arange(size + 1, dtype=np.int32)
    if green.bits:
        end[:-1] += green.length[key]
        np.minimum(end, size, out=end)
    places, stop, lengths, same = [], end, None, None
    for c in (red, blue, alpha):
        places.append(stop)
        if c.bits:
            if same is not c.length:
                lengths = np.zeros(size + 1, np.int32)
                lengths[:-1] = c.length[window & np.uint32((1 << c.bits) - 1)]
                same = c.length
            stop = np.minimum(stop + lengths[stop], size)
    is_number, is_cached = symbol >= 256, symbol >= 280
    jump = np.where(is_cached, end[:-1], stop[:-1]) if cache_bits else stop[:-1].copy()
    jump[is_number & ~is_cached] = -1  # back-references are read one by one
    follow = memoryview(np.append(jump, np.int32(-1)))
    tokens, refs = [], []
    add = tokens.append
    p, i = r.at - 8 * start, 0
    while i < n:
        q = follow[p]
        if q >= 0:
            add(p)
            i += 1
            p = q
        elif p >= size:
            raise ValueError("the stream ends early")
        else:
            s = int(symbol[p])
            r.at = int(end[p]) + 8 * start
            run = _number(r, s - 256)
            back = _distance(_number(r, far.read(r)), width)
            if back > i or i + run > n:
                raise ValueError("back-reference outside the image")
            refs.append((i, back, run, len(tokens)))
            i += run
            p = r.at - 8 * start
    r.at = p + 8 * start
    if r.at > r.end:
        raise ValueError("the stream ends early")
    tokens = np.array(tokens, np.int64)
    symbol = symbol[tokens]
    value = symbol.astype(np.uint32) << 8
    for code, place, shift in zip((red, blue, alpha), places, (16, 0, 24), strict=True):
        if code.bits:
            value |= code.symbol[window[np.minimum(place[tokens], size - 1)] & np.uint32((1 << code.bits) - 1)].astype(np.uint32) << np.uint32(shift)
        else:
            value |= np.uint32(int(code.symbol[0]) << shift)
    if cache_bits and (symbol >= 280).any():
        return _with_cache(value, symbol, refs, n, cache_bits)
    if not refs:
        return value
    out = np.zeros(n, np.uint32)
    i = t = 0
    for at_pixel, back, run, before in refs:
        out[i:at_pixel] = value[t:before]
        _copy(out, at_pixel, back, run)
        i, t = at_pixel + run, before
    out[i:] = value[t:]
    return out


def _slots(pixels: np.ndarray, cache_bits: int) -> np.ndarray:
    """The cache's slot of each pixel."""
    return (pixels.astype(np.uint64) * np.uint64(HASH) & np.uint64(0xFFFFFFFF)).astype(np.int64) >> (32 - cache_bits)


def _with_cache(value: np.ndarray, symbol: np.ndarray, refs: list[tuple[int, int, int, int]], n: int, cache_bits: int) -> np.ndarray:
    """The pixels for literals, cached ones (symbols from 280 on) and back-references, each of which enters the cache.

    A copied pixel points back to its source and a cached one to the last pixel of its slot; slots are known
    without values, since a cached pixel's symbol tells it. Pointers are followed in doubling steps.
    """
    source, is_token = np.arange(n), np.ones(n, bool)
    for at, back, run, _ in refs:
        source[at : at + run] -= back
        is_token[at : at + run] = False
    source = _followed(source)
    where = np.flatnonzero(is_token)
    slot, values, cached = np.zeros(n, np.int64), np.zeros(n + 1, np.uint32), np.zeros(n, bool)
    by_cache = symbol >= 280
    slot[where] = np.where(by_cache, symbol - 280, _slots(value, cache_bits))
    values[where], cached[where] = value, by_cache
    slot = slot[source]
    by = np.argsort(slot.astype(np.int16), kind="stable")
    before = np.full(n, n)  # the cache begins with zeros
    same = slot[by[1:]] == slot[by[:-1]]
    before[by[1:][same]] = by[:-1][same]
    source[cached] = before[cached]
    return values[_followed(np.append(source, n))[:n]]


def _followed(pointers: np.ndarray) -> np.ndarray:
    """Where each pointer ends; those that end point to themselves."""
    while True:
        further = pointers[pointers]
        if (further == pointers).all():
            return pointers
        pointers = further


def _bytes(pixels: np.ndarray) -> np.ndarray:
    """Pixels as rows of blue, green, red, alpha."""
    return np.ascontiguousarray(pixels, "<u4").view(np.uint8).reshape(*pixels.shape, 4)


def _predict(mode: int, left: list, top: list, top_left: list, top_right: list) -> list:
    avg = lambda a, b: [x + y >> 1 for x, y in zip(a, b, strict=True)]
    clamp = lambda x: 0 if x < 0 else 255 if x > 255 else x
    if mode == 0:
        return [0, 0, 0, 255]
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return top_right
    if mode == 4:
        return top_left
    if mode == 5:
        return avg(avg(left, top_right), top)
    if mode == 6:
        return avg(left, top_left)
    if mode == 7:
        return avg(left, top)
    if mode == 8:
        return avg(top_left, top)
    if mode == 9:
        return avg(top, top_right)
    if mode == 10:
        return avg(avg(left, top_left), avg(top, top_right))
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(top, top_left, strict=True))
        to_top = sum(abs(x - c) for x, c in zip(left, top_left, strict=True))
        return left if to_left < to_top else top
    if mode == 12:
        return [clamp(x + t - c) for x, t, c in zip(left, top, top_left, strict=True)]
    if mode == 13:
        # the halving rounds towards zero
        return [clamp(m + int((m - c) / 2)) for m, c in zip(avg(left, top), top_left, strict=True)]
    raise ValueError("unknown predictor")


def predictions(mode: int, left: np.ndarray, top: np.ndarray, corner: np.ndarray, right: np.ndarray) -> np.ndarray:
    """_predict() of many pixels: 16-bit samples, the channels last. Black's alpha is left to the caller."""
    if mode == 0:
        return np.zeros_like(left)
    if mode < 5:
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return ((left + right >> 1) + top) >> 1
    if mode == 10:
        return ((left + corner >> 1) + (top + right >> 1)) >> 1
    if mode < 10:
        a, b = ((left, corner), (left, top), (corner, top), (top, right))[mode - 6]
        return a + b >> 1
    if mode == 11:
        to_left, to_top = np.abs(top - corner).sum(axis=-1), np.abs(left - corner).sum(axis=-1)
        return np.where((to_left < to_top)[..., None], left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        middle = left + top >> 1
        over = middle - corner
        return np.clip(middle + (over + (over < 0) >> 1), 0, 255)
    raise ValueError("unknown predictor")


def unpredicted(image: np.ndarray, modes: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The pixels of residuals; modes: each pixel's; y: each row's place in its image, so several images may follow each other.

    First rows and columns are running sums, and pixels of mode 0 need no others. Rows with other modes follow the
    rows above them, those of the same place in step; only modes that look to the left go from pixel to pixel.
    """
    out = _bytes(image).copy()
    width = image.shape[1]
    modes = modes.astype(np.int64)
    modes[:, 0] = modes[y == 0] = 0
    first = np.flatnonzero(y == 0)
    out[1 - (y == 0).astype(int) > 0, 1:, 3] += np.uint8(255)
    out[first, 0, 3] += np.uint8(255)
    out[first] = np.cumsum(out[first], axis=1, dtype=np.uint8)
    column = np.cumsum(out[:, 0], axis=0, dtype=np.uint8)
    start = first[np.cumsum(y == 0) - 1]
    out[:, 0] = column - column[start] + out[start, 0]
    if modes.max(initial=0) > 13:
        raise ValueError("unknown predictor")
    wanted = np.flatnonzero(modes.any(axis=1))
    wanted = wanted[np.argsort(y[wanted], kind="stable")]
    if len(wanted):
        out[..., 3] -= (modes > 0).astype(np.uint8) * np.uint8(255)
    for rows in np.split(wanted, np.flatnonzero(np.diff(y[wanted])) + 1) if len(wanted) else ():
        top, mode = out[rows - 1].astype(np.int16), modes[rows]
        corner = np.concatenate([top[:, :1], top[:, :-1]], axis=1)
        right = np.concatenate([top[:, 1:], out[rows, :1].astype(np.int16)], axis=1)
        for m in (2, 3, 4, 8, 9):
            r, x = np.nonzero(mode == m)
            if len(r):
                out[rows[r], x] += predictions(m, top[r, x], top[r, x], corner[r, x], right[r, x]).astype(np.uint8)
        to_left = np.isin(mode, (1, 5, 6, 7, 10, 11, 12, 13))
        for x in np.flatnonzero(to_left.any(axis=0)).tolist():
            here = np.flatnonzero(to_left[:, x])
            of = mode[here, x]
            for m in np.unique(of).tolist():
                r = here[of == m]
                out[rows[r], x] += predictions(m, out[rows[r], x - 1].astype(np.int16), top[r, x], corner[r, x], right[r, x]).astype(np.uint8)
    return out.view("<u4").reshape(-1, width).astype(np.uint32)


def _with_predictor(image: np.ndarray, modes: np.ndarray, bits: int, undo: bool) -> np.ndarray:
    """Adds (undo) or subtracts each pixel's prediction; modes has one pixel per block, the mode in its green."""
    height, width = image.shape
    mode = np.repeat(np.repeat(modes >> 8 & 255, 1 << bits, 0), 1 << bits, 1)[:height, :width].astype(np.int64)
    if undo:
        return unpredicted(image, mode, np.arange(height))
    big = _bytes(image).astype(np.int16)
    top = np.concatenate([big[:1], big[:-1]])
    left = np.concatenate([big[:, :1], big[:, :-1]], axis=1)
    corner = np.concatenate([top[:, :1], top[:, :-1]], axis=1)
    right = np.concatenate([top[:, 1:], big[:, :1]], axis=1)
    mode[0], mode[:, 0] = 1, 2
    guess = np.zeros_like(big)
    guess[..., 3] = 255
    for m in np.unique(mode).tolist():
        if m:
            at = np.nonzero(mode == m)
            guess[at] = predictions(m, left[at], top[at], corner[at], right[at])
    guess[0, 0] = 0, 0, 0, 255
    return (big - guess).astype(np.uint8).view("<u4").reshape(height, width).astype(np.uint32)


def _with_cross_colour(image: np.ndarray, elements: np.ndarray, bits: int, undo: bool) -> np.ndarray:
    height, width = image.shape
    e = _bytes(np.repeat(np.repeat(elements, 1 << bits, 0), 1 << bits, 1)[:height, :width]).view(np.int8).astype(np.int32)
    b = _bytes(image).copy()
    signed = lambda c: c.view(np.int8).astype(np.int32)
    sign = 1 if undo else -1
    green, red = np.ascontiguousarray(b[:, :, 1]), np.ascontiguousarray(b[:, :, 2])
    new_red = ((red + sign * (e[:, :, 0] * signed(green) >> 5)) & 255).astype(np.uint8)
    true_red = new_red if undo else red
    b[:, :, 0] = b[:, :, 0] + sign * ((e[:, :, 1] * signed(green) >> 5) + (e[:, :, 2] * signed(true_red) >> 5)) & 255
    b[:, :, 2] = new_red
    return b.view("<u4").reshape(height, width).astype(np.uint32)


def _with_green(image: np.ndarray, undo: bool) -> np.ndarray:
    b = _bytes(image).copy()
    for c in (0, 2):
        b[:, :, c] = b[:, :, c] + b[:, :, 1] if undo else b[:, :, c] - b[:, :, 1]
    return b.view("<u4").reshape(image.shape).astype(np.uint32)


def _bundle_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def decode(data: bytes) -> np.ndarray:
    """The pixels of a lossless WebP file: height x width x (red, green, blue, alpha)."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    r = BitReader(data[20 : 20 + struct.unpack("<I", data[16:20])[0]])
    if r.read(8) != 0x2F:
        raise ValueError("no VP8L signature")
    width, height = r.read(14) + 1, r.read(14) + 1
    has_alpha = r.read(1)
    if r.read(3):
        raise ValueError("unknown version")
    undo, now, seen = [], width, set()
    while r.read(1):
        kind = r.read(2)
        if kind in seen:
            raise ValueError("a transform is used twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = r.read(3) + 2
            across = -(-now >> bits)
            undo.append((kind, bits, _read_pixels(r, across, -(-height >> bits), False).reshape(-1, across), now))
        elif kind == PALETTE:
            colours = r.read(8) + 1
            table = np.cumsum(_bytes(_read_pixels(r, colours, 1, False)), axis=0, dtype=np.uint8).view("<u4").reshape(-1).astype(np.uint32)
            undo.append((kind, _bundle_bits(colours), table, now))
            now = -(-now >> _bundle_bits(colours))
        else:
            undo.append((kind, 0, None, now))
    image = _read_pixels(r, now, height, True).reshape(height, now)
    for kind, bits, sub, was in reversed(undo):
        if kind == PREDICTOR:
            image = _with_predictor(image, sub, bits, True)
        elif kind == CROSS_COLOUR:
            image = _with_cross_colour(image, sub, bits, True)
        elif kind == SUBTRACT_GREEN:
            image = _with_green(image, True)
        else:
            index = image >> 8 & 255
            if bits:
                each = 8 >> bits
                index = (index[:, :, None] >> np.arange(0, 8, each, dtype=np.uint32) & ((1 << each) - 1)).reshape(height, -1)[:, :was]
            full = np.zeros(256, np.uint32)
            full[: len(sub)] = sub
            image = full[index]
    out = _bytes(image)[:, :, [2, 1, 0, 3]]
    if not has_alpha:
        out[:, :, 3] = 255
    return out


# Encoding


def code_lengths(counts: np.ndarray, limit: int = 15) -> np.ndarray:
    """Lengths of a prefix code for the symbols that occur, none over `limit`; one symbol alone has length 1."""
    out = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) <= 2:
        out[used] = 1
        return out
    weights = counts[used].tolist()
    while True:
        # leaves by weight, and inner nodes, which come in rising weight by themselves: two queues
        n = len(used)
        leaves = sorted(range(n), key=weights.__getitem__)
        weight = [*weights, *([0] * (n - 1))]
        parent = [0] * (2 * n - 1)
        i, j = 0, n
        for k in range(n, 2 * n - 1):
            total = 0
            for _ in (0, 1):
                if i < n and (j >= k or weights[leaves[i]] <= weight[j]):
                    x = leaves[i]
                    i += 1
                else:
                    x = j
                    j += 1
                total += weight[x]
                parent[x] = k
            weight[k] = total
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth[:n]) <= limit:
            out[used] = depth[:n]
            return out
        weights = [(w + 1) // 2 for w in weights]  # flatter weights make a flatter tree


def _codes(lengths: np.ndarray) -> np.ndarray:
    """The canonical codes with their first bit lowest, as they are written."""
    out = np.zeros(len(lengths), np.uint64)
    used = np.flatnonzero(lengths)
    if len(used):
        n = lengths[used]
        by = np.argsort(n, kind="stable")
        n = n[by]
        top = int(n[-1])
        ends = np.cumsum(np.left_shift(1, top - n))
        out[used[by[0]]] = 0
        out[used[by[1:]]] = _reversed(top)[ends[:-1]]
    return out


class BitWriter:
    """Collects (value, bits) pairs, and joins them at the end."""

    def __init__(self):
        self.values: list[np.ndarray] = []
        self.bits: list[np.ndarray] = []
        self._v: list[int] = []
        self._b: list[int] = []

    def write(self, value: int, bits: int) -> None:
        self._v.append(value)
        self._b.append(bits)

    def many(self, pairs: list[tuple[int, int]]) -> None:
        values, bits = zip(*pairs, strict=True)
        self._v += values
        self._b += bits

    def extend(self, values: np.ndarray, bits: np.ndarray) -> None:
        self._flush()
        self.values.append(values.astype(np.uint64))
        self.bits.append(bits.astype(np.int64))

    def _flush(self) -> None:
        if self._v:
            self.values.append(np.array(self._v, np.uint64))
            self.bits.append(np.array(self._b, np.int64))
            self._v, self._b = [], []

    def done(self) -> bytes:
        self._flush()
        v, b = np.concatenate(self.values), np.concatenate(self.bits)
        some = b > 0
        v, b = v[some], b[some]
        ends = np.cumsum(b)
        at = ends - b
        word, shift = at >> 5, (at & 31).astype(np.uint64)
        total = int(ends[-1])
        v = v << shift
        low, high = v & np.uint64(0xFFFFFFFF), v >> np.uint64(32)
        out = np.zeros((total >> 5) + 2, np.uint64)
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[first]] += np.add.reduceat(low, first)
        out[word[first] + 1] += np.add.reduceat(high, first)
        return out.astype("<u4").tobytes()[: (total + 7) // 8]


class Written:
    """A prefix code for some counts: how it is written, and its codes and their lengths as symbols are written with."""

    def __init__(self, counts: np.ndarray):
        w: list[tuple[int, int]] = []
        used = np.flatnonzero(counts)
        self.lengths = self.codes = np.zeros(len(counts), np.int64)
        if len(used) <= 2 and (not len(used) or used[-1] < 256):
            symbols = used.tolist() or [0]
            w += [(1, 1), (len(symbols) - 1, 1), (1, 1), *((s, 8) for s in symbols)]
            if len(symbols) == 2:
                self.lengths[symbols] = 1
                self.codes = _codes(self.lengths)
        else:
            stored = code_lengths(counts)
            if len(used) > 1:
                self.lengths, self.codes = stored, _codes(stored)
            self._describe(w, stored, used)
        self.head = w

    @staticmethod
    def _describe(w: list[tuple[int, int]], lengths: np.ndarray, used: np.ndarray) -> None:
        tokens: list[tuple[int, int, int]] = []
        before = -1
        for at, n in zip(used.tolist(), lengths[used].tolist(), strict=True):
            gap = at - before - 1
            if gap:
                while gap >= 11:
                    tokens.append((18, min(gap, 138) - 11, 7))
                    gap -= min(gap, 138)
                if gap >= 3:
                    tokens.append((17, gap - 3, 3))
                else:
                    tokens += [(0, 0, 0)] * gap
            tokens.append((n, 0, 0))
            before = at
        of = code_lengths(np.bincount([t[0] for t in tokens], minlength=19), 7)
        codes, bits = _codes(of).tolist(), of.tolist()
        stored = max(4, max(i for i, s in enumerate(LENGTH_ORDER) if bits[s]) + 1)
        w += [(0, 1), (stored - 4, 4), *((bits[s], 3) for s in LENGTH_ORDER[:stored])]
        alone = sum(map(bool, bits)) == 1
        n = len(tokens)
        if 2 <= n < len(lengths):
            half = max(1, -(-(n - 2).bit_length() // 2))
            w += [(1, 1), (half - 1, 3), (n - 2, 2 * half)]
        else:  # the number of lengths isn't told, so all are written
            w.append((0, 1))
            rest = len(lengths) - before - 1
            if rest:
                raise ValueError("a code of one or all symbols past 255")
        for s, extra, more in tokens:
            if not alone:
                w.append((codes[s], bits[s]))
            if more:
                w.append((extra, more))

    def write(self, w: BitWriter) -> None:
        w.many(self.head)


def _prefix(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix, extra bits, their number) of lengths or distance codes from 1 on."""
    v = value.astype(np.int64) - 1
    high = np.frexp(v)[1].astype(np.int64) - 1  # the place of the highest bit
    extra = np.maximum(high - 1, 0)
    return np.where(v >= 4, 2 * high + (v >> extra & 1), v), np.where(v >= 4, v & (np.left_shift(1, extra) - 1), 0), np.where(v >= 4, extra, 0)


def _matches(pixels: np.ndarray, least: int = 4) -> list[tuple[int, int, int]]:
    """Greedy back-references (at, distance, length) of at least `least` pixels, each to the last place with the same `least` pixels."""
    n = len(pixels)
    if n < 2 * least:
        return []
    with np.errstate(over="ignore"):
        key = np.zeros(n - least + 1, np.uint64)
        for i in range(least):
            key = key * np.uint64(0x9E3779B97F4A7C15) + pixels[i : n - least + 1 + i]
    by = np.argsort(key, kind="stable")
    same = key[by[1:]] == key[by[:-1]]
    if not same.any():
        return []
    last = np.full(len(key), -1)
    last[by[1:][same]] = by[:-1][same]
    found, end = [], 0
    for at in np.flatnonzero(last >= 0).tolist():
        if at < end:
            continue
        back = at - int(last[at])
        differ = np.flatnonzero(pixels[at : at + 4096] != pixels[at - back : min(n, at + 4096) - back])
        length = int(differ[0]) if len(differ) else min(4096, n - at)
        if length >= least:
            found.append((at, back, length))
            end = at + length
    return found


def _write_pixels(w: BitWriter, pixels: np.ndarray, main: bool, cache_bits: int = 0, references: bool = False) -> None:
    w.write(int(cache_bits > 0), 1)
    if cache_bits:
        w.write(cache_bits, 4)
    if main:
        w.write(0, 1)
    n = len(pixels)
    refs = _matches(pixels) if references else []
    literal = np.ones(n, bool)
    for at, _, length in refs:
        literal[at : at + length] = False
    green = (pixels >> 8 & 255).astype(np.int64)
    cached = np.zeros(n, bool)
    if cache_bits:
        # a pixel is in the cache if the pixel before it of its slot is the same one
        slots = _slots(pixels, cache_bits)
        by = np.argsort(slots, kind="stable")
        again = by[1:][(slots[by[1:]] == slots[by[:-1]]) & (pixels[by[1:]] == pixels[by[:-1]])]
        cached[again] = literal[again]
        green[cached] = 280 + slots[cached]
    plain = literal & ~cached
    at = np.array([m[0] for m in refs], np.int64)
    length, length_extra, length_bits = _prefix(np.array([m[2] for m in refs], np.int64))
    far, far_extra, far_bits = _prefix(np.array([m[1] for m in refs], np.int64) + 120)
    green[at] = 256 + length
    first = literal.copy()
    first[at] = True
    size = 280 + (1 << cache_bits if cache_bits else 0)
    red, blue, alpha = (pixels >> s & 255 for s in (16, 0, 24))
    counts = [np.bincount(x.astype(np.int64), minlength=m) for x, m in ((green[first], size), (red[plain], 256), (blue[plain], 256), (alpha[plain], 256), (far, 40))]
    together = Written(counts[1] + counts[2])  # one code does for red and blue, at some bits more
    codes = [Written(counts[0]), together, together, Written(counts[3]), Written(counts[4])]
    for code in codes:
        code.write(w)
    values, bits = np.zeros((n, 4), np.uint64), np.zeros((n, 4), np.int64)
    for i, (x, where) in enumerate(((green, np.flatnonzero(first)), (red, np.flatnonzero(plain)), (blue, np.flatnonzero(plain)), (alpha, np.flatnonzero(plain)))):
        if codes[i].lengths.any():
            symbols = x[where]
            values[where, i], bits[where, i] = codes[i].codes[symbols], codes[i].lengths[symbols]
    if len(at):
        values[at, 1], bits[at, 1] = length_extra, length_bits
        values[at, 2], bits[at, 2] = codes[4].codes[far], codes[4].lengths[far]
        values[at, 3], bits[at, 3] = far_extra, far_bits
    w.extend(values.reshape(-1), bits.reshape(-1))


def _few_colours(pixels: np.ndarray) -> bool:
    ordered = np.sort(pixels, axis=None)
    return int((ordered[1:] != ordered[:-1]).sum()) < min(256, pixels.size // 2)


def encode(image: np.ndarray, predictor: np.ndarray | None = None, cross_colour: np.ndarray | None = None, block_bits: int = 3, subtract_green: bool = False, palette: bool = False, cache_bits: int = 0, references: bool = True) -> bytes:
    """A lossless WebP file of height x width x 3 or 4 samples.

    predictor: the mode of each block; cross_colour: each block's element as a pixel number; palette:
    used if the image has 256 colours at most, and at least twice as many pixels, so that it pays.
    """
    height, width, channels = image.shape
    if not 0 < height <= MAX_SIDE or not 0 < width <= MAX_SIDE:
        raise ValueError("a side must have 1 to 16384 pixels")
    c = image.astype(np.uint32)
    alpha = c[:, :, 3] if channels == 4 else np.uint32(255)
    pixels = alpha << 24 | c[:, :, 0] << 16 | c[:, :, 1] << 8 | c[:, :, 2]
    w = BitWriter()
    w.write(0x2F, 8)
    w.write(width - 1, 14)
    w.write(height - 1, 14)
    w.write(int(channels == 4), 1)
    w.write(0, 3)
    if palette and _few_colours(pixels):
        colours, index = np.unique(pixels, return_inverse=True)
        if len(colours) <= min(256, pixels.size // 2):
            w.write(1 | PALETTE << 1, 3)
            w.write(len(colours) - 1, 8)
            steps = np.diff(_bytes(colours), axis=0, prepend=np.zeros((1, 4), np.uint8)).astype(np.uint8)
            _write_pixels(w, np.ascontiguousarray(steps).view("<u4").reshape(-1).astype(np.uint32), False)
            bits = _bundle_bits(len(colours))
            index = index.reshape(height, width).astype(np.uint32)
            if bits:
                per, each = 1 << bits, 8 >> bits
                index = np.pad(index, ((0, 0), (0, -width % per))).reshape(height, -1, per)
                index = (index << np.arange(0, 8, each, dtype=np.uint32)).sum(axis=2).astype(np.uint32)
            pixels = index << 8 | np.uint32(0xFF000000)
    if subtract_green:
        w.write(1 | SUBTRACT_GREEN << 1, 3)
        pixels = _with_green(pixels, False)
    for kind, sub in ((PREDICTOR, predictor), (CROSS_COLOUR, cross_colour)):
        if sub is not None:
            w.write(1 | kind << 1, 3)
            w.write(block_bits - 2, 3)
            sub = sub.astype(np.uint32)
            sub = (sub << 8 | np.uint32(0xFF000000)) if kind == PREDICTOR else sub
            _write_pixels(w, sub.reshape(-1), False)
            pixels = _with_predictor(pixels, sub, block_bits, False) if kind == PREDICTOR else _with_cross_colour(pixels, sub, block_bits, False)
    w.write(0, 1)
    _write_pixels(w, pixels.reshape(-1), True, cache_bits, references)
    stream = w.done()
    size = len(stream)
    stream += b"\0" * (size & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(stream)) + b"WEBPVP8L" + struct.pack("<I", size) + stream
