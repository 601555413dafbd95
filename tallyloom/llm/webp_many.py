"""Many lossless WebP files in step with each other: each numpy operation works on all images of a batch.

The encoder writes images of one width and three channels. A block of 8 x 8 pixels takes the predictor, and after it
the cross-colour element, under which its residuals are cheapest in the bits that the image's own bytes have; green is
subtracted where that is cheaper for the whole image. An image's file depends on nothing but the image.
The decoder reads such files, and leaves others to webp.decode().
"""

from __future__ import annotations

import struct

import numpy as np

from .webp import CROSS_COLOUR, HASH, LENGTH_ORDER, MAX_SIDE, PALETTE, PREDICTOR, SUBTRACT_GREEN, _bundle_bits, _bytes, _distance, _few_colours, _prefix, _reversed, _slots, _with_cross_colour, _with_green, decode, predictions, unpredicted

#: Longest code of pixels that is written: three of them and a shift of 31 fit into 64 bits.
LIMIT = 11
BLOCK_BITS = 3
#: Quarter bits that a block must save by a mode or an element other than 0.
GAIN = 64
#: Images are read in step while so many are left, others by themselves.
TOGETHER = 64
_BLACK = np.uint32(0xFF000000)


class _Odd(Exception):
    """A file that this encoder doesn't write."""


# Prefix codes


def code_lengths_many(counts: np.ndarray, limit: int) -> np.ndarray:
    """webp.code_lengths() of each row of counts: prefix codes of at most `limit` bits."""
    out = np.zeros(counts.shape, np.int64)
    used = (counts > 0).sum(axis=1)
    few = used <= 2
    out[few] = counts[few] > 0
    rows = np.flatnonzero(~few)
    while len(rows):
        rows = rows[np.argsort(-used[rows], kind="stable")]
        u = used[rows]
        n, none = int(u[0]), np.int64(1) << 60
        key = np.sort(np.where(counts[rows] > 0, counts[rows].astype(np.int64) << 12 | np.arange(counts.shape[1]), none), axis=1)[:, :n]
        leaf = np.concatenate([np.where(key < none, key >> 12, none), np.full((len(rows), 1), none)], axis=1)
        inner = np.full((len(rows), n + 1), none)
        # leaves, then inner nodes, which come in rising weight by themselves: two queues a row
        parent = np.zeros((len(rows), 2 * n), np.int64)
        row = np.arange(len(rows))
        i, j = row * (n + 1), row * (n + 1)
        of_i, of_j = row * (2 * n) - i, row * (2 * n) - j + n  # from places in the queues to places in `parent`
        leaves, inners, parents = leaf.reshape(-1), inner.reshape(-1), parent.reshape(-1)
        rows_left = np.searchsorted(-u, -(np.arange(n - 1) + 1)).tolist()  # rows with more than t + 1 leaves stand first
        for t, a in enumerate(rows_left):
            x, y, total = i[:a], j[:a], 0
            for _ in (0, 1):
                of_leaf, of_inner = leaves.take(x), inners.take(y)
                take = of_leaf <= of_inner
                total = total + np.minimum(of_leaf, of_inner)
                parents[np.where(take, x + of_i[:a], y + of_j[:a])] = t
                x += take
                y += ~take
            inner[:a, t] = total
        depth = np.zeros((len(rows), n), np.int64)
        for t in range(n - 3, -1, -1):
            a = int(np.searchsorted(-u, -(t + 2)))  # t is below the root, u - 2
            depth[:a, t] = depth[row[:a], parent[:a, n + t]] + 1
        at, place = np.nonzero(key < none)
        deep = depth[at, parent[at, place]] + 1
        out[rows[at], key[at, place] & 4095] = deep
        most = np.zeros(len(rows), np.int64)
        np.maximum.at(most, at, deep)
        rows = rows[most > limit]
        if len(rows):
            counts = counts.copy()
            counts[rows] = (counts[rows] + 1) // 2  # flatter weights make a flatter tree
    return out


def _canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, length, symbol) of the symbols that occur, in the order of their codes."""
    row, symbol = np.nonzero(lengths)
    key = np.sort(row.astype(np.int64) << 20 | lengths[row, symbol].astype(np.int64) << 12 | symbol)
    return key >> 20, key >> 12 & 255, key & 4095


def codes_many(lengths: np.ndarray) -> np.ndarray:
    """The canonical codes of each row, with their first bit lowest."""
    row, n, symbol = _canonical(lengths)
    out = np.zeros(lengths.shape, np.int64)
    if len(row):
        size = np.left_shift(1, 15 - n)
        before = np.cumsum(size) - size
        first = np.searchsorted(row, np.arange(len(lengths)))
        before -= before[np.minimum(first, len(row) - 1)][row]
        out[row, symbol] = _reversed(15)[before]
    return out


def tables(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all rows' tables over the next bits, as symbol << 4 | length; where each row's begins; its bits)."""
    row, n, symbol = _canonical(lengths)
    bits = lengths.max(axis=1).astype(np.int64)
    alone = np.bincount(row, minlength=len(lengths)) == 1
    bits[alone] = 0
    n = np.where(alone[row], 0, n)
    size = np.left_shift(1, bits)
    start = np.cumsum(size) - size
    reps = np.left_shift(1, bits[row] - n)
    if (np.bincount(row, reps, len(lengths)) != size).any():
        raise ValueError("not a complete prefix code")
    in_order = np.repeat((symbol << 4 | n).astype(np.int32), reps)
    out = np.empty_like(in_order)
    for b in np.unique(bits).tolist():
        at = start[bits == b][:, None]
        out[at + np.arange(1 << b)] = in_order[at + _reversed(b)]
    return out, start, bits


# Encoding


class _Sections:
    """Bits of all images: sections that follow each other in every image, each with its entries in the order of images."""

    def __init__(self, images: int):
        self.images, self.parts = images, []

    def put(self, values: np.ndarray, bits: np.ndarray, image: np.ndarray) -> None:
        self.parts.append((values.astype(np.uint64), bits.astype(np.int64), image))

    def table(self, values: np.ndarray, bits: np.ndarray) -> None:
        """One row for each image."""
        self.put(values.reshape(-1), bits.reshape(-1), np.repeat(np.arange(self.images), values.shape[1]))

    def done(self) -> list[bytes]:
        of = [np.bincount(image, bits, self.images).astype(np.int64) for _, bits, image in self.parts]
        size = sum(of) + 7 >> 3
        first = np.cumsum(size) - size
        start = 8 * first
        out = np.zeros((int(size.sum()) >> 2) + 3, np.uint64)
        for (v, b, image), total in zip(self.parts, of, strict=True):
            at = np.cumsum(b) - b + (start - (np.cumsum(total) - total))[image]
            some = b > 0
            v, at = v[some], at[some]
            start = start + total
            if not len(v):
                continue
            word = at >> 5
            v = v << (at & 31).astype(np.uint64)
            begins = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            out[word[begins]] += np.add.reduceat(v & np.uint64(0xFFFFFFFF), begins)
            out[word[begins] + 1] += np.add.reduceat(v >> np.uint64(32), begins)
        # words past 32 bits can't carry: no bit is written twice
        raw = out.astype("<u4").tobytes()
        return [raw[a : a + n] for a, n in zip(first.tolist(), size.tolist(), strict=True)]


def _put_codes(w: _Sections, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Writes a prefix code of each image's counts; the codes and lengths that symbols are written with."""
    k, alphabet = counts.shape
    row = np.arange(k)
    used = counts > 0
    n_used = used.sum(axis=1)
    last = np.where(n_used > 0, alphabet - 1 - np.argmax(used[:, ::-1], axis=1), 0)
    simple = (n_used <= 2) & (last < 256)
    lengths = code_lengths_many(counts, LIMIT)
    first = np.argmax(used, axis=1)
    two = n_used == 2
    s, b = np.stack([row * 0 + 1, two, row * 0 + 1, first, last], 1), np.stack([row * 0 + 1, row * 0 + 1, row * 0 + 1, row * 0 + 8, 8 * two], 1)
    w.table(s, b * simple[:, None])
    whole = np.where(simple[:, None], 0, lengths)
    # tokens: the lengths of the symbols that occur, each after the run of zeros before it
    at, symbol = np.nonzero(whole)
    before = np.concatenate([[-1], symbol[:-1]])
    before[np.concatenate([[True], at[1:] != at[:-1]])[: len(at)]] = -1
    gap = symbol - before[: len(at)] - 1
    long, rest = gap // 138, gap % 138
    n_rest = np.where(rest >= 3, 1, rest)
    each = long + n_rest + 1
    owner = np.repeat(np.arange(len(at)), each)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
    is_long, is_own = place < long[owner], place == each[owner] - 1
    rest = rest[owner]
    token = np.where(is_own, whole[at, symbol][owner], np.where(is_long | (rest >= 11), 18, np.where(rest >= 3, 17, 0)))
    extra = np.where(is_own, 0, np.where(is_long, 127, np.where(rest >= 11, rest - 11, np.where(rest >= 3, rest - 3, 0))))
    more = np.where(token == 18, 7, np.where(token == 17, 3, 0))
    of = at[owner]
    seen = np.bincount(of * 19 + token, minlength=19 * k).reshape(k, 19)
    small = code_lengths_many(seen, 7)
    code = codes_many(small)
    in_order = small[:, LENGTH_ORDER]
    stored = np.maximum(4, 19 - np.argmax(in_order[:, ::-1] > 0, axis=1))
    w.table(np.stack([row * 0, stored - 4], 1), np.stack([row * 0 + 1, row * 0 + 4], 1) * ~simple[:, None])
    w.table(in_order, 3 * ((np.arange(19) < stored[:, None]) & ~simple[:, None]))
    n = seen.sum(axis=1)
    told = (n >= 2) & (n < alphabet)
    if (~simple & ~told & (last < alphabet - 1)).any():
        raise ValueError("a code of one or all symbols past 255")
    width = 2 * np.maximum(1, -(-np.frexp(np.maximum(n - 2, 0))[1] // 2))
    w.table(np.stack([told, width // 2 - 1, n - 2], 1) * ~simple[:, None] * np.stack([told, told, told], 1), np.stack([row * 0 + 1, 3 * told, width * told], 1) * ~simple[:, None])
    size = np.where((seen > 0).sum(axis=1) == 1, 0, small.T).T[of, token]
    w.put(np.where(size > 0, code[of, token], 0) | extra << size, size + more, of)
    return codes_many(lengths), np.where(n_used[:, None] > 1, lengths, 0)


def _matches_many(pixels: np.ndarray, image: np.ndarray, ends: np.ndarray, least: int = 4) -> list[tuple[int, int, int]]:
    """Greedy back-references (at, distance, length) inside images, each to the last place with the same `least` pixels."""
    n = len(pixels)
    if n < 2 * least:
        return []
    key = image[: n - least + 1].astype(np.uint64) + np.uint64(1)
    for i in range(least):
        key = (key ^ key >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) + pixels[i : n - least + 1 + i]
    end = ends[image]
    where = np.flatnonzero(np.arange(n - least + 1) + least <= end[: n - least + 1])
    key = key[where]
    by = np.argsort(key, kind="stable")
    same = key[by[1:]] == key[by[:-1]]
    to, of = where[by[1:][same]], where[by[:-1][same]]
    rise = np.argsort(to)
    found, done = [], 0
    for at, source in zip(to[rise].tolist(), of[rise].tolist(), strict=True):
        if at < done:
            continue
        stop = min(int(end[at]), at + 4096)
        differ = pixels[at:stop] != pixels[source : source + stop - at]
        length = int(differ.argmax()) if differ.any() else stop - at
        if length >= least:
            found.append((at, at - source, length))
            done = at + length
    return found


def _put_pixels(w: _Sections, pixels: np.ndarray, image: np.ndarray, ends: np.ndarray, main: bool, cache_bits: int) -> None:
    k, n = w.images, len(pixels)
    ones = np.ones((k, 1), np.int64)
    w.table(np.concatenate([ones * (cache_bits > 0), ones * cache_bits, ones * 0], 1), np.concatenate([ones, 4 * ones * (cache_bits > 0), ones * main], 1))
    refs = np.array(_matches_many(pixels, image, ends) if main else [], np.int64).reshape(-1, 3)
    at = refs[:, 0]
    literal = np.zeros(n + 1, np.int64)
    np.add.at(literal, at, 1)
    np.add.at(literal, at + refs[:, 2], -1)
    literal = np.cumsum(literal[:n]) == 0
    green = (pixels >> 8 & 255).astype(np.int64)
    cached = np.zeros(n, bool)
    if cache_bits:
        slots = _slots(pixels, cache_bits)
        by = np.sort((image << cache_bits | slots) << 32 | np.arange(n))
        where = by & 0xFFFFFFFF
        again = where[1:][(by[1:] >> 32 == by[:-1] >> 32) & (pixels[where[1:]] == pixels[where[:-1]])]
        cached[again] = literal[again]
        green[cached] = 280 + slots[cached]
    plain = np.flatnonzero(literal & ~cached)
    length, length_extra, length_bits = _prefix(refs[:, 2])
    far, far_extra, far_bits = _prefix(refs[:, 1] + 120)
    green[at] = 256 + length
    first = literal.copy()
    first[at] = True
    first = np.flatnonzero(first)
    size = 280 + (1 << cache_bits if cache_bits else 0)
    count = lambda x, where, m: np.bincount(image[where] * m + x, minlength=k * m).reshape(k, m)
    red, blue, alpha = ((pixels[plain] >> s & 255).astype(np.int64) for s in (16, 0, 24))
    values, bits = np.zeros((n, 2), np.int64), np.zeros((n, 2), np.int64)

    def add(slot, where, code, symbols):
        key = image[where] * code[0].shape[1] + symbols
        c, b = code[0].take(key), code[1].take(key)
        values[where, slot] |= np.where(b > 0, c, 0) << bits[where, slot]
        bits[where, slot] += b

    add(0, first, _put_codes(w, count(green[first], first, size)), green[first])
    add(0, plain, _put_codes(w, count(red, plain, 256)), red)
    add(0, plain, _put_codes(w, count(blue, plain, 256)), blue)
    add(1, plain, _put_codes(w, count(alpha, plain, 256)), alpha)
    values[at, 0] |= length_extra << bits[at, 0]
    bits[at, 0] += length_bits
    add(1, at, _put_codes(w, count(far, at, 40)), far)
    values[at, 1] |= far_extra << bits[at, 1]
    bits[at, 1] += far_bits
    w.put(values.reshape(-1), bits.reshape(-1), np.repeat(image, 2))


def _block_sums(cost: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums over blocks of bytes under 100: a row for each row of pixels; starts: the first row of each row of blocks."""
    words = cost.reshape(len(cost), -1).view(np.uint64)
    pairs = np.uint64(0x00FF00FF00FF00FF)
    four = (words & pairs) + (words >> np.uint64(8) & pairs)  # four sums side by side in a word
    each = four.shape[1] * 8 // (cost.shape[1])
    four = four.reshape(len(cost), -1, each)
    total = four[:, :, 0]
    for i in range(1, each):
        total = total + four[:, :, i]
    return (np.add.reduceat(total, starts, axis=0) * np.uint64(0x0001000100010001) >> np.uint64(48)).astype(np.int32)


def _chosen(costs: list[np.ndarray]) -> np.ndarray:
    """The cheapest choice of each block; another than the first one only if it saves something."""
    costs = [costs[0] - GAIN, *costs[1:]]
    return np.argmin(np.stack(costs), axis=0)


def encode_many(images: list[np.ndarray], cache_bits: int = 0) -> list[bytes]:
    """A lossless WebP file for each image of height x width x 3 samples, all of one width, a multiple of 8."""
    out: list[bytes | None] = [None] * len(images)
    heights = np.array([len(x) for x in images])
    width = images[0].shape[1] if images else 0
    if heights.max(initial=1) > MAX_SIDE or heights.min(initial=1) < 1:
        raise ValueError("a side must have 1 to 16384 pixels")
    some, few = [], []
    for i, x in enumerate(images):
        c = x.astype(np.uint32)
        pixels = _BLACK | c[:, :, 0] << 16 | c[:, :, 1] << 8 | c[:, :, 2]
        if _few_colours(pixels):
            colours, index = np.unique(pixels, return_inverse=True)
            if len(colours) <= min(256, pixels.size // 2):
                few.append((i, colours, index.reshape(len(x), width)))
                continue
        some.append(i)
    for files, at in ((_with_palettes(few, width, cache_bits), [x[0] for x in few]), (_with_predictors([images[i] for i in some], width, cache_bits), some)):
        for i, file in zip(at, files, strict=True):
            out[i] = file
    return out


def _file(stream: bytes) -> bytes:
    size = len(stream)
    stream += b"\0" * (size & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(stream)) + b"WEBPVP8L" + struct.pack("<I", size) + stream


def _with_palettes(few: list[tuple[int, np.ndarray, np.ndarray]], width: int, cache_bits: int) -> list[bytes]:
    """Files of images given as colours and their numbers."""
    if not few:
        return []
    steps, packed = [], []
    for _, colours, index in few:
        steps.append(np.ascontiguousarray(np.diff(_bytes(colours), axis=0, prepend=np.zeros((1, 4), np.uint8)).astype(np.uint8)).view("<u4").reshape(-1))
        bits = _bundle_bits(len(colours))
        if bits:
            each = 8 >> bits
            index = np.pad(index, ((0, 0), (0, -width % (1 << bits)))).reshape(len(index), -1, 1 << bits)
            index = (index << np.arange(0, 8, each)).sum(axis=2)
        packed.append((_BLACK | index.astype(np.uint32) << np.uint32(8)).reshape(-1))
    k = len(few)
    one = np.ones(k, np.int64)
    w = _Sections(k)
    w.table(np.stack([0x2F * one, (width - 1) * one, np.array([len(x) - 1 for _, _, x in few]), 0 * one, (1 | PALETTE << 1) * one, np.array([len(x) - 1 for x in steps])], 1), np.stack([8 * one, 14 * one, 14 * one, 4 * one, 3 * one, 8 * one], 1))
    for parts, main in ((steps, False), (packed, True)):
        n = np.array([len(x) for x in parts])
        if main:
            w.table(np.zeros((k, 1), np.int64), np.ones((k, 1), np.int64))
        _put_pixels(w, np.concatenate(parts).astype(np.uint32), np.repeat(np.arange(k), n), np.cumsum(n), main, cache_bits if main else 0)
    return [_file(x) for x in w.done()]


def _with_predictors(images: list[np.ndarray], width: int, cache_bits: int) -> list[bytes]:
    """Files with predictors and cross-colour elements, and green subtracted where that pays."""
    if not images:
        return []
    heights, s = np.array([len(x) for x in images]), np.concatenate(images)
    k, of_row = len(images), np.repeat(np.arange(len(images)), heights)
    first_row = np.cumsum(heights) - heights
    # bits of each byte value in its image, in quarters; values that it lacks cost two bits more than one of a single sample
    counts = np.bincount((of_row[:, None] * 256 + s.reshape(len(s), -1)).reshape(-1), minlength=256 * k).reshape(k, 256)
    price = np.round(4 * (np.log2(3.0 * width * heights)[:, None] - np.log2(np.maximum(counts, 0.25)))).astype(np.uint8).reshape(-1)
    base = (of_row * 256).astype(np.int32)[:, None, None]
    key, found = np.empty(s.shape, np.int32), np.empty(s.shape, np.uint8)

    def cost(x):
        """The price of each sample, in an array that the next call writes over."""
        if x.ndim == 2:
            return price.take(base[:, :, 0] + x)
        return price.take(np.add(base, x, out=key), out=found, mode="clip")

    less = s.copy()
    less[:, :, 0] -= s[:, :, 1]
    less[:, :, 2] -= s[:, :, 1]

    def entropy(x):
        """Bits of each image's red and blue samples."""
        seen = np.bincount((of_row[:, None, None] * 512 + x[:, :, ::2] + np.array([0, 256])).reshape(-1), minlength=512 * k).reshape(k, 512)
        return -(seen * np.log2(np.maximum(seen, 1))).sum(axis=1)  # less what both cases have in common

    minus_green = entropy(less) < entropy(s)
    s = np.where(minus_green[of_row][:, None, None], less, s)

    y = np.arange(len(s)) - first_row[of_row]
    starts = np.flatnonzero(y % (1 << BLOCK_BITS) == 0)
    block_row = np.cumsum(y % (1 << BLOCK_BITS) == 0) - 1
    big = s.astype(np.int16)
    top = np.concatenate([big[:1], big[:-1]])
    top[first_row] = 0
    left = np.concatenate([big[:, :1], big[:, :-1]], axis=1)
    corner = np.concatenate([top[:, :1], top[:, :-1]], axis=1)
    right = np.concatenate([top[:, 1:], big[:, :1]], axis=1)
    residuals = lambda mode: (big - predictions(mode, left, top, corner, right)).astype(np.uint8)
    modes = _chosen([_block_sums(cost(residuals(m)), starts) for m in range(14)])
    mode = np.repeat(modes[block_row], 1 << BLOCK_BITS, axis=1)
    rest = s.copy()
    for m in np.unique(modes).tolist():
        if m:
            at = np.nonzero(mode == m)
            rest[at] = (big[at] - predictions(m, left[at], top[at], corner[at], right[at])).astype(np.uint8)
    rest[:, 0] = (big[:, 0] - top[:, 0]).astype(np.uint8)
    rest[first_row] = (big[first_row] - left[first_row]).astype(np.uint8)
    rest[first_row, 0] = s[first_row, 0]

    red, green, blue = (rest[:, :, c].view(np.int8).astype(np.int32) for c in range(3))
    price_of = lambda x: _block_sums(cost(x & 255), starts)
    to_red = (0, 16, 32)
    to_blue = ((0, 0), (16, 0), (32, 0), (0, 16), (0, 32))
    chosen_red = np.array(to_red)[_chosen([price_of(red - (e * green >> 5)) for e in to_red])]
    chosen_blue = np.array(to_blue)[_chosen([price_of(blue - (g * green >> 5) - (r * red >> 5)) for g, r in to_blue])]
    elements = (_BLACK | (chosen_blue[:, :, 1] << 16 | chosen_blue[:, :, 0] << 8 | chosen_red).astype(np.uint32)).astype(np.uint32)
    each = np.repeat(elements[block_row], 1 << BLOCK_BITS, axis=1)
    c = rest.astype(np.uint32)
    pixels = c[:, :, 0] << 16 | c[:, :, 1] << 8 | c[:, :, 2]
    if chosen_red.any() or chosen_blue.any():
        pixels = _with_cross_colour(pixels, each, 0, False)

    w = _Sections(k)
    one = np.ones(k, np.int64)
    w.table(np.stack([0x2F * one, (width - 1) * one, heights - 1, 0 * one, 1 | SUBTRACT_GREEN << 1 | 0 * one], 1), np.stack([8 * one, 14 * one, 14 * one, 4 * one, 3 * minus_green], 1))
    of_block = of_row[starts]
    across = width >> BLOCK_BITS
    sub_image = np.repeat(of_block, across)
    sub_ends = np.cumsum(np.bincount(of_block, minlength=k)) * across
    for kind, sub in ((PREDICTOR, _BLACK | modes.astype(np.uint32) << np.uint32(8)), (CROSS_COLOUR, elements)):
        w.table(np.stack([(1 | kind << 1) * one, (BLOCK_BITS - 2) * one], 1), np.stack([3 * one, 3 * one], 1))
        _put_pixels(w, sub.reshape(-1).astype(np.uint32), sub_image, sub_ends, False, 0)
    w.table(np.zeros((k, 1), np.int64), np.ones((k, 1), np.int64))
    _put_pixels(w, pixels.reshape(-1), np.repeat(of_row, width), np.cumsum(heights) * width, True, cache_bits)
    return [_file(x) for x in w.done()]


# Decoding


class _Readers:
    """A place in each of several streams."""

    def __init__(self, streams: list[bytes]):
        raw = b"".join(streams) + bytes(16)
        self.words = np.ascontiguousarray(np.ndarray((len(raw) - 8,), "<u8", buffer=raw, strides=(1,)))
        size = np.array([len(x) for x in streams], np.int64)
        self.end = 8 * np.cumsum(size)
        self.at = self.end - 8 * size

    def window(self, at: np.ndarray) -> np.ndarray:
        """57 bits or more from each place."""
        return (self.words.take(at >> 3, mode="clip") >> (at & 7).astype(np.uint64)).astype(np.int64)

    def read(self, who: np.ndarray, n) -> np.ndarray:
        x = self.window(self.at[who]) & ((1 << n) - 1 if isinstance(n, int) else np.left_shift(1, n) - 1)
        self.at[who] += n
        return x

    def codes(self, alphabet: int) -> np.ndarray:
        """The code lengths of one prefix code in every stream."""
        who = np.arange(len(self.at))
        lengths = np.zeros((len(who), alphabet), np.uint8)
        simple = self.read(who, 1) == 1
        a = who[simple]
        two, wide = self.read(a, 1) == 1, self.read(a, 1)
        lengths[a, self.read(a, np.where(wide > 0, 8, 1))] = 1
        lengths[a[two], self.read(a[two], 8)] = 1
        m = who[~simple]
        if not len(m):
            return lengths
        stored, of = 4 + self.read(m, 4), np.zeros((len(m), 19), np.uint8)
        for i in range(int(stored.max())):
            some = stored > i
            of[some, LENGTH_ORDER[i]] = self.read(m[some], 3)
        if not of.any(axis=1).all():
            raise ValueError("not a complete prefix code")
        table, start, bits = tables(of)
        mask = np.left_shift(1, bits) - 1
        left = np.full(len(m), alphabet)
        told = np.flatnonzero(self.read(m, 1))
        width = 2 + 2 * self.read(m[told], 3)
        left[told] = 2 + self.read(m[told], width)
        place, last, at, go = np.zeros(len(m), np.int64), np.full(len(m), 8, np.int64), self.at[m], np.arange(len(m))
        while len(go):
            x = self.window(at[go])
            e = table[start[go] + (x & mask[go])].astype(np.int64)
            symbol, n = e >> 4, e & 15
            x >>= n
            own = symbol < 16
            lengths[m[go[own]], place[go[own]]] = symbol[own]
            last[go] = np.where(own & (symbol > 0), symbol, last[go])
            more = np.where(own, 0, np.where(symbol == 16, 2, np.where(symbol == 17, 3, 7)))
            run = np.where(own, 1, (x & np.left_shift(1, more) - 1) + np.where(symbol == 18, 11, 3))
            for i in np.flatnonzero(symbol == 16).tolist():
                g = go[i]
                lengths[m[g], place[g] : place[g] + run[i]] = last[g]
            place[go] += run
            at[go] += n + more
            left[go] -= 1
            go = go[(place[go] < alphabet) & (left[go] > 0)]
        if (place > alphabet).any():
            raise ValueError("too many code lengths")
        self.at[m] = at
        empty = ~lengths.any(axis=1)
        lengths[empty, 0] = 1
        return lengths

    def pixels(self, count: np.ndarray, width: int, main: bool) -> np.ndarray:
        """The entropy-coded pixels of an image in each stream, one after the other."""
        who = np.arange(len(self.at))
        has = self.read(who, 1)
        cache_bits = np.zeros(len(who), np.int64)
        cache_bits[has > 0] = self.read(who[has > 0], 4)
        if (cache_bits != cache_bits[0]).any() or cache_bits[0] > 11 or (main and self.read(who, 1).any()):
            raise _Odd
        cache_bits = int(cache_bits[0])
        codes = [tables(self.codes(n)) for n in (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)]
        if (sum(c[2] for c in codes[:4]) > 57).any():
            raise _Odd
        base = np.cumsum(count) - count
        out = np.zeros(int(count.sum()), np.uint32)
        cache = np.zeros(len(who) << cache_bits, np.uint32) if cache_bits else None
        fours = [(t, s.copy(), np.left_shift(1, b) - 1) for t, s, b in codes[:4]]
        flat = [bool((b == 0).all()) for _, _, b in codes[:4]]
        at, i, words = self.at.copy(), np.zeros(len(who), np.int64), self.words
        go, shift = who, np.uint32(32 - cache_bits)
        state = [at, i + base, base + count, *(x for _, s, m in fours for x in (s, m))]
        while len(go):
            keep = state[1] < state[2]
            if not keep.all():
                self.at[go[~keep]] = state[0][~keep]
                go, state = go[keep], [x[keep] for x in state]
                if not len(go):
                    break
            at, to, stop = state[:3]
            slot0 = go << cache_bits
            parts = [(t[0], state[3 + 2 * j], state[4 + 2 * j], flat[j], t[0][state[3 + 2 * j]] >> 4 if flat[j] else None) for j, t in enumerate(fours)]
            for _ in range(int((stop - to).min())):
                x = (words.take(at >> 3, mode="clip") >> (at & 7).astype(np.uint64)).view(np.int64)
                found, moved = [], 0
                for table, start, mask, single, symbol in parts:
                    if single:
                        found.append(symbol)
                        continue
                    e = table.take(start + (x & mask))
                    n = e & 15
                    x = x >> n
                    moved = moved + n
                    found.append(e >> 4)
                    if len(found) == 1:
                        green_bits = moved
                green, red, blue, alpha = found
                pixel = (alpha << 24 | red << 16 | green << 8 | blue).astype(np.uint32)
                numbers = ()
                if not flat[0] and (green >= 256).any():
                    by_cache = np.flatnonzero(green >= 280)
                    if len(by_cache):
                        pixel[by_cache] = cache[slot0[by_cache] + green[by_cache] - 280]
                        moved[by_cache] = green_bits[by_cache]
                    numbers = np.flatnonzero((green >= 256) & (green < 280)).tolist()
                    for j in numbers:
                        # a back-reference goes on one pixel before its end; its last pixel is the one of this step
                        here = int(at[j]) + int(green_bits[j])
                        run, here = self._number(here, int(green[j]) - 256)
                        table, start, bits = codes[4]
                        e = int(table[start[go[j]] + (self._peek(here) & (1 << int(bits[go[j]])) - 1)])
                        code, here = self._number(here + (e & 15), e >> 4)
                        back, a = _distance(code, width), int(to[j])
                        if back > a - base[go[j]] or a + run > stop[j]:
                            raise ValueError("back-reference outside the image")
                        for d in range(0, run, back):
                            out[a + d : a + min(run, d + back)] = out[a - back : a - back + min(back, run - d)]
                        if cache_bits:
                            copied = out[a : a + run]
                            slot = (copied * np.uint32(HASH)) >> shift
                            cache[slot0[j] + slot] = copied  # of several for one slot the last one stays
                        pixel[j] = out[a + run - 1]
                        to[j] += run - 1
                        moved[j] = here - int(at[j])
                out[to] = pixel
                if cache_bits:
                    cache[slot0 + ((pixel * np.uint32(HASH)) >> shift)] = pixel
                to += 1
                at += moved
                if numbers:
                    break
            if (at > self.end[go]).any():
                raise ValueError("the stream ends early")
        if (self.at > self.end).any():
            raise ValueError("the stream ends early")
        return out

    def _peek(self, at: int) -> int:
        return int(self.words[min(at >> 3, len(self.words) - 1)]) >> (at & 7)

    def _number(self, at: int, prefix: int) -> tuple[int, int]:
        """A length or distance code's number, and where it ends."""
        if prefix < 4:
            return prefix + 1, at
        extra = (prefix - 2) >> 1
        return ((2 + (prefix & 1)) << extra) + (self._peek(at) & (1 << extra) - 1) + 1, at + extra


def _decode_together(streams: list[bytes]) -> list[np.ndarray]:
    r = _Readers(streams)
    who = np.arange(len(streams))
    if (r.read(who, 8) != 0x2F).any():
        raise ValueError("no VP8L signature")
    widths, heights = r.read(who, 14) + 1, r.read(who, 14) + 1
    width = int(widths[0])
    if (widths != width).any() or width % (1 << BLOCK_BITS) or r.read(who, 4).any():
        raise _Odd
    kind = r.read(who, 3)
    green = kind == (1 | SUBTRACT_GREEN << 1)
    kind[green] = r.read(who[green], 3)
    subs = []
    across, down = width >> BLOCK_BITS, -(-heights >> BLOCK_BITS)
    for expected in (PREDICTOR, CROSS_COLOUR):
        if expected == CROSS_COLOUR:
            kind = r.read(who, 3)
        if (kind != (1 | expected << 1)).any() or (r.read(who, 3) != BLOCK_BITS - 2).any():
            raise _Odd
        subs.append(r.pixels(down * across, across, False).reshape(-1, across))
    if r.read(who, 1).any():
        raise _Odd
    image = r.pixels(heights * width, width, True).reshape(-1, width)
    of_row = np.repeat(who, heights)
    first_row = np.cumsum(heights) - heights
    y = np.arange(len(of_row)) - first_row[of_row]
    block_row = (np.cumsum(down) - down)[of_row] + (y >> BLOCK_BITS)
    modes, elements = (np.repeat(x[block_row], 1 << BLOCK_BITS, axis=1) for x in subs)
    if (elements & np.uint32(0xFFFFFF)).any():
        image = _with_cross_colour(image, elements, 0, True)
    image = unpredicted(image, modes >> 8 & 255, y)
    if green.any():
        rows = green[of_row]
        image[rows] = _with_green(image[rows], True)
    out = np.ascontiguousarray(_bytes(image)[:, :, 2::-1])
    return [out[a : a + h] for a, h in zip(first_row.tolist(), heights.tolist(), strict=True)]


def decode_many(files: list[bytes]) -> list[np.ndarray]:
    """height x width x (red, green, blue) of each file."""
    out: list[np.ndarray | None] = [None] * len(files)
    streams = {}
    for i, data in enumerate(files):
        if data[:4] == b"RIFF" and data[8:16] == b"WEBPVP8L" and len(data) > 25 and data[25] & 7 in (1 | PREDICTOR << 1, 1 | SUBTRACT_GREEN << 1):
            streams[i] = data[20 : 20 + struct.unpack("<I", data[16:20])[0]]
    # a few much longer files than the others are read by themselves
    sizes = sorted((len(x) for x in streams.values()), reverse=True)
    if len(sizes) >= TOGETHER:
        some = [i for i, x in streams.items() if len(x) <= sizes[TOGETHER - 1]]
        try:
            for i, x in zip(some, _decode_together([streams[i] for i in some]), strict=True):
                out[i] = x
        except _Odd:
            pass
    return [decode(data)[:, :, :3] if x is None else x for x, data in zip(out, files, strict=True)]
