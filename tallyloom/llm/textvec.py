"""Vectorised word segmentation and hashing on the UTF-8 buffers of Arrow string columns.

Everything works on a whole batch of documents at once: no Python loop per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_R = 0x9E3779B97F4A7C15 | 1  # odd, so it has an inverse modulo 2**64
_R_INV = pow(_R, -1, 1 << 64)
#: Bytes of text handled at a time; bounds a task's memory whatever the batch's size.
CHUNK_BYTES = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


#: A random 64-bit value for each byte value.
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_R))
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        m = max(n, CHUNK_BYTES + 64)
        with np.errstate(over="ignore"):
            have = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(m, base, np.uint64))])
        _powers[base] = have
    return have[:n]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about `limit` bytes; a longer text has its own run. Null is empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offs, offs[at] + limit, "right")) - 1
        end = min(n, max(end, at + 1))
        yield at, end, raw[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def spans(raw: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each maximal run of word bytes; a document's end ends a word. is_word: 256 booleans."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = is_word[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offs[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of raw[start:end] for each span: a polynomial over random byte values, length mixed in."""
    n = len(raw)
    with np.errstate(over="ignore"):
        acc = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[raw] * _power(_R, n), out=acc[1:])
        h = (acc[ends] - acc[starts]) * _power(_R_INV, n + 1)[starts]
        return mix64(h ^ ((ends - starts).astype(np.uint64) * _MIX1))


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    upper = (raw >= 65) & (raw <= 90)
    return raw + (upper.astype(np.uint8) << 5)


def lower_latin(raw: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the Latin-1 letters that UTF-8 writes as C3 80 to C3 9E."""
    out = lower_ascii(raw)
    if len(out) > 1:
        two = np.zeros(len(out), bool)
        two[1:] = (out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)
        out = out + (two.astype(np.uint8) << 5)
    return out


#: Bytes that are not white space as the duplicate operators define it (0x20, 0x09 to 0x0D).
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Letters, digits and all bytes of non-ASCII characters.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def shingles(raw: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every k-word shingle, lower-cased A-Z; a document of 1 to k-1 words has its whole sequence as its one shingle."""
    low = lower_ascii(raw)
    starts, ends, doc = spans(low, offs, NOT_SPACE)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    words = hash_spans(low, starts, ends)
    n = len(words)
    per_doc = np.bincount(doc, minlength=len(offs) - 1)
    with np.errstate(over="ignore"):
        full = np.zeros(max(0, n - k + 1), np.uint64)
        for i in range(k):
            full += words[i : n - k + 1 + i] * _power(_R, k + 1)[i + 1] if n >= k else 0
        same = doc[: n - k + 1] == doc[k - 1 :] if n >= k else np.zeros(0, bool)
        full = mix64(full)
        short = np.flatnonzero((per_doc > 0) & (per_doc < k))
        if not len(short):
            return doc[: n - k + 1][same], full[same]
        first = np.concatenate([[0], np.cumsum(per_doc)[:-1]])
        alone = np.zeros(len(short), np.uint64)
        for i in range(k - 1):
            has = per_doc[short] > i
            alone[has] += words[first[short[has]] + i] * _power(_R, k + 1)[i + 1]
        alone = mix64(alone ^ per_doc[short].astype(np.uint64))
    docs = np.concatenate([doc[: n - k + 1][same], short])
    hashes = np.concatenate([full[same], alone])
    order = np.argsort(docs, kind="stable")
    return docs[order], hashes[order]


def distinct_sets(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (document, hash) pairs, sorted by document and hash. doc must be ascending."""
    order = np.lexsort((hashes, doc))
    d, h = doc[order], hashes[order]
    keep = np.ones(len(d), bool)
    keep[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    return d[keep], h[keep]


class SpanHasher:
    """hash_spans for several sets of spans of the same bytes."""

    def __init__(self, raw: np.ndarray):
        self.n = len(raw)
        self.acc = np.zeros(self.n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_BYTE[raw] * _power(_R, self.n), out=self.acc[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (self.acc[ends] - self.acc[starts]) * _power(_R_INV, self.n + 1)[starts]
            return mix64(h ^ ((ends - starts + (salt << 32)).astype(np.uint64) * _MIX1))
