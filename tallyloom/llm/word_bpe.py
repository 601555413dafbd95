"""BPE encoding and decoding with word ends, by contiguous rank arrays.

A short word is held as the ids of its parts and, beside them, the rank of each adjacent pair.
The array is scanned for the least rank, that boundary is deleted, and the ranks of the
two neighbouring pairs are refreshed, until no pair has a rank. Words repeat, so a task keeps
the ids of the words it has met, up to a bound.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Words whose ids a worker keeps; longer words than MAX_KEPT characters aren't kept.
CACHE_WORDS, MAX_KEPT = 400_000, 40
#: From so many parts on, a word is merged by a queue instead of by repeated scans, whose time grows with the square.
LONG_WORD = 64
#: Rows of text that are handled together.
ROWS = 64

#: Unicode's White_Space property.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE = re.compile(f"[{_WHITE}]+")
_CONTROL_SPACE = re.compile("[\x1c-\x1f]")
_NONE = 1 << 62


def _byte_chars() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def _ranges(chars: str) -> str:
    """Ascending characters as the inside of a character class."""
    out, start, before = [], None, None
    for c in [*map(ord, chars), None]:
        if start is not None and c != before + 1:
            out.append(f"\\U{start:08x}-\\U{before:08x}")
            start = None
        start, before = c if start is None else start, c
    return "".join(out)


@cache
def _class(name: str) -> str:
    """The characters of a class as the library's own version of Unicode has them."""
    from tokenizers import Regex, pre_tokenizers

    split = pre_tokenizers.Split(Regex(rf"[^\p{{{name}}}]+"), "removed")
    every = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    return _ranges("".join(piece for i in range(0, len(every), 4096) for piece, _ in split.pre_tokenize_str("".join(every[i : i + 4096]))))


def _compiled(pattern: str) -> re.Pattern:
    """A pattern with \\s, \\p{L} and \\p{N} for the re module."""
    return re.compile(pattern.replace(r"\s", _WHITE).replace(r"\p{L}", _class("L")).replace(r"\p{N}", _class("N")))


@cache
def _unassigned() -> np.ndarray:
    """Whether Python's version of Unicode lacks each code point: what becomes of those characters is left to the library."""
    return np.array([unicodedata.category(chr(c)) == "Cn" for c in range(sys.maxunicode + 1)])


class WordBpe:
    """A tokenizer file of kind BPE with an end-of-word suffix and byte-level words."""

    _loaded: dict[str, WordBpe] = {}

    @classmethod
    def load(cls, path: str) -> WordBpe:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        chars = _byte_chars()
        self.first = [vocab[c] for c in chars]
        self.last = [vocab[c + suffix] for c in chars]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        #: left id * 2**20 + right id -> rank * 2**20 + merged id
        self.ranks = {vocab[a] << 20 | vocab[b]: rank << 20 | vocab[a + b] for rank, (a, b) in enumerate(merges)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in special.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.at_special = re.compile("(" + "|".join(re.escape(t) for t in sorted(special, key=len, reverse=True)) + ")") if special else None
        from tokenizers import Tokenizer

        self.normalizer = Tokenizer.from_file(path).normalizer
        splits = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.pieces = _compiled(splits[0])
        self.kept: dict[str, tuple[int, ...]] = {}

    def merge(self, ids: list[int]) -> list[int]:
        """Merges adjacent ids, the least rank first and of equal ranks the leftmost."""
        if len(ids) >= LONG_WORD:
            return self._merge_long(ids)
        get = self.ranks.get
        ranks = [get(a << 20 | b, _NONE) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            i = ranks.index(least)
            ids[i] = least & 0xFFFFF
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 20 | ids[i], _NONE)
            if i < len(ranks):
                ranks[i] = get(ids[i] << 20 | ids[i + 1], _NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        import heapq

        n, get = len(ids), self.ranks.get
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(queue)
        alive = [True] * n
        while queue:
            r, i, a, b = heapq.heappop(queue)
            j = right[i]
            if not alive[i] or ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i] = r & 0xFFFFF
            alive[j] = False
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
            for x in (left[i], i):
                if x >= 0 and right[x] < n and (q := get(ids[x] << 20 | ids[right[x]])) is not None:
                    heapq.heappush(queue, (q, x, ids[x], ids[right[x]]))
        return [x for x, a in zip(ids, alive, strict=True) if a]

    def _word(self, word: str) -> tuple[int, ...]:
        """The ids of a lower-case run of other characters than white space."""
        out: list[int] = []
        for piece in self.pieces.findall(word):
            data = piece.encode()
            ids = [self.first[b] for b in data]
            ids[-1] = self.last[data[-1]]
            out += self.merge(ids)
        return tuple(out)

    def _plain(self, text: str) -> list[int]:
        if not text.isascii():
            if _unassigned()[np.frombuffer(text.encode("utf-32-le"), "<u4")].any():
                words = _SPACE.split(self.normalizer.normalize_str(text))
            else:
                text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
                words = _SPACE.split(text.lower())
        else:
            low = text.lower()
            words = _SPACE.split(low) if _CONTROL_SPACE.search(low) else low.split()
        kept = self.kept
        found = list(map(kept.get, words))
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    w = words[i]
                    ids = kept.get(w)
                    if ids is None:
                        ids = self._word(w)
                        if len(w) <= MAX_KEPT:
                            if len(kept) >= CACHE_WORDS:
                                kept.clear()
                            kept[w] = ids
                    found[i] = ids
        return list(chain.from_iterable(found))

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; null is empty. Strings of added tokens become their ids."""
        if not text:
            return []
        if self.at_special is None or "<|" not in text and not any(t in text for t in self.special if "<|" not in t):
            return self._plain(text)
        out: list[int] = []
        for part in self.at_special.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += self._plain(part)
        return out

    def decode(self, ids: list[int]) -> str:
        """The tokens of ids joined by one space, special ones included, as for a file without a decoder."""
        return " ".join(map(self.names.__getitem__, ids))


def _map(df: DataFrame, column: str, fields: list[T.StructField], make) -> DataFrame:
    """df with columns that make(values) gives for some rows' values of a column at a time."""
    names = {f.name for f in fields}
    kept = df.drop(*[c for c in df.columns if c in names and c != column])
    schema = T.StructType([*kept.schema.fields, *fields])
    at = kept.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                yield pa.RecordBatch.from_arrays([*part.columns, *make(part.column(at).to_pylist())], names=schema.names)

    return kept.mapInArrow(run, schema)


def with_ids(df: DataFrame, path: str, text_col: str = "text", to: str = "ids") -> DataFrame:
    """df with the ids of its texts (array of int; null and empty texts have none). A column named as `to` is replaced."""
    return _map(df, text_col, [T.StructField(to, T.ArrayType(T.IntegerType()))], lambda texts: [pa.array([WordBpe.load(path).encode(t) for t in texts], pa.list_(pa.int32()))])


def with_decoded(df: DataFrame, path: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """df with the text that its ids decode to; null ids give null."""
    return _map(df, ids_col, [T.StructField(to, T.StringType())], lambda rows: [pa.array([None if r is None else WordBpe.load(path).decode(r) for r in rows], pa.string())])


def digests(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """df without its text, with n_tokens, ids_sha256 (of the decimal ids joined by a space) and decoded_sha256 of the round trip through encode() and decode(), in one pass."""
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    decimal: list[str] = []

    def make(texts):
        codec = WordBpe.load(path)
        if not decimal:
            decimal.extend(map(str, range(len(codec.names))))
        n, shas, back = [], [], []
        for text in texts:
            ids = codec.encode(text)
            n.append(len(ids))
            shas.append(hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
            back.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
        return [pa.array(n, pa.int64()), pa.array(shas, pa.string()), pa.array(back, pa.string())]

    return _map(df, text_col, fields, make).drop(text_col)
