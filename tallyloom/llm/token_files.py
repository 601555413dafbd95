"""Token ids in binary segments of patched frame-of-reference blocks.

A segment holds the ids of some whole documents, in the order of their ids in the table. Layout,
little-endian: magic, documents, tokens, blocks; per document its id, whether it is null,
and its number of tokens; per block of 128 ids its start in the payload, its minimum, its width
and its number of exceptions; then the payload. A block subtracts its minimum, packs each id's
low bits at the width that PERCENTILE of its ids need, and lists the other ids' positions
and high bits as exceptions. A document is read by its position without decoding the rest.

Segments are rows of a Parquet table in the shared folder, which Spark's committer makes
whole even if executors are lost.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .textvec import chunks

MAGIC, BLOCK, PERCENTILE = b"PFOR0001", 128, 90
#: Bytes of text in a segment, unless one document has more.
SEGMENT_BYTES = 1 << 20
#: Pieces of text whose ids a worker keeps, and the longest that is kept.
CACHE_PIECES, MAX_KEPT = 600_000, 48

_HEAD = np.dtype([("magic", "S8"), ("docs", "<u4"), ("blocks", "<u4"), ("tokens", "<u8")])
_DOC = np.dtype([("id", "<i8"), ("null", "u1"), ("tokens", "<u8")])
_INDEX = np.dtype([("start", "<u8"), ("least", "<u4"), ("width", "u1"), ("exceptions", "u1")])


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(block index, payload bytes) of unsigned 32-bit ids; the last block is filled up with its last id."""
    blocks = -(-len(ids) // BLOCK)
    index = np.zeros(blocks, _INDEX)
    if not blocks:
        return index, np.zeros(0, np.uint8)
    full = np.empty(blocks * BLOCK, np.uint32)
    full[: len(ids)] = ids
    full[len(ids) :] = ids[-1]
    full = full.reshape(blocks, BLOCK)
    least = full.min(axis=1)
    over = full - least[:, None]
    nth = np.partition(over, BLOCK * PERCENTILE // 100, axis=1)[:, BLOCK * PERCENTILE // 100]
    width = np.ceil(np.log2(nth.astype(np.float64) + 1)).astype(np.int64)
    high = (over.astype(np.uint64) >> width.astype(np.uint64)[:, None]).astype(np.uint32)
    block, place = np.nonzero(high)
    exceptions = np.bincount(block, minlength=blocks)
    size = width * (BLOCK // 8) + exceptions * 5
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    index["start"], index["least"], index["width"], index["exceptions"] = start, least, width, exceptions
    payload = np.zeros(int(size.sum()), np.uint8)
    for w in np.unique(width).tolist():
        if w:
            at = np.flatnonzero(width == w)
            bits = (over[at][:, :, None] >> np.arange(w, dtype=np.uint32)) & 1
            payload[start[at][:, None] + np.arange(w * BLOCK // 8)] = np.packbits(bits.reshape(len(at), -1).astype(np.uint8), axis=1, bitorder="little")
    nth_of = np.arange(len(block)) - np.concatenate([[0], np.cumsum(exceptions)[:-1]])[block]
    lists = start + width * (BLOCK // 8)
    payload[lists[block] + nth_of] = place
    payload[(lists[block] + exceptions[block] + 4 * nth_of)[:, None] + np.arange(4)] = high[block, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    return index, payload


def unpack(index: np.ndarray, payload: np.ndarray, first: int = 0, end: int | None = None) -> np.ndarray:
    """The ids of blocks first to end, found through the index of block starts."""
    index = index[first:end]
    out = np.zeros((len(index), BLOCK), np.uint32)
    start, width, exceptions = index["start"].astype(np.int64), index["width"].astype(np.int64), index["exceptions"].astype(np.int64)
    for w in np.unique(width).tolist():
        if w:
            at = np.flatnonzero(width == w)
            bits = np.unpackbits(payload[start[at][:, None] + np.arange(w * BLOCK // 8)], axis=1, bitorder="little").reshape(len(at), BLOCK, w)
            value = np.zeros((len(at), BLOCK), np.uint32)
            for b in range(w):
                value |= bits[:, :, b].astype(np.uint32) << np.uint32(b)
            out[at] = value
    block = np.repeat(np.arange(len(index)), exceptions)
    nth_of = np.arange(len(block)) - np.repeat(np.concatenate([[0], np.cumsum(exceptions)[:-1]]), exceptions) if len(index) else np.zeros(0, np.int64)
    lists = start + width * (BLOCK // 8)
    place = payload[lists[block] + nth_of]
    high = np.ascontiguousarray(payload[(lists[block] + exceptions[block] + 4 * nth_of)[:, None] + np.arange(4)]).view("<u4").reshape(-1)
    out[block, place] |= (high.astype(np.uint64) << width[block].astype(np.uint64)).astype(np.uint32)
    return (out + index["least"][:, None]).reshape(-1)


def segment(doc_ids: np.ndarray, is_null: np.ndarray, tokens: np.ndarray, ids: np.ndarray) -> bytes:
    index, payload = pack(ids)
    head = np.zeros(1, _HEAD)
    head["magic"], head["docs"], head["blocks"], head["tokens"] = MAGIC, len(doc_ids), len(index), len(ids)
    docs = np.zeros(len(doc_ids), _DOC)
    docs["id"], docs["null"], docs["tokens"] = doc_ids, is_null, tokens
    return head.tobytes() + docs.tobytes() + index.tobytes() + payload.tobytes()


def open_segment(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(documents, block index, payload, number of tokens)."""
    head = np.frombuffer(data, _HEAD, 1)[0]
    if head["magic"] != MAGIC:
        raise ValueError("not a token segment")
    docs = np.frombuffer(data, _DOC, int(head["docs"]), _HEAD.itemsize)
    index = np.frombuffer(data, _INDEX, int(head["blocks"]), _HEAD.itemsize + docs.nbytes)
    return docs, index, np.frombuffer(data, np.uint8, offset=_HEAD.itemsize + docs.nbytes + index.nbytes), int(head["tokens"])


def document(data: bytes, position: int) -> np.ndarray:
    """The ids of one document of a segment, decoding only the blocks that hold it."""
    docs, index, payload, _ = open_segment(data)
    start = int(docs["tokens"][:position].sum())
    end = start + int(docs["tokens"][position])
    first = start // BLOCK
    return unpack(index, payload, first, -(-end // BLOCK))[start - first * BLOCK : end - first * BLOCK]


class PieceEncoder:
    """The library's ids of whole texts, encoded piece by piece.

    A text is cut before each space that another character than white space follows, where the byte-level
    pattern always begins a new word, so the pieces' ids follow each other as in the whole text.
    Each distinct piece is encoded by the library once, most of them in one call with line feeds between,
    whose slices are checked by their lengths in bytes; the ids of texts are gathered from those.
    """

    _loaded: dict[str, PieceEncoder] = {}
    #: A space before white space, as Arrow's patterns and as Python's tell it.
    _uneven = r" [\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    _cut = re.compile(r" (?=\S)")
    _space = re.compile(r"\s")

    @classmethod
    def load(cls, path: str) -> PieceEncoder:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        line = self._ids(["\n", "\n a\na"])
        # a line feed between pieces is a word of its own in byte-level patterns; where it isn't, pieces are encoded one by one
        self.line = line[0][0] if len(line[0]) == 1 and line[1] == [*line[0], *self._ids([" a"])[0], *line[0], *self._ids(["a"])[0]] else None
        # bytes of each id: byte-level tokens are written with a character for each byte, added ones as they are
        self.bytes = np.zeros(self.library.get_vocab_size(with_added_tokens=True), np.int64)
        for token, i in self.library.get_vocab(with_added_tokens=True).items():
            self.bytes[i] = len(token)
        for i, token in self.library.get_added_tokens_decoder().items():
            self.bytes[i] = len(token.content.encode())
        self._forget()

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.ends, self.known = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), 0

    def _keep(self, pieces: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        start, n = int(self.ends[self.known]), len(pieces)
        while start + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.known + n >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ids[start : start + len(ids)] = ids
        self.ends[self.known + 1 : self.known + n + 1] = start + np.cumsum(counts)
        self.number.update(zip(pieces, range(self.known, self.known + n), strict=True))
        self.known += n

    def _learn(self, pieces: list[str]) -> None:
        # only pieces without white space but one leading space: in these, no line feed can meet the one that separates them
        together = [p for p in pieces if p and p != " " and not self._space.search(p, p[0] == " ")] if self.line is not None else []
        if together:
            ids = np.array(self._ids(["\n".join(together)])[0], np.uint32)
            at = np.flatnonzero(ids == self.line)
            if len(at) == len(together) - 1:
                counts, own = np.diff(at, prepend=-1, append=len(ids)) - 1, np.delete(ids, at)
                ends = np.concatenate([[0], np.cumsum(self.bytes[own])])[np.concatenate([[0], np.cumsum(counts)])]
                # the ids spell the joined text, so slices of the pieces' lengths spell the pieces
                if (np.diff(ends) == [len(p.encode()) for p in together]).all():
                    self._keep(together, own, counts)
        alone = [p for p in pieces if p not in self.number]
        found = self._ids(alone)
        self._keep(alone, np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64))

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        new = [p for p in pieces if p not in self.number]
        if new:
            self._learn(list(dict.fromkeys(new)))
            self.long += [p for p in new if len(p) > MAX_KEPT]
        return np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        if self.known > CACHE_PIECES:
            self._forget()
        self.long: list[str] = []
        uneven = np.asarray(pc.match_substring_regex(texts, self._uneven)).astype(bool) if len(texts) else np.zeros(0, bool)
        split = pc.split_pattern(pc.filter(texts, pa.array(~uneven)), " ")
        pieces = split.flatten().dictionary_encode()
        counts = np.zeros(len(texts), np.int64)
        counts[~uneven] = np.asarray(pc.list_value_length(split))
        # all pieces but a text's first follow a space
        key, strings = np.asarray(pieces.indices), pieces.dictionary
        begins = np.zeros(len(key), bool)
        begins[np.cumsum(counts[~uneven]) - counts[~uneven]] = True
        of = np.empty(len(key), np.int64)
        for where, space in ((begins, ""), (~begins, " ")):
            used, inverse = np.unique(key[where], return_inverse=True)
            of[where] = self._numbers([space + p for p in strings.take(pa.array(used)).to_numpy(zero_copy_only=False).tolist()])[inverse]
        if uneven.any():
            odd = []
            for text in pc.filter(texts, pa.array(uneven)).to_pylist():
                first, *rest = self._cut.split(text)
                odd.append([first, *(" " + p for p in rest)])
            counts[uneven] = [len(x) for x in odd]
            mixed = np.empty(int(counts.sum()), np.int64)
            is_odd = np.repeat(uneven, counts)
            mixed[~is_odd], mixed[is_odd] = of, self._numbers([p for x in odd for p in x])
            of = mixed
        start, n = self.ends[of], self.ends[of + 1] - self.ends[of]
        total = np.concatenate([[0], np.cumsum(n)])
        ids = self.ids[np.repeat(start - total[:-1], n) + np.arange(total[-1])]
        for p in self.long:  # their ids stay in the store until it is emptied, but they'd be keys of any length
            self.number.pop(p, None)
        return ids, np.diff(total[np.concatenate([[0], np.cumsum(counts)])])


def write(documents: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id", end_id: int = 0) -> DataFrame:
    """The table of segments of all documents, written to the shared folder: part, start (ids before it in its part), tokens, data.

    Parts ascend in id; null ids come first, rows of one id in the order of a hash of their text.
    Each document ends with end_id; a null or empty text has just that. Ids are integers.
    """
    docs = documents.select(F.col(id_col).cast("bigint").alias("__id"), F.coalesce(text_col, F.lit("")).alias("__text")).withColumn("__tie", F.xxhash64("__text"))
    ordered = docs.repartitionByRange("__id", "__tie").sortWithinPartitions("__id", "__tie")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, before = PieceEncoder.load(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for first, end, _, _ in chunks(batch.column(1), SEGMENT_BYTES):
                some = batch.slice(first, end - first)
                ids, n = encoder.encode(some.column(1))
                tokens = n + 1
                out = np.full(int(tokens.sum()), end_id, np.uint32)
                out[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
                doc = some.column(0)
                data = segment(np.asarray(doc.fill_null(0)), np.asarray(doc.is_null()), tokens, out)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([len(out)], pa.int64()), pa.array([data], pa.binary())], names=["part", "start", "tokens", "data"])
                before += len(out)

    return written(ordered.mapInArrow(encode, "part int, start bigint, tokens bigint, data binary"), "token-segments")


def read(segments: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document of the segments: id, start (ids of all documents before it), n_tokens, ids_crc32 (of its ids as little-endian 32-bit integers)."""
    spark = segments.sparkSession
    sums = segments.groupBy("part").agg(F.sum("tokens").alias("n")).orderBy("part").collect()  # one row per partition of the writing job
    before, offsets = 0, []
    for r in sums:
        offsets.append((r.part, before))
        before += r.n
    parts = spark.createDataFrame(offsets, "part int, before bigint")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                docs, index, payload, n = open_segment(batch.column(1)[i].as_py())
                ids = unpack(index, payload)[:n].astype("<u4")
                ends = np.cumsum(docs["tokens"].astype(np.int64))
                starts = ends - docs["tokens"].astype(np.int64)
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(docs["id"], pa.int64(), mask=docs["null"].astype(bool)), pa.array(starts + batch.column(0)[i].as_py()),
                    pa.array(docs["tokens"].astype(np.int64)), pa.array(crc, pa.int64()),
                ], names=[id_col, "start", "n_tokens", "ids_crc32"])

    placed = segments.join(parts, "part").select((F.col("start") + F.col("before")).alias("start"), "data")
    return placed.mapInArrow(decode, f"`{id_col}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
