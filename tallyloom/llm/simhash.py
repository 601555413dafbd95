"""SimHash near-duplicates with pivot distance tables.

A fingerprint has a bit set where more than half of the text's shingle hashes have it (XXH64, seed
42, repeats counted). Equal fingerprints are one node. Each node gets a table of its Hamming distances to
REFERENCES fixed reference fingerprints. By the triangle inequality two fingerprints within
RADIUS bits differ by no more than RADIUS in any of these coordinates, so a pair whose largest
coordinate difference is greater is discarded, and only survivors are compared bit by bit.

Not all pairs have to be looked at for that. Most references differ from the zero reference in one of
SEGMENTS segments of 16 bits only, so that the distances to them and to the zero reference tell
about that segment alone. RADIUS differing bits leave at least SEGMENTS - RADIUS segments
untouched, in all of whose coordinates a near pair is equal. So nodes meet under the coordinates of each
set of that many segments, and the pairs that meet are put to the tables. One range
shuffle on (coordinates, fingerprint) brings them together and splits hot keys.

A group of over SMALL nodes, where pairs would grow with the square, is settled by further references: the
points within one bit of its nodes. Two fingerprints differ in at most 2 bits exactly if some point is
within one bit of both, and a point is that near to 65 fingerprints at most, so these groups are
bounded and the work is in proportion to the nodes. Nodes at the edges of a partition go
there too, since their group may go on in the next one. The result is exact, without caps.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written
from .components import components
from .textvec import chunks, mix64

BITS, RADIUS, SEED = 64, 2, 42
#: Segments of the fingerprint, references for each, and references that differ from zero anywhere.
SEGMENTS, PER_SEGMENT, WHOLE = 4, 14, 8
#: Groups of so many nodes are compared by their tables; larger ones by references one bit away.
SMALL = 16
#: Hashes held before their bits are counted, and bytes of a text that are split in words at a time.
HELD, TEXT_BYTES = 1 << 17, 1 << 20

_LANES = np.uint64(0x0101010101010101)


def _references() -> np.ndarray:
    """The zero reference, those of each segment in turn, and those anywhere: fixed pseudo-random numbers."""
    width = BITS // SEGMENTS
    with np.errstate(over="ignore"):
        drawn = mix64(np.arange(1, SEGMENTS * PER_SEGMENT + WHOLE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    inside = drawn[: SEGMENTS * PER_SEGMENT].reshape(SEGMENTS, PER_SEGMENT) & np.uint64((1 << width) - 1)
    inside <<= (np.arange(SEGMENTS, dtype=np.uint64) * np.uint64(width))[:, None]
    return np.concatenate([np.zeros(1, np.uint64), inside.reshape(-1), drawn[SEGMENTS * PER_SEGMENT :]])


REFERENCES = _references()


def distance_table(fingerprints: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to each reference, as bytes."""
    return np.bitwise_count(fingerprints[:, None] ^ REFERENCES)


def meeting_keys(table: np.ndarray) -> np.ndarray:
    """For each set of SEGMENTS - RADIUS segments a hash of its coordinates, each taken as the distance to the reference less that to zero."""
    parts = (table[:, 1 : 1 + SEGMENTS * PER_SEGMENT].astype(np.int64) - table[:, :1]).reshape(len(table), SEGMENTS, PER_SEGMENT)
    keys = []
    with np.errstate(over="ignore"):
        weights = mix64(np.arange(1, PER_SEGMENT + 1, dtype=np.uint64))
        of = mix64((parts.astype(np.uint64) * weights).sum(axis=2))
        for i, some in enumerate(combinations(range(SEGMENTS), SEGMENTS - RADIUS)):
            key = np.full(len(table), i + 1, np.uint64)
            for s in some:
                key = mix64(key ^ of[:, s])
            keys.append(key)
    return np.stack(keys, axis=1).view(np.int64)


def _words(text: memoryview) -> Iterator[list[bytes]]:
    """The lower-cased words of a text, some at a time; each list but the first begins with the two words before it."""
    at, before = 0, []
    while at < len(text):
        end = min(len(text), at + TEXT_BYTES)
        part = bytes(text[at:end])
        if end < len(text):
            # up to the last white space; a longer word is taken whole
            cut = max(part.rfind(c) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            while cut < 0 and end < len(text):
                end = min(len(text), end + TEXT_BYTES)
                more = bytes(text[at + len(part) : end])
                cut = next((i for i, c in enumerate(more) if c in b" \n\t\r\x0b\x0c"), -1)
                cut = cut + len(part) if cut >= 0 else -1
                part += more
            if cut >= 0:
                part, end = part[:cut], at + cut + 1
        words = before + part.lower().split()
        at = end
        if words[len(before) :]:
            yield words
        before = words[-2:]


def shingle_hashes(text: memoryview) -> Iterator[np.ndarray]:
    """Unsigned XXH64 of the 3-word shingles of a UTF-8 text, some at a time; fewer words are one shingle, none give none."""
    seen = 0
    held: list[bytes] = []
    for words in _words(text):
        held = words
        if len(words) > 2:
            seen += len(words) - 2
            made = map(b" ".join, zip(words, words[1:], words[2:], strict=False))
            yield np.fromiter(map(xxhash.xxh64_intdigest, made, repeat(SEED)), np.uint64, len(words) - 2)
    if not seen and held:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(held), SEED)], np.uint64)


def bit_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many hashes of each run have each bit; runs are not empty. Eight bits are summed at once, a byte each, over 255 hashes at most."""
    ends = np.append(starts[1:], len(hashes))
    pieces = -(-(ends - starts) // 255)
    first = np.cumsum(pieces) - pieces
    at = np.repeat(starts, pieces) + 255 * (np.arange(int(pieces.sum())) - np.repeat(first, pieces))
    counts = np.empty((len(starts), 8, 8), np.int64)
    for b in range(8):
        lanes = np.add.reduceat(hashes >> np.uint64(b) & _LANES, at)
        counts[:, :, b] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
    return counts.reshape(len(starts), BITS)


def fingerprints(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The fingerprints of texts given as bytes and the offsets between them; a text without words has 0."""
    counts, n = np.zeros((len(offs) - 1, BITS), np.int64), np.zeros(len(offs) - 1, np.int64)
    held, of, size = [], [], 0

    def count() -> None:
        lengths = np.array([len(h) for h in held])
        np.add.at(counts, of, bit_counts(np.concatenate(held), np.cumsum(lengths) - lengths))
        np.add.at(n, of, lengths)

    view = memoryview(np.ascontiguousarray(raw))
    for i, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
        for h in shingle_hashes(view[a:b]):
            held.append(h)
            of.append(i)
            size += len(h)
        if size > HELD:
            count()
            held, of, size = [], [], 0
    if held:
        count()
    return ((2 * counts > n[:, None]).astype(np.uint64) << np.arange(BITS, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def with_fingerprint(documents: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id and fingerprint (a signed long of the 64 bits) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, raw, offs in chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(fingerprints(raw, offs).view(np.int64))], names=["id", "fingerprint"])

    return documents.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id bigint, fingerprint bigint")


def _tables(nodes: DataFrame) -> DataFrame:
    """Each node with its distance table and the keys under which it meets others."""
    n_keys = len(list(combinations(range(SEGMENTS), SEGMENTS - RADIUS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            table = distance_table(np.asarray(batch.column(0)).view(np.uint64))
            keys = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * n_keys), pa.array(meeting_keys(table).reshape(-1)))
            rows = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1, dtype=np.int32) * len(REFERENCES)).tobytes()), pa.py_buffer(table.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), rows, keys], names=["node", "distances", "keys"])

    return nodes.select("node").mapInArrow(run, "node bigint, distances binary, keys array<bigint>")


def survivors(nodes: np.ndarray, tables: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of pairs of rows (x, y), those that are within RADIUS bits: first by the largest coordinate difference, then by the bits."""
    apart = np.maximum(tables[x], tables[y]) - np.minimum(tables[x], tables[y])
    keep = apart.max(axis=1) <= RADIUS
    keep[keep] = np.bitwise_count(nodes[x[keep]] ^ nodes[y[keep]]) <= RADIUS
    return keep


def _meet(tables: DataFrame) -> DataFrame:
    """(u, v) of verified near pairs in small groups, and (u, null) of the nodes of large groups and at partitions' edges."""
    index = tables.select(F.explode("keys").alias("key"), "node", "distances").repartitionByRange("key", "node").sortWithinPartitions("key", "node")

    def out(u: np.ndarray, v: np.ndarray | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.nulls(len(u), pa.int64()) if v is None else pa.array(v.view(np.int64))], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the group that a batch ends with waits for the next one; `open_` is the key of one that is known to be no small group
        key, node, table, open_, begun = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros((0, len(REFERENCES)), np.uint8), None, False
        for batch in batches:
            if batch.num_rows == 0:
                continue
            distances = batch.column(2)
            new = np.frombuffer(distances.buffers()[2], np.uint8)[distances.offset * len(REFERENCES) :][: batch.num_rows * len(REFERENCES)].reshape(-1, len(REFERENCES))
            key, node, table = np.concatenate([key, np.asarray(batch.column(0))]), np.concatenate([node, np.asarray(batch.column(1)).view(np.uint64)]), np.concatenate([table, new])
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.append(starts, len(key)))
            if not begun:  # the first group may have begun in the partition before
                begun, open_ = True, key[0]
            large = sizes > SMALL
            large |= key[starts] == open_ if open_ is not None else False
            if large[-1]:
                open_, done = key[-1], len(key)
            else:
                done = int(starts[-1])
            of = np.repeat(np.arange(len(starts)), sizes)[:done]
            alone = node[:done][large[of]]
            if len(alone):
                yield out(alone, None)
            for gap in range(1, SMALL):
                x = np.flatnonzero((of[gap:] == of[:-gap]) & ~large[of[gap:]]) if gap < done else np.zeros(0, np.int64)
                if not len(x):
                    break
                near = survivors(node, table, x, x + gap)
                if near.any():
                    yield out(node[x[near]], node[x[near] + gap])
            key, node, table = key[done:], node[done:], table[done:]
        if len(key):
            yield out(node, None)

    return index.mapInArrow(run, "u bigint, v bigint")


def _balls(nodes: DataFrame) -> DataFrame:
    """Links (u, v) among nodes, through the points within one bit of them. At most 65 nodes share a point."""
    points = F.concat(F.array(F.col("node")), F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.col("node").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i))))
    shared = nodes.select("node", F.explode(points).alias("point")).groupBy("point").agg(F.collect_list("node").alias("near")).where("size(near) > 1")
    return shared.select(F.array_min("near").alias("u"), F.explode("near").alias("v")).where("u != v").distinct()


def near_duplicates(documents: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, fingerprint (long), component_id (the smallest id that links reach, itself included).

    Documents link when their fingerprints differ in at most RADIUS bits. A-Z count as lower case; words are runs of other bytes
    than white space (space and 9 to 13). A null, empty or blank text has fingerprint zero and links as any other. Rows of one
    fingerprint are linked whatever their ids; a component of rows without ids has a null component_id. An empty
    table gives no rows; further columns are ignored, and whole texts are read however long.
    """
    rows = written(with_fingerprint(documents, text_col, id_col), "simhash-rows")
    ids = written(rows.groupBy(F.col("fingerprint").alias("node")).agg(F.min("id").alias("id")), "simhash-nodes")
    tables = written(_tables(ids), "simhash-tables")
    met = written(_meet(tables), "simhash-met")
    drop_written(documents.sparkSession, tables)
    links = met.where("v IS NOT NULL").distinct()
    roots = components(links.union(_balls(met.where("v IS NULL").select(F.col("u").alias("node")).distinct())))
    rooted = ids.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    of_node = rooted.join(names, "root").select(F.col("node").alias("fingerprint"), "component_id")
    return rows.join(of_node, "fingerprint", "left").select(F.col("id").alias(id_col), "fingerprint", "component_id")
