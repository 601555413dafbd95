"""Conflict-constrained best-fit packing of documents into bins of a fixed number of words.

Documents are dealt to shards by a hash, so that each shard packs on its own with bounded memory.
Within a shard pieces come in falling size; open bins are ordered by their residual room. A
bin carries two bitmaps: the sources it is full of, and the duplicate clusters it holds. The
search starts at the smallest residual that fits and goes on to the next residual until a
bin is found whose bitmaps don't conflict, so the tightest compatible bin is taken.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Words in a bin, and pieces of one source that a bin takes.
CAPACITY, PER_SOURCE = 2048, 4
#: About so many words make a shard, a piece counting as so many words more; the number of shards follows the corpus.
SHARD_WORDS, PIECE_WORDS = 2_000_000, 16

#: A cluster is hot if it has over so many pieces of a shard, and over this share (one in HOT) of them.
SMALL, HOT = 64, 64

SCHEMA = "shard bigint, bin bigint, position int, bin_start int, __key bigint, piece int, piece_start bigint, n_words int"


class Bins:
    """The open bins of a shard by residual, and for each residual by the bitmaps of the sources that they are full of and of the hot clusters that they hold.

    hot: the bits of clusters with so many pieces that a search must not look at each of their bins. For these it is kept which
    residuals have only bins that hold them, so a search passes over such residuals at once.
    """

    def __init__(self, capacity: int, per_source: int, hot: int = 0):
        self.capacity, self.per_source, self.hot = capacity, per_source, hot
        self.hot_bits = [1 << i for i in range(hot.bit_length()) if hot >> i & 1]
        self.by_room: dict[int, dict[tuple[int, int], list[int]]] = defaultdict(lambda: defaultdict(list))
        self.open_bins: dict[int, int] = defaultdict(int)  # by residual
        self.holding: dict[int, dict[int, int]] = {c: defaultdict(int) for c in self.hot_bits}  # of these, those that hold a hot cluster
        self.only: dict[int, int] = dict.fromkeys(self.hot_bits, 0)  # bit r is set while all bins with residual r hold the cluster
        self.rooms = 0  # bit r is set while a bin with residual r is open
        self.held: list[dict[int, int]] = []  # per bin: pieces of each source
        self.room: list[int] = []
        self.full: list[int] = []  # per bin: bitmap of the sources it is full of
        self.clusters: list[int] = []
        self.pieces: list[int] = []

    def open(self, b: int) -> None:
        r = self.room[b]
        if r:
            self.by_room[r][self.full[b], self.clusters[b] & self.hot].append(b)
            self.rooms |= 1 << r
            self._count(r, b, 1)

    def _count(self, room: int, b: int, step: int) -> None:
        self.open_bins[room] += step
        for c in self.hot_bits:
            if self.clusters[b] & c:
                self.holding[c][room] += step
            if self.holding[c][room] == self.open_bins[room]:
                self.only[c] |= 1 << room
            else:
                self.only[c] &= ~(1 << room)

    def _take(self, size: int, source: int, cluster: int) -> int:
        """The tightest compatible open bin, no longer open; -1 if there is none."""
        rest, room = (self.rooms & ~self.only.get(cluster, 0)) >> size, size
        while rest:
            step = (rest & -rest).bit_length() - 1
            room += step
            here = self.by_room[room]
            for (full, hot), bins in here.items():
                if full & source or hot & cluster:
                    continue
                for i in range(len(bins) - 1, -1, -1):
                    if self.clusters[bins[i]] & cluster:
                        continue
                    found = bins.pop(i)
                    self._count(room, found, -1)
                    if not bins:
                        del here[full, hot]
                        if not here:
                            self.rooms &= ~(1 << room)
                    return found
            rest >>= step + 1
            room += 1
        return -1

    def put(self, size: int, source: int, cluster: int) -> tuple[int, int, int]:
        """Puts a piece of `size` words in the tightest compatible bin, which is then not open: (bin, position, start). source and cluster are bits, cluster 0 for none."""
        b = self._take(size, source, cluster)
        if b < 0:
            b = len(self.room)
            self.room.append(self.capacity)
            self.full.append(0)
            self.clusters.append(0)
            self.pieces.append(0)
            self.held.append({})
        start = self.capacity - self.room[b]
        self.room[b] -= size
        if size:
            self.held[b][source] = held = self.held[b].get(source, 0) + 1
            if held >= self.per_source:
                self.full[b] |= source
        self.clusters[b] |= cluster
        self.pieces[b] += 1
        return b, self.pieces[b] - 1, start

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int, int]:
        """put(), and the bin is open again."""
        found = self.put(size, source, cluster)
        self.open(found[0])
        return found


def quota(words: np.ndarray, source: np.ndarray, capacity: int, per_source: int) -> int:
    """How many pieces of a source a bin takes: per_source, or twice an even share of an average bin's pieces where a shard has so few sources that bins would stay empty."""
    some = words[words > 0]
    if not len(some):
        return per_source
    return max(per_source, int(-(-2 * capacity // (some.mean() * len(np.unique(source))))))


def pack_shard(words: np.ndarray, source: np.ndarray, cluster: np.ndarray, key: np.ndarray, piece: np.ndarray, capacity: int, per_source: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, position, start) of each piece. Ties in size go by cluster, key, piece and source, so the result depends on the rows alone; rows equal in all of these are exchangeable. Pieces of no words are in no cluster and count for no source."""
    order = np.lexsort((source, piece, key, cluster, -words))
    _, src = np.unique(source, return_inverse=True)
    _, clu, often = np.unique(np.where(words > 0, cluster, 0), return_inverse=True, return_counts=True)
    # a cluster with one piece here conflicts with nothing and needs no bit
    bit = np.where(often > 1, np.cumsum(often > 1) - 1, -1)[clu]
    bit[words == 0] = -1
    hot = np.unique(bit[(often > max(SMALL, len(words) // HOT))[clu] & (bit >= 0)]).tolist()
    bins = Bins(capacity, quota(words, source, capacity, per_source), sum(1 << b for b in hot))
    out = np.zeros((3, len(words)), np.int64)
    before, waiting = None, []
    for i in order.tolist():
        # copies of one size come together, and none can join the bin of another: those bins open again after the last
        if (words[i], bit[i]) != before:
            for b in waiting:
                bins.open(b)
            before, waiting = (words[i], bit[i]), []
        out[:, i] = found = bins.put(int(words[i]), 1 << int(src[i]), 1 << int(bit[i]) if bit[i] >= 0 else 0)
        if bit[i] >= 0:
            waiting.append(found[0])
        else:
            bins.open(found[0])
    return out[0], out[1], out[2]


def pack(documents: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard_words: int = SHARD_WORDS, cluster_col: str | None = None) -> DataFrame:
    """One row per piece: id, piece, piece_start, n_words, shard, bin, position, bin_start, cluster.

    A document of over `capacity` words is cut into pieces of `capacity` and a rest; a null, empty
    or blank text is one piece of no words, without a cluster. A bin takes per_source pieces of a source at most (null
    is a source of its own; more where a shard has few sources, see quota()), and no two pieces of one duplicate cluster: the values of
    cluster_col, such as the component_id of ngram_join, or without one texts equal but for case
    and white space. Pieces of one document are of one cluster. bin is unique within a shard.
    Rows without an id are packed like others; repeated rows are packed each, dealt to shards by their number. An empty table
    gives no rows; further columns are ignored.
    """
    normal = F.lower(F.trim(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[ \t\n\x0B\f\r]+", " ")))
    texts = documents.select(F.col(id_col).alias("__key"), F.xxhash64(F.col(source_col), F.col(source_col).isNull()).alias("__source"), (F.xxhash64(normal) if cluster_col is None else F.xxhash64(F.col(cluster_col))).alias("__cluster"), normal.alias("__normal"))
    rows = texts.select(
        "__key", "__source", "__cluster",
        F.when(F.col("__normal") == "", 0).otherwise(F.length("__normal") - F.length(F.replace("__normal", F.lit(" "), F.lit(""))) + 1).cast("bigint").alias("__words"),
    )
    return pack_rows(written(rows, "packing-rows"), id_col, capacity, per_source, shard_words)


def pack_rows(rows: DataFrame, id_col: str, capacity: int, per_source: int, shard_words: int) -> DataFrame:
    """pack() for rows of __key, __words, __source, __cluster."""
    count = F.expr(f"greatest(0L, (__words - 1) div {capacity}) + 1")
    total = rows.agg(F.sum(F.col("__words") + PIECE_WORDS * count)).first()[0] or 0
    shards = max(1, round(total / shard_words))
    # repeated rows are numbered within each part of the input, so that they are dealt out too; other rows have number 1
    nth = F.row_number().over(Window.partitionBy("__part", "__key", "__cluster").orderBy("__source"))
    numbered = rows.withColumn("__part", F.spark_partition_id()).withColumn("__nth", nth)
    pieces = numbered.withColumn("__piece", F.explode(F.expr(f"sequence(0L, greatest(0L, (__words - 1) div {capacity}))"))).select(
        "__key", "__source", "__cluster", F.col("__piece").cast("int").alias("__piece"),
        F.least(F.lit(capacity), F.col("__words") - F.col("__piece") * capacity).cast("int").alias("__words"),
        F.pmod(F.when(F.col("__nth") == 1, F.xxhash64("__key", "__piece", "__cluster")).otherwise(F.xxhash64("__key", "__piece", "__cluster", "__nth")), F.lit(shards)).alias("__shard"),
    )

    def fill(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        words, source, cluster, piece = (t.column(c).to_numpy() for c in ("__words", "__source", "__cluster", "__piece"))
        keys = t.column("__key").combine_chunks()
        bins, position, start = pack_shard(words, source, cluster, np.asarray(keys.fill_null(-(1 << 63))), piece, capacity, per_source)
        made = [pa.array(np.full(len(t), key[0].as_py(), np.int64)), pa.array(bins), pa.array(position.astype(np.int32)), pa.array(start.astype(np.int32)), keys.cast(pa.int64()), pa.array(piece.astype(np.int32)), pa.array(piece.astype(np.int64) * capacity), pa.array(words.astype(np.int32)), pa.array(cluster, mask=words == 0)]
        yield pa.RecordBatch.from_arrays(made, names=["shard", "bin", "position", "bin_start", "__key", "piece", "piece_start", "n_words", "cluster"])

    packed = pieces.groupBy("__shard").applyInArrow(fill, SCHEMA + ", cluster bigint")
    return packed.select(F.col("__key").alias(id_col), "piece", "piece_start", "n_words", "shard", "bin", "position", "bin_start", "cluster")
