"""N-gram Jaccard join with token-combination prefixes.

A document is the set of its distinct k-word shingles ("tokens" here). Tokens have one global
order: by how often a fixed-size table of counts saw them, then by hash. With e = n minus the
least overlap that a set of n tokens needs, two similar sets share a token among the first
e + 1 of each. A set whose first e + 1 tokens are all rare indexes them singly. Another set
extends its prefix by m + 1 tokens in all: rare ones are indexed singly, frequent ones as
pairs within m hashed classes. Similar sets share m + 1 tokens there, so either a rare one or,
by the pigeonhole principle, two frequent ones of one class. m grows with the size band of a
set, which keeps the number of pairs in proportion to the set; a set indexes each band that a
partner may be in.

Each signature keeps its place in the set's order. The tokens before the first common one are in
one set only, so a pair whose places leave too few tokens after them isn't a candidate there; for a
pair of tokens, up to m - 1 common ones may come before.

Candidates whose bitmaps of token parities differ in more bits than the pair may differ in tokens
are dropped before their sets are fetched; no similar pair is lost by that.

Sets that are equal are one node. Nodes that share a signature are candidates: first only
neighbours in the order of a signature's nodes, whose verified links already join large groups
of near copies. Of the signatures whose nodes are still in several components, groups of few
nodes are compared pair by pair. A larger group has a pivot, and each node's difference to it,
which is small among near copies, settles most pairs without a comparison: those whose
differences together are small enough are linked through one node, and the others meet in
prefixes of the differences, where what the group has in common plays no part. The result is
exact. Work grows with the rows of a group as long as a family's pivot is one of its own nodes; nodes of a family that has
only another family's pivot meet under the tokens that all of them share.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, written
from .components import components
from .textvec import chunks, distinct_sets, mix64, shingles

#: The table of counts has 2**WIDTH_BITS entries whatever the corpus; it only orders tokens.
WIDTH_BITS, BLOCK_BITS = 22, 16
#: Bytes of text that are hashed at a time, unless one text has more.
TEXT_BYTES = 1 << 18
#: Tables of counts of so many tasks, or more, are added before those sums meet.
FAN_IN = 64
#: A token is frequent from this many sightings, over the table's mean noise.
FREQUENT = 200
#: A band of sets has as many classes of frequent tokens as the tokens that similar sets of it may differ in, over this: fewer classes make each pair rarer, but more of them, up to the square of the prefix.
CLASS_SHARE = 2
#: Groups of so many rows of a signature are compared pair by pair; larger ones through a pivot.
SMALL = 8
#: Bits of the map of candidate nodes that a task holds: eight for each node, within these bounds. A full map only lets through more rows.
MAP_BITS = 16, 27

#: Marks tokens that only a pivot has.
_LACKING = 0x5DEECE66D1234567
_C1, _C2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def _columns(text_col: str, batches: Iterator[pa.RecordBatch], k: int):
    for batch in batches:
        for first, end, raw, offs in chunks(batch.column(batch.schema.get_field_index(text_col)), TEXT_BYTES):
            yield batch.slice(first, end - first), offs, *distinct_sets(*shingles(raw, offs, k))


def count_table(docs: DataFrame, k: int) -> tuple[np.ndarray, int]:
    """The log-scaled counts of all documents' tokens by hash (a fixed 4 MB), and the level from which a token is frequent."""

    def count(batches):
        seen, held, n = np.zeros(1 << WIDTH_BITS, np.int64), [], 0
        part = TaskContext.get().partitionId() % FAN_IN
        for _, _, _, h in _columns("__text", batches, k):
            held.append((h >> np.uint64(64 - WIDTH_BITS)).astype(np.int64))
            n += len(h)
            if n > 1 << 20:
                seen += np.bincount(np.concatenate(held), minlength=1 << WIDTH_BITS)
                held, n = [], 0
        if held:
            seen += np.bincount(np.concatenate(held), minlength=1 << WIDTH_BITS)
        if seen.any():
            blocks = [zlib.compress(b.tobytes(), 1) for b in seen.reshape(-1, 1 << BLOCK_BITS)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(blocks)), pa.int32()), pa.array(np.full(len(blocks), part), pa.int32()), pa.array(blocks, pa.binary())], names=["block", "part", "counts"])

    def summed(batches):
        total = np.zeros(1 << BLOCK_BITS, np.int64)
        for batch in batches:
            for x in batch.column("counts"):
                total += np.frombuffer(zlib.decompress(x.as_py()), np.int64)
        return total

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([zlib.compress(summed(batches).tobytes(), 1)], pa.binary())], names=["block", "counts"])

    def finish(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = summed(batches)
        level = np.minimum(255, np.floor(8 * np.log2(1.0 + total))).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([zlib.compress(level.tobytes(), 1)], pa.binary()), pa.array([int(total.sum())], pa.int64())], names=["block", "levels", "tokens"])

    # tables meet in two steps, so that no task reads one of every other task's
    counted = docs.select("__text").mapInArrow(count, "block int, part int, counts binary").groupBy("block", "part").applyInArrow(add, "block int, counts binary")
    rows = counted.groupBy("block").applyInArrow(finish, "block int, levels binary, tokens bigint").collect()
    levels, tokens = np.zeros(1 << WIDTH_BITS, np.uint8), 0
    for r in rows:
        levels[r.block << BLOCK_BITS : (r.block + 1) << BLOCK_BITS] = np.frombuffer(zlib.decompress(r.levels), np.uint8)
        tokens += r.tokens
    return levels, int(8 * np.log2(1 + FREQUENT + 2 * tokens / (1 << WIDTH_BITS)))


def signatures(doc: np.ndarray, h: np.ndarray, n: np.ndarray, level: np.ndarray, frequent: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, signature, place) of the prefixes of sets given as sorted distinct (doc, hash) pairs."""
    order = np.lexsort((h, level, doc))
    doc, h, level = doc[order], h[order], level[order]
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    rank = np.arange(len(doc)) - first[doc]
    spare = n - -(-percent * n // 100)
    rare = np.bincount(doc[level < frequent], minlength=len(n))
    plain = rare >= spare + 1
    docs, sigs, places = [], [], []
    reach = np.where(plain, spare + 1, 0)
    for i in np.flatnonzero(~plain & (n >= 2)):
        low, high = int(-(-percent * n[i] // 100)).bit_length() - 1, int(n[i] * 100 // percent).bit_length() - 1
        for band in range(low, high + 1):
            m = max(1, ((1 << band) - -(-percent * (1 << band) // 100)) // CLASS_SHARE)
            end = int(min(n[i], spare[i] + m + 1))
            reach[i] = max(reach[i], end)
            t = h[first[i] + rare[i] : first[i] + end]
            cls = (t % np.uint64(m)).astype(np.int64)
            by = np.lexsort((np.arange(len(t)), cls))
            t, cls, at = t[by], cls[by], by + rare[i]
            for gap in range(1, len(t)):
                same = cls[gap:] == cls[:-gap]
                if not same.any():
                    break
                with np.errstate(over="ignore"):
                    made = mix64(t[:-gap][same] * _C1 + t[gap:][same] * _C2 + np.uint64(band))
                sigs.append(made)
                docs.append(np.full(len(made), i))
                places.append(np.maximum(0, at[:-gap][same] - (m - 1)))
    single = (rank < reach[doc]) & (level < frequent)
    docs.append(doc[single])
    sigs.append(h[single])
    places.append(rank[single])
    docs, sigs, places = np.concatenate(docs), np.concatenate(sigs), np.concatenate(places)
    by = np.argsort(docs, kind="stable")
    return docs[by], sigs[by], places[by]


def _digests(doc: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set, the same in any order of its tokens."""
    with np.errstate(over="ignore"):
        both = []
        for c in (_C1, _C2):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(h ^ c), dtype=np.uint64)])
            ends = np.cumsum(n)
            both.append((total[ends] - total[ends - n]).astype(np.int64))
    return both[0], both[1]


def _parities(doc: np.ndarray, h: np.ndarray, n_docs: int) -> pa.Array:
    """256 bits per set: the parity of its tokens in each of 256 hash classes. Two sets differ in no more bits than tokens."""
    counts = np.bincount(doc * 256 + (mix64(h ^ _C1) >> np.uint64(56)).astype(np.int64), minlength=256 * n_docs)
    bits = np.packbits((counts & 1).astype(np.uint8).reshape(n_docs, 256), axis=1).view(np.int64).reshape(-1)
    return pa.ListArray.from_arrays(pa.array(np.arange(n_docs + 1, dtype=np.int32) * 4), pa.array(bits))


def _lists(docs: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(docs, minlength=n))]), pa.int32()), pa.array(values))


def _nodes(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Each document's id, set size, digests and signatures."""
    levels, frequent = count_table(docs, k)
    table = docs.sparkSession.sparkContext.broadcast(zlib.compress(levels.tobytes(), 1))  # 4 MB at most, whatever the corpus

    def make(batches):
        level_of = np.frombuffer(zlib.decompress(table.value), np.uint8)
        for part, offs, doc, h in _columns("__text", batches, k):
            n = np.bincount(doc, minlength=len(offs) - 1)
            d1, d2 = _digests(doc, h, n)
            s_doc, s, place = signatures(doc, h, n, level_of[(h >> np.uint64(64 - WIDTH_BITS)).astype(np.int64)], frequent, percent)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(d1), pa.array(d2), _lists(s_doc, s.view(np.int64), len(n)), _lists(s_doc, place.astype(np.int32), len(n)), _parities(doc, h, len(n))], names=["id", "n", "d1", "d2", "sigs", "places", "bits"])

    return docs.select("__id", "__text").mapInArrow(make, "id bigint, n bigint, d1 bigint, d2 bigint, sigs array<bigint>, places array<int>, bits array<bigint>")


#: Stands in for the id of a set that only rows without an id have.
_NAMELESS = "shiftleft(-1L, 62) - shiftrightunsigned(d1, 2)"


_ROW = ["sig", "node", "d", "n", "place"]


def _shared(index: DataFrame, percent: int) -> DataFrame:
    """The rows that share their signature with a node of a fitting size, each with the node before it if that one is a candidate.

    One range shuffle on (signature, size, node) splits hot signatures; in that order a node has a
    partner of a fitting size just when a neighbour fits. The first and the last row of a partition
    are kept in any case, since their neighbours may be in the next one.
    """

    def keep(batches):
        held = None  # the last row of the batch before, while it isn't known whether the next one fits
        names = [*_ROW, *(f"p_{c}" for c in _ROW[1:])]
        for batch in batches:
            if batch.num_rows == 0:
                continue
            cols = [np.asarray(batch.column(i)).astype(np.int64) for i in range(5)]
            first = held is None
            if not first:
                cols = [np.concatenate([[h], c]).astype(np.int64) for h, c in zip(held[0], cols, strict=True)]
            sig, _, _, n, _ = cols
            fits = (sig[1:] == sig[:-1]) & (100 * n[:-1] >= percent * n[1:])  # n rises within a signature
            before = np.concatenate([[False], fits])
            wanted = before.copy()
            wanted[:-1] |= fits
            if first:
                wanted[0] = True
            else:
                wanted[0] |= held[1]
                before[0] = held[2] is not None
            p = [np.concatenate([[0], c[:-1]]).astype(np.int64) for c in cols[1:]]
            if not first and held[2] is not None:
                for c, x in zip(p, held[2], strict=True):
                    c[0] = x
            held = (tuple(int(c[-1]) for c in cols), bool(wanted[-1]), tuple(int(c[-1]) for c in p) if before[-1] else None)
            out = np.flatnonzero(wanted[:-1])
            yield pa.RecordBatch.from_arrays([*(pa.array(c[out]) for c in cols), *(pa.array(c[out], mask=~before[out]) for c in p)], names=names)
        if held is not None:
            last = held[2] or (None,) * 4
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (*held[0], *last)], names=names)

    ordered = index.repartitionByRange("sig", "n", "node").sortWithinPartitions("sig", "n", "node")
    return ordered.mapInArrow(keep, ", ".join(f"{c} bigint" for c in (*_ROW, *(f"p_{c}" for c in _ROW[1:]))))


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, d, tokens) of the wanted nodes, and of a few more; a bit map keeps most other documents' sets from being made into rows."""
    low, high = MAP_BITS
    map_bits = min(high, max(low, (8 * wanted.count()).bit_length()))

    def spot(node, d):
        with np.errstate(over="ignore"):
            return (mix64(node.view(np.uint64) * _C1 + d.view(np.uint64)) >> np.uint64(64 - map_bits)).astype(np.int64)

    def mark(batches):
        seen = np.zeros(1 << map_bits, bool)
        for batch in batches:
            seen[spot(np.asarray(batch.column(0)), np.asarray(batch.column(1)))] = True
        blocks = np.packbits(seen).reshape(64, -1)
        full = [i for i in range(64) if blocks[i].any()]
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([zlib.compress(blocks[i].tobytes(), 1) for i in full], pa.binary())], names=["block", "bits"])

    def unite(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << map_bits - 9, np.uint8)
        for batch in batches:
            for x in batch.column("bits"):
                bits |= np.frombuffer(zlib.decompress(x.as_py()), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([zlib.compress(bits.tobytes(), 1)], pa.binary())], names=["block", "bits"])

    marks = np.zeros((64, 1 << map_bits - 9), np.uint8)
    for r in wanted.select("node", "d").mapInArrow(mark, "block int, bits binary").groupBy("block").applyInArrow(unite, "block int, bits binary").collect():
        marks[r.block] = np.frombuffer(zlib.decompress(r.bits), np.uint8)
    table = docs.sparkSession.sparkContext.broadcast(zlib.compress(marks.tobytes(), 1))  # 16 MB at most, whatever the corpus

    def make(batches):
        bits = np.frombuffer(zlib.decompress(table.value), np.uint8)
        for part, offs, doc, h in _columns("__text", batches, k):
            n = np.bincount(doc, minlength=len(offs) - 1)
            d1, _ = _digests(doc, h, n)
            node = part.column(0)
            if node.null_count:
                made = -(1 << 62) - (d1.view(np.uint64) >> np.uint64(2)).astype(np.int64)
                node = np.where(np.asarray(node.is_null()), made, np.asarray(node.fill_null(0)))
            node = np.asarray(node)
            at = spot(node, d1)
            want = (bits[at >> 3] >> (7 - (at & 7)) & 1).astype(bool) & (n > 0)
            if want.any():
                pick = want[doc]
                new = np.cumsum(want) - 1
                yield pa.RecordBatch.from_arrays([pa.array(node[want]), pa.array(d1[want]), _lists(new[doc[pick]], h[pick].view(np.int64), int(want.sum()))], names=["node", "d", "tokens"])

    return docs.select("__id", "__text").mapInArrow(make, "node bigint, d bigint, tokens array<bigint>")


_PAIR = ["a", "da", "na", "b", "db", "nb"]


def _pairs(found: DataFrame, x: str, y: str, percent: int) -> DataFrame:
    """Candidate pairs of rows x and y of one signature: their sizes fit, and their places leave enough tokens for the overlap that the pair needs."""
    pick = [F.col(f"{p}{c}").alias(n) for p, names in ((x, ("a", "da", "na", "pa")), (y, ("b", "db", "nb", "pb"))) for c, n in zip(("node", "d", "n", "place"), names, strict=True)]
    return found.where(_candidates(x, y, percent)).select(*pick).select(_PAIR)


def _candidates(x: str, y: str, percent: int):
    (nx, px), (ny, py) = ((F.col(f"{p}n"), F.col(f"{p}place")) for p in (x, y))
    overlap = percent * (nx + ny)  # over 100 + percent
    return (100 * F.least(nx, ny) >= percent * F.greatest(nx, ny)) & ((100 + percent) * (nx - px) >= overlap) & ((100 + percent) * (ny - py) >= overlap)


def _near(bx: str, by: str, n, percent: int):
    """Whether two bitmaps leave it open that sets of n tokens together are similar."""
    apart = sum((F.bit_count(F.element_at(bx, i).bitwiseXOR(F.element_at(by, i))) for i in (2, 3, 4)), F.bit_count(F.element_at(bx, 1).bitwiseXOR(F.element_at(by, 1))))
    return (100 + percent) * apart <= (100 - percent) * n


def _open(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """The pairs that their bitmaps leave open."""
    left, right = (bits.select(F.col("node").alias(c), F.col("bits").alias("b" + c)) for c in "ab")
    return pairs.join(left, "a").join(right, "b").where(_near("ba", "bb", F.col("na") + F.col("nb"), percent)).select(_PAIR)


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs that are similar by the whole sets."""
    left = sets.select(F.col("node").alias("a"), F.col("d").alias("da"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("node").alias("b"), F.col("d").alias("db"), F.col("tokens").alias("tb"))
    both = pairs.join(left, ["a", "da"]).join(right, ["b", "db"]).withColumn("common", F.size(F.array_intersect("ta", "tb")))
    return both.where(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _mixed(rows: DataFrame, *key: str) -> DataFrame:
    """The rows of the groups whose nodes are in several components, with their group's size as `c`."""
    groups = rows.groupBy(*key).agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("c")).where("low < high").select(*key, "c")
    return rows.join(groups, list(key))


def _apart(shared: DataFrame, roots: DataFrame, bits: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows of signatures whose nodes are in several components, as small groups (at most SMALL rows) and large ones.

    Large groups whose sizes don't all fit are split by bands of set sizes first. Sizes of similar sets are in one band
    or in neighbouring ones, so each of their rows goes to its own band and to the next one.
    """
    rooted = shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = rooted.groupBy("sig").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("c"), F.min("n").alias("least"), F.max("n").alias("most")).where("low < high")
    rooted = rooted.join(sizes.select("sig", "c", (100 * F.col("least") >= percent * F.col("most")).alias("fit")), "sig")
    rooted = written(rooted.join(bits, "node"), "ngram-apart")
    step = math.log(100 / percent) * (1 + 1e-12)  # a little wider than the ratio, so that rounding moves no similar sets two bands apart
    band = F.floor(F.log("n") / step) if percent < 100 else F.col("n")
    whole = rooted.where(f"c <= {SMALL} OR fit").withColumn("band", F.lit(-1).cast("bigint"))
    banded = _mixed(rooted.where(f"c > {SMALL} AND NOT fit").drop("c").withColumn("band", F.explode(F.array(band, band + 1))), "sig", "band")
    columns = [*_ROW, "root", "bits", "band"]
    few, large = (whole.where(f"c {x} {SMALL}").select(columns).union(banded.where(f"c {x} {SMALL}").select(columns)) for x in ("<=", ">"))
    return few, large


def _all_pairs(few: DataFrame, percent: int) -> DataFrame:
    """All candidate pairs of nodes of different components in small groups; their number is in proportion to the rows, since SMALL is fixed."""
    x, y = few.alias("x"), few.alias("y")
    near = x.join(y, (F.col("x.sig") == F.col("y.sig")) & (F.col("x.band") == F.col("y.band")) & (F.col("x.root") < F.col("y.root")) & _candidates("x.", "y.", percent) & _near("x.bits", "y.bits", F.col("x.n") + F.col("y.n"), percent))
    return _pairs(near, "x.", "y.", percent)


def _stars(large: DataFrame) -> DataFrame:
    """Each node of a large group with the group's pivot (p, dp): of the component with most nodes there, the node of least hash. Overlapping groups mostly choose one pivot."""
    ends = large.groupBy("sig", "band", "root").agg(F.count("*").alias("m"), F.min(F.struct(F.xxhash64("node").alias("at"), "node", "d")).alias("x"))
    pivots = ends.groupBy("sig", "band").agg(F.max(F.struct("m", "root", "x")).alias("x")).select("sig", "band", F.col("x.x.node").alias("p"), F.col("x.x.d").alias("dp"))
    return large.join(pivots, ["sig", "band"]).select("p", "dp", "node", "d", "n", "root").distinct()


def _differences(stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Each node's difference to its pivot as tokens, those that only the pivot has in other words, and `s`: what of the allowed difference is left, times 100 + percent."""
    own = sets.select("node", "d", F.col("tokens").alias("t"))
    of_pivot = sets.select(F.col("node").alias("p"), F.col("d").alias("dp"), F.col("tokens").alias("tp"))
    lacking = F.transform(F.array_except("tp", "t"), lambda x: x.bitwiseXOR(F.lit(_LACKING)))
    both = stars.join(own, ["node", "d"]).join(of_pivot, ["p", "dp"]).withColumn("diff", F.concat(F.array_except("t", "tp"), lacking))
    return both.select("p", "node", "d", "n", "root", "diff", F.size("diff").cast("bigint").alias("m")).withColumn("s", (100 - percent) * F.col("n") - (100 + percent) * F.col("m"))


def _near_pivots(differences: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links within the stars, and the candidate pairs that these leave open.

    Two sets differ in no more tokens than both differ from the pivot, so they are similar if their s add up to 0 or
    more. Nodes that are similar by that to any node are so to the one of the largest s, and linked to it. So the components of
    all these are one; nodes of other components ("out") can only be similar to a node with which they share tokens of their
    differences; how many, the two s tell. So the differences have prefixes in which similar pairs meet: first come tokens that
    no node out of that component shares with one of another component, which are most of a family's tokens, then the rarest of a star.
    """
    links, rows = _prefixes(differences, percent)
    x, y = rows.where("to_out").alias("x"), rows.where("out").alias("y")
    meet = F.expr("x.p = y.p AND x.token = y.token AND x.root != y.root AND IF(x.out, y.to_out AND x.node < y.node, y.to_in)")
    fits = F.expr(f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) AND {2 * (100 + percent)} * (least(x.m - x.i, y.m - y.i) + 1) >= -(x.s + y.s)")
    pick = [F.col(f"{t}.{c}").alias(n) for t, names in (("x", ("a", "da", "na")), ("y", ("b", "db", "nb"))) for c, n in zip(("node", "d", "n"), names, strict=True)]
    return links, x.join(y, meet & fits).select(*pick)


def _prefixes(differences: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links within the stars, and the rows of the prefixes of differences, each with its place `i`.

    A pair of sets shares no fewer tokens of its differences than its s leave to be shared, and no fewer than either difference has over the tokens
    in which the pair may differ. The latter keeps prefixes of nodes far from their pivot as short as what they may differ in from a set of fitting
    size; their many tokens that only they have go first, so few or none of the shared ones need rows.
    """
    whole = 2 * (100 + percent)
    best = differences.groupBy("p").agg(F.max(F.struct("s", "node", "root")).alias("best"))
    marked = differences.join(best, "p").withColumn("far", F.col("s") + F.col("best.s") < 0)
    links = marked.where("NOT far AND node != best.node").select(F.col("node").alias("u"), F.col("best.node").alias("v"))
    joined = marked.where("NOT far").select("p", "root").distinct().withColumn("joined", F.lit(True))
    marked = marked.join(joined, ["p", "root"], "left").withColumn("root", F.when(F.col("joined"), F.col("best.root")).otherwise(F.col("root"))).withColumn("out", F.col("root") != F.col("best.root"))
    most = marked.groupBy("p").agg(F.max(F.when(F.col("out"), F.col("s"))).alias("s_out"), F.max("n").alias("n_most")).where("s_out IS NOT NULL")
    open_ = marked.join(most, "p").select("p", "node", "d", "n", "root", "m", "s", "out", F.col("best.s").alias("s_best"), "s_out", "n_most", "diff")
    tokens = open_.select("p", "node", "root", "out", F.explode("diff").alias("token"))
    shared = tokens.groupBy("p", "token").agg(F.count("*").alias("seen"), F.max("out").alias("of_out"), F.min("root").alias("low"), F.max("root").alias("high")).where("of_out AND low < high").select("p", "token", "seen")
    ranked = tokens.select("p", "node", "token").join(shared, ["p", "token"])
    # the other tokens come first, and need no rows: their number is the place of the first shared one
    places = ranked.withColumn("i", F.row_number().over(Window.partitionBy("p", "node").orderBy("seen", "token"))).withColumn("own", F.count("*").over(Window.partitionBy("p", "node")))
    rows = open_.drop("diff").join(places, ["p", "node"]).withColumn("i", F.col("m") - F.col("own") + F.col("i"))
    apart = F.floor((100 - percent) * (F.col("n") + F.least("n_most", F.floor(100 * F.col("n") / percent))) / (100 + percent))  # what a similar pair of this node may differ in
    least = lambda other: F.greatest(F.lit(1), F.ceil(-(F.col("s") + F.col(other)) / whole), F.col("m") - apart)
    rows = rows.withColumn("to_out", F.col("i") <= F.col("m") - least("s_out") + 1).withColumn("to_in", F.col("out") & (F.col("i") <= F.col("m") - least("s_best") + 1)).where("to_out OR to_in")
    return links, rows.select("p", "token", "node", "d", "n", "root", "m", "s", "i", "out", "to_out", "to_in")


def _nodes_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node"), F.col("da").alias("d")).union(pairs.select("b", "db"))


def _distinct(pairs: DataFrame) -> DataFrame:
    """The distinct pairs, the smaller node first."""
    return pairs.where("a != b").select(*[F.expr(f"IF(a < b, {x}, {y})").alias(x) for x, y in zip(_PAIR, [*_PAIR[3:], *_PAIR[:3]], strict=True)]).distinct()


def join(documents: DataFrame, text_col: str = "text", id_col: str = "doc_id", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: id, n_shingles, component_id (the smallest id that links reach, itself included), set_digest.

    Documents link when 100 * |intersection| >= percent * |union| of their distinct k-word shingles,
    words being runs of other bytes than white space, with A-Z lower-cased; a text of fewer words
    is one shingle. A null, empty or blank text has no shingles and links with nothing. percent
    must be over 50. Ids are integers; rows of equal sets are linked whatever their ids, and
    a component of rows without ids has a null component_id. An empty table gives no rows;
    further columns are ignored.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50 and at most 100")
    spark = documents.sparkSession
    docs = documents.select(F.col(id_col).cast("bigint").alias("__id"), F.col(text_col).alias("__text"))
    nodes = written(_nodes(docs, k, percent), "ngram-nodes")
    rows = written(nodes.select("id", "n", "d1", "d2"), "ngram-rows")
    once = nodes.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("id").alias("id"), F.first(F.struct("sigs", "places")).alias("s"), F.first("bits").alias("bits"))
    reps = written(once.withColumn("node", F.coalesce("id", F.expr(_NAMELESS))), "ngram-reps")
    drop_written(spark, nodes)
    index = reps.select(F.explode(F.arrays_zip("s.sigs", "s.places")).alias("s"), "node", F.col("d1").alias("d"), "n").select(F.col("s.sigs").alias("sig"), "node", "d", "n", F.col("s.places").alias("place"))
    shared = written(_shared(index, percent), "ngram-shared")
    bits, of_set = written(reps.select("node", "bits"), "ngram-bits"), written(reps.select("d1", "d2", "n", "node", "id"), "ngram-of-set")
    drop_written(spark, reps)
    parts = max(8, shared.count() // 200_000)  # few rows stay in few partitions, whatever the session's shuffle width
    tried = written(_open(_distinct(_pairs(shared.where("p_node IS NOT NULL"), "", "p_", percent)), bits, percent).coalesce(parts), "ngram-pairs")
    sets = written(_sets(docs, _nodes_of(tried), k), "ngram-sets")
    links = written(_links(tried, sets, percent).coalesce(parts), "ngram-links")
    drop_written(spark, sets)
    few, large = _apart(shared.select(_ROW), components(links), bits, percent)
    drop_written(spark, shared)
    found = written(_distinct(_all_pairs(few, percent)).join(tried.select("a", "b"), ["a", "b"], "left_anti").select(_PAIR).coalesce(parts), "ngram-pairs")
    stars = written(_stars(large).coalesce(parts), "ngram-stars")
    sets = written(_sets(docs, _nodes_of(found).union(stars.select("node", "d")).union(stars.select("p", "dp")), k), "ngram-sets")
    if not stars.isEmpty():
        differences = written(_differences(stars, sets, percent).coalesce(parts), "ngram-differences")
        within, more = _near_pivots(differences, percent)
        links = links.union(written(within.distinct().coalesce(parts), "ngram-links"))
        found = found.union(written(_distinct(more).join(tried.select("a", "b"), ["a", "b"], "left_anti").select(_PAIR).coalesce(parts), "ngram-pairs"))
        drop_written(spark, differences)
    links = links.union(written(_links(found, sets, percent).coalesce(parts), "ngram-links"))
    drop_written(spark, sets)
    roots = components(links)
    of_set = of_set.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = of_set.groupBy("root").agg(F.min("id").alias("component_id"))
    of_set = of_set.join(names, "root").select("d1", "d2", "n", "component_id")
    out = rows.select("id", "n", "d1", "d2").join(of_set, ["d1", "d2", "n"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"), F.struct("d1", "d2").alias("set_digest"))
