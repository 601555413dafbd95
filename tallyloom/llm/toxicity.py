"""Toxicity by weak supervision.

Voters are lexicons (one fixed, others mined from labelled rows: words and word beginnings that
mark label 1, chosen by greedy cover so that words which merely stand beside them stay out) and
patterns (shouting, exclamation marks, several hits, dense hits). A generative label model
estimates how often each voter fires under either latent class by EM over the counts of vote
vectors of all documents, labelled training rows clamped; correlations of voters beyond the
class lower the weight of voters that repeat each other. Its posteriors are the soft labels
on which a linear classifier over the lexicon entries is trained; the classifier gives the score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_written, held_out, written
from .mapping import with_text_columns
from .textvec import LETTERS, SpanHasher, chunks, lower_latin, spans

#: Score from which a document counts as toxic.
THRESHOLD = 0.7
#: Labelled rows that are learned from, at most.
MAX_FIT_ROWS = 20_000
#: The classifier's prior is worth ridge times its rows, but of no more than so many.
PRIOR_ROWS = 10_000
#: A mined entry needs so many toxic rows, and this share of its rows toxic.
MIN_SUPPORT, MIN_PRECISION = 3, 0.9
#: Lengths in bytes of the word beginnings that are mined beside whole words (0).
KINDS = (0, 4, 5, 6, 7, 8)

# An insult lexicon, nouns and adjectives.
NOUNS = ["clown", "dumbass", "fool", "garbage", "idiot", "imbecile", "jerk", "loser", "moron", "scum", "trash", "vermin"]
ADJECTIVES = ["disgusting", "pathetic", "repulsive", "stupid", "worthless"]

GROUPS = 6
VOTERS = ["nouns", "adjectives", *[f"mined{i}" for i in range(GROUPS)], "several_hits", "dense_hits", "shouting", "exclaiming"]


def _hash_words(words: list[str]) -> np.ndarray:
    raw = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in words])
    return SpanHasher(raw)(np.concatenate([[0], ends[:-1]]), ends)


def _entries(raw: np.ndarray, offs: np.ndarray):
    """Per kind: the document and hash of each word or word beginning; also the words' spans and documents."""
    low = lower_latin(raw)
    starts, ends, doc = spans(low, offs, LETTERS)
    hasher = SpanHasher(low)
    found = []
    for kind in KINDS:
        if kind == 0:
            found.append((doc, hasher(starts, ends)))
        else:
            long = ends - starts >= kind
            found.append((doc[long], hasher(starts[long], starts[long] + kind, kind)))
    return found, starts, ends, doc


def _hits(found, lexicon: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, entry) of each occurrence of a lexicon entry; lexicon is sorted, by gives its entries' numbers."""
    docs, idx = [], []
    if len(lexicon):
        for doc, h in found:
            at = np.minimum(np.searchsorted(lexicon, h), len(lexicon) - 1)
            hit = lexicon[at] == h
            docs.append(doc[hit])
            idx.append(by[at[hit]])
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(docs), np.concatenate(idx)


_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True


@dataclass(frozen=True)
class Lexicon:
    """Sorted hashes; entry number of each: fixed nouns, fixed adjectives, then mined ones."""

    hashes: np.ndarray
    numbers: np.ndarray
    size: int

    @staticmethod
    def of(mined: np.ndarray) -> Lexicon:
        fixed = _hash_words([*NOUNS, *ADJECTIVES])
        mined = mined[~np.isin(mined, fixed)]
        every = np.concatenate([fixed, mined])
        by = np.argsort(every)
        return Lexicon(every[by], by, len(every))

    def read(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (document, entry) pairs, and each document's votes as bits in the order of VOTERS."""
        n = len(offs) - 1
        found, starts, ends, doc = _entries(raw, offs)
        docs, idx = _hits(found, self.hashes, self.numbers)
        words = np.maximum(1, np.bincount(doc, minlength=n))
        dense = 50 * np.bincount(docs[idx < len(NOUNS) + len(ADJECTIVES)], minlength=n) >= words
        pairs = np.unique(docs * self.size + idx) if len(docs) else np.zeros(0, np.int64)
        docs, idx = pairs // self.size, pairs % self.size
        votes = np.zeros(n, np.int64)
        nouns, fixed = len(NOUNS), len(NOUNS) + len(ADJECTIVES)
        voter = np.where(idx < nouns, 0, np.where(idx < fixed, 1, 2 + (idx - fixed) % GROUPS))
        np.bitwise_or.at(votes, docs, np.left_shift(1, voter))
        several = np.bincount(docs, minlength=n) >= 2
        capital = np.concatenate([[0], np.cumsum(_CAPITAL[raw])])
        shouted = np.bincount(doc, weights=(capital[ends] - capital[starts] == ends - starts) & (ends - starts >= 2), minlength=n)
        marks = np.concatenate([[0], np.cumsum(raw == ord("!"))])
        bits = (several, dense, 5 * shouted >= words, 20 * (marks[offs[1:]] - marks[offs[:-1]]) >= words)
        for i, b in enumerate(bits):
            votes |= np.left_shift(b.astype(np.int64), 2 + GROUPS + i)
        return docs, idx, votes


def _lists(docs: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(docs, minlength=n))]), pa.int32()), pa.array(values.astype(np.int32)))


def with_votes(df: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    fields = [T.StructField("__hits", T.ArrayType(T.IntegerType())), T.StructField("__votes", T.LongType())]

    def compute(raw, offs):
        docs, idx, votes = lexicon.read(raw, offs)
        return [_lists(docs, idx, len(offs) - 1), votes]

    return with_text_columns(df, text_col, fields, compute)


def _mine(known: DataFrame) -> np.ndarray:
    """Entries that mark label 1 in known(__text, __y), whose texts are distinct: all that pass support and precision, then a greedy cover of the toxic rows, each covered twice where it can be.

    Of entries that stand in the same toxic rows the cover can use two, so only the first two go to the driver.
    """

    def count(batches):
        for batch in batches:
            y = np.asarray(batch.column(batch.schema.get_field_index("__y")))
            for first, end, raw, offs in chunks(batch.column(batch.schema.get_field_index("__text"))):
                label = y[first:end].astype(np.uint64)
                marks = SpanHasher(raw)(offs[:-1], offs[1:]) * label
                docs, found = [], []
                for doc, h in _entries(raw, offs)[0]:
                    by = np.lexsort((h, doc))
                    d, s = doc[by], h[by]
                    new = np.ones(len(d), bool)
                    new[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1])
                    docs.append(d[new])
                    found.append(s[new])
                d = np.concatenate(docs)
                h, inverse = np.unique(np.concatenate(found), return_inverse=True)
                toxic = np.bincount(inverse, weights=label[d].astype(np.int64), minlength=len(h)).astype(np.int64)
                rows = np.bincount(inverse, minlength=len(h))
                where = np.zeros(len(h), np.uint64)
                np.bitwise_xor.at(where, inverse, marks[d])
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(toxic), pa.array(rows), pa.array(where.view(np.int64))], names=["h", "toxic", "rows", "where"])

    counted = known.mapInArrow(count, "h bigint, toxic bigint, rows bigint, where bigint").groupBy("h").agg(F.sum("toxic").alias("toxic"), F.sum("rows").alias("rows"), F.bit_xor("where").alias("where"))
    passed = counted.where((F.col("toxic") >= MIN_SUPPORT) & (F.col("toxic") >= MIN_PRECISION * F.col("rows")))
    first = F.row_number().over(Window.partitionBy("toxic", "where").orderBy("rows", "h"))
    best = passed.withColumn("at", first).where("at <= 2").select("toxic", "rows", "h").toPandas().sort_values(["toxic", "rows", "h"], ascending=[False, True, True])
    if not len(best):
        return np.zeros(0, np.uint64)
    hashes = best["h"].to_numpy(np.int64).view(np.uint64)
    by = np.argsort(hashes)
    ordered = hashes[by]

    def find(raw, offs):
        docs, idx = _hits(_entries(raw, offs)[0], ordered, by)
        pairs = np.unique(docs * len(ordered) + idx) if len(docs) else np.zeros(0, np.int64)
        return [_lists(pairs // len(ordered), pairs % len(ordered), len(offs) - 1)]

    toxic = with_text_columns(known.where("__y = 1"), "__text", [T.StructField("__found", T.ArrayType(T.IntegerType()))], find).select("__found").toArrow()
    return hashes[cover(*_flat(toxic.column(0)), len(hashes))]


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bounds of each list in the values of all, and these values."""
    sizes = lists.combine_chunks().value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), values


def cover(offs: np.ndarray, entry: np.ndarray, size: int) -> list[int]:
    """Greedy: the entry that stands in the most rows not yet covered twice, the first of equal ones, as long as these are MIN_SUPPORT. Row i has entry[offs[i]:offs[i + 1]]."""
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    by = np.argsort(entry, kind="stable")
    starts = np.searchsorted(entry[by], np.arange(size + 1))
    need = np.full(len(offs) - 1, 2)
    gain = np.bincount(entry, minlength=size)
    chosen: list[int] = []
    while size:
        k = int(gain.argmax())
        if gain[k] < MIN_SUPPORT:
            break
        chosen.append(k)
        rows = row[by[starts[k] : starts[k + 1]]]
        rows = rows[need[rows] > 0]
        need[rows] -= 1
        for i in rows[need[rows] == 0].tolist():
            gain[entry[offs[i] : offs[i + 1]]] -= 1
        gain[k] = 0
        # later rows that are covered would take gain[k] below 0, which is never chosen
    return chosen


def label_model(masks: np.ndarray, counts: np.ndarray, known_masks: np.ndarray, known_y: np.ndarray, rounds: int = 40) -> np.ndarray:
    """The posterior of label 1 for each of masks.

    Semi-supervised EM: a_j, b_j are the chances that voter j fires under label 1 and 0. After it,
    the correlation of each two voters given the label is estimated, and a voter's log-likelihood
    ratio is divided by one plus the correlations it shares; the prior follows the labels.
    """
    v = len(VOTERS)
    x = (masks[:, None] >> np.arange(v) & 1).astype(float)
    kx = (known_masks[:, None] >> np.arange(v) & 1).astype(float)
    if not len(known_y) or known_y.min() == known_y.max():  # no anchor: the lexicon voters' own say
        post = np.where(x[:, : 2 + GROUPS].any(axis=1), 0.9, 0.05)
        kx, known_y = kx[:0], known_y[:0]
    else:
        one, none = kx[known_y == 1], kx[known_y == 0]
        a, b = (one.sum(0) + 0.5) / (len(one) + 1), (none.sum(0) + 0.5) / (len(none) + 1)
        post = 1 / (1 + np.exp(-np.clip(x @ np.log(a / b) + (1 - x) @ np.log((1 - a) / (1 - b)) + np.log(max(len(one), 1) / max(len(none), 1)), -30, 30)))
    weight = counts.astype(float)
    anchor = max(1.0, weight.sum() / max(1, len(known_y)))  # labelled rows weigh as much as the rest together
    for _ in range(rounds):
        w1, w0 = weight * post, weight * (1 - post)
        k1, k0 = anchor * (known_y == 1), anchor * (known_y == 0)
        n1, n0 = w1.sum() + k1.sum(), w0.sum() + k0.sum()
        a, b = (w1 @ x + k1 @ kx + 0.5) / (n1 + 1), (w0 @ x + k0 @ kx + 0.5) / (n0 + 1)
        prior = (n1 + 0.5) / (n1 + n0 + 1)
        shared = np.ones(v)
        for w, k, m in ((w1, k1, a), (w0, k0, b)):
            every, wt = np.concatenate([x, kx]) - m, np.concatenate([w, k])
            cov = (every * wt[:, None]).T @ every / max(wt.sum(), 1e-9)
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            shared += np.clip(cov / np.outer(sd, sd) - np.eye(v), 0, 1).sum(0) / 2
        llr1, llr0 = np.log(a / b) / shared, np.log((1 - a) / (1 - b)) / shared
        new = 1 / (1 + np.exp(-np.clip(x @ llr1 + (1 - x) @ llr0 + np.log(prior / (1 - prior)), -30, 30)))
        if np.abs(new - post).max() < 1e-6:
            break
        post = new
    return post


def _design(offs: np.ndarray, hits: np.ndarray, size: int) -> np.ndarray:
    """Presence of each lexicon entry, any hit, two or more hits, and a constant."""
    many = np.diff(offs)
    x = np.zeros((len(many), size + 3), np.float32)
    x[np.repeat(np.arange(len(many)), many), hits] = 1
    x[:, size] = many >= 1
    x[:, size + 1] = many >= 2
    x[:, size + 2] = 1
    return x


def _sums(offs: np.ndarray, hits: np.ndarray, size: int, soft: np.ndarray, counts: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What some patterns add to the gradient and the Hessian of the logistic loss at w. Pattern i has hits[offs[i]:offs[i + 1]] and stands for counts[i] rows."""
    grad, hess = np.zeros(len(w)), np.zeros((len(w), len(w)))
    step_rows = max(1, 1_000_000 // len(w))  # bounds the part of the design that is held at once
    for first in range(0, len(soft), step_rows):
        end = min(first + step_rows, len(soft))
        x = _design(offs[first : end + 1] - offs[first], hits[offs[first] : offs[end]], size)
        p, n = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), counts[first:end]
        grad += x.T @ ((soft[first:end] - p) * n)
        hess += (x * (p * (1 - p) * n)[:, None]).T @ x
    return grad, hess


def newton(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], size: int, total: float, ridge: float = 3e-4, rounds: int = 50) -> np.ndarray:
    """Logistic regression on soft labels of `total` rows by Newton's method; the constant isn't shrunk. sums(w) is what all rows add to the gradient and the Hessian."""
    w = np.zeros(size + 3)
    if not total:
        return w
    shrink = np.full(len(w), ridge * min(1, PRIOR_ROWS / total))
    shrink[-1] = 1e-6
    for _ in range(rounds):
        grad, hess = sums(w)
        step = np.linalg.solve(np.diag(shrink + 1e-7 * min(1, PRIOR_ROWS / total)) + hess / total, grad / total - shrink * w)
        w += step
        if np.abs(step).max() < 1e-5:
            break
    return w


def train(offs: np.ndarray, hits: np.ndarray, size: int, soft: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """newton() over patterns that are held here."""
    return newton(lambda w: _sums(offs, hits, size, soft, counts, w), size, float(counts.sum()))


#: Sums of so many groups of tasks reach the driver in a round of training.
FAN_IN = 8


def _spark_sums(patterns: DataFrame, size: int, posterior: np.ndarray) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """sums() for newton() over a table of patterns (__hits, __votes, n), by a job for each w. Only sums leave the tasks, of a size that the lexicon sets; these meet in FAN_IN groups first."""
    schema = "part int, grad binary, hess binary"

    def row(part: int, grad: np.ndarray, hess: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([grad.tobytes()], pa.binary()), pa.array([hess.tobytes()], pa.binary())], names=["part", "grad", "hess"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grad, hess = np.zeros(size + 3), np.zeros((size + 3, size + 3))
        for batch in batches:
            for g, h in zip(batch.column("grad"), batch.column("hess"), strict=True):
                grad += np.frombuffer(g.as_py())
                hess += np.frombuffer(h.as_py()).reshape(hess.shape)
        yield row(key[0].as_py(), grad, hess)

    def at(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grad, hess = np.zeros(size + 3), np.zeros((size + 3, size + 3))
            for batch in batches:
                offs, hits = _flat(pa.chunked_array([batch.column("__hits")]))
                g, h = _sums(offs, hits, size, posterior[np.asarray(batch.column("__votes")).astype(np.int64)], np.asarray(batch.column("n")).astype(float), w)
                grad += g
                hess += h
            yield row(TaskContext.get().partitionId() % FAN_IN, grad, hess)

        found = patterns.mapInArrow(run, schema).groupBy("part").applyInArrow(add, schema).collect()
        return sum((np.frombuffer(r.grad) for r in found), np.zeros(size + 3)), sum((np.frombuffer(r.hess).reshape(size + 3, size + 3) for r in found), np.zeros((size + 3, size + 3)))

    return at


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    weights: np.ndarray

    def scores(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        n, size = len(offs) - 1, self.lexicon.size
        docs, idx, _ = self.lexicon.read(raw, offs)
        hits = np.bincount(docs, minlength=n)
        z = np.bincount(docs, weights=self.weights[idx], minlength=n) + self.weights[size] * (hits >= 1) + self.weights[size + 1] * (hits >= 2) + self.weights[size + 2]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(documents: DataFrame, labels: DataFrame, label_col: str = "toxic", text_col: str = "text", id_col: str = "doc_id") -> Model:
    """Learns from labelled rows that aren't held out (MAX_FIT_ROWS of them at most, in the order of a hash of the id) and from the votes on all documents, each pattern of hits and votes weighing as often as it occurs.

    Rows without an id or a label teach nothing; an id with several labels takes the largest. Entries are
    mined from distinct texts, so copies count once; a text with several labels takes the largest there.
    Without labels the fixed lexicon alone speaks.
    """
    known = (
        labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y"))
        .where(F.col("__y").isNotNull() & ~held_out("__id", 3, 1))
        .groupBy("__id").agg(F.max("__y").alias("__y"))
        .orderBy(F.xxhash64("__id"), "__id").limit(MAX_FIT_ROWS)
    )
    docs = documents.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    labelled = docs.join(F.broadcast(known), "__id").select("__text", "__y")  # MAX_FIT_ROWS bounds what is broadcast
    texts = written(labelled.groupBy("__text").agg(F.max("__y").alias("__y")), "toxicity-texts")
    lexicon = Lexicon.of(_mine(texts))
    drop_written(documents.sparkSession, texts)
    taught = with_votes(labelled, lexicon, "__text").select("__votes", "__y").toPandas()
    patterns = written(with_votes(docs, lexicon, "__text").groupBy("__hits", "__votes").agg(F.count("*").alias("n")), "toxicity-patterns")
    votes = patterns.groupBy("__votes").agg(F.sum("n").alias("n")).orderBy("__votes").toPandas()  # 2 ** len(VOTERS) rows at most
    masks, counts = votes["__votes"].to_numpy(np.int64), votes["n"].to_numpy(np.int64)
    posterior = np.zeros(1 << len(VOTERS))
    if len(masks):
        posterior[masks] = label_model(masks, counts, taught["__votes"].to_numpy(np.int64), taught["__y"].to_numpy(np.int64))
    weights = newton(_spark_sums(patterns, lexicon.size, posterior), lexicon.size, float(counts.sum()))
    drop_written(documents.sparkSession, patterns)
    return Model(lexicon, weights)


def with_score(df: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df with score (0 to 1) and predicted (1 if score >= threshold); columns of these names are replaced. Null and empty texts get the score of a text without any hit."""
    out = with_text_columns(df.drop("predicted"), text_col, [T.StructField("score", T.DoubleType())], lambda raw, offs: [model.scores(raw, offs)])
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
