"""Quality classifier: Bradley-Terry pairwise ranking over surface features of a text.

A document's worth is a linear function of its features. It is learned from preference pairs
(a document labelled 1 is preferred to one labelled 0): under Bradley-Terry the probability of
a preference is the logistic function of the difference of worths, so the weights minimise
logistic loss on differences of features. The worth at the quantile that matches the share
of label 0 becomes the threshold, and scores are scaled so that it lies at THRESHOLD.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out
from .mapping import with_text_columns
from .textvec import LETTERS, NOT_SPACE, hash_spans, lower_latin, spans

#: Score from which a document is kept.
THRESHOLD = 0.3
#: At most so many labelled rows and preference pairs are used in fitting; rows are taken in the order of a hash of their id.
MAX_FIT_ROWS, MAX_PAIRS = 20_000, 40_000

FEATURES = ["log_words", "mean_word", "upper", "symbols", "marks", "digits", "pipes", "adjacent_repeats", "distinct", "lines", "shouted_words", "repeated_lines"]

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_LOWER[128:] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*@^~<>{}[]\\_=+"]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "!?"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_NOT_NEWLINE = np.ones(256, bool)
_NOT_NEWLINE[10] = False


def _per_doc(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return (total[offs[1:]] - total[offs[:-1]]).astype(np.float64)


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((h, doc))
    d, s = doc[order], h[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1])
    return np.bincount(d[new], minlength=n).astype(np.float64)


def features(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row per document, one column per entry of FEATURES; an empty text has zeros."""
    n = len(offs) - 1
    size = np.maximum(1.0, (offs[1:] - offs[:-1]).astype(np.float64))
    starts, ends, doc = spans(raw, offs, NOT_SPACE)
    words = np.bincount(doc, minlength=n).astype(np.float64)
    w = np.maximum(1.0, words)
    h = hash_spans(lower_latin(raw), starts, ends)
    same = (doc[1:] == doc[:-1]) & (h[1:] == h[:-1])
    upper = _per_doc(_UPPER[raw], offs)
    letters = np.maximum(1.0, _per_doc(LETTERS[raw], offs))
    capital = np.concatenate([[0], np.cumsum(_UPPER[raw], dtype=np.int64)])
    small = np.concatenate([[0], np.cumsum(_LOWER[raw], dtype=np.int64)])
    shouted = (capital[ends] - capital[starts] >= 2) & (small[ends] == small[starts])
    ls, le, ldoc = spans(raw, offs, _NOT_NEWLINE)
    lines = np.bincount(ldoc, minlength=n).astype(np.float64)
    lh = hash_spans(raw, ls, le)
    return np.column_stack([
        np.log1p(words),
        np.minimum(20.0, np.bincount(doc, weights=ends - starts, minlength=n) / w),
        upper / letters,
        _per_doc(_SYMBOL[raw], offs) / size,
        _per_doc(_MARK[raw], offs) / w,
        _per_doc(_DIGIT[raw], offs) / size,
        _per_doc(raw == ord("|"), offs) / w,
        np.bincount(doc[1:][same], minlength=n) / w,
        _distinct(doc, h, n) / w,
        lines / w,
        np.bincount(doc[shouted], minlength=n) / w,
        1.0 - _distinct(ldoc, lh, n) / np.maximum(1.0, lines),
    ])


@dataclass(frozen=True)
class Ranking:
    """score = logistic(weights . z + bias), z being the features in standard units, clipped as they were for learning."""

    weights: tuple[float, ...]
    bias: float
    mean: tuple[float, ...]
    scale: tuple[float, ...]

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = _standard(x, np.array(self.mean), np.array(self.scale)) @ np.array(self.weights) + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -8, 8)


def fit_pairs(x: np.ndarray, y: np.ndarray, threshold: float = THRESHOLD, max_pairs: int = MAX_PAIRS, ridge: float = 1e-3) -> Ranking:
    """Bradley-Terry by Newton's method on differences of features. Without both labels every document scores 0.5."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Ranking((0.0,) * x.shape[1], 0.0, (0.0,) * x.shape[1], (1.0,) * x.shape[1])
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = _standard(x, mean, scale)
    rng = np.random.default_rng(11)
    n = min(max_pairs, 4 * len(y))
    diff = z[rng.choice(good, n)] - z[rng.choice(bad, n)]
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1.0 / (1.0 + np.exp(-np.clip(diff @ w, -30, 30)))
        grad = diff.T @ (1.0 - p) / n - ridge * w
        hess = (diff * (p * (1.0 - p))[:, None]).T @ diff / n + (ridge + 1e-9) * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    worth = np.sort(z @ w)
    k = int(np.clip(len(bad), 1, len(worth) - 1))  # the quantile of the share of label 0
    cut = (worth[k - 1] + worth[k]) / 2
    spread = max(float(np.subtract(*np.quantile(worth, [0.95, 0.05]))), 1e-9)
    gain = 12.0 / spread
    bias = -gain * cut + float(np.log(threshold / (1 - threshold)))
    return Ranking(tuple(map(float, gain * w)), bias, tuple(map(float, mean)), tuple(map(float, scale)))


def with_features(df: DataFrame, text_col: str = "text") -> DataFrame:
    fields = [T.StructField("__features", T.ArrayType(T.DoubleType()))]
    return with_text_columns(df, text_col, fields, lambda raw, offs: [list(features(raw, offs))])


def fit(documents: DataFrame, labels: DataFrame, label_col: str = "quality", text_col: str = "text", id_col: str = "doc_id", max_rows: int = MAX_FIT_ROWS) -> Ranking:
    """Learns from labelled rows that aren't held out, max_rows of them at most, in the order of a hash of the id.

    The labels are bounded before any features are made, so only the sample's documents are, and the
    join is by broadcast of max_rows rows. Only features and labels of that sample reach the driver. Rows without an id or a label
    teach nothing; an id with several labels takes the largest; repeated documents each count.
    """
    known = (
        labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y"))
        .where(F.col("__y").isNotNull() & ~held_out("__id", 5, 0))
        .groupBy("__id").agg(F.max("__y").alias("__y"))
        .orderBy(F.xxhash64("__id"), "__id").limit(max_rows)
    )
    sample = documents.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(known), "__id")
    rows = with_features(sample, "__text").orderBy(F.xxhash64("__id"), "__id").limit(max_rows).select("__features", "__y").toPandas()  # copies of an id may be more rows than ids
    x = np.array(rows["__features"].tolist(), dtype=float).reshape(len(rows), len(FEATURES))
    return fit_pairs(x, rows["__y"].to_numpy(dtype=int))


def with_score(df: DataFrame, model: Ranking, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df with score (0 to 1) and predicted (1 if score >= threshold); columns of these names are replaced. Null and empty texts are scored alike."""
    fields = [T.StructField("score", T.DoubleType())]
    out = with_text_columns(df.drop("predicted"), text_col, fields, lambda raw, offs: [model.scores(features(raw, offs))])
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(documents: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The documents that the classifier doesn't reject, with their own columns."""
    scored = with_score(documents.withColumns({f"__own_{c}": F.col(c) for c in ("score", "predicted") if c in documents.columns}), fit(documents, labels, text_col=text_col, id_col=id_col), text_col)
    return scored.where("predicted = 1").select(*[F.col(f"__own_{c}").alias(c) if c in ("score", "predicted") else F.col(c) for c in documents.columns])
