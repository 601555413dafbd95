"""Fill-in-middle: a text is cut in prefix, middle and suffix, and written with the middle last.

Cuts count units, `[A-Za-z]+|[^A-Za-z]` over code points. A text's UTF-8 bytes are taken in fixed
blocks; a Fenwick tree over them holds how many units and how many code points begin in each.
A cut after c units begins unit c: binary lifting descends the tree to the block that holds that
beginning, with the units and code points before the block, and the boundary is looked for in
that block alone. The trees of many documents are built and descended together.

Which documents are transformed, in which form and where they are cut, follows from a seeded hash of
the id, so every run and every partitioning gives the same output.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textvec import chunks

#: Bytes of a block.
BLOCK = 512
#: What stands before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


class BlockTrees:
    """A Fenwick tree for each text of a run of non-empty texts, given as bytes and the offsets between them."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray, block: int = BLOCK):
        letter, self.lead = _LETTER[raw], (raw & 0xC0) != 0x80
        self.unit = self.lead.copy()
        self.unit[1:] &= ~(letter[1:] & letter[:-1])
        self.unit[offs[:-1]] = True
        self.offs, self.block, size = offs, block, np.diff(offs)
        self.blocks = -(-size // block)
        self.base = np.concatenate([[0], np.cumsum(self.blocks)[:-1]])
        self.place = np.arange(int(self.blocks.sum())) - np.repeat(self.base, self.blocks)
        starts = np.repeat(offs[:-1], self.blocks) + block * self.place
        self.units = np.add.reduceat(self.unit, starts, dtype=np.int64)
        self.points = np.add.reduceat(self.lead, starts, dtype=np.int64)
        step = 1
        while step < self.blocks.max():  # node i (from 1) gets the sum of the i & -i blocks up to block i
            at = np.flatnonzero((self.place + 1) % (2 * step) == 0)
            self.units[at] += self.units[at - step]
            self.points[at] += self.points[at - step]
            step *= 2

    def totals(self) -> np.ndarray:
        """The number of units of each text."""
        at, n = self.blocks.copy(), np.zeros(len(self.blocks), np.int64)
        while at.any():
            n += np.where(at > 0, self.units[self.base + np.maximum(at, 1) - 1], 0)
            at -= at & -at
        return n

    def cuts(self, which: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(byte in the text, code points before it) of the boundary after so many units, for some of the texts."""
        base, blocks = self.base[which], self.blocks[which]
        at, left, points = np.zeros(len(which), np.int64), after.copy(), np.zeros(len(which), np.int64)
        step = 1 << int(blocks.max()).bit_length() - 1 if len(which) else 0
        while step:
            node = base + np.minimum(at + step, blocks) - 1
            take = (at + step <= blocks) & (self.units[node] <= left)
            left -= np.where(take, self.units[node], 0)
            points += np.where(take, self.points[node], 0)
            at += step * take
            step >>= 1
        byte = np.minimum(at * self.block, np.diff(self.offs)[which])
        for i in np.flatnonzero(at < blocks).tolist():
            first = int(self.offs[which[i]] + byte[i])
            inside = int(np.flatnonzero(self.unit[first : first + self.block])[left[i]])
            byte[i] += inside
            points[i] += np.count_nonzero(self.lead[first : first + inside])
        return byte, points


def _draws(id_col: str, seed: str) -> list[Column]:
    """Four 32-bit numbers from the hash of seed and id; a null id counts as the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint").alias(f"__h{i + 1}") for i in range(4)]


_MADE = T.StructType([T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())])


def transform(documents: DataFrame, text_col: str = "text", id_col: str = "doc_id", seed: str = "1", percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """documents with n (units), form, prefix_chars, middle_chars and output; columns of these names are replaced, all others pass through.

    percent of the documents are transformed, spm_percent of these as suffix, prefix, middle ("spm"),
    the others as prefix, suffix, middle ("psm"). A text that is null, empty or contains a sentinel
    stays as it is (form "plain", output the text or "", null counts of characters), since only
    texts without sentinels can be restored. Repeated rows of one id and text come out alike;
    rows that share an id draw the same numbers. An empty table gives no rows. Whole texts are cut, however long.
    """
    made = {f.name for f in _MADE}
    kept = documents.select([c for c in documents.columns if c not in made or c in (text_col, id_col)])
    if made & {text_col, id_col}:
        raise ValueError(f"the text and id columns can't have the names {sorted(made)}")
    passed = [f"__c{i}" for i in range(len(kept.columns))]  # columns may have any names, even the helpers'
    given = kept.select(*[F.col(f"`{c}`").alias(p) for c, p in zip(kept.columns, passed, strict=True)], F.col(f"`{text_col}`").cast("string").alias("__text"), *_draws(f"`{id_col}`", seed))
    schema = T.StructType([*(T.StructField(p, f.dataType) for p, f in zip(passed, kept.schema, strict=True)), *_MADE])
    first_extra = len(passed)
    signs = [s.encode() for s in (PREFIX, SUFFIX, MIDDLE)]

    def forms(raw: bytes, offs: list[int], h: list[np.ndarray]) -> tuple[list, ...]:
        size = np.diff(offs)
        full = np.flatnonzero(size)
        n = np.zeros(len(size), np.int64)
        form = ["plain"] * len(size)
        prefix, middle, out = [None] * len(size), [None] * len(size), [raw[a:b] for a, b in zip(offs[:-1], offs[1:], strict=True)]
        if not len(full):
            return n, form, prefix, middle, out
        trees = BlockTrees(np.frombuffer(raw, np.uint8), np.array(offs)[np.append(full, len(size))])
        n[full] = trees.totals()
        cut = np.flatnonzero([h[2][i] % 100 < percent and not any(s in out[i] for s in signs) for i in full])
        at = full[cut]
        one, two = h[0][at] % (n[at] + 1), h[1][at] % (n[at] + 1)
        a, chars_a = trees.cuts(cut, np.minimum(one, two))
        b, chars_b = trees.cuts(cut, np.maximum(one, two))
        for i, x, y, before, upto in zip(at.tolist(), a.tolist(), b.tolist(), chars_a.tolist(), chars_b.tolist(), strict=True):
            text = out[i]
            head, mid, tail = text[:x], text[x:y], text[y:]
            form[i] = "spm" if h[3][i] % 100 < spm_percent else "psm"
            out[i] = b"".join((signs[1], tail, signs[0], head, signs[2], mid) if form[i] == "spm" else (signs[0], head, signs[1], tail, signs[2], mid))
            prefix[i], middle[i] = before, upto - before
        return n, form, prefix, middle, out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            h = [np.asarray(batch.column(first_extra + 1 + i)) for i in range(4)]
            for first, end, raw, offs in chunks(batch.column(first_extra)):
                n, form, prefix, middle, out = forms(raw.tobytes(), offs.tolist(), [x[first:end] for x in h])
                part = batch.slice(first, end - first)
                arrays = [pa.array(n), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns[:first_extra], *arrays], names=schema.names)

    found = given.mapInArrow(run, schema)
    return found.select(*[F.col(p).alias(c) for p, c in zip(passed, kept.columns, strict=True)], *[F.col(f.name) for f in _MADE])


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made of; only sentinels that transform() wrote are in a transformed output, so each is found once."""
    after = lambda text, sign: F.split_part(text, F.lit(sign), F.lit(2))
    before = lambda text, sign: F.split_part(text, F.lit(sign), F.lit(1))
    out = F.col(output)
    middle = after(out, MIDDLE)
    psm = F.concat(before(after(out, PREFIX), SUFFIX), middle, before(after(out, SUFFIX), MIDDLE))
    spm = F.concat(before(after(out, PREFIX), MIDDLE), middle, before(after(out, SUFFIX), PREFIX))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(out)
