"""Audit of how far sources differ in their words, language by language.

Counting is an Arrow pipeline inside mapInArrow: ascii_lower, split_pattern_regex and
dictionary_encode make (document, term) columns of a run of texts, a hash group_by counts each document's terms
and another one adds up the occurrences and the documents of each (lang, source, term). A task merges these partial
counts until there are MERGE_ROWS of them and passes them on; Spark adds up the tasks' counts.

Each language keeps the terms of at least `least_docs` of its documents. A group's (lang, source)
smoothed share of a term is a whole number of billionths, so all arithmetic is exact.
For the distances between groups the counts of a language are dealt by term into columnar shards of about SHARD_ROWS
rows. A shard fills a matrix of groups by terms, a bounded part at a time, sums the
absolute differences of its rows, and Spark adds up the shards. So no task holds a language or a source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, written
from .textvec import chunks

#: Bytes of text that are split at a time, rows of partial counts that a task merges at most, rows of a shard, and cells of a shard's matrix that are filled at a time.
TEXT_BYTES, MERGE_ROWS, SHARD_ROWS, CELLS = 4 << 20, 500_000, 10_000, 1 << 20
#: Billionths; the smallest number of documents of a kept term; what is added to each count.
UNIT, LEAST_DOCS, SMOOTH = 1_000_000_000, 30, 5
#: Fixed value: what separates terms once A-Z are lower-cased.
SEPARATOR = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"

_KEY = ["lang", "source", "term"]


def _counted(langs: pa.Array, sources: pa.Array, texts: pa.Array) -> pa.Table:
    """lang, source, term, n (occurrences), docs of some documents; a row without a term for each group."""
    terms = pc.split_pattern_regex(pc.ascii_lower(texts), SEPARATOR)
    codes = pc.list_flatten(terms).dictionary_encode()
    full = pc.not_equal(pc.binary_length(codes.dictionary), 0)  # what stands before the first and after the last separator
    rows = pa.table({"row": pc.list_parent_indices(terms), "code": codes.indices})
    rows = rows.filter(pc.take(full, codes.indices))
    each = rows.group_by(["row", "code"], use_threads=False).aggregate([([], "count_all")])
    row = each["row"].combine_chunks()
    table = pa.table({"lang": langs.take(row), "source": sources.take(row), "term": codes.dictionary.take(each["code"].combine_chunks()), "n": each["count_all"], "docs": pa.array(np.ones(len(row), np.int64))})
    groups = pa.table({"lang": langs, "source": sources}).group_by(["lang", "source"], use_threads=False).aggregate([])
    none = pa.table({"lang": groups["lang"], "source": groups["source"], "term": pa.nulls(len(groups), table.schema.field("term").type), "n": pa.array(np.zeros(len(groups), np.int64)), "docs": pa.array(np.zeros(len(groups), np.int64))})
    return _merged([table, none])


def _merged(tables: list[pa.Table]) -> pa.Table:
    summed = pa.concat_tables(tables).group_by(_KEY, use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return summed.rename_columns([c.removesuffix("_sum") for c in summed.column_names]).select([*_KEY, "n", "docs"])


def term_counts(documents: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n, docs over all documents, and a row with a null term for every group; nulls count as ''."""
    given = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged, waiting, rows = [], [], 0
        for batch in batches:
            for first, end, _, _ in chunks(batch.column(2), TEXT_BYTES):
                part = batch.slice(first, end - first)
                waiting.append(_counted(*part.columns))
                rows += len(waiting[-1])
                if rows > MERGE_ROWS:
                    merged = [_merged([*merged, *waiting])]
                    waiting, rows = [], 0
                    if len(merged[0]) > MERGE_ROWS:
                        yield from merged[0].to_batches()
                        merged = []
        if merged or waiting:
            yield from _merged([*merged, *waiting]).combine_chunks().to_batches()

    partial = given.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    return partial.groupBy(*_KEY).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: str, total: str, terms: str) -> Column:
    """The smoothed share in billionths, rounded down, and 1. Decimals of 38 digits hold the product of any counts, so it is exact."""
    return F.expr(f"1 + (cast({UNIT} AS decimal(10,0)) * cast({count} + {SMOOTH} AS decimal(20,0))) div cast({total} + {SMOOTH} * {terms} AS decimal(20,0))")


def kept_counts(merged: DataFrame, least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """(counts, groups) of the kept terms.

    counts: lang, source, term, p and q (the group's and the language's share), where the group has the term, and its shard.
    groups: lang, source, p0 (the group's share of a kept term that it hasn't got) and the language's number of shards.
    """
    kept = written(merged.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= least_docs).drop("docs"), "divergence-kept")
    found = written(merged.join(kept, ["lang", "term"]).select(*_KEY, "n", "lang_n"), "divergence-counts")
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total")).join(found.groupBy("lang").agg(F.count("*").alias("rows")), "lang")
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = merged.where("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.na.fill(0, ["total", "terms", "lang_total", "rows"]).withColumn("shards", F.expr(f"1 + rows div {SHARD_ROWS}"))
    groups = written(groups.withColumn("p0", F.when(F.col("terms") > 0, _share("0", "total", "terms")).otherwise(0)), "divergence-groups")
    shares = found.join(groups, ["lang", "source"]).withColumn("p", _share("n", "total", "terms")).withColumn("q", _share("lang_n", "lang_total", "terms"))
    return shares.select(*_KEY, "p", "q", F.pmod(F.xxhash64("term"), "shards").alias("shard")), groups.select("lang", "source", "p0", "shards")


def _shard_distances(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of absolute differences over the shard's terms for each pair of the language's groups, a before b."""
    table = pa.Table.from_batches(batches)
    is_group = pc.is_null(table["term"])
    groups, cells = table.filter(is_group).sort_by("source"), table.filter(pc.invert(is_group))
    names = groups["source"].combine_chunks()
    base, n = np.asarray(groups["p"]), len(groups)
    terms = cells["term"].combine_chunks().dictionary_encode()
    column, line, share = np.asarray(terms.indices), np.asarray(pc.index_in(cells["source"].combine_chunks(), names)), np.asarray(cells["p"])
    order = np.argsort(column, kind="stable")
    column, line, share = column[order], line[order], share[order]
    wide, tall = max(1, CELLS // max(1, n)), 256  # terms and groups a taken at a time
    for first in range(0, n, tall):
        end = min(n, first + tall)
        sums = np.zeros((end - first, n), np.int64)
        for at in range(0, len(terms.dictionary), wide):
            some = slice(*np.searchsorted(column, [at, at + wide]))
            matrix = np.repeat(base[:, None], min(wide, len(terms.dictionary) - at), axis=1)
            matrix[line[some], column[some] - at] = share[some]
            for a in range(first, end):
                sums[a - first, a + 1 :] += np.abs(matrix[a + 1 :] - matrix[a]).sum(axis=1)
        a, b = np.nonzero(np.arange(first, end)[:, None] < np.arange(n))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()] * len(a), pa.string()), names.take(pa.array(a + first)), names.take(pa.array(b)), pa.array(sums[a, b])], names=["lang", "a", "b", "value"])


def pair_distances(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (each other source of the language), value (the sum of absolute differences of shares over all kept terms)."""
    everywhere = groups.select("lang", "source", F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"), F.explode(F.expr("sequence(0L, shards - 1)")).alias("shard"))
    dealt = counts.select(*_KEY, "p", "shard").unionByName(everywhere)
    sums = dealt.groupBy("lang", "shard").applyInArrow(_shard_distances, "lang string, a string, b string, value bigint").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    sums = written(sums, "divergence-pairs")
    return sums.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").union(sums.select("lang", "b", "a", "value"))


def audit(documents: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: how each group of documents of a language and source differs.

    Part "pair": each other source of the language, with the sum of absolute differences of all kept terms' shares (0 if no term is
    kept). Part "term": the `top` terms that the group has and uses more than its language, with the difference.
    Ranks run from 1 by falling value, then by item in UTF-8 order. Null text, lang or source counts as ''; every
    row counts as a document, repeated ones too; a group without terms takes part, a language of one source has no pairs.
    Whole texts are counted; an empty table gives no rows; further columns are ignored.
    """
    merged = written(term_counts(documents, text_col, lang_col, source_col), "divergence-terms")
    counts, groups = kept_counts(merged, least_docs)
    drop_written(documents.sparkSession, merged)
    terms = counts.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_distances(counts, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by).alias("rank"))
    best = terms.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    return pairs.unionByName(best.withColumn("part", F.lit("term")))
