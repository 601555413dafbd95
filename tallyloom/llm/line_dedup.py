"""Deletes later copies of line runs, with DataFrame functions only.

Documents are sequences of line ids (blank lines aside). A suffix array over them is built by
distributed prefix doubling: the rank of a suffix by its first 2**k lines comes from the pair of
ranks of its two halves, named by a range sort of the distinct pairs, so ranks follow the
suffixes' order. Only lines that occur twice, in stretches of at least min_words words, take part.

A repeated run of at least min_words words is covered by windows that just reach min_words from
some first or to some last line. The suffixes that share a window are one interval of the
suffix array whose longest common prefix is at least the window; a window of n lines is told by
the ranks of the two blocks of 2**k <= n lines that cover it. In each interval the first
occurrence stays; the lines of the others' windows go, which together are the later copies
of all maximal repeated runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, written

#: A run of so many words counts as repeated text.
MIN_WORDS = 50

_DOC = ["__doc", "__hash"]


def _with_key(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """Documents are told apart by id and text; rows equal in both are one document."""
    return df.withColumns({"__doc": F.coalesce(F.col(id_col).cast("bigint"), F.lit(0)), "__hash": F.xxhash64(F.col(text_col), F.col(id_col).isNull())})


def _lines(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(doc, at, id, words) of all lines that aren't blank; the id is a 128-bit hash."""
    cut = _with_key(df.select(F.col(id_col), F.col(text_col)), text_col, id_col).select(*_DOC, F.posexplode(F.split(F.col(text_col), "\n")).alias("at", "line"))
    words = F.size(F.array_remove(F.split("line", " "), ""))
    return cut.select(*_DOC, "at", F.struct(F.xxhash64("line").alias("a"), F.xxhash64(F.lit(7), "line").alias("b")).alias("id"), words.alias("words")).where("words > 0")


def _stretches(lines: DataFrame, min_words: int) -> DataFrame:
    """The lines that occur twice or more, in unbroken stretches of at least min_words words: doc, stretch, pos (counting lines that aren't blank), id, words."""
    placed = lines.withColumn("pos", F.dense_rank().over(Window.partitionBy(*_DOC).orderBy("at")))
    twice = lines.groupBy("id").count().where("count > 1").select("id")
    common = placed.join(twice, "id").distinct()
    by_doc = Window.partitionBy(*_DOC).orderBy("pos")
    starts = (F.col("pos") - F.lag("pos", 1, -1).over(by_doc) != 1).cast("int")
    cut = common.withColumn("start", starts).withColumn("stretch", F.sum("start").over(by_doc))
    total = F.sum("words").over(Window.partitionBy(*_DOC, "stretch"))
    return cut.withColumn("total", total).where(F.col("total") >= min_words).select(*_DOC, "stretch", "pos", "at", "id", "words")


def _ranked(rows: DataFrame, key: list[str], name: str) -> DataFrame:
    """rows with the rank of their key: order-preserving numbers from a range sort of the distinct keys."""
    keys = rows.select(*key).distinct().repartitionByRange(*key).sortWithinPartitions(*key).select(*key, F.monotonically_increasing_id().alias(name))
    return rows.join(written(keys, "line-ranks"), key)


def suffix_ranks(rows: DataFrame, depth: int) -> DataFrame:
    """rows with r0, r1, ...: the rank of each line's suffix by its first 2**k lines, as far as 2**k <= depth; null where the stretch is shorter.

    One round doubles the prefix. rows has the columns of _stretches().
    """
    now = written(_ranked(rows, ["id"], "r0").drop("id"), "line-suffixes")
    k = 0
    while 2 << k <= depth:
        ahead = F.lead(f"r{k}", 1 << k).over(Window.partitionBy(*_DOC, "stretch").orderBy("pos"))
        paired = now.withColumn("second", ahead)
        pairs = paired.where("second IS NOT NULL").select(F.col(f"r{k}").alias("first"), "second")
        names = pairs.distinct().repartitionByRange("first", "second").sortWithinPartitions("first", "second").select(F.col("first").alias(f"r{k}"), "second", F.monotonically_increasing_id().alias(f"r{k + 1}"))
        now = written(paired.join(written(names, "line-ranks"), [f"r{k}", "second"], "left").drop("second"), "line-suffixes")
        k += 1
    return now


def _windows(rows: DataFrame, min_words: int) -> DataFrame:
    """The windows that just reach min_words: from each line on, and up to each line. doc, stretch, first and last pos."""
    order = Window.partitionBy(*_DOC, "stretch").orderBy("pos")
    ends = rows.select(*_DOC, "stretch", "pos", "words", F.sum("words").over(order).alias("end"))
    spans = ends.withColumn("begin", F.col("end") - F.col("words"))
    from_here = Window.partitionBy(*_DOC, "stretch").orderBy("begin")
    forth = spans.withColumns({"last": F.max("pos").over(from_here.rangeBetween(0, min_words - 1)), "reach": F.max("end").over(from_here.rangeBetween(0, min_words - 1))})
    to_here = Window.partitionBy(*_DOC, "stretch").orderBy("end")
    back = spans.withColumns({"before": F.max("pos").over(to_here.rangeBetween(Window.unboundedPreceding, -min_words)), "least": F.min("pos").over(to_here.rangeBetween(Window.unboundedPreceding, 0))})
    cols = [*_DOC, "stretch"]
    return (
        forth.where(F.col("reach") - F.col("begin") >= min_words).select(*cols, F.col("pos").alias("first"), "last")
        .union(back.where(F.col("end") >= min_words).select(*cols, F.coalesce(F.col("before") + 1, F.col("least")).alias("first"), F.col("pos").alias("last")))
        .distinct()
    )


def _block(k: Column, top: int) -> Column:
    """The rank at level k of a row with r0 ... r{top}."""
    return F.element_at(F.array(*[F.col(f"r{i}") for i in range(top + 1)]), (k + 1).cast("int"))


def later_copies(documents: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """(__doc, __hash, gone): for each document that loses lines, their indices among all its lines, counted from 0.

    Copies are ordered by id (rows without one last), hash of the text and line.
    """
    lines = written(_lines(documents, text_col, id_col), "lines")
    rows = written(_stretches(lines, min_words), "line-stretches")
    drop_written(documents.sparkSession, lines)
    windows = written(_windows(rows, min_words).withColumn("n", F.col("last") - F.col("first") + 1).withColumn("k", F.floor(F.log2("n"))), "line-windows")
    depth = windows.agg(F.max("n")).first()[0] or 1
    ranks = suffix_ranks(rows, depth)
    top = depth.bit_length() - 1
    at = ranks.select(*_DOC, "stretch", "pos", *[f"r{i}" for i in range(top + 1)])
    head = at.withColumnRenamed("pos", "first")
    tail = at.withColumnRenamed("pos", "second")
    named = windows.join(head, [*_DOC, "stretch", "first"]).withColumn("head", _block(F.col("k"), top)).drop(*[f"r{i}" for i in range(top + 1)])
    named = named.withColumn("second", (F.col("last") + 1 - F.pow(F.lit(2), F.col("k"))).cast("int"))
    named = named.join(tail, [*_DOC, "stretch", "second"]).select(*_DOC, "stretch", "first", "last", "n", "head", _block(F.col("k"), top).alias("tail"))
    place = F.struct("__doc", "__hash", "first")
    named = written(named, "line-windows")
    # an interval of the suffix array: the suffixes whose first n lines are the same
    intervals = named.groupBy("n", "head", "tail").agg(F.count("*").alias("size"), F.min(place).alias("kept")).where("size > 1")
    later = named.join(intervals, ["n", "head", "tail"]).where(place > F.col("kept"))
    gone = later.select(*_DOC, "stretch", F.explode(F.sequence("first", "last")).alias("pos")).distinct()
    return gone.join(rows.select(*_DOC, "stretch", "pos", "at"), [*_DOC, "stretch", "pos"]).groupBy(*_DOC).agg(F.collect_set("at").alias("gone"))


def dedup(documents: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_words: int = MIN_WORDS, to: str = "lines_deleted") -> DataFrame:
    """documents with later copies of repeated line runs deleted from the text, and their number in a column `to`.

    A run is any number of whole adjacent lines, blank ones aside, of at least min_words words (parts
    between spaces). Lines are compared as they are. The first copy in the order of ids (a missing id
    counts as 0), then of a hash of the text, stays; blank lines stay. A null text stays null, an
    empty one empty, and a text may become empty. Rows equal in id and text are one document and
    get the same result. Where a run overlaps its own copy, as when one line is repeated, the copy's
    lines go and the first ones stay. A column named as `to` is replaced; an empty table gives no rows.
    """
    gone = later_copies(documents, text_col, id_col, min_words)
    keyed = _with_key(documents.drop(*[c for c in documents.columns if c == to and c not in (text_col, id_col)]), text_col, id_col)
    joined = keyed.join(gone, _DOC, "left")
    lines = F.split(F.col(text_col), "\n")
    rest = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("gone", i)), "\n")
    out = {c: F.col(c) for c in documents.columns if c != to}
    out[text_col] = F.when(F.col("gone").isNull(), F.col(text_col)).otherwise(rest).alias(text_col)
    return joined.select(*[out[c].alias(c) for c in out], F.coalesce(F.size("gone"), F.lit(0)).alias(to))
