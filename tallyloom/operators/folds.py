"""Order-dependent folds of event logs, as windows over a key and an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segment(df: DataFrame, key: list[str], order: list[str], starts: Column, to: str = "turn_no") -> DataFrame:
    """Numbers the segments of each log: a row where `starts` holds opens one; rows before the first have 0."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(to, F.sum(F.when(starts, 1).otherwise(0)).over(w))


def carry_forward(df: DataFrame, key: list[str], order: list[str], value: str, to: str) -> DataFrame:
    """The last value that was reported so far."""
    return df.withColumn(to, F.last(value, ignorenulls=True).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def as_of(rows: DataFrame, marks: DataFrame, key: list[str], time: str, mark: str) -> DataFrame:
    """rows with the latest mark whose time isn't after theirs: one sort of both sides together, without a join. At one time marks come first; rows without a time get the last mark of their key."""
    a = marks.select(*key, F.col(time).alias("__t"), F.lit(0).alias("__kind"), F.col(mark).alias("__mark"), F.lit(None).cast(rows.select(F.struct("*").alias("r")).schema["r"].dataType).alias("__row"))
    b = rows.select(*key, F.col(time).alias("__t"), F.lit(1).alias("__kind"), F.lit(None).cast(marks.schema[mark].dataType).alias("__mark"), F.struct("*").alias("__row"))
    w = Window.partitionBy(*key).orderBy(F.asc_nulls_last("__t"), "__kind").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("__found", F.last("__mark", ignorenulls=True).over(w))
    return both.where("__kind = 1").select("__row.*", F.col("__found").alias(mark))


def last_row_only(df: DataFrame, key: list[str], order: list[str], value: Column, to: str) -> DataFrame:
    """A value of the whole log on its last row, 0 on others."""
    at = F.row_number().over(Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order]))
    return df.withColumn(to, F.when(at == 1, value).otherwise(0))


def without_replays(child: DataFrame, parent: DataFrame, key: list[str]) -> DataFrame:
    """Messages of a branch that its parent doesn't have."""
    return child.join(parent.select(*key).distinct(), key, "left_anti")


def residual(total: DataFrame, parts: DataFrame, key: str, value: str) -> DataFrame:
    """What a log's total has beyond its parts, not below 0."""
    sums = parts.groupBy(key).agg(F.sum(value).alias("__sum"))
    return total.join(sums, key, "left").withColumn("residual", F.greatest(F.col(value) - F.coalesce("__sum", F.lit(0)), F.lit(0))).drop("__sum")


def longest_prefix(paths: DataFrame, path: str, names: list[tuple[str, str]], default: str = "unmapped") -> DataFrame:
    """The name of the longest prefix that a path equals or lies under; of equal prefixes the first. The mapping is configuration, so it is an expression rather than a join."""
    clean = F.rtrim(F.replace(F.col(path), F.lit("\\"), F.lit("/")), F.lit("/"))
    out = F.lit(default)
    ranked = sorted(enumerate(names), key=lambda x: (len(x[1][0].rstrip("/")), -x[0]))
    for _, (prefix, name) in ranked:
        p = prefix.replace("\\", "/").rstrip("/")
        out = F.when((clean == p) | clean.startswith(p + "/"), name).otherwise(out)
    return paths.withColumn("project", out)


def sessions(df: DataFrame, key: list[str], order: list[str], opens: Column, closes: Column) -> DataFrame:
    """Sessions between markers: rows after a closing marker and before the next opening one belong to none."""
    w = Window.partitionBy(*key).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    numbered = df.withColumn("session", F.sum(F.when(opens, 1).otherwise(0)).over(upto))
    inner = Window.partitionBy(*key, "session").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return numbered.withColumn("__over", F.coalesce(F.max(closes).over(inner), F.lit(False))).where("session > 0 AND NOT __over").drop("__over")


def ancestors(nodes: DataFrame, rounds: int) -> DataFrame:
    """nodes(node, parent, mark) with depth and the largest mark up to the root, for trees of depth under 2**rounds.

    Each round doubles how far a node sees, so a chain of pointers takes few joins; a cycle can't
    run on, its nodes just reach no root and get a null depth.
    """
    now = nodes.select("node", F.col("parent").alias("up"), F.col("mark").alias("largest"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("bigint").alias("depth"))
    for _ in range(rounds):
        seen = now.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("largest").alias("above"), F.col("depth").alias("more"))
        now = now.join(seen, "up", "left").select("node", F.col("next").alias("up"), F.greatest("largest", "above").alias("largest"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
    return now.select("node", "largest", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))
