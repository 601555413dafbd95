"""Joins and folds that connectors make between the records of one store: fragments, parts, copies, edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_fragment(df: DataFrame, key: list[str], rank: list[Column], columns: list[str]) -> DataFrame:
    """Of each key's fragments the one of the largest rank, as one aggregate; rank must tell fragments apart."""
    best = df.groupBy(*key).agg(F.max_by(F.struct(*columns), F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)])).alias("best"))
    return best.select(*key, "best.*")


def first_of(df: DataFrame, key: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The first record of each key: later ones of the same id change nothing."""
    return df.groupBy(*key).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("first")).select(*key, "first.*")


def merged(df: DataFrame, key: list[str], order: str, parts: str, last: str, newest: str) -> DataFrame:
    """Records that came in fragments: their parts in order, the last value that isn't null, the newest time. One record's fragments are gathered, no more."""
    return df.groupBy(*key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(parts).alias("p")))), lambda x: x["p"]).alias(parts),
        F.max_by(last, F.when(F.col(last).isNotNull(), F.col(order))).alias(last), F.max(newest).alias(newest),
    )


def with_parts(messages: DataFrame, parts: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """messages with their number of parts (0 without any), and one row with the number of parts whose message is missing."""
    counts = parts.groupBy(*key).agg(F.count("*").alias("n_parts"))
    orphans = counts.join(messages.select(*key).distinct(), key, "left_anti").agg(F.coalesce(F.sum("n_parts"), F.lit(0)).alias("orphans"))
    return messages.join(counts, key, "left").fillna(0, ["n_parts"]), orphans


def either(left: DataFrame, right: DataFrame, key: list[str], zeros: list[str]) -> DataFrame:
    """All keys of both sides, with 0 for the counts of a side that lacks the key."""
    return left.join(right, key, "full_outer").fillna(0, zeros)


def zipped(rows: DataFrame, others: DataFrame, key: list[str], order: list[str], other_order: list[str]) -> DataFrame:
    """rows and others of each key side by side in their orders; rows beyond the others stay without one, and others beyond the rows go."""
    at = lambda by: F.row_number().over(Window.partitionBy(*key).orderBy(*by))
    return rows.withColumn("__at", at(order)).join(others.withColumn("__at", at(other_order)), [*key, "__at"], "left").drop("__at")


def resolved(edges: DataFrame, conversations: DataFrame, key: str) -> DataFrame:
    """Edges with parent_key and child_key, looked up by provider, machine and id; null where the conversation isn't stored."""
    keys = lambda end: conversations.select("provider", "machine", F.col("conversation_id").alias(f"{end}_id"), F.col(key).alias(f"{end}_key"))
    return edges.join(keys("parent"), ["provider", "machine", "parent_id"], "left").join(keys("child"), ["provider", "machine", "child_id"], "left")


def following_copies(stored: DataFrame, new: DataFrame, outcome: DataFrame) -> DataFrame:
    """Edges after a merge: each follows the stored copy of its child.

    outcome(child_id, written) tells whether the batch's copy of a child replaced the stored one. If so, its stored edges go
    and the batch's come; if not, the batch's come only where none is stored; edges of other children change nothing.
    """
    replaced = outcome.where("written").select("child_id")
    offered = new.join(outcome, "child_id")
    come = offered.where("written").drop("written").unionByName(offered.where("NOT written").drop("written").join(stored.select("child_id").distinct(), "child_id", "left_anti"))
    return stored.join(replaced, "child_id", "left_anti").unionByName(come.select(stored.columns))
