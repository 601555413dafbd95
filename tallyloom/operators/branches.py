"""Branched logs: each record names its parent, and what it doesn't tell itself comes from above.

Joins are merges by hint: tables of a round that are just small enough would be broadcast, so what the driver gets would grow with rounds and records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import cut


def inherited(nodes: DataFrame, key: list[str], node: str, parent: str, marks: dict[str, str], rounds: int = 20) -> DataFrame:
    """nodes with, for each mark, what the nearest record above them tells.

    marks: from a column to the name of the result. A column is a struct of one field, so that a record can
    tell a null; a null struct tells nothing. Every round doubles how far a record sees, up to 2**rounds
    records, and rounds end when all have seen a root; in a cycle a record sees itself last.
    """
    own = cut(nodes.select(*key, F.col(node).alias("__n"), F.col(parent).alias("__up"), *[F.col(c).alias(f"__m{i}") for i, c in enumerate(marks)]), "records")
    names = [f"__m{i}" for i in range(len(marks))]
    above = own.select(*key, F.col("__n").alias("__up"), F.col("__up").alias("__next"), *[F.col(m).alias(f"{m}_up") for m in names])
    now = cut(own.select(*key, "__n", "__up").join(above.hint("merge"), [*key, "__up"], "left").select(*key, "__n", F.col("__next").alias("__up"), *[F.col(f"{m}_up").alias(m) for m in names]), "inherited")
    for _ in range(rounds):
        if now.where("__up IS NOT NULL").isEmpty():
            break
        # what a record sees from its parent on reaches up to __up; the next stretch is what __up's parent sees, and __up itself
        stretch = own.select(*key, "__n", *[F.col(m).alias(f"{m}_own") for m in names]).join(now.hint("merge"), [*key, "__n"]).select(*key, F.col("__n").alias("__up"), F.col("__up").alias("__next"), *[F.coalesce(f"{m}_own", m).alias(f"{m}_up") for m in names])
        now = cut(now.join(stretch.hint("merge"), [*key, "__up"], "left").select(*key, "__n", F.col("__next").alias("__up"), *[F.coalesce(m, f"{m}_up").alias(m) for m in names]), "inherited")
    found = now.select(*key, F.col("__n").alias(node), *[F.col(m).alias(to) for m, to in zip(names, marks.values(), strict=True)])
    return nodes.join(found.hint("merge"), [*key, node], "left")


def path_to_root(nodes: DataFrame, leaves: DataFrame, key: list[str], node: str, parent: str, rounds: int = 20) -> DataFrame:
    """key, node, distance of the records from each key's leaf up to its root, or up to the record whose parent is missing or is on the path already.

    Every round doubles the length of the path that is known, up to 2**rounds records.
    """
    jump = nodes.select(*key, F.col(node).alias("__n"), F.col(parent).alias("__up")).where("__up IS NOT NULL")
    known = nodes.select(*key, F.col(node).alias("__up"))
    jump = cut(jump.join(known.hint("merge"), [*key, "__up"], "left_semi"), "jumps")
    path = cut(leaves.select(*key, F.col(node).alias("__n"), F.lit(0).cast("bigint").alias("distance")), "path")
    for k in range(rounds):
        reached = path.join(jump.hint("merge"), [*key, "__n"]).select(*key, F.col("__up").alias("__n"), (F.col("distance") + (1 << k)).alias("distance"))
        longer = cut(path.unionByName(reached).groupBy(*key, "__n").agg(F.min("distance").alias("distance")), "path")
        if longer.join(path.hint("merge"), [*key, "__n"], "left_anti").isEmpty():
            break
        path = longer
        further = jump.select(*key, F.col("__n").alias("__up"), F.col("__up").alias("__next"))
        jump = cut(jump.join(further.hint("merge"), [*key, "__up"]).select(*key, "__n", F.col("__next").alias("__up")), "jumps")
    return path.select(*key, F.col("__n").alias(node), "distance")
