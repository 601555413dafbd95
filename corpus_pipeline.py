"""Documents to packed training sequences: classify, drop repeated lines, drop near copies, hide personal data, pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import line_dedup, ngram_join, packing, pii, quality
from tallyloom.llm.common import table, written

def _as_before(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """changed with the columns of docs, n_chars following the text."""
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns)


def _free(docs: DataFrame, name: str) -> str:
    """name, or one made from it that docs has no column of."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs of 50 words go; so do documents of which nothing but white space is left by that."""
    deleted = _free(docs, "lines_deleted")
    cleaned = line_dedup.dedup(docs, to=deleted)
    return _as_before(cleaned.where((F.col(deleted) == 0) | F.col("text").rlike(r"\S")), docs)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity of 0.8) the document with the smallest id stays. Rows without an id stay, and rows that share an id stay or go together."""
    found = ngram_join.join(docs, k=5, percent=80)
    others = found.where("doc_id != component_id").select("doc_id")
    return docs.join(written(others, "near-copies").distinct(), "doc_id", "left_anti").select(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets become surrogates."""
    return _as_before(pii.with_surrogates(docs, pii.session_key(spark), to=_free(docs, "entities")), docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document, or of its pieces, in bins of 2048 words."""
    return packing.pack(docs)


STAGES = [("quality", quality_stage), ("line dedup", line_stage), ("near copies", near_copy_stage), ("pii", pii_stage), ("packing", packing_stage)]

#: Training a classifier, surrogates and best-fit bins can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places in bins of all documents that the stages keep.

    A null text is scored as an empty one and, if it is kept, packed as a piece of no words. Rows without an id stay through all stages
    unless the classifier rejects them; repeated rows are packed each, as far as they aren't copies of a row with a smaller id. Further columns,
    also ones with the names that stages use, pass unchanged to the last stage. Empty tables give no rows; without labels no document is rejected.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
