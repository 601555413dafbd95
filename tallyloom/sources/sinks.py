"""Files of a selected graph: CSV tables that spreadsheets may open, and JSON data sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import script_safe
from ..operators.privacy import exported

#: Columns that reports don't show.
UNREPORTED = ("cache_write_1h_input_tokens",)


def reported(df: DataFrame) -> DataFrame:
    return df.drop(*UNREPORTED)


def write_csv(df: DataFrame, key: list[str], path: str, single_file: bool = False) -> None:
    """A table in the order of its key, null as empty, arrays as JSON text. A range sort writes files that follow each other; single_file is for small exports."""
    flat = df.select(*[F.to_json(c).alias(c) if t.startswith("array") else F.col(c) for c, t in reported(df).dtypes])
    rows = exported(flat).orderBy(*key)
    (rows.coalesce(1) if single_file else rows).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").option("escape", '"').option("lineSep", "\r\n").csv(path)


def dataset(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of several tables as (section, row): row is JSON text that may stand in an HTML script element. Sections are separate rows, so none is gathered."""
    out = None
    for section, df in tables.items():
        one = reported(df).select(F.lit(section).alias("section"), script_safe(F.to_json(F.struct("*"))).alias("row"))
        out = one if out is None else out.union(one)
    return out


def write_dataset(tables: dict[str, DataFrame], path: str) -> None:
    """One folder of JSON lines per section."""
    dataset(tables).write.mode("overwrite").partitionBy("section").text(path)
