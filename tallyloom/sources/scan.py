"""Scans of semi-structured stores as VARIANT rows, with malformed rows counted instead of dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import MAX_LONG, label

TOKEN_FIELDS = ["uncached_input_tokens", "cached_input_tokens", "cache_write_input_tokens", "visible_output_tokens", "reasoning_output_tokens", "unattributed_tokens"]


def json_lines(spark: SparkSession, paths: list[str] | str, longest: int | None = None, below: str | None = None) -> DataFrame:
    """One row per line that isn't blank: path, at (orders the lines of a file), value (null where it isn't a JSON object), size.

    longest: an optional bound on a line's bytes; longer lines count as malformed. below: a pattern of the names of files at any depth below the paths.
    """
    reader = spark.read if below is None else spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", below)
    lines = reader.text(paths).select("value", "_metadata.file_path", F.col("_metadata.file_block_start").alias("block")).withColumn("row", F.monotonically_increasing_id())
    lines = lines.where(F.trim("value") != "")
    value = F.try_parse_json("value")
    ok = F.schema_of_variant(value).startswith("OBJECT")
    if longest is not None:
        ok &= F.octet_length("value") <= longest
    return lines.select(F.col("file_path").alias("path"), F.struct("block", "row").alias("at"), F.when(ok, value).alias("value"), F.octet_length("value").alias("size"), F.sha2("value", 256).alias("digest"))


def json_documents(spark: SparkSession, paths: list[str] | str, below: str | None = None) -> DataFrame:
    """One row per file: path, value (null where it isn't a JSON object), digest of its bytes. below: as in json_lines()."""
    reader = spark.read.format("binaryFile")
    files = (reader if below is None else reader.option("recursiveFileLookup", True).option("pathGlobFilter", below)).load(paths)
    value = F.try_parse_json(F.col("content").cast("string"))
    return files.select("path", F.when(F.schema_of_variant(value).startswith("OBJECT"), value).alias("value"), F.sha2("content", 256).alias("digest"))


def _kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def text(v: Column, path: str) -> Column:
    """A string at a path; null for any other type (a plain cast would turn numbers into text)."""
    return F.when(_kind(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def number(v: Column, path: str) -> Column:
    """A number at a path as a double; null for any other type, booleans and digits in quotes too."""
    return F.when(_kind(v, path).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, path, "double"))


def count(v: Column, path: str) -> Column:
    """A number at a path as a count: truncated, clamped to 0 .. 2**63 - 1, 0 if it is none."""
    whole = F.when(_kind(v, path) == "BIGINT", F.try_variant_get(v, path, "bigint"))
    real = F.when(_kind(v, path).rlike("^(DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, path, "double"))
    limited = F.when(F.isnan(real) | (real <= 0), F.lit(0)).when(real >= float(MAX_LONG), F.lit(MAX_LONG)).otherwise(real.cast("bigint"))
    return F.greatest(F.lit(0), F.coalesce(whole, limited, F.lit(0)))


def has(v: Column, path: str, kind: str) -> Column:
    return F.coalesce(_kind(v, path).startswith(kind), F.lit(False))


def name(v: Column, path: str, longest: int = 512) -> Column:
    return label(text(v, path), longest)


def zoned_ms(s: Column) -> Column:
    """Epoch milliseconds of a zoned ISO text; null for any other."""
    return F.when(s.rlike(r"(?i)(Z|[+-]\d{2}:?\d{2})$"), F.unix_millis(F.try_to_timestamp(s)))


def time_ms(v: Column, path: str, in_ms: bool = False) -> Column:
    """Epoch milliseconds of a zoned ISO text, or of a number of seconds (of milliseconds if over 1e10, or always)."""
    n = number(v, path)
    return F.coalesce(zoned_ms(text(v, path)), (n if in_ms else F.when(F.abs(n) > 1e10, n).otherwise(n * 1000)).cast("bigint"))


def tokens(uncached: Column | None = None, cached: Column | None = None, cache_write: Column | None = None, visible: Column | None = None, reasoning: Column | None = None, total: Column | None = None) -> Column:
    """The parts of a call's tokens as a struct. Parts stop together at 2**63 - 1 in this order; what a reported total has beyond them is unattributed."""
    limit, used, parts = F.lit(MAX_LONG).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"), []
    for x in (uncached, cached, cache_write, visible, reasoning):
        part = F.least((F.lit(0) if x is None else x).cast("decimal(38,0)"), limit - used)
        parts.append(part)
        used = (used + part).cast("decimal(38,0)")
    rest = F.greatest(F.lit(0).cast("decimal(38,0)"), F.least((F.lit(0) if total is None else total).cast("decimal(38,0)") - used, limit - used))
    return F.struct(*[p.cast("bigint").alias(n) for p, n in zip([*parts, rest], TOKEN_FIELDS, strict=True)])


def with_totals(df: DataFrame) -> DataFrame:
    """df with input, output and total tokens from its parts; totals are never summed on their own."""
    d = lambda *c: sum((F.col(x).cast("decimal(38,0)") for x in c[1:]), F.col(c[0]).cast("decimal(38,0)"))
    return df.withColumns({
        "input_tokens": d(*TOKEN_FIELDS[:3]).cast("bigint"), "output_tokens": d(*TOKEN_FIELDS[3:5]).cast("bigint"), "total_tokens": d(*TOKEN_FIELDS).cast("bigint"),
    })


def saturated(columns: list[str] = TOKEN_FIELDS, source: str = "tok") -> list[Column]:
    """Sums of parts over a group that stop together at 2**63 - 1, in the order of the fields."""
    limit, used, out = F.lit(MAX_LONG).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"), []
    for c in columns:
        part = F.least(F.coalesce(F.sum(F.col(f"{source}.{c}").cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)"), limit - used)
        out.append(part.cast("bigint").alias(c))
        used = (used + part).cast("decimal(38,0)")
    return out
