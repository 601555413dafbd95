"""A Python data source of SQLite files: one partition for each file, read-only, in Arrow batches."""

from __future__ import annotations

import glob
import os
import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

ROWS_AT_ONCE = 4096
#: Bytes of a text or blob that a store may hold.
LONGEST = 8 << 20


@dataclass
class SqliteFile(InputPartition):
    path: str


class SqliteReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, options

    def partitions(self) -> list[SqliteFile]:
        """The files that exist; only their names pass through the driver."""
        return [SqliteFile(p) for p in sorted(glob.glob(self.options["path"])) if os.path.isfile(p)] or [SqliteFile("")]

    def read(self, partition: SqliteFile) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(self.schema)
        if not partition.path:
            return
        connection = sqlite3.connect(f"file:{partition.path}?mode=ro", uri=True)
        try:
            table = self.options["table"].replace('"', '""')
            there = {row[1].lower(): row[2] for row in connection.execute(f'PRAGMA table_info("{table}")')}
            if not there:  # a store of another layout
                return
            names = [f.name for f in self.schema if f.name.lower() in there]
            longest = int(self.options.get("longest", LONGEST))
            checked = [n for n in names if self.schema[n].dataType.simpleString() in ("string", "binary")]
            if checked:
                too_long = " OR ".join(f'length(CAST("{n}" AS BLOB)) > {longest}' for n in checked)
                if connection.execute(f'SELECT 1 FROM "{table}" WHERE {too_long} LIMIT 1').fetchone():
                    raise ValueError(f"a field of {table} in {os.path.basename(partition.path)} is longer than {longest} bytes")
            loose = self.options.get("loose", "").split(",")
            # what isn't of a column's type is null, as what the store lacks
            kind = {"string": "text", "binary": "blob", "bigint": "integer", "int": "integer", "double": "real"}

            def field(f) -> str:
                if f.name == "_file":
                    return "'" + partition.path.replace("'", "''") + "'"
                if f.name not in names:
                    return "NULL"
                if f.name in loose:
                    return f'CAST("{f.name}" AS TEXT)'
                want = kind[f.dataType.simpleString()]
                fits = f"typeof(\"{f.name}\") IN ('integer', 'real')" if want == "real" else f"typeof(\"{f.name}\") = '{want}'"
                return f'CASE WHEN {fits} THEN "{f.name}" END'

            rows = connection.execute(f'SELECT {", ".join(field(f) for f in self.schema)} FROM "{table}"')
            while some := rows.fetchmany(ROWS_AT_ONCE):
                columns = list(zip(*some, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)
        finally:
            connection.close()


class SqliteSource(DataSource):
    """Options: path (a pattern), table, longest. The schema is the caller's; columns that a file lacks are null, and `_file` is its path."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_files"

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(schema, self.options)


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str, longest: int = LONGEST, loose: tuple[str, ...] = ()) -> DataFrame:
    """The rows of a table of all SQLite files that the pattern names; none where a file lacks the table or there is no file.

    Only the columns of the schema are read. A value of another type than its column's is null, but in the `loose` ones, which are strings, it comes as text; a text or blob of over `longest` bytes fails the read before any row of that file.
    """
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_files").schema(schema).option("path", path).option("table", table).option("longest", longest).option("loose", ",".join(loose)).load()
