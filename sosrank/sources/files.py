"""File sources and sinks: CSV with a declared schema and its rejected records, reloads by version, footer counts."""

from __future__ import annotations

import os
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sosrank.operators.quality import require_columns, require_path


def read_table(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "csv") -> DataFrame:
    """Read a table with a declared schema (no inference pass). CSV: header row, empty cell -> NULL.

    A missing path raises ``FileNotFoundError`` when the DataFrame is defined.
    """
    options = {"header": "true", "mode": "FAILFAST"} if fmt == "csv" else {}
    return require_path(spark, path, fmt, schema, options)


def write_csv(df: DataFrame, path: str, cols: Sequence[str], mode: str = "overwrite") -> None:
    """Write CSV with a header and a fixed column order."""
    require_columns(df, cols)
    df.select(*cols).write.mode(mode).option("header", True).csv(path)


def read_with_rejects(spark: SparkSession, path: str, schema: StructType, header: bool = True,
                      ) -> tuple[DataFrame, DataFrame]:
    """Read CSV with a declared schema: the good rows, and the rejected records ``(record, reasons)``.

    A record is rejected where a value is not of its column's type, where fields are missing or left over, or where a
    column declared NOT NULL is empty; ``reasons`` names the columns, or ``fields``. The two parts hold all records.
    """
    nullable = StructType([StructField(f.name, f.dataType, True) for f in schema.fields])
    raw = StructType([*nullable.fields, StructField("_record", StringType(), True)])
    options = {"header": str(header).lower(), "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_record"}
    rows = require_path(spark, path, "csv", raw, options)
    # true of every row: whichever columns a query reads, all are parsed, or a record would be good for one query and
    # bad for another
    parsed = F.xxhash64(*[f.name for f in schema.fields]) >= F.lit(-(1 << 63))
    rows = rows.where(parsed)
    empty = [F.when(F.col(f.name).isNull(), F.lit(f.name)) for f in schema.fields if not f.nullable]
    missing = F.array_compact(F.array(*empty)) if empty else F.array().cast("array<string>")
    whole = F.col("_record").isNull()
    good = rows.where(whole & (F.size(missing) == 0)).select(*[f.name for f in schema.fields])
    bad = rows.where(~(whole & (F.size(missing) == 0)))
    # of a record that did not parse, the fields as text tell which of them is at fault
    texts = ", ".join(f"`{f.name}` STRING" for f in schema.fields)
    text = F.from_csv("_record", texts)
    mistyped = F.array_compact(F.array(*[F.when(text[f.name].isNotNull() & F.col(f.name).isNull(), F.lit(f.name))
                                         for f in schema.fields]))
    reasons = F.array_sort(F.array_union(missing, F.when(whole, F.array().cast("array<string>")).otherwise(mistyped)))
    reasons = F.when(F.size(reasons) == 0, F.array(F.lit("fields"))).otherwise(reasons)
    line = F.concat_ws(",", *[F.coalesce(F.col(f.name).cast("string"), F.lit("")) for f in schema.fields])
    return good, bad.select(F.coalesce("_record", line).alias("record"), F.array_join(reasons, ",").alias("reasons"))


class ReloadError(ValueError):
    """A new version that does not hold what was to be loaded; the current version stays."""


class VersionedTable:
    """A Parquet table that is replaced as a whole.

    Each load writes a version of its own beside the others, reads it back and checks it; only then one row in a log
    makes it current. The row is one small file, there as a whole or not at all: a reader sees the old or the new
    table, and a load that fails at any point leaves the old one.
    """

    LOG = "seq long, version string, n long"

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str):
        self.spark, self.path, self.schema = spark, path, schema

    def log(self) -> list[Row]:
        """``(seq, version, n)`` of all loads, newest first (one row a load)."""
        try:
            rows = require_path(self.spark, os.path.join(self.path, "log"), "parquet", self.LOG)
        except FileNotFoundError:
            return []
        return rows.orderBy(F.desc("seq"), F.desc("version")).collect()

    def read(self) -> DataFrame:
        log = self.log()
        if not log:
            raise FileNotFoundError(self.path)
        return self.spark.read.schema(self.schema).parquet(os.path.join(self.path, log[0].version))

    def replace(self, df: DataFrame, partition_by: Sequence[str] = (), expected: int | None = None) -> int:
        """Load ``df`` as the new version; ``expected`` is the number of rows that it must have, where it is known."""
        version = f"version-{uuid.uuid4().hex}"
        target = os.path.join(self.path, version)
        seen = Observation()
        writer = df.observe(seen, F.count(F.lit(1)).alias("n")).write
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(target)
        n = self.spark.read.schema(self.schema).parquet(target).count()
        wanted = seen.get["n"] if expected is None else expected
        if n != wanted:
            raise ReloadError(f"{target} holds {n} rows instead of {wanted}")
        log = self.log()
        (self.spark.createDataFrame([((log[0].seq if log else 0) + 1, version, n)], self.LOG).coalesce(1)
         .write.mode("append").parquet(os.path.join(self.path, "log")))
        return n

    def vacuum(self, keep: int = 2) -> int:
        """Delete the files of all loaded versions but the newest ``keep``; returns how many went."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        gone = 0
        for row in self.log()[max(1, keep):]:
            old = hadoop(os.path.join(self.path, row.version))
            gone += bool(old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True))
        return gone


def reload_table(df: DataFrame, path: str, partition_by: Sequence[str] = (),
                 expected: int | None = None) -> VersionedTable:
    """Full reload: the table at ``path`` is replaced as a whole, or stays as it is (see :class:`VersionedTable`)."""
    table = VersionedTable(df.sparkSession, path, df.schema)
    table.replace(df, partition_by, expected)
    return table


#: Settings under which a plain count of a Parquet folder is answered from the files' footers.
FOOTER_COUNTS = {"spark.sql.sources.useV1SourceList": "avro,csv,json,kafka,orc,text",
                 "spark.sql.parquet.aggregatePushdown": "true"}


def footer_counts(spark: SparkSession, paths: Mapping[str, str], explain: list[str] | None = None) -> DataFrame:
    """``(table, n)`` of stored Parquet folders, read from footers alone; plans are appended to ``explain``.

    The settings hold while the counts are taken, one row a table, and are put back.
    """
    before = {k: spark.conf.get(k, None) for k in FOOTER_COUNTS}
    try:
        for k, v in FOOTER_COUNTS.items():
            spark.conf.set(k, v)
        found = []
        for name, path in paths.items():
            count = require_path(spark, path, "parquet").agg(F.count(F.lit(1)).alias("n"))
            found.append((name, count.first().n or 0))  # no row group at all counts as null
            if explain is not None:
                explain.append(count._jdf.queryExecution().executedPlan().toString())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.createDataFrame(found, "table string, n long")
