"""Materialise the model tables (the "load the database" step).

Deriving contests from the source tables costs three fact-sized joins; when
several queries run against the same data, the model is derived once, written
as Parquet to a shared location (by default under ``spark.checkpoint.dir``) and
read back. The written table also cuts the lineage: a lost executor re-reads
files instead of recomputing the derivation.

Layouts:

* ``contests``: a folder a month, sorted by attacker: date filters skip folders, attacker filters skip row groups;
* ``contests_by_defender``: a second copy, bucketed by ``(defender, part)`` and sorted by defender, ``part`` a hash of
  the contest in ``PARTS`` values. A defender filter skips row groups, and a defender that a third of all contests
  share lies in ``PARTS`` buckets;
* ``competitors_by_part``: the dimension once a part, bucketed by ``(name, part)``: it meets the copy above bucket by
  bucket, so that no contest moves for the join.
"""

from __future__ import annotations

import hashlib
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sosrank.schemas import COMPETITORS, CONTEST_COLUMNS, CONTESTS, MATCHUPS
from sosrank.session import scratch_path
from sosrank.sources.adapters import Tables, reverse_outcomes

OUTCOME_COLUMNS = ["contest_id", "attacker", "defender", "winner", "att_strength", "def_strength", "contest_date"]


#: Buckets among which the rows of one defender are dealt.
PARTS = 8
PART = "part"


def _bucketed(spark: SparkSession, path: str, name: str, schema: str, key: str, buckets: int) -> DataFrame:
    """The bucketed table in ``path``; its declaration belongs to the catalog and is made where it is missing."""
    table = f"model_{hashlib.md5(path.encode()).hexdigest()[:16]}_{name}"
    if not spark.catalog.tableExists(table):
        spark.sql(f"CREATE TABLE {table} ({schema}) USING parquet CLUSTERED BY ({key}, {PART}) SORTED BY ({key}) "
                  f"INTO {buckets} BUCKETS LOCATION '{path}/{name}'")
    return spark.table(table)


def _ddl(schema) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)


class Model:
    """Model tables read back from Parquet (same interface as :class:`Tables` for the queries)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        read = lambda name, schema: spark.read.schema(schema).parquet(os.path.join(path, name))
        self.competitors = read("competitors", COMPETITORS)
        self.matchups = read("matchups", MATCHUPS)
        self.contests = read("contests", CONTESTS).select(*CONTEST_COLUMNS)
        buckets = read("layout", "buckets int").first().buckets
        self.contests_by_defender = _bucketed(spark, path, "contests_by_defender", f"{_ddl(CONTESTS)}, {PART} int",
                                              "defender", buckets)
        self.competitors_by_part = _bucketed(spark, path, "competitors_by_part", f"{_ddl(COMPETITORS)}, {PART} int",
                                             "name", buckets)

    @property
    def outcomes(self) -> DataFrame:
        return self.contests.select(*OUTCOME_COLUMNS)

    @property
    def outcomes_by_defender(self) -> DataFrame:
        """Outcomes laid out for the join with :attr:`competitors_by_part`."""
        return self.contests_by_defender.select(*OUTCOME_COLUMNS, PART)

    @property
    def outcomes_reversed(self) -> DataFrame:
        return reverse_outcomes(self.outcomes)


def _write_bucketed(df: DataFrame, path: str, name: str, key: str, buckets: int) -> None:
    """One file a bucket, sorted by ``key``; only the files are kept, the catalog entry is made by :class:`Model`."""
    table = f"load_{uuid.uuid4().hex}"
    (df.repartition(buckets, key, PART).write.format("parquet").option("path", os.path.join(path, name))
     .bucketBy(buckets, key, PART).sortBy(key).saveAsTable(table))
    df.sparkSession.sql(f"DROP TABLE {table}")


def materialize_model(tables: Tables, path: str | None = None, buckets: int | None = None) -> Model:
    """Write competitors, matchups and contests as Parquet in their layouts and return them read back.

    Contests are derived once. The monthly copy is rebalanced by month first: AQE
    splits a large month into files of the advisory size. ``buckets`` (default: the
    session's shuffle partitions) sets the files of the copies laid out by name.
    """
    spark = tables.spark
    path = path or scratch_path(spark, f"model-{uuid.uuid4().hex}")
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tables.competitors.write.mode("overwrite").parquet(os.path.join(path, "competitors"))
    tables.matchups.coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "matchups"))
    by_month = tables.contests.withColumn("contest_month", F.date_format("contest_date", "yyyy-MM"))
    (by_month.hint("rebalance", "contest_month").sortWithinPartitions("contest_month", "attacker")
     .write.mode("overwrite").partitionBy("contest_month").parquet(os.path.join(path, "contests")))
    written = spark.read.schema(CONTESTS).parquet(os.path.join(path, "contests")).select(*CONTEST_COLUMNS)
    part = F.pmod(F.xxhash64("contest_id"), F.lit(PARTS)).cast("int").alias(PART)
    _write_bucketed(written.select("*", part), path, "contests_by_defender", "defender", buckets)
    competitors = spark.read.schema(COMPETITORS).parquet(os.path.join(path, "competitors"))
    every = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias(PART)
    _write_bucketed(competitors.select("*", every), path, "competitors_by_part", "name", buckets)
    spark.range(1).select(F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(os.path.join(path, "layout"))
    return Model(spark, path)
