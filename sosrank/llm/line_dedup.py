"""Line dedup against levelled sorted runs of line hashes.

``LineRuns`` holds, for every line seen, how many documents it was found in: runs, each a table bucketed and sorted by
line hash. A batch is reduced to one row a line (each document counts its line once), merge-anti-joined with the
lines that a run already settles (found in enough documents, so that counting on is of no use), and the rest is added
as a run of level 0. When a level holds ``fan`` runs they are merged into one of the level above, so that a line is
rewritten once a level. All runs are bucketed and sorted alike, so that a batch and two runs meet without moving them.

A batch is named: its name is recorded with its run, and a batch that is already recorded adds nothing, so that a
job that failed half way can be run again. Records are written after their tables; what a failed job left
unrecorded is never read.

A line's key is the line without ASCII white space at both ends, A-Z in lower case; its hash is 128 bits of XXH3.

Results in odd cases: a null or empty text is one empty line, with an empty key; keys shorter than ``min_chars`` code
points never go; each row is a document of its own, also where ids repeat or are null; an empty table gives an
empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sosrank.llm.common import id_text, salted_join, scratch, ship, written

MIN_DOCS, MIN_CHARS = 10, 1
#: Runs of a level that are merged into one of the next.
FAN = 3
#: Batches that the query feeds its documents in.
BATCHES = 4
#: White space at the ends of a line.
ENDS = b" \t\n\v\f\r"


def line_keys(text: bytes) -> list[bytes]:
    """The keys of a text's lines; on bytes, ``lower`` touches A-Z only."""
    return [line.strip(ENDS) for line in text.lower().split(b"\n")]


def _long_enough(key: bytes, min_chars: int) -> bool:
    # a code point takes one byte at least, four at most
    return len(key) >= 4 * min_chars or (len(key) >= min_chars and len(key.decode()) >= min_chars)


def _hashes(keys: list[bytes], min_chars: int) -> list[bytes | None]:
    from xxhash import xxh3_128_digest

    return [xxh3_128_digest(k) if _long_enough(k, min_chars) else None for k in keys]


def hashed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(doc_key, lines)`` of ``(doc_id, text)``: a document's distinct line hashes, under a hash of id and text."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted({h for h in _hashes(line_keys(t.as_py().encode()), min_chars) if h is not None})
                     for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.binary()))],
                                             ["doc_key", "lines"])

    return docs.select(doc_key(), "text").mapInArrow(run, "doc_key string, lines array<binary>")


def doc_key():
    """A name of a row by id and text, the same whenever it is computed; rows alike in both have one outcome."""
    text = F.col("text")
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.hex(F.xxhash64(text)),
                       F.hex(F.xxhash64(F.lit(1), text))).alias("doc_key")


class LineRuns:
    """Levelled runs ``(line, docs)`` under ``location``, a shared folder; tables are registered as ``name``_..."""

    def __init__(self, spark: SparkSession, name: str, location: str, min_docs: int = MIN_DOCS, fan: int = FAN,
                 buckets: int | None = None):
        self.spark, self.name, self.location = spark, name, location
        self.min_docs, self.fan = min_docs, fan
        self.buckets = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    # -- the record: one small row a run, replaced as a whole by a new version
    def _records(self) -> tuple[int, list]:
        """Version and rows ``(run, level, batches)`` of the newest record."""
        name = f"{self.name}_record"
        if not self.spark.catalog.tableExists(name):
            return 0, []
        rows = self.spark.table(name)
        version = rows.agg(F.max("version")).first()[0] or 0
        newest = rows.filter((F.col("version") == version) & F.col("run").isNotNull())
        return version, [(r.run, r.level, list(r.batches)) for r in newest.select("run", "level", "batches").collect()]

    def _record(self, version: int, runs: list) -> None:
        rows = [(version, *r) for r in runs] or [(version, None, None, None)]
        (self.spark.createDataFrame(rows, "version long, run string, level int, batches array<string>").coalesce(1)
         .write.format("parquet").option("path", f"{self.location}/record").mode("append")
         .saveAsTable(f"{self.name}_record"))  # one file: a version is there as a whole or not at all

    def _write(self, rows: DataFrame) -> str:
        run = f"{self.name}_{uuid.uuid4().hex}"
        (rows.select("line", "docs").repartition(self.buckets, "line").write.format("parquet")
         .option("path", f"{self.location}/{run}").bucketBy(self.buckets, "line").sortBy("line").saveAsTable(run))
        return run

    def runs(self) -> list:
        return self._records()[1]

    def add(self, batch: str, lines: DataFrame) -> None:
        """Add a batch ``(lines array<binary>)``, one row a document, unless its name is already recorded."""
        version, runs = self._records()
        if any(batch in names for _, _, names in runs):
            return
        fresh = lines.select(F.explode("lines").alias("line")).groupBy("line").agg(F.count(F.lit(1)).alias("docs"))
        for run, _, _ in runs:
            settled = self.spark.table(run).filter(F.col("docs") >= self.min_docs).select("line")
            fresh = fresh.join(settled.hint("merge"), "line", "left_anti")
        runs = [*runs, (self._write(fresh), 0, [batch])]
        self._record(version + 1, runs)
        self.compact(version + 1, runs)

    def compact(self, version: int, runs: list) -> None:
        """Merge the runs of every full level into one of the next."""
        level = 0
        while level <= max(at for _, at, _ in runs):
            full = [r for r in runs if r[1] == level]
            if len(full) >= self.fan:
                merged = (self._write(self._merged([r[0] for r in full])), level + 1, sum((r[2] for r in full), []))
                runs = [r for r in runs if r[1] != level] + [merged]
                version += 1
                self._record(version, runs)
                for run, _, _ in full:
                    self.spark.sql(f"DROP TABLE {run}")
            level += 1

    def _merged(self, names: list[str]) -> DataFrame:
        """One row a line over all of ``names``, by merge joins. (A union of bucketed tables is no way here: grouped by
        line, Spark 4.1 takes it as dealt by line when its scans are not, and gives a line several rows.)"""
        def meet(a: DataFrame, b: DataFrame) -> DataFrame:
            both = a.alias("a").hint("merge").join(b.alias("b"), F.col("a.line") == F.col("b.line"), "full")
            docs = F.coalesce("a.docs", F.lit(0)) + F.coalesce("b.docs", F.lit(0))
            return both.select(F.coalesce("a.line", "b.line").alias("line"), docs.alias("docs"))

        return reduce(meet, [self.spark.table(n) for n in names]).select("line", "docs")

    def common(self) -> DataFrame:
        """``(line, docs)`` of the lines found in ``min_docs`` documents or more; ``docs`` is exact up to that number."""
        names = [run for run, _, _ in self.runs()]
        if not names:
            return self.spark.createDataFrame([], "line binary, docs long")
        return self._merged(names).filter(F.col("docs") >= self.min_docs)

    def drop(self) -> None:
        """Forget the runs and the record (files under ``location`` stay with their folder)."""
        for run, _, _ in self.runs():
            self.spark.sql(f"DROP TABLE {run}")
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_record")


def drop_common(docs: DataFrame, hashed: DataFrame, common: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, n_lines, n_dropped, text``: the texts of ``(doc_id, text)`` without their common lines."""
    # lists of a document's lines are bounded by the document
    lines = hashed.select("doc_key", F.explode("lines").alias("line"))
    # of a line that is in a third of all documents the rows are dealt out before they meet it
    hits = (salted_join(lines, common.select("line"), ["line"], "doc_key").groupBy("doc_key")
            .agg(F.collect_set("line").alias("gone")))
    rows = docs.withColumn("doc_key", doc_key()).join(hits.hint("merge"), "doc_key", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_dropped, kept = [], [], []
            for text, gone in zip(batch.column(1), batch.column(2), strict=True):
                lines, gone = text.as_py().encode().split(b"\n"), set(gone.as_py() or ())
                n_lines.append(len(lines))
                if gone:
                    hashes = _hashes([k for line in lines for k in [line.lower().strip(ENDS)]], min_chars)
                    lines = [line for line, h in zip(lines, hashes, strict=True) if h not in gone]
                n_dropped.append(n_lines[-1] - len(lines))
                kept.append(b"\n".join(lines).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_lines, pa.int64()),
                                              pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())],
                                             ["doc_id", "n_lines", "n_dropped", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "text", "gone").mapInArrow(
        run, f"doc_id {kind}, n_lines long, n_dropped long, text string")


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, runs: LineRuns | None = None,
                batch: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_lines, n_dropped, text``: ``docs`` without the lines found in ``min_docs`` documents or more.

    With ``runs`` the documents are the batch ``batch``, held against all batches added before and itself; without,
    they are fed to new runs in ``BATCHES`` batches, and held against all of them.
    """
    spark = docs.sparkSession
    rows = id_text(docs, id_col, text_col)
    hashed = written(hashed_lines(rows, min_chars), "lines")
    if runs is not None:
        if not batch:
            raise ValueError("a batch needs a name, by which it is known when it is run again")
        runs.add(batch, hashed)
        common = written(runs.common(), "common")
    else:
        location = scratch(spark, "runs")
        runs = LineRuns(spark, "lines_" + uuid.uuid4().hex, location, min_docs)
        part = F.pmod(F.xxhash64("doc_key"), F.lit(BATCHES))
        for i in range(BATCHES):
            runs.add(str(i), hashed.filter(part == i))
        common = written(runs.common(), "common")
        runs.drop()
    return drop_common(rows, hashed, common, min_chars)


def digests(found: DataFrame) -> DataFrame:
    """The kept texts as SHA-256 digests."""
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


#: DuckDB, for the query's columns.
ORACLE = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS nth
  FROM documents
), k AS (
  SELECT doc_id, nth, line,
         translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), common AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(common.key) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN common.key IS NULL THEN line END, chr(10) ORDER BY nth), '')) AS kept_sha256
FROM k LEFT JOIN common ON k.key = common.key GROUP BY doc_id
"""
