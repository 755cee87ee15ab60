"""Helpers shared by the operators: table reads, scratch tables in the shared folder, distributed numbering."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sosrank.session import scratch_path

#: ASCII white space, as the contracts of the word-based operators define it.
BLANKS = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) only, whatever else the table carries; a null text counts as empty."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder."""
    return scratch_path(spark, f"llm-{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and a lost executor re-reads files."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()

#: Bytes of a batch that goes to a Python worker, where the session sets no bound of its own: whatever the length of
#: texts, a batch and its copies on both sides stay small against an executor's memory.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, which need not have it installed (once an application), and
    bound the batches that go there: the setting stays in the session, where it has none of its own."""
    sc = spark.sparkContext
    if BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="ship-"), "sosrank_workers.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    sc.addPyFile(archive)  # the driver serves the file to executors, also to those that join later
    _shipped.add(sc.applicationId)


def give_back() -> None:
    """Return memory that a Python worker no longer uses to the system: the process goes on to other operators' tasks,
    and what it once held would count against its executor for good."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it
        pass


def crc32_mod(id_col: str | Column, m: int) -> Column:
    """crc32 of the id as text, modulo ``m``; a null id counts as the empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % m


#: Parts into which the rows of one key are dealt in ``salted_join``.
SALTS = 16


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], spread: str, how: str = "inner",
                salts: int = SALTS) -> DataFrame:
    """Join ``big``, any of whose keys may hold a third of its rows, to the far smaller ``small``.

    The rows of a key are dealt to ``salts`` tasks by a hash of ``spread``, a column that tells them apart; ``small``
    is repeated as often. Larger keys yet are left to AQE, which can split either side's partition.
    """
    dealt = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str, spread: int = 64) -> DataFrame:
    """Number the rows 0, 1, 2 ... within ``keys`` without gathering a key in one task.

    Rows are dealt to ``spread`` blocks by a hash of the order columns; each block numbers its own rows of a key,
    and the block's offset is the sum of the key's counts in the blocks before it (``spread`` rows a key).
    Which of a key's rows gets which number carries no meaning beyond being the same in every run.
    """
    block = F.pmod(F.xxhash64(*order), F.lit(spread)).cast("int").alias("_block")
    dealt = df.select("*", block)
    counts = dealt.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    own = Window.partitionBy(*keys, "_block").orderBy(*order)
    return (dealt.withColumn("_r", F.row_number().over(own) - 1)
            .join(offsets, [*keys, "_block"])
            .withColumn(out, (F.col("_r") + F.col("_off")).cast("long"))
            .drop("_r", "_off", "_block"))
