"""The corpus pipeline: five stages over ``documents``, each calling one operator on all that its predecessor kept.

Stages take and return the columns of ``documents`` (whichever the table has); the last returns the packed pieces.
Rows are told apart by id and text; of rows that share both, and of near duplicates that share an id, one stays. Null
texts count as empty; a document all of whose words repeat earlier stays with an empty text; empty tables pass
through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sosrank.llm import best_fit_packing, exact_dedup, simhash_neardup, substring_dedup
from sosrank.llm import toxicity as toxic
from sosrank.llm.common import crc32_mod, read_table, written

#: Contract of the SimHash stage: shingle length and maximum bit distance.
SHINGLE_WORDS, MAX_BITS = 3, 2


def _key(part: str | Column) -> Column:
    """One join key of an id and what tells its rows apart; a null id is a key like others."""
    part = F.col(part) if isinstance(part, str) else part
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), part.cast("string"))


def _text_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _only(docs: DataFrame, key: Column, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose key is in ``kept`` (column ``_key``), one a key: the first by a hash of the row.

    Rows of one key are cut to one in each task before they travel, so that a key that a third of all rows share sends
    one text a task.
    """
    pick = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(F.struct("*").alias("_doc"), key.alias("_key"), pick.alias("_pick"))
    one = Window.partitionBy("_key").orderBy("_pick")
    first = rows.withColumn("_n", F.row_number().over(one)).filter("_n = 1")
    return first.join(kept.hint("merge"), "_key", "left_semi").select("_doc.*")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects (score of 0.5 or more) go."""
    model = toxic.fit(docs, read_table(spark, sf_dir, "labels"), holdout=crc32_mod("doc_id", 5) == 0)
    rows = docs.select(F.struct("*").alias("_doc"), F.col("text").alias("_text"))
    return model.score(rows, "_text").filter("score < 0.5").select("_doc.*")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id stays."""
    found = exact_dedup.exact_dedup(docs).filter("kept").select(_key("text_sha256").alias("_key"))
    digest = F.lower(F.hex(exact_dedup.digest(F.col("text"))))
    return _only(docs, _key(digest), found)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest id stays; a null id comes after all others."""
    found = simhash_neardup.near_duplicates(docs, SHINGLE_WORDS, MAX_BITS)
    first = F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "text_key"))
    kept = found.groupBy("root").agg(first.alias("_first")).select("_first.*").select(_key("text_key").alias("_key"))
    return _only(docs, _key(_text_key()), kept)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that stand in an earlier document go; other texts stay as they are."""
    found = substring_dedup.remove_repeats(docs, with_text=True).filter("n_removed > 0")
    cut = found.select(_key("text_key").alias("_key"), F.col("text").alias("_kept")).dropDuplicates(["_key"])
    rows = docs.select(F.struct("*").alias("_doc"), _key(_text_key()).alias("_key"))
    joined = rows.join(cut.hint("merge"), "_key", "left")
    changed = F.col("_kept").isNotNull()
    new = {"text": F.coalesce(F.col("_kept"), F.col("_doc.text"))}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(changed, F.char_length("_kept").cast(kind)).otherwise(F.col("_doc.n_chars"))
    return joined.select(*[new.get(c, F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 4096 tokens."""
    return best_fit_packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity_stage), ("exact_dedup", exact_stage), ("simhash_neardup", near_stage),
          ("substring_dedup", substring_stage), ("best_fit_packing", packing_stage)]

#: The toxicity stage (a fitted model) and the tokenizer's ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
