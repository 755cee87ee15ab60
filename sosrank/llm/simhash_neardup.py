"""SimHash near-duplicate groups by multi-index hashing.

A fingerprint is cut into two segments of 32 bits, each with a table of the segment's values. Fingerprints at most d
bits apart are at most ``segment_radii(d)`` bits apart in one of the segments, so the small Hamming ball about every
value of that segment is enumerated and looked up in the segment's table. Fingerprints whose value meets no other's in
any table have no partner; all others are candidates.

A segment value may be shared by any number of near copies, so a match lists no pairs. Candidates are compared over
their complete values: each enters once under every value of a small ball about all its bits (radius d/2, rounded up on
one side and down on the other), where two in reach always meet; a bucket's members all link to its smallest inner one,
and the complete distance of each link is verified. So a candidate makes as many entries as its ball has values (65 for
2 bits), however large its group, and a bucket holds no more members than that. Equal fingerprints count once.

Results in odd cases: null text counts as empty; texts without words share the fingerprint zero and link like any
other; rows repeated with one id are members of their groups like others; a null id is never a component's id unless
the group has no other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sosrank.llm.common import give_back, id_text, ship, written
from sosrank.llm.components import connected_components

SEED = 42
SHINGLE_WORDS = 3
MAX_BITS = 2
#: Shingles whose votes are counted at a time, which bounds the memory that a long text takes.
VOTE_ROWS = 1 << 15


def shingle_hashes(text: str, k: int = SHINGLE_WORDS) -> list[int]:
    """XXH64 of the text's k-word shingles; of the whole word sequence where it has fewer words."""
    import xxhash

    words = text.encode().lower().split()  # on bytes, lower() and split() touch ASCII only
    if not words:
        return []
    h = xxhash.xxh64_intdigest
    if len(words) <= k:
        return [h(b" ".join(words), SEED)]
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - k + 1].tolist()
    return [h(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1:].tolist(), strict=True)]


def fingerprint(text: str, k: int = SHINGLE_WORDS) -> int:
    """Bit i is set where over half of the shingle hashes set it; without words, 0."""
    hashes = shingle_hashes(text, k)
    if not hashes:
        return 0
    rows = np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8)
    votes = np.zeros(64, np.int64)
    for i in range(0, len(rows), VOTE_ROWS):
        votes += np.unpackbits(rows[i:i + VOTE_ROWS], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(rows)).tobytes(), "big")


def fingerprints(docs: DataFrame, k: int = SHINGLE_WORDS, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``(doc_id, text_key, fp)`` with xxhash64 of the text and the fingerprint as signed longs."""
    ship(docs.sparkSession)
    rows = id_text(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("text_key"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), k) for t in batch.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fps, pa.int64())],
                                             ["doc_id", "text_key", "fp"])
        give_back()

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, text_key long, fp long")


SEGMENT_BITS, SEGMENTS = 32, 2


def segment_radii(max_bits: int) -> list[int]:
    """The radius to search in each segment (-1: none) so that no pair at most ``max_bits`` apart is missed.

    If every segment differed by more than its radius, the whole would differ by more than ``max_bits``.
    """
    radius, extra = divmod(max_bits, SEGMENTS)
    return [radius if s <= extra else radius - 1 for s in range(SEGMENTS)]


def _ball(radius: int, bits: int) -> list[tuple[int, int]]:
    """Masks of at most ``radius`` of ``bits`` bits as signed longs, each with its number of bits."""
    masks = [(sum(1 << b for b in chosen), r) for r in range(radius + 1) for chosen in combinations(range(bits), r)]
    return [(m - (1 << 64) if m >= 1 << 63 else m, r) for m, r in masks]


def segment_tables(classes: DataFrame, radii: list[int]) -> DataFrame:
    """``(fp, seg, own)``: each fingerprint's value in every segment that is searched."""
    cuts = [F.struct(F.lit(s).alias("seg"), own.alias("own"))
            for s, own in enumerate([F.shiftrightunsigned("fp", SEGMENT_BITS),
                                     F.col("fp").bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))]) if radii[s] >= 0]
    return classes.select("fp", F.explode(F.array(*cuts)).alias("t")).select("fp", "t.*")


def segment_matches(tables: DataFrame, radii: list[int]) -> DataFrame:
    """``(seg, own)``: the segment values that several fingerprints share or whose ball reaches another value."""
    values = tables.groupBy("seg", "own").agg(F.count(F.lit(1)).alias("n"))
    balls = F.array().cast("array<bigint>")
    for s, radius in enumerate(radii):
        if radius > 0:
            here = F.array(*[F.lit(m).cast("long") for m, r in _ball(radius, SEGMENT_BITS) if r])
            balls = F.when(F.col("seg") == s, here).otherwise(balls)
    probes = values.select("seg", "own", F.explode(balls).alias("mask")).select(
        "seg", "own", F.col("own").bitwiseXOR(F.col("mask")).alias("near"))
    table = values.select("seg", F.col("own").alias("near"))
    reached = probes.join(table, ["seg", "near"], "left_semi").select("seg", "own")
    return reached.unionByName(values.filter("n > 1").select("seg", "own")).distinct()


def candidates(classes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """The fingerprints ``fp`` that meet another one in a segment's table: all that have a partner in reach."""
    radii = segment_radii(max_bits)
    tables = segment_tables(classes, radii)
    # shuffled on both sides, so that AQE can split the partition of a segment value that very many share
    found = tables.join(segment_matches(tables, radii).hint("merge"), ["seg", "own"], "left_semi")
    return found.select("fp").distinct()


def near_links(classes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints ``fp`` whose components are those of all pairs in reach.

    Every link joins fingerprints at most ``max_bits`` apart; of the pairs in a bucket only those with the bucket's
    hub are listed.
    """
    if not 0 <= max_bits <= 4:
        raise ValueError("the balls are enumerated for 0 to 4 bits")
    if max_bits == 0:
        return classes.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    found = written(candidates(classes, max_bits), "candidates")
    inner = max_bits // 2
    masks = F.array(*[F.struct(F.lit(m).cast("long").alias("mask"), F.lit(r <= inner).alias("inner"))
                      for m, r in _ball((max_bits + 1) // 2, 64)])
    # a small table of candidates makes many entries: deal them out first
    dealt = found.repartition(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    entries = dealt.select("fp", F.explode(masks).alias("e")).select(
        F.col("fp").bitwiseXOR(F.col("e.mask")).alias("key"), "fp", F.col("e.inner").alias("inner"))
    buckets = (entries.groupBy("key")
               .agg(F.min(F.when(F.col("inner"), F.col("fp"))).alias("a"), F.collect_list("fp").alias("members"))
               .filter(F.col("a").isNotNull() & (F.size("members") > 1)))
    return (buckets.select("a", F.explode("members").alias("b")).filter("a <> b")
            .filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits).distinct())


def near_duplicates(docs: DataFrame, k: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row a document: ``doc_id, fingerprint, component_id`` (the smallest id reachable over links), ``text_key``
    and ``root``, the component's smallest fingerprint: unlike an id, it is never null and tells every two components
    apart."""
    prints = written(fingerprints(docs, k, id_col, text_col), "prints")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    roots = connected_components(near_links(classes, max_bits))
    of = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "first_id")
    lowest = of.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = of.join(lowest, "root").select("fp", "component_id", "root")
    # shuffled on both sides, so that AQE can split the partition of a fingerprint with very many copies
    return prints.join(named.hint("merge"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_key",
        "root")
