"""SimHash document fingerprints and search within a Hamming radius (DataFrame operations only).

Terms are pairs of neighbouring words. A term's hash votes on each of 128 signed bits with the term's weight (its
letters, at most 15: short function words say little), once for every time it occurs. Votes are counted in packed
lanes: one 64-bit sum holds the votes for two bits, 32 bits apart, so that 128 bits take 64 sums in one codegen
aggregation, which runs where the text is and never sees more than one row a term.

``within_radius`` finds all pairs of fingerprints within a radius by permuted block tables: the fingerprint is cut
into blocks, each table leads with one choice of blocks, and two fingerprints that differ in at most ``radius`` bits
agree on the leading blocks of at least one table.

Results in odd cases: null text counts as empty; a text without a term of two words uses its single word, and one
without words has the fingerprint of zeros; equal texts have equal fingerprints; rows with the same id follow each
other by a hash of their text; the next document of the last row is the first, which for a table of one row is itself; a null id
sorts first; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sosrank.llm.common import BLANKS, id_text, written

BITS = 128
WEIGHT_CAP = 15
#: Ids a bucket when documents are put in order; also the fan-in of the levels above.
RUN = 256
_LANES = 0x0000000100000001


def _terms(text: Column) -> Column:
    words = F.array_remove(F.split(F.lower(text), BLANKS), "")
    return F.arrays_zip(words.alias("a"), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))).alias("b"))


def _votes(h: Column, w: Column) -> list[Column]:
    return [F.sum(F.shiftright(h, k).bitwiseAND(F.lit(_LANES)) * w) for k in range(32)]


def _bits(sums: list[str], total: Column) -> Column:
    """A signed 64-bit word from 32 lane sums: bit k is set where its votes exceed half of all weights."""
    out = F.lit(0).cast("long")
    for k, name in enumerate(sums):
        low, high = F.col(name).bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(F.col(name), 32)
        for bit, lane in ((k, low), (k + 32, high)):
            mask = (1 << bit) - (1 << 64 if bit == 63 else 0)
            out = out.bitwiseOR(F.when(lane * 2 > total, F.lit(mask)).otherwise(F.lit(0).cast("long")))
    return out


def fingerprint_columns(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """``keys, hi, lo`` (two signed 64-bit words) for each row of ``texts``; ``keys`` identify a row."""
    term = F.explode_outer(_terms(F.col(text_col))).alias("t")
    exploded = texts.select(*keys, F.length(F.col(text_col)).alias("_len"), term)
    # the last zipped element has no right neighbour; it only counts for a text of one word
    a, b = F.col("t.a"), F.col("t.b")
    hashed = exploded.select(
        *keys, F.xxhash64(F.lit(1), a, b).alias("h"), F.xxhash64(F.lit(2), a, b).alias("g"),
        F.when(a.isNull(), 0).when(b.isNull(), 0)
        .otherwise(F.least(F.length(a) + F.length(b), F.lit(WEIGHT_CAP))).cast("long").alias("w"),
        F.when(b.isNull(), F.xxhash64(F.lit(1), a)).alias("h1"),
        F.when(b.isNull(), F.xxhash64(F.lit(2), a)).alias("g1"), F.when(a.isNotNull(), 1).alias("n"))
    votes = [*_votes(F.col("h"), F.col("w")), *_votes(F.col("g"), F.col("w"))]
    names = [f"v{i}" for i in range(64)]
    sums = hashed.groupBy(*keys).agg(
        *[v.alias(n) for v, n in zip(votes, names, strict=True)], F.sum("w").alias("total"),
        F.count("n").alias("n_words"), F.max("h1").alias("h1"), F.max("g1").alias("g1"))
    total = F.col("total")
    single = F.col("n_words") == 1
    zero = F.lit(0).cast("long")
    return sums.select(
        *keys,
        F.when(F.col("n_words") == 0, zero).when(single, F.col("h1")).otherwise(_bits(names[:32], total)).alias("hi"),
        F.when(F.col("n_words") == 0, zero).when(single, F.col("g1")).otherwise(_bits(names[32:], total)).alias("lo"))


def as_hex(hi: Column, lo: Column) -> Column:
    return F.concat(*[F.lower(F.lpad(F.hex(x), 16, "0")) for x in (hi, lo)])


def distance(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))


def likeness(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Share of equal bits."""
    return F.lit(1.0) - distance(a, b) / F.lit(float(BITS))


def with_next(df: DataFrame, order: list[str], values: list[str]) -> DataFrame:
    """Add ``next_<value>`` of the next row in ascending order (after the last: the first), without a global sort.

    Rows are dealt to buckets of RUN neighbouring ids (the first order column, a number); a bucket finds its own
    neighbours, and its last row takes the first row of the next bucket that has rows.
    """
    key = F.floor(F.col(order[0]) / F.lit(RUN)).cast("long")
    dealt = df.withColumn("_b", F.coalesce(key, F.lit(-(1 << 62))))
    run = Window.partitionBy("_b").orderBy(*order)
    firsts = dealt.withColumn("_rn", F.row_number().over(run)).filter("_rn = 1").select(
        "_b", F.struct(*values).alias("_first"))
    after = _next_key(dealt.select("_b").distinct(), "_b")
    firsts = after.join(firsts.withColumnRenamed("_b", "_next"), "_next").select("_b", "_first")
    inside = dealt.withColumn("_lead", F.lead(F.struct(*values)).over(run))
    joined = inside.join(firsts, "_b")
    nxt = F.coalesce(F.col("_lead"), F.col("_first"))
    return joined.select(*df.columns, "_b", *[nxt[v].alias(f"next_{v}") for v in values])


def _next_key(keys: DataFrame, name: str, levels: int = 2) -> DataFrame:
    """(key, _next): each distinct key's successor, the last one's being the first; found level by level."""
    if levels == 0:
        everything = Window.orderBy(name)
        ends = keys.agg(F.min(name).alias("_lowest"))
        return (keys.withColumn("_next", F.lead(name).over(everything)).crossJoin(ends)
                .select(name, F.coalesce("_next", "_lowest").alias("_next")))
    up = f"{name}u"
    dealt = keys.withColumn(up, F.floor(F.col(name) / F.lit(RUN)).cast("long"))
    own = dealt.withColumn("_lead", F.lead(name).over(Window.partitionBy(up).orderBy(name)))
    lows = dealt.groupBy(up).agg(F.min(name).alias("_low"))
    above = _next_key(lows.select(up), up, levels - 1).withColumnRenamed("_next", "_upnext")
    lows = above.join(lows.withColumnRenamed(up, "_upnext"), "_upnext").select(up, "_low")
    return own.join(lows, up).select(name, F.coalesce("_lead", "_low").alias("_next"))


def within_radius(queries: DataFrame, index: DataFrame, radius: int, blocks: int | None = None) -> DataFrame:
    """All pairs ``(query_hi, query_lo, hi, lo, bits)`` of distinct fingerprints at most ``radius`` bits apart.

    Both inputs are ``(hi, lo)``. The 128 bits are cut into ``blocks`` (default ``radius + 2``); for each choice of
    ``blocks - radius`` of them there is a table keyed by the chosen blocks, and matches are verified over all bits.
    Copies of a fingerprint count once.
    """
    blocks = blocks or radius + 2
    edges = [BITS * i // blocks for i in range(blocks + 1)]

    def cut(lo_bit: int, hi_bit: int) -> list[Column]:
        parts = []
        for word, base in (("hi", 0), ("lo", 64)):
            a, b = max(lo_bit - base, 0), min(hi_bit - base, 64)
            if a < b:
                mask = ((1 << (b - a)) - 1)
                mask = mask - (1 << 64) if mask >= 1 << 63 else mask
                parts.append(F.shiftrightunsigned(F.col(word), a).bitwiseAND(F.lit(mask).cast("long")))
        return parts

    def tables(df: DataFrame) -> DataFrame:
        keys = []
        for number, chosen in enumerate(combinations(range(blocks), blocks - radius)):
            cols = [c for i in chosen for c in cut(edges[i], edges[i + 1])]
            keys.append(F.struct(F.lit(number).alias("table"), F.array(*cols).alias("lead")))
        return df.select("hi", "lo").distinct().select("hi", "lo", F.explode(F.array(*keys)).alias("key"))

    q = tables(queries).select(F.col("hi").alias("query_hi"), F.col("lo").alias("query_lo"), "key")
    bits = distance((F.col("query_hi"), F.col("query_lo")), (F.col("hi"), F.col("lo")))
    return (q.join(tables(index), "key").withColumn("bits", bits).filter(F.col("bits") <= radius)
            .select("query_hi", "query_lo", "hi", "lo", "bits").distinct())


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its fingerprint, that of its edited text, and their likeness; see the contract of the query.

    The edited text has its last floor(n/2) code points replaced by the first as many (or all) of the next document.
    """
    rows = id_text(docs, id_col, text_col).select(
        "*", F.xxhash64("text").alias("_order"), F.monotonically_increasing_id().alias("row_id"))
    rows = with_next(rows, ["doc_id", "_order"], ["text"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr(F.col("text"), F.lit(1), n - half), F.substr(F.col("next_text"), F.lit(1), half))
    rows = rows.select("_b", "doc_id", "row_id", n.cast("long").alias("n_chars"),
                       F.sha2(edited, 256).alias("edited_sha256"), "_order",
                       F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("text")),
                                         F.struct(F.lit(1).alias("side"), edited.alias("text")))).alias("_v"))
    rows = rows.select("*", F.col("_v.side").alias("side"), F.col("_v.text").alias("text"))
    # grouped by the bucket that the rows are already dealt by: no further shuffle
    keys = ["_b", "doc_id", "row_id", "n_chars", "edited_sha256", "_order", "side"]
    sides = fingerprint_columns(rows, keys)
    pick = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    prints = sides.groupBy(*keys[:-1]).agg(pick(0, "hi").alias("hi"), pick(0, "lo").alias("lo"),
                                           pick(1, "hi").alias("ehi"), pick(1, "lo").alias("elo"))
    prints = written(prints.drop("_b"), "fingerprints")
    own, ed, nxt = ((F.col(a), F.col(b)) for a, b in (("hi", "lo"), ("ehi", "elo"), ("next_hi", "next_lo")))
    near = with_next(prints, ["doc_id", "_order", "row_id"], ["hi", "lo"])
    return near.select("doc_id", "n_chars", "edited_sha256", as_hex(*own).alias("fingerprint"),
                       as_hex(*ed).alias("edited_fingerprint"), likeness(own, ed).alias("near_edited"),
                       likeness(own, nxt).alias("near_next"))
