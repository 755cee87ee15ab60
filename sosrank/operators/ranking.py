"""Ranking and top-k operators that do not funnel fact-sized data into one task.

``F.rank().over(Window.orderBy(x))`` without a partition moves every row to a
single task. :func:`histogram_rank` instead ranks the *distinct values*:

1. ``h = df.groupBy(*part, x).count()`` -- a distributed aggregate whose size
   is the number of distinct (part, x) values, not the number of rows;
2. a window over ``h`` turns counts into "rows strictly before" prefix sums;
3. the result is joined back on (part, x) with null-safe equality (AQE turns
   the join into a broadcast when ``h`` is measured small).

It reproduces SQL ``RANK`` and ``PERCENT_RANK`` exactly, ties included, with
Spark's NULL order (ASC NULLS FIRST, DESC NULLS LAST). It is the right tool
for rounded scores (a few thousand distinct values at one decimal). For
unrounded values :func:`range_ranks` ranks and numbers every row, and
:func:`top_k_with_rank` those of a top-k report.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sosrank.session import stored


def _order(col: str, descending: bool) -> Column:
    return F.col(col).desc_nulls_last() if descending else F.col(col).asc_nulls_first()


def histogram_ranks(df: DataFrame, order_col: str, specs: Sequence[dict]) -> DataFrame:
    """Several RANK / PERCENT_RANK columns over the same score from one histogram.

    Each spec is ``{"partition_by": [...], "descending": bool, "rank_col": str|None,
    "percent_col": str|None}``. One aggregate ``(all partition keys, score) -> count``
    feeds every spec (re-aggregated to the spec's keys when they are coarser), the
    per-spec windows run over distinct values only, and the combined lookup is
    joined back to ``df`` once.
    """
    all_keys: list[str] = []
    for sp in specs:
        for k in sp.get("partition_by", ()):
            if k not in all_keys:
                all_keys.append(k)
    base = df.groupBy(*all_keys, order_col).agg(F.count(F.lit(1)).alias("_hcnt"))
    lookup, lookup_keys = None, None
    for sp in specs:
        keys = list(sp.get("partition_by", ()))
        h = base if keys == all_keys else base.groupBy(*keys, order_col).agg(F.sum("_hcnt").alias("_hcnt"))
        w = Window.partitionBy(*keys).orderBy(_order(order_col, sp.get("descending", True)))
        before = F.coalesce(F.sum("_hcnt").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        total = F.sum("_hcnt").over(Window.partitionBy(*keys))
        outs = []
        if sp.get("rank_col"):
            outs.append((before + F.lit(1)).cast("bigint").alias(sp["rank_col"]))
        if sp.get("percent_col"):
            outs.append(
                F.when(total > 1, before.cast("double") / (total - F.lit(1)).cast("double"))
                .otherwise(F.lit(0.0))
                .alias(sp["percent_col"])
            )
        h = h.select(*keys, order_col, *outs)
        if lookup is None:
            lookup, lookup_keys = h, keys
        elif set(keys) <= set(lookup_keys):
            lookup = _join_null_safe(lookup, h, keys + [order_col])
        else:
            lookup, lookup_keys = _join_null_safe(h, lookup, lookup_keys + [order_col]), keys
    if set(lookup_keys) != set(all_keys):
        lookup = _join_null_safe(base.select(*all_keys, order_col), lookup, lookup_keys + [order_col])
    # The lookup has one row per distinct (keys, score); AQE broadcasts it if it is measured small, and splits a
    # hot score value otherwise.
    return _join_null_safe(df, lookup, all_keys + [order_col])


def _join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on ``keys`` with NULL-safe equality, keeping one copy of each key."""
    others = [c for c in right.columns if c not in keys]
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *others)
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        cond = c if cond is None else cond & c
    return left.join(r, cond, "inner").select(*left.columns, *others)


def histogram_rank(df: DataFrame, order_col: str, partition_by: Sequence[str] = (), descending: bool = True,
                   rank_col: str | None = "rank", percent_col: str | None = None) -> DataFrame:
    """Append SQL ``RANK`` (bigint) and/or ``PERCENT_RANK`` (double in [0, 1]) columns."""
    return histogram_ranks(df, order_col, [{"partition_by": list(partition_by), "descending": descending,
                                            "rank_col": rank_col, "percent_col": percent_col}])


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """Top-k by a total order; planned as ``TakeOrderedAndProject`` (partial top-k per task)."""
    return df.orderBy(*order).limit(k)


def top_k_with_rank(df: DataFrame, score: str, k: int, tie_break: Sequence[Column], descending: bool = True,
                    rank_col: str = "rank") -> DataFrame:
    """Top-k rows by ``score`` with their *global* SQL ``RANK``.

    Every row ranked above a selected row is itself selected (the selection is a
    prefix of the score order), so ranking inside the k selected rows gives the
    global rank. Cost: one distributed top-k, then a window over k rows.
    """
    o = _order(score, descending)
    top = df.orderBy(o, *tie_break).limit(k)
    return top.withColumn(rank_col, F.rank().over(Window.orderBy(o)).cast("bigint"))


def top_k_per_group(df: DataFrame, partition_by: Sequence[str], order: Sequence[Column], k: int,
                    rn_col: str | None = None) -> DataFrame:
    """First k rows per group by a total order (``row_number() <= k``).

    Catalyst inserts a partial ``WindowGroupLimit`` before the shuffle, so even a
    hot group ships at most k rows per map task.
    """
    name = rn_col or "_rn"
    w = Window.partitionBy(*partition_by).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
    if rn_col is None:
        out = out.drop(name)
    return out


def both_ends(df: DataFrame, score: str, k: int, tie_break: Sequence[Column], label_col: str,
              top_label: str, bottom_label: str) -> DataFrame:
    """Top k by ``score`` descending UNION ALL top k ascending, each with a category label."""
    hi = df.orderBy(F.col(score).desc_nulls_last(), *tie_break).limit(k)
    lo = df.orderBy(F.col(score).asc_nulls_first(), *tie_break).limit(k)
    return hi.withColumn(label_col, F.lit(top_label)).unionByName(lo.withColumn(label_col, F.lit(bottom_label)))


def _ranges(df: DataFrame, order: Sequence[tuple[str, bool]], ties: Sequence[tuple[str, bool]],
            partitions: int | None) -> tuple[DataFrame, DataFrame]:
    """``df`` dealt to ranges of ``order`` (column, descending), each row with its range ``_part`` and its place there
    from 0, ``_place``; and one row a range with the rows before it and where its first value begins.

    Rows alike in ``order`` are dealt on by ``ties`` and a hash of the whole row, so that a value that a third of all rows share
    fills many ranges instead of one task. The rows are stored once: range borders come from a sample, and a second
    evaluation could draw others.
    """
    key = F.struct(*[F.col(c) for c, _ in order])
    dealt = df.select("*", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).alias("_spread"))
    sorting = [*[_order(c, desc) for c, desc in (*order, *ties)], F.col("_spread")]
    ranged = dealt.repartitionByRange(*([partitions] if partitions else []), *sorting)
    # an id made in a sorted range holds the range's number and the row's place
    placed = ranged.sortWithinPartitions(*sorting).withColumn("_id", F.monotonically_increasing_id())
    rows = stored(placed.select(*df.columns, F.shiftright("_id", 33).alias("_part"),
                                F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("_place")), "ranges")

    ends = (rows.groupBy("_part")
            .agg(F.count(F.lit(1)).alias("_n"), F.min_by(key, "_place").alias("_first"),
                 F.max_by(key, "_place").alias("_last")))
    tails = (rows.join(F.broadcast(ends.select(F.col("_part").alias("_of_part"), "_last")),
                       (F.col("_part") == F.col("_of_part")) & key.eqNullSafe(F.col("_last")))
             .groupBy("_part").agg(F.count(F.lit(1)).alias("_tail")))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    parts = ends.join(tails, "_part").select(
        "_part", "_first", "_last", "_tail", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy()).alias("_total"))
    # a value that runs over borders begins in the first range that ends with it
    begins = parts.groupBy("_last").agg(F.min(F.col("_before") + F.col("_n") - F.col("_tail")).alias("_begin"))
    begins = begins.withColumnRenamed("_last", "_value")
    parts = parts.join(begins, F.col("_first").eqNullSafe(F.col("_value")), "left").select(
        "_part", "_before", "_total", F.coalesce("_begin", "_before").alias("_begin"))
    return rows, parts


def range_ranks(df: DataFrame, order: Sequence[tuple[str, bool]], rank_col: str | None = "rank",
                percent_col: str | None = None, number_col: str | None = None,
                ties: Sequence[tuple[str, bool]] = (), partitions: int | None = None) -> DataFrame:
    """SQL ``RANK``, ``PERCENT_RANK`` and ``ROW_NUMBER`` of every row over any key, without a window over all rows.

    ``order`` lists ``(column, descending)``. Rows are range-partitioned by it; the ranges' counts become offsets
    (one row a range), and each range ranks its own rows. Ties that run over a border get the rank of where their
    value begins. Among ties the row number follows ``ties``, then a hash of the row. NULL order is Spark's (ASC NULLS FIRST, DESC
    NULLS LAST). Runs a job when called: the ranges are stored.
    """
    rows, parts = _ranges(df, order, ties, partitions)
    own = Window.partitionBy("_part").orderBy(*[_order(c, desc) for c, desc in order])
    # as many rows as ranges, at most the number of shuffle partitions
    found = rows.join(F.broadcast(parts), "_part")
    rank = F.col("_before") + F.col("_own")
    if rank_col or percent_col:
        found = found.withColumn("_own", F.rank().over(own))
        rank = F.when(F.col("_own") == 1, F.col("_begin") + 1).otherwise(rank).cast("bigint")
    outs = []
    if rank_col:
        outs.append(rank.alias(rank_col))
    if percent_col:
        outs.append(F.when(F.col("_total") > 1, (rank - 1).cast("double") / (F.col("_total") - 1).cast("double"))
                    .otherwise(F.lit(0.0)).alias(percent_col))
    if number_col:
        outs.append((F.col("_before") + F.col("_place") + 1).cast("bigint").alias(number_col))
    return found.select(*df.columns, *outs)


def number_rows(df: DataFrame, order_col: str, out_col: str = "position", partitions: int | None = None) -> DataFrame:
    """1-based ``ROW_NUMBER`` by a key of any type and spread (a NULL key comes first); see :func:`range_ranks`."""
    return range_ranks(df, [(order_col, False)], rank_col=None, number_col=out_col, partitions=partitions)
