"""Distributed ranking equals the plain (single-partition) window functions."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from sosrank.operators.ranking import histogram_ranks, number_rows, range_ranks, top_k_per_group, top_k_with_rank


def _data(spark, n=600, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        v = None if rnd.random() < 0.05 else round(rnd.choice([rnd.uniform(0, 100), 50.0, 12.5]), 1)
        rows.append((i, f"g{rnd.randint(0, 6)}", v))
    return spark.createDataFrame(rows, "id long, grp string, v double")


def test_histogram_ranks_match_windows(spark):
    df = _data(spark)
    got = histogram_ranks(df, "v", [
        {"partition_by": ["grp"], "descending": True, "rank_col": "r_grp"},
        {"partition_by": [], "descending": False, "rank_col": "r_all", "percent_col": "p_all"},
    ])
    want = df.select(
        "id",
        F.rank().over(Window.partitionBy("grp").orderBy(F.col("v").desc_nulls_last())).alias("w_grp"),
        F.rank().over(Window.orderBy(F.col("v").asc_nulls_first())).alias("w_all"),
        F.percent_rank().over(Window.orderBy(F.col("v").asc_nulls_first())).alias("wp_all"),
    )
    j = got.join(want, "id").collect()
    assert len(j) == 600
    for r in j:
        assert r.r_grp == r.w_grp and r.r_all == r.w_all and abs(r.p_all - r.wp_all) < 1e-12


def test_top_k_with_rank_is_global_rank(spark):
    df = _data(spark).where(F.col("v").isNotNull())
    got = {r.id: r.rk for r in top_k_with_rank(df, "v", 40, [F.col("id")], rank_col="rk").collect()}
    full = {r.id: r.rk for r in df.select("id", F.rank().over(Window.orderBy(F.col("v").desc())).alias("rk")).collect()}
    assert len(got) == 40
    assert all(full[i] == rk for i, rk in got.items())


def test_number_rows_equals_row_number_over_hash_like_ids(spark):
    df = spark.range(0, 5000).select(F.xxhash64("id").alias("k"), F.lit("x").alias("p"))
    got = {r.k: r.position for r in number_rows(df, "k", partitions=7).collect()}
    assert [got[k] for k in sorted(got)] == list(range(1, 5001))
    texts = df.select(F.hex("k").alias("k"))
    got = {r.k: r.position for r in number_rows(texts, "k").collect()}
    assert [got[k] for k in sorted(got)] == list(range(1, 5001))
    some = spark.createDataFrame([(None,), (5,), (-3,)], "k long")
    assert [r.k for r in number_rows(some, "k").orderBy("position").collect()] == [None, -3, 5]
    assert number_rows(some.limit(0), "k").count() == 0


def test_range_ranks_match_windows_with_ties_over_borders(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice([None, 7.5, 7.5, 7.5, rnd.random(), -0.5, float("nan")]), rnd.choice("ab")) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, v double, s string")
    for order in ([("v", True)], [("v", False)], [("s", False), ("v", True)]):
        keys = [F.col(c).desc_nulls_last() if d else F.col(c).asc_nulls_first() for c, d in order]
        w, full = Window.orderBy(*keys), Window.orderBy(*keys, F.col("id").desc())
        want = df.select("id", F.rank().over(w).alias("r"), F.percent_rank().over(w).alias("p"),
                         F.row_number().over(full).alias("n")).collect()
        # more ranges than values: the value that half of the rows share lies over several borders
        got = range_ranks(df, order, "r", "p", "n", ties=[("id", True)], partitions=16).collect()
        assert sorted((g.id, g.r, g.p, g.n) for g in got) == sorted((x.id, x.r, x.p, x.n) for x in want)
    assert range_ranks(df.limit(0), [("v", True)], "r", "p", "n").count() == 0
    one = range_ranks(df.limit(1), [("v", True)], "r", "p", "n").first()
    assert (one.r, one.p, one.n) == (1, 0.0, 1)


def test_no_window_of_range_ranks_covers_all_rows(spark):
    df = spark.range(0, 4000).select("id", (F.col("id") % 3).cast("double").alias("v"))
    out = range_ranks(df, [("v", True)], "r", "p", "n", partitions=8)
    rows = out.groupBy(F.spark_partition_id()).count().collect()
    assert out.count() == 4000 and rows
    # ranges, ties split: no range holds more than a share of the rows
    from sosrank.operators.ranking import _ranges
    sizes = [r["count"] for r in _ranges(df, [("v", True)], [], 8)[0].groupBy("_part").count().collect()]
    assert len(sizes) > 4 and max(sizes) < 1500
    plan = out._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        if "Window [" in line and "_total" not in line and "_before" not in line and "sum(_n" not in line:
            assert "_part" in line, line



def test_top_k_per_group_plans_partial_group_limit(spark):
    df = _data(spark)
    out = top_k_per_group(df, ["grp"], [F.col("v").desc_nulls_last(), F.col("id")], 3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    counts = {r.grp: r["count"] for r in out.groupBy("grp").count().collect()}
    assert all(c == 3 for c in counts.values())
