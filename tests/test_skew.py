"""Skewed inputs: one attacker and one defender hold a third of all contests."""

from pyspark.sql import functions as F

from sosrank.operators import pairs, stats
from sosrank.plans import leaderboards as lb
from tests.helpers import competitor, make_competitors, make_contests, make_matchups


def _skewed(spark, n=3000):
    names = [f"c{i:03d}" for i in range(60)]
    comp = make_competitors(spark, [competitor(nm, f"G{i % 5}") for i, nm in enumerate(names)])
    m = make_matchups(spark, [(f"G{a}", f"G{d}", [0.5, 1.0, 2.0][(a + d) % 3]) for a in range(5) for d in range(5)])
    rows = []
    for j in range(n):
        if j % 3 == 0:  # the hot pair: a third of all contests
            rows.append(("c000", "c001", j % 2 == 0))
        else:
            rows.append((names[j % 60], names[(j * 7 + 1) % 60], j % 5 < 2))
    rows = [r for r in rows if r[0] != r[1]]
    return make_contests(spark, rows), comp, m


def test_stats_are_whole_under_skew(spark):
    c, comp, m = _skewed(spark)
    rows = stats.competitor_stats(c, comp, m, 1).collect()
    assert sum(r.total_contests for r in rows) == c.count()
    hot = [r for r in rows if r.name == "c000"][0]
    assert hot.total_contests >= 1000


def test_hot_competitor_history_is_whole(spark):
    c, comp, m = _skewed(spark)
    out = pairs.recent_contests_all(c, k=10)
    per = {r.competitor: r["count"] for r in out.groupBy("competitor").count().collect()}
    assert per["c000"] == 10 and per["c001"] == 10
    # the full history of the hot competitor is still available (nothing dropped upstream)
    assert c.where((F.col("attacker") == "c000") | (F.col("defender") == "c000")).count() >= 1000


def test_headline_under_skew_matches_plain_windows(spark):
    from pyspark.sql import Window
    c, comp, m = _skewed(spark)
    got = {r.name: (r.rank_in_grp, r.percentile) for r in lb.adjusted_rows(c, comp, m, 1).collect()}
    s = stats.competitor_stats(c, comp, m, 1)
    want = s.select(
        "name",
        F.rank().over(Window.partitionBy("grp").orderBy(F.col("adj_pct").desc_nulls_last())).alias("r"),
        F.round(F.percent_rank().over(Window.orderBy(F.col("adj_pct").asc_nulls_first())) * 100, 1).alias("p"),
    ).collect()
    assert {w.name: (w.r, w.p) for w in want} == got
