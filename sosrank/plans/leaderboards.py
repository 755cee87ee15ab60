"""Leaderboard queries: activity, raw and adjusted rates, gaps, group dominance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sosrank.functions.metrics import (
    CATEGORY_OVERRATED,
    CATEGORY_UNDERRATED,
    adj_pct,
    analyst_tag,
    gap,
    pct,
    verdict,
)
from sosrank.operators.enrich import dim_view
from sosrank.operators.ranking import both_ends, histogram_ranks, range_ranks, top_k, top_k_with_rank
from sosrank.operators.stats import competitor_stats, round_mean_1dp, win_counts

ADJUSTED_COLUMNS = ["name", "grp", "total_contests", "raw_pct", "adj_pct", "gap", "avg_mult",
                    "rank_in_grp", "percentile", "tag"]


def activity_by_group(contests: DataFrame, competitors: DataFrame) -> DataFrame:
    """Per attacker group: contests, distinct attackers, mean attacker strength; busiest first.

    Contests are counted per attacker first (map-side combine), so the dimension
    join and the group aggregate see one row per attacker instead of one per contest.
    """
    per_att = contests.groupBy("attacker").agg(F.count(F.lit(1)).alias("_n"))
    j = per_att.join(dim_view(competitors, "attacker", {"grp": "grp", "strength": "_s"}), "attacker")
    out = j.groupBy("grp").agg(
        F.sum("_n").cast("bigint").alias("total_contests"),
        # exact even if a name appears twice in the dimension; input is one row per attacker match
        F.count_distinct("attacker").cast("bigint").alias("distinct_attackers"),
        F.round(F.try_divide(F.sum(F.col("_s") * F.col("_n")).cast("double"), F.sum("_n").cast("double")),
                1).alias("avg_strength"),
    )
    return out.orderBy(F.col("total_contests").desc(), F.col("grp"))


def raw_leaderboard(contests: DataFrame, competitors: DataFrame, min_contests: int = 30, k: int = 20) -> DataFrame:
    """Top-k raw win rates with the global RANK by the unrounded rate (ties share a rank)."""
    wc = win_counts(contests, min_contests).join(dim_view(competitors, "name", {"grp": "grp"}), "name")
    wc = wc.withColumn("_p", pct("wins", "total_contests"))
    top = top_k_with_rank(wc, "_p", k, [F.col("name")], rank_col="overall_rank")
    return top.select("overall_rank", "name", "grp", "total_contests", "wins",
                      F.round("_p", 1).alias("raw_pct")).orderBy("overall_rank", "name")


def raw_rank_all(contests: DataFrame, competitors: DataFrame, min_contests: int = 30) -> DataFrame:
    """Every qualifying competitor with its global RANK and PERCENT_RANK by the unrounded raw rate, best first, and its
    position (1-based, ties by name)."""
    wc = win_counts(contests, min_contests).join(dim_view(competitors, "name", {"grp": "grp"}), "name")
    wc = wc.withColumn("_p", pct("wins", "total_contests"))
    ranked = range_ranks(wc, [("_p", True)], "overall_rank", "_pr", "position", ties=[("name", False)])
    return ranked.select("position", "overall_rank", "name", "grp", "total_contests", "wins",
                         F.round("_p", 1).alias("raw_pct"), F.round(F.col("_pr") * 100.0, 1).alias("behind_pct"))


def matchup_leaderboard(contests: DataFrame, competitors: DataFrame, matchups: DataFrame,
                        min_contests: int = 30, k: int = 25) -> DataFrame:
    """Raw and adjusted rate side by side; adjusts by the mean multiplier *rounded to 3 dp*."""
    s = competitor_stats(contests, competitors, matchups, min_contests)
    s = s.select("name", "grp", "total_contests", "wins", "raw_pct",
                 F.round(adj_pct("wins", "total_contests", "avg_mult"), 1).alias("adj_pct"), "avg_mult")
    return top_k(s, [F.col("adj_pct").desc_nulls_last(), F.col("name")], k)


def adjusted_win_rate(contests: DataFrame, competitors: DataFrame, matchups: DataFrame,
                      min_contests: int = 30, tag_labels: dict | None = None,
                      by_part: DataFrame | None = None) -> DataFrame:
    """The headline, ordered by adjusted rate (best first); see :func:`adjusted_rows`."""
    return adjusted_rows(contests, competitors, matchups, min_contests, tag_labels, by_part).orderBy(
        F.col("adj_pct").desc_nulls_last(), F.col("name"))


def adjusted_rows(contests: DataFrame, competitors: DataFrame, matchups: DataFrame,
                  min_contests: int = 30, tag_labels: dict | None = None,
                  by_part: DataFrame | None = None) -> DataFrame:
    """The headline: adjusted rate, gap, rank in group, global percentile and tag, all qualifying rows.

    ``rank_in_grp`` is RANK within the group by the rounded adjusted rate
    (descending); ``percentile`` is PERCENT_RANK by the same value ascending,
    x100, 1 dp. Both come from :func:`histogram_ranks`, so no window sees more
    than the distinct values of the score. ``by_part``: see ``stats.schedule_totals``.
    """
    stats = competitor_stats(contests, competitors, matchups, min_contests, by_part=by_part)
    return rank_adjusted(stats, tag_labels)


def rank_adjusted(s: DataFrame, tag_labels: dict | None = None) -> DataFrame:
    """Gap, rank in group, percentile and tag over per-competitor stats."""
    s = histogram_ranks(s, "adj_pct", [
        {"partition_by": ["grp"], "descending": True, "rank_col": "rank_in_grp"},
        {"partition_by": [], "descending": False, "percent_col": "_pr"},
    ])
    return s.select(
        "name", "grp", "total_contests", "raw_pct", "adj_pct", gap("raw_pct", "adj_pct").alias("gap"), "avg_mult",
        "rank_in_grp", F.round(F.col("_pr") * F.lit(100.0), 1).alias("percentile"),
        analyst_tag("rank_in_grp", "raw_pct", "adj_pct", tag_labels).alias("tag"))


def adjusted_top_in_group(contests: DataFrame, competitors: DataFrame, matchups: DataFrame,
                          min_contests: int = 30, k: int = 3) -> DataFrame:
    """Headline rows with rank in group <= k (the percentile is still over all rows)."""
    return adjusted_rows(contests, competitors, matchups, min_contests).where(F.col("rank_in_grp") <= k).orderBy(
        F.col("adj_pct").desc_nulls_last(), F.col("name"))


def overrated_index(contests: DataFrame, competitors: DataFrame, matchups: DataFrame,
                    min_contests: int = 30, k: int = 5) -> DataFrame:
    """Top k by gap (overrated) UNION ALL bottom k by gap (underrated), with image URL.

    The two arms may overlap when fewer than 2k competitors qualify.
    """
    s = competitor_stats(contests, competitors, matchups, min_contests)
    s = s.withColumn("gap", gap("raw_pct", "adj_pct"))
    out = both_ends(s, "gap", k, [F.col("name")], "category", CATEGORY_OVERRATED, CATEGORY_UNDERRATED)
    # Every stats row came from an inner join on the same name, so attaching the image after the
    # top-k is equivalent and joins only 2k rows to the dimension.
    out = out.join(competitors.select("name", "image_url"), "name")
    over = F.col("category") == CATEGORY_OVERRATED
    # the overrated arm by gap descending, then the underrated arm ascending; the order is set after the join
    signed = F.when(over, -F.col("gap")).otherwise(F.col("gap"))
    nulls_last = F.when(over, F.col("gap").isNull()).otherwise(F.col("gap").isNotNull())
    return out.orderBy(over.desc(), nulls_last, signed, "name").select(
        "category", "name", "grp", "total_contests", "raw_pct", "adj_pct", "gap", "image_url")


def group_dominance(contests: DataFrame, competitors: DataFrame, matchups: DataFrame,
                    min_contests: int = 10) -> DataFrame:
    """Per group: pooled raw rate, macro-average adjusted rate, RANK and verdict.

    The macro average is the exact half-up mean of the 1-dp per-competitor rates
    (order-independent). The rank window runs over one row per group.
    """
    s = competitor_stats(contests, competitors, matchups, min_contests)
    g = s.groupBy("grp").agg(
        F.sum("total_contests").cast("bigint").alias("total_contests"),
        F.sum("wins").cast("bigint").alias("total_wins"),
        F.round(pct(F.sum("wins"), F.sum("total_contests")), 1).alias("raw_grp_pct"),
        round_mean_1dp("adj_pct").alias("avg_adj_pct"),
        F.count(F.lit(1)).cast("bigint").alias("n_competitors"),
    )
    g = g.withColumn("grp_rank", F.rank().over(Window.orderBy(F.col("avg_adj_pct").desc_nulls_last())).cast(
        "bigint")).withColumn("verdict", verdict("avg_adj_pct"))
    return g.select("grp", "total_contests", "total_wins", "raw_grp_pct", "avg_adj_pct", "n_competitors",
                    "grp_rank", "verdict").orderBy("grp_rank", "grp")


# --- derived frames feeding the charts ---------------------------------------------------------

def leaderboard_top(adjusted: DataFrame, k: int = 30) -> DataFrame:
    """The k best adjusted rates, returned in ascending order (bar-chart order)."""
    top = top_k(adjusted, [F.col("adj_pct").desc_nulls_last(), F.col("name")], k)
    return top.orderBy(F.col("adj_pct").asc_nulls_first(), F.col("name").desc())


def meaningful_gap(adjusted: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Rows whose |gap| is strictly above ``threshold``, gap ascending."""
    return adjusted.where(F.abs(F.col("gap")) > F.lit(threshold)).orderBy("gap", "name")


def top_groups(dominance: DataFrame, k: int = 3) -> DataFrame:
    """The k best-ranked groups."""
    return top_k(dominance, [F.col("grp_rank"), F.col("grp")], k)
