"""Per-competitor and per-group outcome statistics.

The schedule-adjusted rate needs, per attacker, the mean matrix multiplier over
its contests. The multiplier depends only on (attacker group, defender group),
so contests are collapsed *before* the matrix is touched:

    contests --join defender--> (attacker, def_grp, win)
             --groupBy(attacker, def_grp)-->  at most |groups| rows per attacker
             --join attacker, join matrix--> groupBy(attacker, att_grp)

The mean is then ``sum(mult * n) / sum(n)``, which equals ``avg(mult)`` over the
contest rows: the sum is exact in decimals. Only one fact-sized exchange remains
(the defender join); the matrix join and the attacker join see the collapsed rows. Partial aggregation runs map-side, so a
hot attacker or a hot group is combined before the shuffle, and AQE splits a
skewed defender partition of the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sosrank.functions.metrics import adj_pct, pct, safe_div, win_flag
from sosrank.operators.enrich import NEUTRAL_MULTIPLIER, role_view, with_matrix


def win_counts(contests: DataFrame, min_contests: int | None = None) -> DataFrame:
    """Per attacker: contests and wins (wins count for the attacker only)."""
    out = contests.groupBy(F.col("attacker").alias("name")).agg(
        F.count(F.lit(1)).alias("total_contests"),
        F.sum(win_flag()).cast("bigint").alias("wins"),
    )
    if min_contests is not None:
        out = out.where(F.col("total_contests") >= F.lit(min_contests))
    return out


def schedule_totals(contests: DataFrame, competitors: DataFrame, matchups: DataFrame,
                    default: float = NEUTRAL_MULTIPLIER, by_part: DataFrame | None = None) -> DataFrame:
    """Per (attacker, att_grp): total_contests, wins and mult_sum (sum of multipliers).

    Contests are collapsed to counts per ``(attacker, def_grp)`` before the
    attacker join and the matrix lookup, which then see at most ``|groups|`` rows
    per attacker. The defender join is the only join of fact rows; whether it is
    broadcast is left to Spark, which measures the side. Multipliers are summed
    as decimals of nine places, so the sum does not depend on the order of rows.

    ``by_part`` is the dimension once a part (``Model.competitors_by_part``); ``contests`` then have a ``part`` as
    well (``Model.outcomes_by_defender``), and the two meet bucket by bucket.
    """
    spread = [] if by_part is None else ["part"]
    c = contests.select("attacker", "defender", *spread, win_flag().alias("_w"))
    defenders = role_view(competitors if by_part is None else by_part, "defender",
                          {"grp": "def_grp", **{p: p for p in spread}})
    per_grp = (
        c.join(defenders if by_part is None else defenders.hint("merge"), ["defender", *spread])
        .groupBy("attacker", "def_grp")
        .agg(F.count(F.lit(1)).alias("_n"), F.sum("_w").alias("_wins"))
    )
    per_grp = per_grp.join(role_view(competitors, "attacker", {"grp": "att_grp"}), "attacker")
    per_grp = with_matrix(per_grp, matchups, "_m", default)
    weighted = F.col("_m").cast("decimal(18,9)") * F.col("_n").cast("decimal(19,0)")
    return per_grp.groupBy("attacker", "att_grp").agg(
        F.sum("_n").cast("bigint").alias("total_contests"),
        F.sum("_wins").cast("bigint").alias("wins"),
        F.sum(weighted).cast("double").alias("mult_sum"),
    )


def competitor_stats(contests: DataFrame, competitors: DataFrame, matchups: DataFrame,
                     min_contests: int = 30, default: float = NEUTRAL_MULTIPLIER,
                     by_part: DataFrame | None = None) -> DataFrame:
    """Per competitor with at least ``min_contests`` contests as attacker.

    Columns: name, grp, total_contests, wins, raw_pct, adj_pct (by the unrounded
    mean multiplier), avg_mult (rounded to 3 dp), mean_mult (unrounded).
    """
    return stats_from_totals(schedule_totals(contests, competitors, matchups, default, by_part), min_contests)


def stats_from_totals(totals: DataFrame, min_contests: int = 30) -> DataFrame:
    """Rates from per-(attacker, att_grp) totals (``schedule_totals``)."""
    t = totals.where(F.col("total_contests") >= F.lit(min_contests))
    mean = safe_div("mult_sum", "total_contests")
    return t.select(
        F.col("attacker").alias("name"),
        F.col("att_grp").alias("grp"),
        "total_contests",
        "wins",
        F.round(pct("wins", "total_contests"), 1).alias("raw_pct"),
        F.round(adj_pct("wins", "total_contests", mean), 1).alias("adj_pct"),
        F.round(mean, 3).alias("avg_mult"),
        mean.alias("mean_mult"),
    )


def round_mean_1dp(x) -> F.Column:
    """Aggregate: the mean of 1-dp values, rounded half-up to 1 dp, computed exactly.

    Summing doubles depends on the summation order (and so on partitioning); the
    values are first turned into integer tenths, the mean is rounded with integer
    arithmetic, and only the final value is a double. NULL inputs are ignored.
    """
    col = F.col(x) if isinstance(x, str) else x
    tenths = F.sum(F.round(col * F.lit(10.0)).cast("bigint"))
    return half_up_div(tenths, F.count(col)) / F.lit(10.0)


def half_up_div(num, den) -> F.Column:
    """Exact integer ``round_half_up(num / den)`` for num >= 0, den > 0 (NULL when den = 0)."""
    twice = F.lit(2) * num + den
    step = F.lit(2) * den
    q = (twice - F.pmod(twice, step)).cast("double") / step.cast("double")
    return F.when(den > 0, q)

