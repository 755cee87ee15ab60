"""Join the fact table to its dimensions.

``enrich_contests`` is the per-contest view (role-playing dimension joined
twice, matrix joined with a neutral default). The aggregate queries do not use
it directly: they collapse contests before touching the matrix (see
``sosrank.operators.stats``).
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEUTRAL_MULTIPLIER = 1.0

#: The dimension moves at most so many times a role to spare the contests a second move: it pays where competitors have
#: about as many contests each, or more.
MOST_SLICES = 16


def role_view(competitors: DataFrame, role: str, cols: dict[str, str]) -> DataFrame:
    """The competitor dimension keyed for one role: ``name -> role`` plus renamed attributes."""
    return competitors.select(F.col("name").alias(role), *[F.col(src).alias(dst) for src, dst in cols.items()])


def dim_view(competitors: DataFrame, role: str, cols: dict[str, str]) -> DataFrame:
    """:func:`role_view`; whether it is broadcast is left to Spark."""
    return role_view(competitors, role, cols)


def matrix_view(matchups: DataFrame, out: str = "_mult") -> DataFrame:
    """(att_grp, def_grp, multiplier) with the multiplier renamed."""
    return matchups.select("att_grp", "def_grp", F.col("multiplier").alias(out))


def with_matrix(df: DataFrame, matchups: DataFrame, out: str = "mult",
                default: float = NEUTRAL_MULTIPLIER) -> DataFrame:
    """Left join on (att_grp, def_grp); a missing cell takes the neutral ``default``."""
    keep = [c for c in df.columns if c != out]
    return df.join(matrix_view(matchups), ["att_grp", "def_grp"], "left").select(
        *keep, F.coalesce(F.col("_mult"), F.lit(default)).alias(out))


def _slice(name: str, grid: int) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(grid)).cast("int")


def with_sides(contests: DataFrame, competitors: DataFrame, cols: dict[str, dict[str, str]], grid: int) -> DataFrame:
    """Inner joins of the contests with the dimension on attacker and on defender, ``cols`` naming each role's attributes.

    Cells are pairs of a slice of the attackers and a slice of the defenders, ``grid`` of each: a contest goes to one
    cell and a competitor to the ``grid`` cells of its slice in either role, so that both joins find their rows where
    they are. The contests are moved once for the two joins, the dimension ``grid`` times a role, and a competitor that
    many contests share lies in ``grid`` cells. The merge hint keeps the repeated dimension from being broadcast.
    With fewer than 2 slices both joins are left to Spark.
    """
    if grid < 2:
        for role, attributes in cols.items():
            contests = contests.join(dim_view(competitors, role, attributes), role)
        return contests

    def dealt(df: DataFrame, att: Column, dfn: Column) -> DataFrame:
        return df.withColumn("_cell", att * grid + dfn).repartitionById(grid * grid, "_cell")

    e = dealt(contests, _slice("attacker", grid), _slice("defender", grid))
    other = F.col("_other")
    for role, attributes in cols.items():
        every = F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("_other")
        side, mine = dim_view(competitors, role, attributes).select("*", every), _slice(role, grid)
        side = dealt(side, mine, other) if role == "attacker" else dealt(side, other, mine)
        e = e.join(side.drop("_other").hint("merge"), ["_cell", role])
    return e.drop("_cell")


def enrich_contests(contests: DataFrame, competitors: DataFrame, matchups: DataFrame,
                    default: float = NEUTRAL_MULTIPLIER, grid: int | None = None) -> DataFrame:
    """Each contest with both sides' group and strength and the applicable multiplier.

    Inner joins on attacker and defender (a contest with an unknown side is
    dropped), left join on the matrix with a neutral default. The contests are
    dealt over ``grid`` x ``grid`` cells (see :func:`with_sides`) and carry the
    winner as the side it is. Default: as many cells as the session's shuffle
    partitions hold, none where that would be over ``MOST_SLICES`` a side.
    """
    if grid is None:
        grid = isqrt(int(contests.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        grid = grid if grid <= MOST_SLICES else 0
    winner, side = F.col("winner"), F.col("_side")
    won = F.when(winner == F.col("attacker"), 1).when(winner == F.col("defender"), 2).cast("tinyint")
    c = contests.select("contest_id", "attacker", "defender", won.alias("_side"),
                        F.when(won.isNull(), winner).alias("_neither"))
    e = with_sides(c, competitors, {"attacker": {"grp": "att_grp", "strength": "att_strength"},
                                    "defender": {"grp": "def_grp", "strength": "def_strength"}}, grid)
    e = with_matrix(e, matchups, default=default)
    named = F.when(side == 1, F.col("attacker")).when(side == 2, F.col("defender")).otherwise(F.col("_neither"))
    return e.select("contest_id", "attacker", "defender", named.alias("winner"), "att_grp", "def_grp",
                    "att_strength", "def_strength", "mult")


def with_profile(df: DataFrame, competitors: DataFrame, key: str, cols: dict[str, str]) -> DataFrame:
    """Inner equi-join of ``df[key]`` to competitor ``name``, adding renamed attributes."""
    return df.join(dim_view(competitors, key, cols), key)
