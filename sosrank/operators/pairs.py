"""Entity and pair operators: lookups, recent history, head-to-head, predictions.

Every single-entity lookup has a batch form over all entities (or over a pairs
DataFrame); the batch form is the one meant for scale. Top-k per entity uses
``row_number() <= k`` so Catalyst plans a partial ``WindowGroupLimit`` before
the shuffle: a competitor holding a third of all contests still ships at most
k rows per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sosrank.functions.labels import matchup_text, prob_band
from sosrank.functions.metrics import win_flag
from sosrank.functions.probability import pair_win_prob, predicted_winner, winner_prob
from sosrank.operators.enrich import NEUTRAL_MULTIPLIER, dim_view
from sosrank.operators.ranking import top_k, top_k_per_group

# The columns of a history, and the label of a missing cell.
HISTORY_COLUMNS = ["contest_id", "attacker", "defender", "winner", "multiplier", "att_grp", "def_grp",
                   "contest_date"]
NEUTRAL_LABEL = "normal"


def latest_first() -> list[Column]:
    """Newest contest first; the contest key breaks date ties deterministically."""
    return [F.col("contest_date").desc_nulls_last(), F.col("contest_id").desc()]


def where_eq(df: DataFrame, col: str, value) -> DataFrame:
    return df.where(F.col(col) == F.lit(value))


def where_either(df: DataFrame, cols: list[str], value) -> DataFrame:
    """Rows where any of ``cols`` equals ``value`` (pushed to the scan as an OR filter)."""
    cond = None
    for c in cols:
        e = F.col(c) == F.lit(value)
        cond = e if cond is None else cond | e
    return df.where(cond)


def where_keys(df: DataFrame, keys: dict) -> DataFrame:
    """Rows matching every ``column -> value`` pair (a composite-key lookup)."""
    cond = None
    for c, v in keys.items():
        e = F.col(c) == F.lit(v)
        cond = e if cond is None else cond & e
    return df.where(cond)


def where_pair(df: DataFrame, a, b, cols=("attacker", "defender")) -> DataFrame:
    """Contests between ``a`` and ``b`` in either direction."""
    x, y = F.col(cols[0]), F.col(cols[1])
    return df.where(((x == F.lit(a)) & (y == F.lit(b))) | ((x == F.lit(b)) & (y == F.lit(a))))


def drop_self(df: DataFrame, a: str, b: str) -> DataFrame:
    """Remove rows pairing an entity with itself."""
    return df.where(~F.col(a).eqNullSafe(F.col(b)))


# --- profiles -----------------------------------------------------------------------------------

def profile(competitors: DataFrame, name: str) -> DataFrame:
    return where_eq(competitors, "name", name)


# --- recent history -----------------------------------------------------------------------------

def recent_contests(contests: DataFrame, name: str, k: int = 10, by_defender: DataFrame | None = None) -> DataFrame:
    """The latest k contests of one competitor in either role.

    One branch a role, so that each filter reaches the table the name comes from; a branch keeps its k latest.
    ``by_defender`` is a copy of the contests laid out by defender (``Model.contests_by_defender``).
    """
    other = contests if by_defender is None else by_defender
    mine = [where_eq(contests, "attacker", name),
            where_eq(other, "defender", name).where(F.col("attacker") != F.lit(name))]
    a, d = (top_k(c.select(*HISTORY_COLUMNS), latest_first(), k) for c in mine)
    return top_k(a.unionByName(d), latest_first(), k)


def recent_contests_all(contests: DataFrame, k: int = 10) -> DataFrame:
    """For every competitor, its latest k contests in either role (batch form).

    The latest are chosen over ``(competitor, contest_date, contest_id)`` alone; the other columns are joined back to
    the chosen contests by their key. Where a key is repeated, its rows are chosen among once more.
    """
    roles = contests.select(
        F.explode(F.array_distinct(F.array("attacker", "defender"))).alias("competitor"), "contest_date", "contest_id")
    chosen = top_k_per_group(roles, ["competitor"], latest_first(), k).select("competitor", "contest_id").distinct()
    found = contests.select(*HISTORY_COLUMNS).join(chosen, "contest_id").where(
        (F.col("competitor") == F.col("attacker")) | (F.col("competitor") == F.col("defender")))
    return top_k_per_group(found, ["competitor"], latest_first(), k).select("competitor", *HISTORY_COLUMNS)


def pair_history(contests: DataFrame, a: str, b: str, k: int = 15) -> DataFrame:
    """The latest k contests between a and b in either direction."""
    return top_k(where_pair(contests, a, b).select(*HISTORY_COLUMNS), latest_first(), k)


def pair_record(contests: DataFrame, a: str, b: str, k: int = 15) -> DataFrame:
    """Wins of each side over the *returned* history (at most k contests), one row."""
    h = top_k(where_pair(contests, a, b).select("contest_id", "winner", "contest_date"), latest_first(), k)
    return h.agg(
        F.count(F.when(F.col("winner") == F.lit(a), 1)).cast("bigint").alias("a_wins"),
        F.count(F.when(F.col("winner") == F.lit(b), 1)).cast("bigint").alias("b_wins"),
        F.count(F.lit(1)).cast("bigint").alias("contests"),
    ).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "a_wins", "b_wins", "contests")


def pair_record_all(contests: DataFrame, k: int = 15) -> DataFrame:
    """For every unordered pair that met: wins of each side over its latest k contests."""
    c = contests.select(
        F.least("attacker", "defender").alias("p1"), F.greatest("attacker", "defender").alias("p2"),
        "winner", "contest_date", "contest_id").where(F.col("p1") != F.col("p2"))
    h = top_k_per_group(c, ["p1", "p2"], latest_first(), k)
    return h.groupBy("p1", "p2").agg(
        F.count(F.when(F.col("winner") == F.col("p1"), 1)).cast("bigint").alias("p1_wins"),
        F.count(F.when(F.col("winner") == F.col("p2"), 1)).cast("bigint").alias("p2_wins"),
        F.count(F.lit(1)).cast("bigint").alias("contests"),
    )


# --- head to head -------------------------------------------------------------------------------

def _h2h_agg(df: DataFrame) -> DataFrame:
    return df.groupBy("attacker", "defender").agg(
        F.count(F.lit(1)).cast("bigint").alias("total_matchups"),
        F.sum(win_flag()).cast("bigint").alias("attacker_wins"),
        F.sum(win_flag("winner", "defender")).cast("bigint").alias("defender_wins"),
    )


def head_to_head(contests: DataFrame, a: str, b: str) -> DataFrame:
    """One row per direction with the attacker's and the defender's wins."""
    return _h2h_agg(where_pair(contests, a, b))


def head_to_head_all(contests: DataFrame) -> DataFrame:
    """Directional head-to-head records of every pair (map-side combine absorbs hot pairs)."""
    return _h2h_agg(contests)


def head_to_head_pairs(contests: DataFrame, pairs: DataFrame) -> DataFrame:
    """Head-to-head records for a DataFrame of pairs ``(p1, p2)``, both directions."""
    keys = pairs.select(F.least("p1", "p2").alias("_a"), F.greatest("p1", "p2").alias("_b")).distinct()
    c = contests.withColumn("_a", F.least("attacker", "defender")).withColumn("_b", F.greatest("attacker", "defender"))
    return _h2h_agg(c.join(keys, ["_a", "_b"], "left_semi"))


# --- matrix lookups and predictions -------------------------------------------------------------

def matchup_lookup(matchups: DataFrame, att_grp: str, def_grp: str) -> DataFrame:
    return where_keys(matchups, {"att_grp": att_grp, "def_grp": def_grp}).select("multiplier", "label")


def contest_pairs(contests: DataFrame) -> DataFrame:
    """Distinct (p1 = attacker, p2 = defender) pairs that met; input for the pair operators."""
    return contests.select(F.col("attacker").alias("p1"), F.col("defender").alias("p2")).distinct()


def predict_pairs(pairs: DataFrame, competitors: DataFrame, matchups: DataFrame,
                  default: float = NEUTRAL_MULTIPLIER) -> DataFrame:
    """Two-sided win probability for each pair ``(p1, p2)``.

    Both profiles are joined (a pair with an unknown side is dropped), the matrix
    is looked up in both directions with a neutral default, and
    ``p1 = s1*m12 / (s1*m12 + s2*m21)`` (0.5 when both terms are 0).
    """
    p = drop_self(pairs.select("p1", "p2"), "p1", "p2")
    p = p.join(dim_view(competitors, "p1", {"strength": "s1", "grp": "g1"}), "p1")
    p = p.join(dim_view(competitors, "p2", {"strength": "s2", "grp": "g2"}), "p2")
    m = matchups.select("att_grp", "def_grp", "multiplier", "label")
    fwd = m.select(F.col("att_grp").alias("g1"), F.col("def_grp").alias("g2"),
                   F.struct("multiplier", "label").alias("_c12"))
    rev = m.select(F.col("att_grp").alias("g2"), F.col("def_grp").alias("g1"),
                   F.struct("multiplier", "label").alias("_c21"))
    p = p.join(fwd, ["g1", "g2"], "left").join(rev, ["g1", "g2"], "left")
    m12 = F.coalesce(F.col("_c12.multiplier"), F.lit(default))
    m21 = F.coalesce(F.col("_c21.multiplier"), F.lit(default))
    p = p.select("p1", "p2", "s1", "s2", m12.alias("m12"), m21.alias("m21"),
                 F.coalesce(F.col("_c12.label"), F.lit(NEUTRAL_LABEL)).alias("label12"),
                 F.coalesce(F.col("_c21.label"), F.lit(NEUTRAL_LABEL)).alias("label21"))
    prob = pair_win_prob("s1", "m12", "s2", "m21")
    p = p.withColumn("p1_prob", prob).withColumn("p2_prob", F.lit(1.0) - F.col("p1_prob"))
    return p.select(
        "p1", "p2", "s1", "s2", "m12", "m21", "label12", "label21", "p1_prob", "p2_prob",
        predicted_winner("p1_prob", "p2_prob", "p1", "p2").alias("predicted_winner"),
        winner_prob("p1_prob", "p2_prob").alias("winner_prob"),
        prob_band("p1_prob").alias("p1_band"),
        prob_band("p2_prob").alias("p2_band"),
        matchup_text("m12").alias("text12"),
        matchup_text("m21").alias("text21"),
    )
