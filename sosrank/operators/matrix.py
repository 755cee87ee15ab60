"""Matchup-matrix construction and reshaping.

``build_matchups`` rebuilds the long matrix from per-group relation payloads:
every (attacker, defender) cell starts neutral, then the relation lists
override it with precedence none (0) > half (0.5) > double (2) -- the order in
which a sequential loader would overwrite a cell. Targets (and attacker groups)
outside the known group list are ignored; a NULL payload (failed fetch) leaves
its row neutral.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sosrank.functions.labels import matchup_label
from sosrank.operators.enrich import NEUTRAL_MULTIPLIER
from sosrank.schemas import RELATIONS_PAYLOAD

# Relation list -> (multiplier, precedence); a higher precedence wins a cell.
RELATION_LISTS = [("double_damage_to", 2.0, 1), ("half_damage_to", 0.5, 2), ("no_damage_to", 0.0, 3)]


def relation_edges(relations: DataFrame, payload_col: str = "payload", grp_col: str = "grp") -> DataFrame:
    """Explode relation payloads into ``(att_grp, def_grp, multiplier, prio)`` edges.

    A missing list counts as empty; a NULL or unparsable payload yields no edges.
    The three lists are tagged and concatenated per row and exploded once, so
    the relations input is read a single time.
    """
    parsed = relations.select(F.col(grp_col).alias("att_grp"),
                              F.from_json(F.col(payload_col), RELATIONS_PAYLOAD).alias("_r"))
    def tag(mult: float, prio: int):
        return lambda t: F.struct(t["name"].alias("def_grp"), F.lit(mult).alias("multiplier"),
                                  F.lit(prio).alias("prio"))

    tagged = [F.transform(F.coalesce(F.col(f"_r.{name}"), F.array()), tag(mult, prio))
              for name, mult, prio in RELATION_LISTS]
    return parsed.select("att_grp", F.explode(F.concat(*tagged)).alias("_e")).select(
        "att_grp", "_e.def_grp", "_e.multiplier", "_e.prio")


def apply_overrides(edges: DataFrame) -> DataFrame:
    """Collapse edges to one multiplier per cell: the highest precedence wins."""
    return edges.groupBy("att_grp", "def_grp").agg(F.max_by("multiplier", "prio").alias("multiplier"))


def grid(groups: DataFrame, grp_col: str = "grp") -> DataFrame:
    """All (att_grp, def_grp) cells over a group list.

    The output is groups^2 by definition, which is the one product in the library.
    """
    g = groups.select(F.col(grp_col).alias("att_grp")).distinct()
    d = groups.select(F.col(grp_col).alias("def_grp")).distinct()
    return g.crossJoin(d)


def build_matchups(groups: DataFrame, relations: DataFrame, default: float = NEUTRAL_MULTIPLIER) -> DataFrame:
    """The full long matrix (att_grp, def_grp, multiplier, label) from relation payloads."""
    known = groups.select(F.col("grp").alias("def_grp")).distinct()
    edges = relation_edges(relations).join(known, "def_grp", "left_semi")
    cells = apply_overrides(edges)
    out = grid(groups).join(cells, ["att_grp", "def_grp"], "left")
    mult = F.coalesce(F.col("multiplier"), F.lit(default))
    return out.select("att_grp", "def_grp", mult.alias("multiplier"), matchup_label(mult).alias("label"))


def matrix_long(matchups: DataFrame) -> DataFrame:
    return matchups.select("att_grp", "def_grp", "multiplier", "label").orderBy("att_grp", "def_grp")


def label_distribution(matchups: DataFrame) -> DataFrame:
    """Cells per label, most frequent first."""
    return matchups.groupBy("label").agg(F.count(F.lit(1)).cast("bigint").alias("n")).orderBy(
        F.col("n").desc(), F.col("label"))


def matrix_wide(matchups: DataFrame, order: Sequence[str], hide_neutral: bool = False,
                neutral: float = NEUTRAL_MULTIPLIER) -> DataFrame:
    """Pivot to one row per attacker group and one column per group in ``order``.

    ``order`` is the canonical order; rows are the attacker groups present, columns
    the defender groups present, both in that order, and groups outside it are left
    out. A cell absent from the long matrix is NULL and ``hide_neutral`` blanks the
    neutral cells. The columns are part of the plan, so the defender groups, one a
    column, are read first.
    """
    present = {r.def_grp for r in matchups.select("def_grp").distinct().collect()}
    columns = [g for g in order if g in present]
    value = F.col("multiplier")
    if hide_neutral:
        value = F.when(value != F.lit(neutral), value)
    wide = matchups.withColumn("_v", value).groupBy("att_grp").pivot("def_grp", columns).agg(F.max("_v"))
    at = F.array_position(F.array(*[F.lit(g) for g in order]), F.col("att_grp"))
    return wide.where(at > 0).orderBy(at).select("att_grp", *columns)
