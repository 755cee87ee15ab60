"""Reshaping: stat columns to rows, and side-by-side pair comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sosrank.operators.enrich import dim_view
from sosrank.operators.pairs import drop_self
from sosrank.schemas import STAT_COLUMNS

# Display labels of the six stats, in display order.
STAT_LABELS = ["HP", "Attack", "Defense", "Sp. Atk", "Sp. Def", "Speed"]
STAT_SCALE_MAX = 255.0


def scale_stat(v, max_value: float = STAT_SCALE_MAX):
    """``round(v / max * 100, 1)``: a stat on a 0-100 scale."""
    col = F.col(v) if isinstance(v, str) else v
    return F.round(col / F.lit(max_value) * F.lit(100.0), 1)


def _stat_entries(prefix: str = "") -> F.Column:
    return F.array(*[
        F.struct(F.lit(i + 1).alias("stat_order"), F.lit(label).alias("stat"),
                 F.col(f"{prefix}{c}").alias("value"))
        for i, (c, label) in enumerate(zip(STAT_COLUMNS, STAT_LABELS))
    ])


def stats_long(competitors: DataFrame, max_value: float = STAT_SCALE_MAX) -> DataFrame:
    """One row per (competitor, stat) with the raw value and its 0-100 scaling."""
    e = competitors.select("id", "name", F.inline(_stat_entries()))
    return e.select("id", "name", "stat_order", "stat", "value", scale_stat("value", max_value).alias("scaled"))


def compare_stats(pairs: DataFrame, competitors: DataFrame) -> DataFrame:
    """For each pair ``(p1, p2)``: one row per stat with both values and the mirrored left value.

    Each pair is joined to both profiles once and expanded in place (no join on
    the stat label).
    """
    p = drop_self(pairs.select("p1", "p2"), "p1", "p2")
    p = p.join(dim_view(competitors, "p1", {c: f"a_{c}" for c in STAT_COLUMNS}), "p1")
    p = p.join(dim_view(competitors, "p2", {c: f"b_{c}" for c in STAT_COLUMNS}), "p2")
    rows = F.array(*[
        F.struct(F.lit(i + 1).alias("stat_order"), F.lit(label).alias("stat"),
                 F.col(f"a_{c}").alias("v1"), F.col(f"b_{c}").alias("v2"))
        for i, (c, label) in enumerate(zip(STAT_COLUMNS, STAT_LABELS))
    ])
    out = p.select("p1", "p2", F.inline(rows))
    return out.select("p1", "p2", "stat_order", "stat", "v1", "v2", (-F.col("v1")).alias("mirrored_v1"))
