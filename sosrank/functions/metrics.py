"""Column expressions for rates, gaps and classifications.

All arithmetic is DOUBLE (``F.lit(100.0)``), never DECIMAL, and every division
goes through ``try_divide`` so a zero divisor yields NULL instead of raising
under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The classification labels and thresholds of the reference.
# Analyst tags, in evaluation order (first match wins).
TAG_ELITE = "TRUE ELITE"
TAG_LEADER = "GROUP LEADER"
TAG_OVERRATED = "OVERRATED"
TAG_UNDERRATED = "UNDERRATED"
TAG_STANDARD = "STANDARD"
GAP_TAG_THRESHOLD = 5.0
# Group verdicts: >= 55 dominant, >= 50 strong, >= 45 balanced, else weak.
VERDICT_BOUNDS = [(55.0, "DOMINANT"), (50.0, "STRONG"), (45.0, "BALANCED")]
VERDICT_ELSE = "WEAK"
# Overrated-index categories.
CATEGORY_OVERRATED = "MOST OVERRATED"
CATEGORY_UNDERRATED = "MOST UNDERRATED"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_div(a, b) -> Column:
    """``a / b`` with NULL for a zero (or NULL) divisor."""
    return F.try_divide(_c(a), _c(b))


def pct(wins, n) -> Column:
    """Unrounded percentage ``wins * 100 / n`` (NULL when n = 0)."""
    return safe_div(_c(wins) * F.lit(100.0), _c(n))


def adj_pct(wins, n, avg_mult) -> Column:
    """Unrounded schedule-adjusted percentage ``(wins / avg_mult) * 100 / n``."""
    return safe_div(safe_div(_c(wins) * F.lit(1.0), _c(avg_mult)) * F.lit(100.0), _c(n))


def gap(raw, adj) -> Column:
    """Inflation gap ``round(raw - adj, 1)``: positive = overrated."""
    return F.round(_c(raw) - _c(adj), 1)


def analyst_tag(rank_in_grp, raw, adj, labels: dict | None = None) -> Column:
    """Five-way classification; comparisons use the unrounded difference of the inputs."""
    lab = {
        "elite": TAG_ELITE,
        "leader": TAG_LEADER,
        "over": TAG_OVERRATED,
        "under": TAG_UNDERRATED,
        "standard": TAG_STANDARD,
    }
    lab.update(labels or {})
    r, raw, adj = _c(rank_in_grp), _c(raw), _c(adj)
    return (
        F.when((r == 1) & (adj >= raw), F.lit(lab["elite"]))
        .when(r <= 3, F.lit(lab["leader"]))
        .when(raw - adj > GAP_TAG_THRESHOLD, F.lit(lab["over"]))
        .when(adj - raw > GAP_TAG_THRESHOLD, F.lit(lab["under"]))
        .otherwise(F.lit(lab["standard"]))
    )


def verdict(p) -> Column:
    """Four-way group verdict on a percentage (bounds inclusive)."""
    p = _c(p)
    expr = None
    for bound, label in VERDICT_BOUNDS:
        expr = F.when(p >= bound, F.lit(label)) if expr is None else expr.when(p >= bound, F.lit(label))
    return expr.otherwise(F.lit(VERDICT_ELSE))


def win_flag(winner="winner", attacker="attacker") -> Column:
    """1 when the attacker won, else 0 (wins count for the attacker only)."""
    return F.when(_c(winner) == _c(attacker), F.lit(1)).otherwise(F.lit(0))
