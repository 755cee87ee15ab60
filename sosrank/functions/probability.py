"""Win-probability column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def expected_win_prob(att_strength, mult, def_strength) -> Column:
    """One-sided probability ``s_a*m / (s_a*m + s_d)`` (NULL when the denominator is 0)."""
    adj = _c(att_strength) * _c(mult)
    return F.try_divide(adj, adj + _c(def_strength))


def pair_win_prob(s1, m12, s2, m21) -> Column:
    """Two-sided probability that side 1 wins: ``s1*m12 / (s1*m12 + s2*m21)``; 0.5 when both are 0."""
    a1 = _c(s1).cast("double") * _c(m12)
    a2 = _c(s2).cast("double") * _c(m21)
    return F.when(a1 + a2 > 0, a1 / (a1 + a2)).otherwise(F.lit(0.5))


def predicted_winner(p1, p2, n1, n2) -> Column:
    """Name of the predicted winner; a tie goes to side 1."""
    return F.when(_c(p1) >= _c(p2), _c(n1)).otherwise(_c(n2))


def winner_prob(p1, p2) -> Column:
    return F.greatest(_c(p1), _c(p2))
