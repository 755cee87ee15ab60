"""Label and display-text column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Multiplier -> matrix label.
MATCHUP_LABELS = [(0.0, "immune"), (0.5, "not_very_effective"), (1.0, "normal"), (2.0, "super_effective")]
# Multiplier -> display text; any other value renders as "<m>×".
MATCHUP_TEXTS = [(0.0, "IMMUNE (0×)"), (0.5, "Not Very Effective (½×)"), (1.0, "Normal (1×)"),
                 (2.0, "SUPER EFFECTIVE! (2×)")]
# Probability bands (>= 0.5 high, >= 0.3 mid, else low).
PROB_BANDS = [(0.5, "high"), (0.3, "mid")]
PROB_BAND_ELSE = "low"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _lookup(col: Column, pairs, default: Column) -> Column:
    expr = None
    for value, label in pairs:
        cond = col == F.lit(value)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(default)


def matchup_label(mult) -> Column:
    """0 / 0.5 / 1 / 2 -> immune / not_very_effective / normal / super_effective (else NULL)."""
    return _lookup(_c(mult), MATCHUP_LABELS, F.lit(None).cast("string"))


def matchup_text(mult) -> Column:
    """Display text of a multiplier; unknown values render as ``<m>×``."""
    m = _c(mult)
    return _lookup(m, MATCHUP_TEXTS, F.concat(m.cast("string"), F.lit("×")))


def prob_band(p) -> Column:
    p = _c(p)
    return F.when(p >= 0.5, F.lit(PROB_BANDS[0][1])).when(p >= 0.3, F.lit(PROB_BANDS[1][1])).otherwise(
        F.lit(PROB_BAND_ELSE))


def title_case(s) -> Column:
    """Python-style ``str.title`` for names: capitalise after spaces *and* hyphens.

    Spark's ``initcap`` only splits on spaces, so the hyphen parts are
    capitalised separately and rejoined.
    """
    parts = F.split(_c(s), "-")
    return F.array_join(F.transform(parts, lambda p: F.initcap(p)), "-")


def display_name(s) -> Column:
    """Title-cased display name (``mr-mime`` -> ``Mr-Mime``)."""
    return title_case(s)


def skill_display_name(s) -> Column:
    """Skill names: hyphen to space, then title case (``thunder-punch`` -> ``Thunder Punch``)."""
    return F.initcap(F.regexp_replace(_c(s), "-", " "))


def _fmt(pattern: str, v) -> Column:
    # format_string renders NULL as text; keep NULL as NULL
    col = _c(v)
    return F.when(col.isNotNull(), F.format_string(pattern, col))


def pct_text(v) -> Column:
    """``12.3%`` with one decimal (NULL stays NULL)."""
    return _fmt("%.1f%%", v)


def signed_text(v) -> Column:
    """``+2.0`` / ``-1.5`` with one decimal and an explicit sign (NULL stays NULL)."""
    return _fmt("%+.1f", v)


def pad_id(v) -> Column:
    """``#007``: id zero-padded to three digits (NULL stays NULL)."""
    return _fmt("#%03d", v)


def thousands(v) -> Column:
    """``1,234``: integer with thousands separators."""
    return F.format_number(_c(v), 0)
