"""Column-expression functions (built-in Spark functions only, no UDFs)."""

from sosrank.functions.labels import (  # noqa: F401
    display_name,
    matchup_label,
    matchup_text,
    pad_id,
    pct_text,
    prob_band,
    signed_text,
    skill_display_name,
    thousands,
    title_case,
)
from sosrank.functions.metrics import (  # noqa: F401
    adj_pct,
    analyst_tag,
    gap,
    pct,
    safe_div,
    verdict,
    win_flag,
)
from sosrank.functions.probability import (  # noqa: F401
    expected_win_prob,
    pair_win_prob,
    predicted_winner,
    winner_prob,
)
