"""Invariants over the generated tables (sf0.001)."""

from pyspark.sql import functions as F

from sosrank.functions.metrics import TAG_ELITE, TAG_LEADER, TAG_OVERRATED, TAG_STANDARD, TAG_UNDERRATED
from sosrank.plans import leaderboards as lb
from sosrank.sources.adapters import Tables
from tests.helpers import SF_SMALL


def test_group_totals_sum_to_fact_count(spark):
    t = Tables(spark, SF_SMALL)
    total = lb.activity_by_group(t.outcomes, t.competitors).agg(F.sum("total_contests")).first()[0]
    assert total == t.outcomes.count()


def test_headline_invariants(spark):
    t = Tables(spark, SF_SMALL)
    rows = lb.adjusted_rows(t.outcomes_reversed, t.competitors, t.matchups, min_contests=1).collect()
    assert rows
    tags = {TAG_ELITE, TAG_LEADER, TAG_OVERRATED, TAG_UNDERRATED, TAG_STANDARD}
    for r in rows:
        assert 0.0 <= r.percentile <= 100.0
        assert r.tag in tags
        assert r.rank_in_grp >= 1
        if r.adj_pct is not None:
            assert abs(r.gap - round(r.raw_pct - r.adj_pct, 1)) < 1e-9
    # each group has exactly one rank-1 unless tied
    firsts = {}
    for r in rows:
        firsts.setdefault(r.grp, []).append(r.rank_in_grp)
    assert all(min(v) == 1 for v in firsts.values())


def test_dominance_totals_match_stats(spark):
    t = Tables(spark, SF_SMALL)
    g = lb.group_dominance(t.outcomes, t.competitors, t.matchups, min_contests=10)
    s = lb.competitor_stats(t.outcomes, t.competitors, t.matchups, 10)
    assert g.agg(F.sum("total_contests")).first()[0] == s.agg(F.sum("total_contests")).first()[0]
    assert g.agg(F.sum("n_competitors")).first()[0] == s.count()
