"""The registered queries (names follow the operator inventory)."""

from __future__ import annotations

from sosrank import functions as fn
from sosrank.operators import enrich, matrix, pairs, quality, reshape, stats
from sosrank.plans import leaderboards as lb
from sosrank.plans import lookups as lk
from sosrank.plans import oracle_sql as osql
from sosrank.plans.registry import register
from sosrank.sources import nested

# --- leaderboards -------------------------------------------------------------------------------


@register("activity_by_group", osql.activity_sql())
def _activity(t):
    return lb.activity_by_group(t.outcomes, t.competitors)


@register("raw_leaderboard", osql.raw_leaderboard_sql())
def _raw(t):
    return lb.raw_leaderboard(t.outcomes, t.competitors)


@register("raw_leaderboard_reversed", osql.raw_leaderboard_sql(reversed_roles=True))
def _raw_rev(t):
    return lb.raw_leaderboard(t.outcomes_reversed, t.competitors)


@register("raw_rank_all", osql.raw_rank_all_sql())
def _raw_all(t):
    return lb.raw_rank_all(t.outcomes, t.competitors)


@register("raw_rank_all_reversed", osql.raw_rank_all_sql(reversed_roles=True))
def _raw_all_rev(t):
    return lb.raw_rank_all(t.outcomes_reversed, t.competitors)


@register("matchup_leaderboard", osql.matchup_leaderboard_sql())
def _matchup(t):
    return lb.matchup_leaderboard(t.outcomes, t.competitors, t.matchups)


@register("adjusted_win_rate", osql.adjusted_sql())
def _adjusted(t):
    return lb.adjusted_win_rate(t.outcomes, t.competitors, t.matchups)


@register("adjusted_win_rate_min600", osql.adjusted_sql(600))
def _adjusted600(t):
    return lb.adjusted_win_rate(t.outcomes, t.competitors, t.matchups, min_contests=600)


@register("adjusted_win_rate_reversed", osql.adjusted_sql(reversed_roles=True))
def _adjusted_rev(t):
    return lb.adjusted_win_rate(t.outcomes_reversed, t.competitors, t.matchups)


@register("adjusted_top_in_group", osql.adjusted_sql(top_in_group=3))
def _adjusted_top(t):
    return lb.adjusted_top_in_group(t.outcomes, t.competitors, t.matchups)


@register("adjusted_top_in_group_reversed", osql.adjusted_sql(top_in_group=3, reversed_roles=True))
def _adjusted_top_rev(t):
    return lb.adjusted_top_in_group(t.outcomes_reversed, t.competitors, t.matchups)


@register("overrated_index", osql.overrated_sql())
def _overrated(t):
    return lb.overrated_index(t.outcomes, t.competitors, t.matchups)


@register("overrated_index_reversed", osql.overrated_sql(reversed_roles=True))
def _overrated_rev(t):
    return lb.overrated_index(t.outcomes_reversed, t.competitors, t.matchups)


@register("group_dominance", osql.group_dominance_sql())
def _dominance(t):
    return lb.group_dominance(t.outcomes, t.competitors, t.matchups)


@register("group_dominance_reversed", osql.group_dominance_sql(reversed_roles=True))
def _dominance_rev(t):
    return lb.group_dominance(t.outcomes_reversed, t.competitors, t.matchups)


# --- derived chart frames -----------------------------------------------------------------------

@register("leaderboard_top", osql.leaderboard_top_sql())
def _lb_top(t):
    return lb.leaderboard_top(lb.adjusted_rows(t.outcomes, t.competitors, t.matchups))


@register("meaningful_gap", osql.meaningful_gap_sql())
def _gap(t):
    return lb.meaningful_gap(lb.adjusted_rows(t.outcomes, t.competitors, t.matchups))


@register("top_groups", osql.top_groups_sql())
def _top_groups(t):
    return lb.top_groups(lb.group_dominance(t.outcomes, t.competitors, t.matchups))


# --- building blocks ----------------------------------------------------------------------------

@register("win_counts", osql.win_counts_sql())
def _win_counts(t):
    return stats.win_counts(t.outcomes)


@register("enrich_contests", osql.enrich_contests_sql())
def _enrich(t):
    return enrich.enrich_contests(t.outcomes, t.competitors, t.matchups)


@register("expected_win_prob", osql.expected_win_prob_sql())
def _expected(t):
    return lk.expected_win_probs(t.outcomes, t.competitors, t.matchups)


# --- lookups and pairs --------------------------------------------------------------------------

NAME_A = "Supplier#000000046"
NAME_B = "Customer#000000755"
GROUP_A, GROUP_B = "NATION_3", "NATION_7"


@register("profile", osql.profile_sql(NAME_A))
def _profile(t):
    return pairs.profile(t.competitors, NAME_A)


@register("recent_contests", osql.recent_contests_sql(NAME_A))
def _recent(t):
    return pairs.recent_contests(t.contests, NAME_A)


@register("recent_contests_all", osql.recent_contests_all_sql())
def _recent_all(t):
    return pairs.recent_contests_all(t.contests)


@register("pair_history", osql.pair_history_sql(NAME_A, NAME_B))
def _pair_history(t):
    return pairs.pair_history(t.contests, NAME_A, NAME_B)


@register("pair_record", osql.pair_record_sql(NAME_A, NAME_B))
def _pair_record(t):
    return pairs.pair_record(t.outcomes, NAME_A, NAME_B)


@register("pair_record_all", osql.pair_record_all_sql())
def _pair_record_all(t):
    return pairs.pair_record_all(t.outcomes)


@register("head_to_head", osql.head_to_head_sql(NAME_A, NAME_B))
def _h2h(t):
    return pairs.head_to_head(t.outcomes, NAME_A, NAME_B)


@register("head_to_head_all", osql.head_to_head_all_sql())
def _h2h_all(t):
    return pairs.head_to_head_all(t.outcomes)


@register("head_to_head_pairs", osql.head_to_head_all_sql())
def _h2h_pairs(t):
    met = pairs.contest_pairs(t.outcomes)
    return pairs.head_to_head_pairs(t.outcomes, met.select(met.p2.alias("p1"), met.p1.alias("p2")))


@register("matchup_lookup", osql.matchup_lookup_sql(GROUP_A, GROUP_B))
def _lookup(t):
    return pairs.matchup_lookup(t.matchups, GROUP_A, GROUP_B)


@register("predict_pairs", osql.predict_pairs_sql())
def _predict(t):
    return pairs.predict_pairs(pairs.contest_pairs(t.outcomes), t.competitors, t.matchups)


@register("competitor_report", osql.competitor_report_sql())
def _report(t):
    return lk.competitor_report(t.competitors, t.outcomes, t.matchups)


@register("contest_summary", osql.contest_summary_sql())
def _summary(t):
    return lk.contest_summary(t.outcomes)


@register("table_counts", osql.table_counts_sql())
def _counts(t):
    return quality.table_counts({"competitors": t.competitors, "contests": t.outcomes, "matchups": t.matchups})


@register("roster", osql.roster_sql())
def _roster(t):
    return lk.roster(t.competitors)


@register("roster_numbered", osql.roster_numbered_sql())
def _roster_numbered(t):
    return lk.roster_numbered(t.competitors)


@register("display_names", osql.display_names_sql())
def _display(t):
    return lk.display_names(t.competitors)


# --- matrix and reshape -------------------------------------------------------------------------

@register("matrix_long", osql.matrix_long_sql())
def _matrix_long(t):
    return matrix.matrix_long(t.matchups)


@register("label_distribution", osql.label_distribution_sql())
def _labels(t):
    return matrix.label_distribution(t.matchups)


@register("matchup_text", osql.matchup_text_sql())
def _matchup_text(t):
    m = t.matchups
    return m.select("att_grp", "def_grp", "multiplier", fn.matchup_text("multiplier").alias("text"))


@register("build_matchups", osql.build_matchups_sql())
def _build(t):
    return matrix.build_matchups(t.groups, t.observed_relations)


@register("matrix_wide", osql.matrix_wide_sql())
def _wide(t):
    return matrix.matrix_wide(t.matchups, t.group_order())


@register("matrix_wide_hidden", osql.matrix_wide_sql(hide_neutral=True))
def _wide_hidden(t):
    return matrix.matrix_wide(t.matchups, t.group_order(), hide_neutral=True)


@register("stats_long", osql.stats_long_sql())
def _stats_long(t):
    return reshape.stats_long(t.competitors)


@register("compare_stats", osql.compare_stats_sql())
def _compare(t):
    return reshape.compare_stats(pairs.contest_pairs(t.outcomes), t.competitors)


# --- nested payloads ----------------------------------------------------------------------------

@register("json_profile", osql.json_profile_sql())
def _json_profile(t):
    return nested.profiles_from_json(t.profile_payloads)


@register("levelled_skills", osql.levelled_skills_sql())
def _levelled(t):
    return nested.levelled_skills(t.skills_payloads).select("entity", "skill", "level")


@register("top_skills", osql.top_skills_sql())
def _top_skills(t):
    return nested.top_skills(t.skills_payloads)


@register("event_props", osql.event_props_sql())
def _event_props(t):
    e = t.raw("events")
    # try_cast: a malformed value gives NULL instead of an ANSI cast error
    return e.select("event_id", "event_type", nested.json_scalar("props", "$.k").try_cast("int").alias("k"))


# --- data quality and files ---------------------------------------------------------------------

@register("dq_row_counts", osql.dq_row_counts_sql())
def _dq_counts(t):
    return quality.check_row_counts(
        {"competitors": t.competitors, "contests": t.outcomes, "matchups": t.matchups}, t.expected_counts())


@register("dq_constraints", osql.dq_constraints_sql())
def _dq_constraints(t):
    return lk.model_constraints(t.competitors, quality.seed_violations(t.contests), t.matchups)


@register("contests_csv_roundtrip", osql.contests_csv_roundtrip_sql())
def _contests_csv(t):
    return lk.contests_csv_roundtrip(t.spark, t.contests)


@register("csv_roundtrip", osql.csv_roundtrip_sql())
def _csv(t):
    return lk.csv_roundtrip(t.spark, t.competitors)


@register("contests_csv_rejects", osql.contests_csv_rejects_sql())
def _rejects(t):
    return lk.contests_csv_rejects(t.spark, t.outcomes)
