"""Hand-made edge fixtures: semantics that the generated tables do not reach."""

import datetime as dt

from pyspark.sql import functions as F

from tests.helpers import competitor, make_competitors, make_contests, make_matchups
from sosrank.functions.labels import display_name
from sosrank.functions.metrics import analyst_tag, verdict
from sosrank.operators import matrix, pairs
from sosrank.plans import leaderboards as lb
from sosrank.sources import nested


def _groups(spark):
    return make_matchups(spark, [(a, d, 1.0) for a in "XYZ" for d in "XYZ"])


def test_all_neutral_multipliers_adjusted_equals_raw(spark):
    comp = make_competitors(spark, [competitor(f"a{i}", "X") for i in range(3)] + [competitor("d", "Y")])
    rows = [(f"a{i}", "d", j % (i + 2) == 0) for i in range(3) for j in range(30)]
    out = lb.adjusted_rows(make_contests(spark, rows), comp, _groups(spark)).collect()
    assert len(out) == 3
    for r in out:
        assert r.adj_pct == r.raw_pct and r.gap == 0.0 and r.avg_mult == 1.0


def test_zero_multiplier_gives_null_adjusted_rate_ranked_last(spark):
    comp = make_competitors(spark, [competitor("z", "Z"), competitor("x", "X"), competitor("d", "D")])
    m = make_matchups(spark, [("Z", "D", 0.0), ("X", "D", 1.0)])
    rows = [("z", "d", True)] * 30 + [("x", "d", j % 2 == 0) for j in range(30)]
    out = {r.name: r for r in lb.adjusted_rows(make_contests(spark, rows), comp, m).collect()}
    assert out["z"].adj_pct is None and out["z"].percentile == 0.0
    assert out["x"].percentile == 100.0
    # rank in group: z is alone in its group; a NULL score still gets rank 1 there
    assert out["z"].rank_in_grp == 1


def test_missing_matrix_cell_is_neutral(spark):
    comp = make_competitors(spark, [competitor("a", "X"), competitor("d", "Q")])
    rows = [("a", "d", j < 15) for j in range(30)]
    out = lb.adjusted_rows(make_contests(spark, rows), comp, _groups(spark)).collect()
    assert out[0].avg_mult == 1.0 and out[0].adj_pct == out[0].raw_pct == 50.0


def test_threshold_is_inclusive(spark):
    comp = make_competitors(spark, [competitor("a29", "X"), competitor("a30", "X"), competitor("d", "Y")])
    rows = [("a29", "d", True)] * 29 + [("a30", "d", True)] * 30
    out = lb.adjusted_rows(make_contests(spark, rows), comp, _groups(spark), min_contests=30).collect()
    assert [r.name for r in out] == ["a30"]


def test_rank_ties_share_and_skip(spark):
    comp = make_competitors(spark, [competitor(n, "X") for n in ["p", "q", "r"]] + [competitor("d", "Y")])
    rows = [("p", "d", j < 20) for j in range(30)] + [("q", "d", j < 20) for j in range(30)] + \
           [("r", "d", j < 10) for j in range(30)]
    out = {r.name: r.rank_in_grp for r in lb.adjusted_rows(make_contests(spark, rows), comp, _groups(spark)).collect()}
    assert out == {"p": 1, "q": 1, "r": 3}


def test_single_qualifier_percentile_zero(spark):
    comp = make_competitors(spark, [competitor("a", "X"), competitor("d", "Y")])
    out = lb.adjusted_rows(make_contests(spark, [("a", "d", True)] * 30), comp, _groups(spark)).collect()
    assert out[0].percentile == 0.0


def test_overrated_index_overlapping_ends(spark):
    names = [f"a{i}" for i in range(7)]
    comp = make_competitors(spark, [competitor(n, "X") for n in names] + [competitor("h", "H"), competitor("d", "D")])
    m = make_matchups(spark, [("X", "H", 0.5), ("X", "D", 2.0)])
    # attacker i: 4i contests against the resisted group, the rest against the weak one -> distinct gaps
    rows = [(n, "h" if j < 4 * i else "d", j % 2 == 0) for i, n in enumerate(names) for j in range(30)]
    out = lb.overrated_index(make_contests(spark, rows), comp, m).collect()
    assert len(out) == 10
    over = {r.name for r in out if r.category == "MOST OVERRATED"}
    under = {r.name for r in out if r.category == "MOST UNDERRATED"}
    assert len(over & under) == 3


def test_gap_of_exactly_five_is_not_tagged(spark):
    df = spark.createDataFrame([(4, 60.1, 55.1), (4, 55.1, 60.1), (4, 60.2, 55.1)], "r int, raw double, adj double")
    tags = [r.t for r in df.select(analyst_tag("r", "raw", "adj").alias("t")).collect()]
    # 60.1 - 55.1 is 5.000000000000007 in doubles: the comparison uses the unrounded difference
    assert tags[0] == ("OVERRATED" if 60.1 - 55.1 > 5 else "STANDARD")
    assert tags[1] == ("UNDERRATED" if 60.1 - 55.1 > 5 else "STANDARD")
    assert tags[2] == "OVERRATED"
    exact = spark.createDataFrame([(4, 60.0, 55.0)], "r int, raw double, adj double")
    assert exact.select(analyst_tag("r", "raw", "adj").alias("t")).first().t == "STANDARD"


def test_verdict_bounds_inclusive(spark):
    df = spark.createDataFrame([(55.0,), (50.0,), (45.0,), (44.9,)], "p double")
    assert [r.v for r in df.select(verdict("p").alias("v")).collect()] == ["DOMINANT", "STRONG", "BALANCED", "WEAK"]


def test_rounded_vs_unrounded_mean_divisor(spark):
    comp = make_competitors(spark, [competitor("a", "X"), competitor("h", "H"), competitor("n", "N")])
    m = make_matchups(spark, [("X", "H", 0.5), ("X", "N", 1.0)])
    rows = [("a", "h", True)] * 29 + [("a", "n", False)]
    c = make_contests(spark, rows)
    q03 = lb.matchup_leaderboard(c, comp, m).first()
    q04 = lb.adjusted_rows(c, comp, m).first()
    assert q03.adj_pct == 187.0 and q04.adj_pct == 187.1 and q03.avg_mult == 0.517


def test_pair_probability_fallback_when_both_zero(spark):
    comp = make_competitors(spark, [competitor("a", "X"), competitor("b", "Y")])
    m = make_matchups(spark, [("X", "Y", 0.0), ("Y", "X", 0.0)])
    p = spark.createDataFrame([("a", "b")], "p1 string, p2 string")
    r = pairs.predict_pairs(p, comp, m).first()
    assert r.p1_prob == 0.5 and r.p2_prob == 0.5 and r.predicted_winner == "a"


def test_predict_pairs_default_and_self_pairs(spark):
    comp = make_competitors(spark, [competitor("a", "X", strength=300), competitor("b", "Y", strength=100)])
    m = make_matchups(spark, [("X", "Y", 2.0)])
    p = spark.createDataFrame([("a", "b"), ("a", "a"), ("a", "zz")], "p1 string, p2 string")
    out = pairs.predict_pairs(p, comp, m).collect()
    assert len(out) == 1
    r = out[0]
    assert r.m21 == 1.0 and r.label21 == "normal" and abs(r.p1_prob - 600 / 700) < 1e-12
    assert r.p1_band == "high" and r.p2_band == "low"


def test_head_to_head_both_directions(spark):
    rows = [("a", "b", True), ("a", "b", False), ("b", "a", True), ("a", "c", True)]
    out = {(r.attacker, r.defender): r for r in pairs.head_to_head(make_contests(spark, rows), "a", "b").collect()}
    assert set(out) == {("a", "b"), ("b", "a")}
    assert (out[("a", "b")].attacker_wins, out[("a", "b")].defender_wins) == (1, 1)
    assert out[("b", "a")].total_matchups == 1


def test_pair_history_is_limited_and_record_counts_it(spark):
    rows = [("a", "b", j % 3 == 0, dt.date(2024, 1, 1) + dt.timedelta(days=j)) for j in range(20)]
    c = make_contests(spark, rows)
    h = pairs.pair_history(c, "a", "b")
    assert h.count() == 15
    rec = pairs.pair_record(c, "a", "b").first()
    assert rec.a_wins + rec.b_wins == 15 and rec.contests == 15
    latest = [r.contest_date for r in h.collect()]
    assert latest[0] == dt.date(2024, 1, 20)


def test_override_precedence_and_unknown_targets(spark):
    groups = spark.createDataFrame([("A",), ("B",), ("C",)], "grp string")
    rel = spark.createDataFrame([
        ("A", '{"double_damage_to":[{"name":"B"}],"half_damage_to":[{"name":"B"},{"name":"C"}],'
              '"no_damage_to":[{"name":"C"},{"name":"ELSEWHERE"}]}'),
        ("B", '{"double_damage_to":[{"name":"A"}]}'),
        ("C", None),
        ("OUTSIDER", '{"double_damage_to":[{"name":"A"}]}'),
    ], "grp string, payload string")
    out = {(r.att_grp, r.def_grp): (r.multiplier, r.label) for r in matrix.build_matchups(groups, rel).collect()}
    assert len(out) == 9
    assert out[("A", "B")] == (0.5, "not_very_effective")
    assert out[("A", "C")] == (0.0, "immune")
    assert out[("B", "A")] == (2.0, "super_effective")
    assert out[("C", "A")] == (1.0, "normal")
    assert ("OUTSIDER", "A") not in out and ("A", "ELSEWHERE") not in out


def test_profile_payloads(spark):
    docs = spark.createDataFrame([
        ('{"id": 1, "name": "one", "types": [{"slot": 1, "type": {"name": "fire"}}],'
         ' "stats": [{"base_stat": 5, "stat": {"name": "hp"}}, {"base_stat": 7, "stat": {"name": "speed"}},'
         ' {"base_stat": 99, "stat": {"name": "accuracy"}}], "sprites": {}}',),
        ('{"id": 2, "name": "two", "types": [{"slot": 1, "type": {"name": "water"}},'
         ' {"slot": 2, "type": {"name": "ice"}}], "stats": [], "sprites": {"front_default": null}}',),
        (None,),
    ], "payload string")
    out = {r.id: r for r in nested.profiles_from_json(docs).collect()}
    assert set(out) == {1, 2}
    assert out[1].grp == "fire" and out[1].grp2 is None and out[1].hp == 5 and out[1].speed == 7
    assert out[1].attack is None and out[1].image_url == ""
    assert out[2].grp2 == "ice" and out[2].image_url is None


def test_skills_first_level_up_and_dedup(spark):
    doc = ('{"moves": ['
           '{"move": {"name": "late-skill"}, "version_group_details": ['
           '{"level_learned_at": 0, "move_learn_method": {"name": "level-up"}},'
           '{"level_learned_at": 5, "move_learn_method": {"name": "level-up"}}]},'
           '{"move": {"name": "twice"}, "version_group_details": ['
           '{"level_learned_at": 9, "move_learn_method": {"name": "level-up"}}]},'
           '{"move": {"name": "twice"}, "version_group_details": ['
           '{"level_learned_at": 1, "move_learn_method": {"name": "machine"}},'
           '{"level_learned_at": 3, "move_learn_method": {"name": "level-up"}}]}]}')
    df = spark.createDataFrame([(1, doc)], "entity long, payload string")
    out = [(r.skill, r.level) for r in nested.top_skills(df).orderBy("rank").collect()]
    assert out == [("Twice", 3)]


def test_title_case_after_hyphen(spark):
    df = spark.createDataFrame([("mr-mime",), ("nidoran-f",), ("pikachu",)], "n string")
    assert [r.t for r in df.select(display_name("n").alias("t")).collect()] == ["Mr-Mime", "Nidoran-F", "Pikachu"]


def test_group_dominance_macro_average_is_exact(spark):
    comp = make_competitors(spark, [competitor(f"a{i}", "X") for i in range(3)] + [competitor("d", "Y")])
    # adjusted rates 10.0, 10.1, 10.2 -> mean 10.1 exactly (no binary drift)
    rows = []
    for i, wins in enumerate([100, 101, 102]):
        rows += [(f"a{i}", "d", j < wins) for j in range(1000)]
    g = lb.group_dominance(make_contests(spark, rows), comp, _groups(spark)).where(F.col("grp") == "X").first()
    assert g.avg_adj_pct == 10.1 and g.n_competitors == 3 and g.verdict == "WEAK" and g.grp_rank == 1
