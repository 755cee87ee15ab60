"""Plan-shape assertions and equivalence of the alternative physical strategies."""

from pyspark.sql import functions as F

from sosrank.operators import pairs, stats
from sosrank.plans import leaderboards as lb
from sosrank.sources.adapters import Tables
from tests.helpers import SF_SMALL


def _plan(df) -> str:
    df.collect()  # final adaptive plan
    return df._jdf.queryExecution().executedPlan().toString()


def _stage_count(spark) -> int:
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup("building"))


def test_totals_collapse_before_the_matrix(spark):
    t = Tables(spark, SF_SMALL)
    s = stats.schedule_totals(t.outcomes, t.competitors, t.matchups)
    logical = s._jdf.queryExecution().optimizedPlan().toString()
    # collapse to (attacker, def_grp) happens before the attacker join
    assert logical.count("Aggregate") >= 2


#: These run jobs when called: they write files and read them back (ranges are stored), or need a pivot's column names.
EAGER = {"csv_roundtrip", "contests_csv_roundtrip", "matrix_wide", "matrix_wide_hidden", "raw_rank_all",
         "raw_rank_all_reversed", "roster_numbered", "contests_csv_rejects"}


def test_building_runs_no_job_and_ranks_no_wide_input_in_one_task(spark):
    from sosrank.plans import registry

    for name, query in registry.queries().items():
        if name in EAGER:
            continue
        spark.sparkContext.setJobGroup("building", name)
        df = query(spark, SF_SMALL)
        jobs = _stage_count(spark)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert jobs == 0, name
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Coalesce 1" not in plan, name


def test_decimal_multipliers_do_not_depend_on_row_order(spark):
    from tests.helpers import competitor, make_competitors, make_contests, make_matchups
    comp = make_competitors(spark, [competitor(n, g) for n, g in (("a", "G0"), ("b", "G1"), ("c", "G2"))])
    m = make_matchups(spark, [("G0", "G1", 0.1), ("G0", "G2", 0.7)])
    c = make_contests(spark, [("a", "b" if i % 3 else "c", i % 2 == 0) for i in range(100)])
    sums = {stats.schedule_totals(c.repartition(n), comp, m).first().mult_sum for n in (1, 3, 7)}
    assert sums == {66 * 0.1 + 34 * 0.7} or sums == {30.4}


def test_no_python_udfs_and_pruned_scan(spark):
    t = Tables(spark, SF_SMALL)
    df = lb.adjusted_win_rate(t.outcomes, t.competitors, t.matchups)
    plan = _plan(df)
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    full = df._jdf.queryExecution().toString()
    # the lineitem scan reads only the columns the derivation needs
    assert "l_extendedprice" not in full.split("== Physical Plan ==")[1]


def test_matrix_queries_do_not_read_the_fact(spark):
    from sosrank.plans import registry

    for name in ("matrix_long", "label_distribution", "matchup_text", "matchup_lookup", "matrix_wide"):
        plan = registry.queries()[name](spark, SF_SMALL)._jdf.queryExecution().toString()
        assert "l_orderkey" not in plan, name


def test_constraints_derive_the_contests_once(spark):
    from sosrank.plans import registry

    plan = registry.queries()["dq_constraints"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_linestatus") and sum("Relation [l_orderkey" in x for x in plan.splitlines()) == 1


def test_global_rank_windows_only_see_histograms(spark):
    t = Tables(spark, SF_SMALL)
    df = lb.adjusted_win_rate(t.outcomes, t.competitors, t.matchups)
    plan = _plan(df)
    # every single-partition exchange sits above an aggregate (the histogram), never above the fact scan
    for block in plan.split("Exchange SinglePartition")[1:]:
        below = block.split("Exchange")[0] if "Exchange" in block else block
        assert "FileScan" not in below


def test_recent_pushes_the_name_to_both_dimensions(spark):
    t = Tables(spark, SF_SMALL)
    plan = pairs.recent_contests(t.contests, "Supplier#000000001")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(s_name,Supplier#000000001)" in plan and "EqualTo(c_name,Supplier#000000001)" in plan


def test_overrated_rows_come_in_order(spark):
    t = Tables(spark, SF_SMALL)
    rows = lb.overrated_index(t.outcomes_reversed, t.competitors, t.matchups).collect()
    over = [r.gap for r in rows if r.category == rows[0].category]
    under = [r.gap for r in rows if r.category != rows[0].category]
    assert over == sorted(over, reverse=True) and under == sorted(under) and len(over) == len(under) == 5
    assert [r.category for r in rows] == [rows[0].category] * 5 + [rows[-1].category] * 5


def test_wide_matrix_rows_in_canonical_order(spark):
    from sosrank.operators import matrix

    t = Tables(spark, SF_SMALL)
    order = t.group_order()
    assert [r.att_grp for r in matrix.matrix_wide(t.matchups, order[::-1]).collect()] == order[::-1]


def test_wide_matrix_shows_present_groups_only(spark):
    from sosrank.operators import matrix

    cells = [("b", "a", 2.0), ("b", "c", 1.0), ("c", "a", 0.5), ("x", "c", 0.0)]
    m = spark.createDataFrame(cells, "att_grp string, def_grp string, multiplier double")
    wide = matrix.matrix_wide(m, ["a", "b", "c", "d"])
    assert wide.columns == ["att_grp", "a", "c"]
    assert [tuple(r) for r in wide.collect()] == [("b", 2.0, 1.0), ("c", 0.5, None)]


def test_recent_contests_travel_as_three_columns(spark):
    import re

    t = Tables(spark, SF_SMALL)
    plan = pairs.recent_contests_all(t.contests)._jdf.queryExecution().executedPlan().toString().splitlines()
    sent = [i for i, line in enumerate(plan) if re.search(r"Exchange hashpartitioning\(competitor", line)]
    assert len(sent) == 2  # the choice among all, and below the join the choice among the chosen
    limit = next(line for line in plan[sent[1]:] if "Sort [" in line)
    narrow = next(line for line in plan[sent[1]:] if "Project" in line or "Generate" in line)
    assert "contest_date" in limit and "multiplier" not in narrow and "att_grp" not in narrow


def test_model_partitioned_by_month(spark):
    from sosrank.sources.load import materialize_model
    m = materialize_model(Tables(spark, SF_SMALL))
    plan = pairs.recent_contests(m.contests, "Supplier#000000001")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(attacker,Supplier#000000001)" in plan
    assert m.contests.where(F.col("attacker") == "Supplier#000000001").count() > 0
