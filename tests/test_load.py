"""The materialised model (load step used by the bench) answers exactly like the raw derivation."""

import pytest
from pyspark.sql import functions as F

from sosrank.operators import pairs, stats
from sosrank.plans import leaderboards as lb
from sosrank.sources.adapters import Tables
from sosrank.sources.load import PARTS, Model, materialize_model
from tests.helpers import SF_SMALL, ancestors


def test_model_matches_raw_derivation(spark):
    t = Tables(spark, SF_SMALL)
    m = materialize_model(t)
    assert m.contests.count() == t.contests.count()
    for f in (lambda x: lb.adjusted_win_rate(x.outcomes, x.competitors, x.matchups),
              lambda x: lb.group_dominance(x.outcomes, x.competitors, x.matchups),
              lambda x: pairs.recent_contests_all(x.contests)):
        assert sorted(f(m).collect()) == sorted(f(t).collect())


@pytest.fixture(scope="module")
def model(spark):
    return materialize_model(Tables(spark, SF_SMALL), buckets=4)


def test_headline_joins_the_defender_without_moving_contests(spark, model):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        totals = stats.schedule_totals(model.outcomes_by_defender, model.competitors, model.matchups,
                                       by_part=model.competitors_by_part)
        plan = totals._jdf.queryExecution().executedPlan().toString().splitlines()
        above = ancestors("\n".join(plan), "contests_by_defender")
        moved = next(i for i, line in enumerate(above) if "Exchange" in line)
        joined = next(i for i, line in enumerate(above) if "SortMergeJoin" in line)
        combined = next(i for i, line in enumerate(above) if "HashAggregate" in line)
        assert joined < combined < moved  # contests leave their task only as partial counts
        assert all("Exchange" not in line for line in plan if "competitors_by_part" in line)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    t = Tables(spark, SF_SMALL)
    laid = lb.adjusted_win_rate(model.outcomes_by_defender, model.competitors, model.matchups,
                                by_part=model.competitors_by_part)
    assert sorted(laid.collect()) == sorted(lb.adjusted_win_rate(t.outcomes, t.competitors, t.matchups).collect())


def _rows_read(df) -> int:
    """Rows that the plan's scans put out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    leaves, read = plan.collectLeaves(), 0
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        while leaf.getClass().getSimpleName().endswith("QueryStageExec"):
            leaf = leaf.plan()
        metric = leaf.metrics().get("numOutputRows")
        read += metric.get().value() if metric.isDefined() else 0
    return read


def test_lookups_by_defender_skip_row_groups(spark, model):
    name = "Customer#000000007"
    spark.conf.set("parquet.block.size", str(16 * 1024))
    hadoop = spark._jsc.hadoopConfiguration()
    hadoop.set("parquet.block.size", str(16 * 1024))
    hadoop.set("parquet.page.row.count.limit", "200")
    try:
        small = materialize_model(Tables(spark, SF_SMALL), buckets=2)
    finally:
        hadoop.unset("parquet.block.size")
        hadoop.unset("parquet.page.row.count.limit")
        spark.conf.unset("parquet.block.size")
    total = small.contests.count()
    of = small.contests_by_defender.where(F.col("defender") == name)
    own = of.count()
    assert 0 < own < total / 20
    # by defender, row groups without the name are not read; by attacker nearly all of them may hold it
    assert _rows_read(of.select("contest_id", "defender")) < total / 2
    got = pairs.recent_contests(small.contests, name, by_defender=small.contests_by_defender)
    want = pairs.recent_contests(Tables(spark, SF_SMALL).contests, name)
    assert sorted(got.collect()) == sorted(want.collect())


def test_model_opens_from_its_path_alone(spark, model):
    for row in spark.catalog.listTables():
        if row.name.startswith("model_"):
            spark.sql(f"DROP TABLE {row.name}")
    again = Model(spark, model.path)
    assert again.contests_by_defender.count() == again.contests.count()
    assert again.competitors_by_part.count() == PARTS * again.competitors.count()
