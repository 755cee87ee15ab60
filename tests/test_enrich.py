"""Enriched contests: what moves, and the rows against plain joins."""

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from sosrank.operators import enrich
from sosrank.plans import lookups
from sosrank.sources.adapters import RAW_SCHEMAS, contest_outcomes_from_tables
from tests.helpers import ancestors, make_matchups


@contextmanager
def no_broadcasts(spark):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def _moves(df, marker: str) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in ancestors(plan, marker) if "Exchange" in x]


def _model(spark):
    comp = [(f"n{i}", f"G{i % 3}", i) for i in range(12)] + [("n1", "G2", 77), (None, "G0", 5), ("n99", None, 0)]
    comp = spark.createDataFrame(comp, "name string, grp string, strength int")
    m = make_matchups(spark, [("G0", "G1", 0.5), ("G1", "G2", 2.0), ("G2", "G2", 0.0)])
    rows = [(f"c{i}", f"n{i % 11}", f"n{i * 7 % 12}", f"n{i % 11 if i % 2 else i * 7 % 12}") for i in range(60)]
    rows += [("d0", None, "n1", "n1"), ("d1", "n1", None, "n1"), ("d2", "n1", "n99", None), ("d3", "n99", "n2", "n5"),
             ("d4", "gone", "n2", "n2"), ("d5", "n2", "gone", "n2"), ("d6", "n3", "n3", "n3"), (None, "n4", "n1", ""),
             ("c1", "n1", "n7", "n1")]
    c = spark.createDataFrame(rows, "contest_id string, attacker string, defender string, winner string")
    return c, comp, m


def _plain(c, comp, m):
    att = comp.select(F.col("name").alias("attacker"), F.col("grp").alias("att_grp"), F.col("strength").alias("att_strength"))
    dfn = comp.select(F.col("name").alias("defender"), F.col("grp").alias("def_grp"), F.col("strength").alias("def_strength"))
    cells = m.select("att_grp", "def_grp", "multiplier")
    e = c.join(att, "attacker").join(dfn, "defender").join(cells, ["att_grp", "def_grp"], "left")
    return e.select("contest_id", "attacker", "defender", "winner", "att_grp", "def_grp", "att_strength", "def_strength",
                    F.coalesce("multiplier", F.lit(1.0)).alias("mult"))


@pytest.mark.parametrize("grid", [0, 2, 3, 7])
def test_rows_are_those_of_plain_joins(spark, grid):
    c, comp, m = _model(spark)
    got, want = enrich.enrich_contests(c, comp, m, grid=grid), _plain(c, comp, m)
    assert got.dtypes == want.dtypes
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() > 60


def test_a_contest_moves_once_for_both_sides(spark):
    c, comp, m = _model(spark)
    with no_broadcasts(spark):
        for query in (enrich.enrich_contests, lookups.expected_win_probs):
            assert len(_moves(query(c, comp, F.broadcast(m)), "Scan ExistingRDD[contest_id")) == 1


def test_many_partitions_leave_the_joins_to_spark(spark):
    c, comp, m = _model(spark)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    for n, dealt in ((3, False), (200, True), (1000, False)):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            plan = enrich.enrich_contests(c, comp, m)._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", was)
        assert ("shufflepartitionidpassthrough" in plan) == dealt


def test_the_winner_moves_as_a_side(spark):
    c, comp, m = _model(spark)
    plan = enrich.enrich_contests(c, comp, m)._jdf.queryExecution().executedPlan().toString()
    sent = next(x for x in ancestors(plan, "Scan ExistingRDD[contest_id") if "Project" in x)
    assert "AS _side" in sent and ", winner" not in sent


def test_the_dimension_in_many_cells_is_not_broadcast(spark):
    c, comp, m = _model(spark)
    plan = enrich.enrich_contests(c, comp, m, grid=3)._jdf.queryExecution().executedPlan().toString()
    below = [part for part in plan.split("BroadcastExchange")[1:] if "Scan ExistingRDD[name" in part]
    assert plan.count("Scan ExistingRDD[name") == 2 and not below


def test_lines_do_not_move_by_customer(spark):
    raw = {name: spark.range(1).selectExpr(*(f"cast(id as {t}) {c}" if t != "TIMESTAMP_NTZ" else f"timestamp_ntz'1997-01-01' {c}"
                                             for c, t in (x.split() for x in RAW_SCHEMAS[name].split(", "))))
           for name in ("lineitem", "orders", "supplier", "customer")}
    raw = [spark.createDataFrame(df.collect(), df.schema) for df in raw.values()]
    with no_broadcasts(spark):
        moves = _moves(contest_outcomes_from_tables(*raw), "Scan ExistingRDD[l_orderkey")
    assert len(moves) == 2 and not any("custkey" in x for x in moves)
