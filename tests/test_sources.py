"""Sources, sinks and data-quality guards."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sosrank.operators.quality import check_constraints, require_columns, require_path
from sosrank.schemas import COMPETITOR_COLUMNS, COMPETITORS
from sosrank.sources.adapters import Tables
from sosrank.sources.files import (
    ReloadError,
    VersionedTable,
    footer_counts,
    read_table,
    read_with_rejects,
    reload_table,
    write_csv,
)
from tests.helpers import SF_SMALL, ancestors, competitor, make_competitors, make_contests


def test_require_columns_lists_missing(spark):
    df = spark.createDataFrame([(1, "a")], "id long, name string")
    assert require_columns(df, ["id"]) is df
    with pytest.raises(ValueError, match=r"\['grp', 'strength'\]"):
        require_columns(df, ["id", "strength", "grp"])


def test_require_path_fails_fast(spark):
    with pytest.raises(FileNotFoundError):
        require_path(spark, os.path.join(tempfile.mkdtemp(), "nope.parquet"))


def test_csv_roundtrip_and_reload(spark):
    d = tempfile.mkdtemp(prefix="sosrank-test-")
    comp = make_competitors(spark, [competitor("a-b", "X", grp2=None, id_=1), competitor("c", "Y", grp2="Z", id_=2,
                                                                                        image="u")])
    write_csv(comp, os.path.join(d, "c.csv"), COMPETITOR_COLUMNS)
    back = read_table(spark, os.path.join(d, "c.csv"), COMPETITORS)
    assert sorted(back.collect()) == sorted(comp.collect())
    reload_table(back, os.path.join(d, "p"))
    table = reload_table(back, os.path.join(d, "p"))  # idempotent: replaced, not appended
    assert sorted(table.read().collect()) == sorted(comp.collect())


def test_reload_that_fails_leaves_the_table(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="sosrank-test-"), "t")
    rows = spark.range(100).select("id", (F.col("id") % 4).cast("int").alias("grp"))
    table = VersionedTable(spark, path, rows.schema)
    with pytest.raises(FileNotFoundError):
        table.read()
    assert reload_table(rows, path, ["grp"], expected=100).read().count() == 100
    open_before = table.read()
    broken = rows.withColumn("id", F.when(F.col("id") == 77, F.raise_error(F.lit("lost")).cast("long"))
                             .otherwise(F.col("id")))
    with pytest.raises(Exception, match="lost"):
        table.replace(broken, ["grp"])
    with pytest.raises(ReloadError, match="99 rows instead of 100"):
        table.replace(rows.where("id <> 5"), ["grp"], expected=100)
    assert table.read().agg(F.sum("id")).first()[0] == 4950 and len(table.log()) == 1
    assert table.replace(rows.limit(0), ["grp"]) == 0 and table.read().count() == 0
    assert open_before.count() == 100  # a reader of the old version is not disturbed
    assert table.replace(rows.limit(7)) == 7 and [r.n for r in table.log()] == [7, 0, 100]
    assert table.vacuum(keep=1) == 2 and table.read().count() == 7


def test_rejected_records_and_their_reasons(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="sosrank-test-"), "t.csv")
    with open(path, "w") as f:
        f.write('id,name,day\n1,a,2024-01-02\nx,b,2024-01-02\n2,"c, d",\n3,,2024-01-02\n4,e\n5,f,2024-01-02,9\n'
                'y,g,today\n,,\n6,"h ""i""",2024-13-40\n')
    schema = T.StructType.fromDDL("id INT NOT NULL, name STRING NOT NULL, day DATE")
    good, bad = read_with_rejects(spark, path, schema)
    assert sorted((r.id, r.name) for r in good.collect()) == [(1, "a"), (2, "c, d")]
    assert good.select("name").count() == 2  # whatever is read, the same records are good
    got = {r.record: r.reasons for r in bad.collect()}
    assert got == {"x,b,2024-01-02": "id", "3,,2024-01-02": "name", "4,e": "fields", "5,f,2024-01-02,9": "fields",
                   "y,g,today": "day,id", ",,": "id,name", '6,"h ""i""",2024-13-40': "day"}


def test_counts_come_from_footers(spark):
    d = tempfile.mkdtemp(prefix="sosrank-test-")
    spark.range(1234).write.parquet(f"{d}/a")
    spark.range(0).write.parquet(f"{d}/b")
    plans, before = [], spark.conf.get("spark.sql.sources.useV1SourceList")
    assert {r.table: r.n for r in footer_counts(spark, {"a": f"{d}/a", "b": f"{d}/b"}, plans).collect()} == {
        "a": 1234, "b": 0}
    assert all("PushedAggregation: [COUNT(*)]" in p for p in plans)
    assert spark.conf.get("spark.sql.sources.useV1SourceList") == before


def test_constraints_report_violations(spark):
    comp = make_competitors(spark, [competitor("a", "X", id_=1), competitor("a", "X", id_=1), competitor("b", "Y", id_=2)])
    con = make_contests(spark, [("a", "b", True), ("a", "a", True), ("ghost", "b", False)])
    rules = {r.rule: r.violations for r in check_constraints(
        con, "contests", pk=["contest_id"], fks=[("attacker", comp, "name")],
        predicates={"no_self": con.attacker != con.defender}).collect()}
    assert rules["contests.pk(contest_id)"] == 0
    assert rules["contests.fk(attacker)"] == 1
    assert rules["contests.no_self"] == 1
    crules = {r.rule: r.violations for r in check_constraints(comp, "competitors", pk=["id"],
                                                              unique=[["name"]]).collect()}
    assert crules["competitors.pk(id)"] == 1 and crules["competitors.unique(name)"] == 1


def test_constraints_over_odd_keys(spark):
    rows = [(1, "a", 1.0), (1, "a", 1.0), (None, "b", None), (None, "c", 2.0), (2, None, 3.0)]
    df = spark.createDataFrame(rows, "k int, name string, v double")
    parents = spark.createDataFrame([(1,), (3,)], "id int")
    check = lambda d: {r.rule: r.violations for r in check_constraints(
        d, "t", pk=["k", "name"], unique=[["k"], ["v"]], not_null=["v"], fks=[("k", parents, "id")],
        predicates={"small": F.col("v") < 3}).collect()}
    assert check(df) == {"t.pk(k,name)": 1, "t.unique(k)": 2, "t.unique(v)": 1, "t.fk(k)": 1, "t.not_null(k)": 2,
                         "t.not_null(name)": 1, "t.not_null(v)": 1, "t.small": 2}
    assert set(check(df.limit(0)).values()) == {0} and len(check(df.limit(0))) == 8


def test_constraints_explode_no_fact_rows(spark):
    t = Tables(spark, SF_SMALL)
    plan = check_constraints(t.contests, "contests", pk=["contest_id"], not_null=["winner"],
                             fks=[("attacker", t.competitors, "name")])._jdf.queryExecution().optimizedPlan().toString()
    above = ancestors(plan, "Relation [l_orderkey")
    generators = [i for i, line in enumerate(above) if "Generate" in line]
    # the one generator stands above the last aggregate, over one row
    assert len(generators) == 1 and generators[0] > max(i for i, line in enumerate(above) if "Aggregate" in line)
    assert "to_json" not in plan and sum("Expand" in line for line in above) == 1


def test_adapter_counts(spark):
    t = Tables(spark, SF_SMALL)
    assert t.matchups.count() == 600
    assert t.competitors.count() == t.raw("supplier").count() + t.raw("customer").count()
    assert t.contests.count() == t.raw("lineitem").count()
    labels = {r.label: r["count"] for r in t.matchups.groupBy("label").count().collect()}
    assert labels == {"immune": 25, "not_very_effective": 120, "normal": 361, "super_effective": 94}


def test_cluster_conf_sizes_partitions():
    from sosrank.session import MB, cluster_conf
    c = cluster_conf(shuffle_bytes=40 * 1024 * 1024 * MB, executors=1000, cores_per_executor=4)
    assert int(c["spark.sql.shuffle.partitions"]) == 209716  # ceil(40 TiB / 200 MiB)
    small = cluster_conf(shuffle_bytes=10 * MB, executors=10, cores_per_executor=4)
    assert int(small["spark.sql.shuffle.partitions"]) == 40  # never below the core count
    assert small["spark.sql.adaptive.skewJoin.enabled"] == "true"
