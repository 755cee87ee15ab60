"""Entity reports, summaries and display-ready frames."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegerType, StringType, StructField, StructType

from sosrank.functions.labels import pad_id, pct_text, signed_text, thousands, title_case
from sosrank.functions.metrics import pct, win_flag
from sosrank.functions.probability import expected_win_prob
from sosrank.operators.enrich import enrich_contests
from sosrank.operators.ranking import number_rows
from sosrank.operators.quality import check_constraints
from sosrank.plans.leaderboards import adjusted_rows
from sosrank.schemas import COMPETITOR_COLUMNS, COMPETITORS
from sosrank.session import scratch_path
from sosrank.sources.files import read_table, read_with_rejects, write_csv


def competitor_report(competitors: DataFrame, contests: DataFrame, matchups: DataFrame,
                      min_contests: int = 30) -> DataFrame:
    """Every competitor's profile with its adjusted-rate row, or ``has_stats = false`` when it
    has fewer than ``min_contests`` contests (profile LEFT JOIN headline rows)."""
    adj = adjusted_rows(contests, competitors, matchups, min_contests).drop("grp")
    prof = competitors.select("id", "name", "grp", "grp2", "strength")
    r = prof.join(adj, "name", "left")
    return r.select(
        "id", "name", "grp", "grp2", "strength",
        title_case("name").alias("display_name"),
        pad_id("id").alias("id_text"),
        "total_contests", "raw_pct", "adj_pct", "gap",
        (-F.col("gap")).alias("delta"),
        pct_text("raw_pct").alias("raw_text"),
        pct_text("adj_pct").alias("adj_text"),
        F.when(F.col("gap") != 0, F.concat(signed_text(-F.col("gap")), F.lit("pp")))
        .when(F.col("gap") == 0, F.lit("0")).alias("delta_text"),
        "rank_in_grp", "percentile", "tag",
        F.col("total_contests").isNotNull().alias("has_stats"),
    )


def contest_summary(contests: DataFrame) -> DataFrame:
    """One row: total contests, distinct attackers, the busiest attacker and its count, and
    the overall attacker win percentage.

    Contests are first counted per attacker (distributed, map-side combined);
    a single global aggregate over those rows picks the busiest attacker with
    ``min(struct(-n, name))`` (ties go to the smallest name), so no cross join
    of one-row frames and no sort is needed.
    """
    per = contests.groupBy("attacker").agg(F.count(F.lit(1)).alias("_n"), F.sum(win_flag()).alias("_w"))
    g = per.agg(
        F.sum("_n").cast("bigint").alias("total_contests"),
        F.count(F.lit(1)).cast("bigint").alias("distinct_attackers"),
        F.min(F.struct((-F.col("_n")).alias("neg_n"), F.col("attacker").alias("name"))).alias("_top"),
        F.sum("_w").alias("_wins"),
    )
    return g.select(
        "total_contests", "distinct_attackers",
        F.col("_top.name").alias("busiest_attacker"),
        (-F.col("_top.neg_n")).cast("bigint").alias("busiest_contests"),
        F.round(pct("_wins", "total_contests"), 1).alias("attacker_win_pct"),
    )


def roster(competitors: DataFrame) -> DataFrame:
    """Names in id order."""
    return competitors.select("id", "name").orderBy("id").select("name")


def roster_numbered(competitors: DataFrame) -> DataFrame:
    """1-based position by id with the ``#007 Name`` label (distributed numbering)."""
    n = number_rows(competitors.select("id", "name"), "id", "position")
    return n.select("position", "name",
                    F.concat(pad_id("position"), F.lit(" "), title_case("name")).alias("label"))


def display_names(competitors: DataFrame) -> DataFrame:
    return competitors.select(
        "id", "name", title_case("name").alias("display_name"), F.upper("grp").alias("grp_badge"),
        pad_id("id").alias("id_text"), thousands("strength").alias("strength_text"))


def expected_win_probs(contests: DataFrame, competitors: DataFrame, matchups: DataFrame) -> DataFrame:
    """Per contest, the attacker's expected win probability ``s_a*m / (s_a*m + s_d)``."""
    e = enrich_contests(contests, competitors, matchups)
    return e.select("contest_id", "attacker", "defender",
                    expected_win_prob("att_strength", "mult", "def_strength").alias("expected_p"))


def model_constraints(competitors: DataFrame, contests: DataFrame, matchups: DataFrame) -> DataFrame:
    """The declared keys, NOT NULLs, foreign keys and row rules of the three tables."""
    comp = check_constraints(competitors, "competitors", pk=["id"], unique=[["name"]],
                             not_null=["name", "grp", "strength"])
    mat = check_constraints(
        matchups, "matchups", pk=["att_grp", "def_grp"], not_null=["multiplier", "label"],
        predicates={"known_multiplier": F.col("multiplier").isin(0.0, 0.5, 1.0, 2.0)})
    con = check_constraints(
        contests, "contests", pk=["contest_id"], not_null=["attacker", "defender", "winner"],
        fks=[("attacker", competitors, "name"), ("defender", competitors, "name")],
        predicates={"no_self_contest": F.col("attacker") != F.col("defender"),
                    "winner_is_side": F.col("winner").isin(F.col("attacker"), F.col("defender"))})
    return comp.unionByName(mat).unionByName(con)


def csv_roundtrip(spark: SparkSession, competitors: DataFrame) -> DataFrame:
    """Write the dimension as CSV (fixed column order) under the shared scratch folder and read
    it back with the declared schema; returns the read-back table."""
    path = scratch_path(spark, f"csv-{uuid.uuid4().hex}")
    write_csv(competitors, path, COMPETITOR_COLUMNS)
    return read_table(spark, path, COMPETITORS, "csv")


CONTESTS_TEXT_DATE = ("contest_id STRING, attacker STRING, defender STRING, winner STRING, att_strength INT, "
                      "def_strength INT, multiplier DOUBLE, att_grp STRING, def_grp STRING, contest_date STRING")


def contests_csv_roundtrip(spark: SparkSession, contests: DataFrame) -> DataFrame:
    """Write the fact table as CSV with text dates (``YYYY-MM-DD``) and read it back, parsing the dates."""
    from sosrank.schemas import CONTEST_COLUMNS

    path = scratch_path(spark, f"csv-{uuid.uuid4().hex}")
    text = contests.withColumn("contest_date", F.date_format("contest_date", "yyyy-MM-dd"))
    write_csv(text, path, CONTEST_COLUMNS)
    back = read_table(spark, path, CONTESTS_TEXT_DATE, "csv")
    return back.withColumn("contest_date", F.to_date("contest_date", "yyyy-MM-dd"))


#: The lean contest as text: everything but the date and the strengths may hold any text.
OUTCOMES_CSV = StructType([
    StructField("contest_id", StringType(), False), StructField("attacker", StringType(), False),
    StructField("defender", StringType(), False), StructField("winner", StringType()),
    StructField("att_strength", IntegerType()), StructField("def_strength", IntegerType()),
    StructField("contest_date", DateType())])


def contests_csv_rejects(spark: SparkSession, outcomes: DataFrame) -> DataFrame:
    """The rejected records, with reasons, of contests written as text lines with faults by the sides' strengths:
    values of another type, missing and left-over fields, empty keys."""
    s = (F.col("att_strength") + F.col("def_strength")) % 97
    text = {f.name: F.coalesce(F.col(f.name).cast("string"), F.lit("")) for f in OUTCOMES_CSV.fields}
    text["att_strength"] = F.when(s.isin(1, 2), F.lit("strong")).otherwise(text["att_strength"])
    text["contest_date"] = F.when(s.isin(2, 3), F.lit("someday")).otherwise(text["contest_date"])
    text["attacker"] = F.when(s == 4, F.lit("")).otherwise(text["attacker"])
    line = F.concat_ws(",", *text.values())
    short = F.concat_ws(",", *list(text.values())[:4])
    line = F.when(s == 5, short).when(s == 6, F.concat(line, F.lit(",more"))).otherwise(line)
    path = scratch_path(spark, f"lines-{uuid.uuid4().hex}")
    outcomes.select(line.alias("value")).write.text(path)
    return read_with_rejects(spark, path, OUTCOMES_CSV, header=False)[1]
