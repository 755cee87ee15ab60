"""Derive contests / competitors / matchups from the star-schema test tables.

The test tables contain no contests, so this adapter maps them onto the
library's data model (the same derivation is written in SQL in
``sosrank.plans.oracle_sql`` for the DuckDB check):

* competitors = suppliers UNION ALL customers, group = nation name;
* contests    = one per lineitem: the supplier attacks the ordering customer
  and wins iff ``l_linestatus = 'F'``;
* matchups    = nation-by-nation multipliers from a fixed rule, with the
  ``k = 23`` diagonal left out so the neutral default is exercised;
* observed relations = per-group relation payloads derived from the attacker
  win share of every group pair over all contests (input of the matrix
  construction query, so its work grows with the data).
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sosrank.functions.labels import matchup_label
from sosrank.schemas import COMPETITOR_COLUMNS, CONTEST_COLUMNS, STAT_COLUMNS

# Fixed values of the derivation.
CUSTOMER_ID_OFFSET = 1_000_000_000
N_NATIONS = 25  # modulus of the matchup rule over nation keys
MISSING_OFFSET = 23  # matrix cells with this offset are left out


# Declared read schemas of the source tables (the columns this adapter uses).
# Declaring them avoids a footer-reading job per table at plan-construction time.
RAW_SCHEMAS = {
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
                "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, "
                "l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = os.path.join(sf_dir, f"{name}.parquet")
    if name in RAW_SCHEMAS:
        return spark.read.schema(RAW_SCHEMAS[name]).parquet(path)
    return spark.read.parquet(path)


def _strength(acctbal: Column) -> Column:
    return (F.lit(1) + F.floor(F.abs(acctbal))).cast("int")


def _stats(id_col: Column) -> list[Column]:
    return [((id_col * 7 + 13 * i) % 256).cast("int").alias(c) for i, c in enumerate(STAT_COLUMNS)]


def competitors_from_tables(supplier: DataFrame, customer: DataFrame, nation: DataFrame) -> DataFrame:
    """Suppliers and customers as one competitor dimension."""
    n = nation.select("n_nationkey", "n_name")
    sup = supplier.join(n, supplier.s_nationkey == n.n_nationkey).select(
        F.col("s_suppkey").cast("bigint").alias("id"),
        F.col("s_name").alias("name"),
        F.col("n_name").alias("grp"),
        F.lit(None).cast("string").alias("grp2"),
        *_stats(F.col("s_suppkey")),
        _strength(F.col("s_acctbal")).alias("strength"),
        F.concat(F.lit("img/"), F.col("s_suppkey").cast("string"), F.lit(".png")).alias("image_url"),
    )
    cid = F.col("c_custkey") + F.lit(CUSTOMER_ID_OFFSET)
    cus = customer.join(n, customer.c_nationkey == n.n_nationkey).select(
        cid.cast("bigint").alias("id"),
        F.col("c_name").alias("name"),
        F.col("n_name").alias("grp"),
        F.col("c_mktsegment").alias("grp2"),
        *_stats(cid),
        _strength(F.col("c_acctbal")).alias("strength"),
        F.concat(F.lit("img/"), cid.cast("string"), F.lit(".png")).alias("image_url"),
    )
    return sup.unionByName(cus).select(*COMPETITOR_COLUMNS)


def matchups_from_nation(nation: DataFrame) -> DataFrame:
    """The nation-by-nation matrix.

    For attacker key ``a`` and defender key ``d`` with ``k = (d - a) mod 25``:
    0 if k = 24; 0.5 if 10 <= k <= 9 + 2*(a mod 6); 2 if 1 <= k <= 1 + (a mod 7);
    else 1; cells with k = 23 are absent. Each attacker row is expanded by an
    explode over the 25 offsets and resolved with an equi-join on the defender
    key, so no cross join is planned.
    """
    n = nation.select("n_nationkey", "n_name")
    a = n.select(
        F.col("n_nationkey").alias("a"),
        F.col("n_name").alias("att_grp"),
        F.explode(F.sequence(F.lit(0), F.lit(N_NATIONS - 1))).alias("k"),
    ).where(F.col("k") != MISSING_OFFSET)
    a = a.withColumn("d", (F.col("a") + F.col("k")) % N_NATIONS)
    d = n.select(F.col("n_nationkey").alias("d"), F.col("n_name").alias("def_grp"))
    k, ak = F.col("k"), F.col("a")
    mult = (
        F.when(k == 24, F.lit(0.0))
        .when((k >= 10) & (k <= F.lit(9) + F.lit(2) * (ak % 6)), F.lit(0.5))
        .when((k >= 1) & (k <= F.lit(1) + (ak % 7)), F.lit(2.0))
        .otherwise(F.lit(1.0))
    )
    return a.join(d, "d").select(
        "att_grp", "def_grp", mult.alias("multiplier"), matchup_label(mult).alias("label")
    )


def _contest_rows(lineitem: DataFrame, orders: DataFrame, supplier: DataFrame, customer: DataFrame) -> DataFrame:
    li = lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus", "l_shipdate")
    o = orders.select("o_orderkey", "o_custkey")
    s = supplier.select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    c = customer.select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    # orders, a fraction of the lines, meet their customers first: no line moves by customer
    oc = o.join(c, o.o_custkey == c.c_custkey)
    return li.join(oc, li.l_orderkey == oc.o_orderkey).join(s, li.l_suppkey == s.s_suppkey)


def _core_columns() -> list[Column]:
    return [
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("contest_id"),
        F.col("s_name").alias("attacker"),
        F.col("c_name").alias("defender"),
        F.when(F.col("l_linestatus") == "F", F.col("s_name")).otherwise(F.col("c_name")).alias("winner"),
        _strength(F.col("s_acctbal")).alias("att_strength"),
        _strength(F.col("c_acctbal")).alias("def_strength"),
    ]


def contest_outcomes_from_tables(lineitem: DataFrame, orders: DataFrame, supplier: DataFrame,
                                 customer: DataFrame) -> DataFrame:
    """Contests without the denormalised group / multiplier columns.

    The analytic queries re-derive groups and multipliers from the dimensions and
    never read those columns; Catalyst prunes unused columns but cannot drop the
    outer joins that would fill them, so the lean view skips them.
    """
    j = _contest_rows(lineitem, orders, supplier, customer)
    return j.select(*_core_columns(), F.to_date("l_shipdate").alias("contest_date"))


# Fixed values of the observed-relations rule: attacker win share per group pair.
SHARE_NONE_BELOW = 0.48   # share < 0.48         -> no_damage_to
SHARE_HALF_BELOW = 0.505  # share < 0.505        -> half_damage_to
SHARE_DOUBLE_ABOVE = 0.5  # share > 0.5          -> double_damage_to (overlaps the half list)


def relations_from_contests(contests: DataFrame) -> DataFrame:
    """Per attacker group, relation payloads (JSON text) observed in the contests.

    The attacker win share of every (att_grp, def_grp) pair over *all* contests
    (a partial aggregate, G^2 output rows) places the defender group in
    overlapping lists, so the override precedence decides: share > 0.5 double,
    share < 0.505 half, share < 0.48 none. Every none list also names a group
    outside the known list. Groups that never attacked have no payload row.
    """
    pairs = contests.groupBy("att_grp", "def_grp").agg(
        F.try_divide(F.sum(F.when(F.col("winner") == F.col("attacker"), 1).otherwise(0)) * F.lit(1.0),
                     F.count(F.lit(1))).alias("share"))
    share, named = F.col("share"), F.struct(F.col("def_grp").alias("name"))
    lists = pairs.groupBy("att_grp").agg(
        F.sort_array(F.collect_list(F.when(share > SHARE_DOUBLE_ABOVE, named))).alias("double_damage_to"),
        F.sort_array(F.collect_list(F.when(share < SHARE_HALF_BELOW, named))).alias("half_damage_to"),
        F.sort_array(F.collect_list(F.when(share < SHARE_NONE_BELOW, named))).alias("no_damage_to"),
    )
    outsider = F.array(F.struct(F.lit("UNKNOWN_GROUP").alias("name")))
    payload = F.to_json(F.struct(
        "double_damage_to", "half_damage_to", F.concat(F.col("no_damage_to"), outsider).alias("no_damage_to")))
    return lists.select(F.col("att_grp").alias("grp"), payload.alias("payload"))


def contests_from_tables(lineitem: DataFrame, orders: DataFrame, supplier: DataFrame,
                         customer: DataFrame, nation: DataFrame, matchups: DataFrame) -> DataFrame:
    """One contest per lineitem, with the denormalised columns of the fact table."""
    n = nation.select("n_nationkey", "n_name")
    m = matchups.select("att_grp", "def_grp", F.col("multiplier").alias("_m"))
    j = (
        _contest_rows(lineitem, orders, supplier, customer)
        .join(n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("att_grp")),
              "s_nationkey", "left")
        .join(n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("def_grp")),
              "c_nationkey", "left")
        .join(m, ["att_grp", "def_grp"], "left")
    )
    return j.select(
        *_core_columns(),
        F.coalesce(F.col("_m"), F.lit(1.0)).alias("multiplier"),
        "att_grp",
        "def_grp",
        F.to_date("l_shipdate").alias("contest_date"),
    ).select(*CONTEST_COLUMNS)


def reverse_outcomes(outcomes: DataFrame) -> DataFrame:
    """Lean contests with attacker and defender swapped (the winner is unchanged)."""
    return outcomes.select(
        "contest_id",
        F.col("defender").alias("attacker"),
        F.col("attacker").alias("defender"),
        "winner",
        F.col("def_strength").alias("att_strength"),
        F.col("att_strength").alias("def_strength"),
        "contest_date",
    )


def profile_payloads(competitors: DataFrame) -> DataFrame:
    """``(id, payload)``: each competitor as a nested profile document.

    Types are an ordered list (second entry only when ``grp2`` is set), stats a
    list of ``{base_stat, stat:{name}}`` including one unknown and one missing stat
    name and, before the true entry, an outdated one of the first stat; the image
    sits under ``sprites.front_default`` (key absent when there is none). Besides
    the whole documents, every tenth id has a second record that failed: NULL,
    cut off, or of another shape.
    """
    named = lambda c: F.struct(c.alias("name"))
    types = F.filter(
        F.array(F.struct(F.lit(1).alias("slot"), named(F.col("grp")).alias("type")),
                F.struct(F.lit(2).alias("slot"), named(F.col("grp2")).alias("type"))),
        lambda t: t["type"]["name"].isNotNull())
    api_names = ["hp", "attack", "defense", "special-attack", "special-defense", "speed"]
    stats = F.array(
        F.struct(F.lit(0).alias("base_stat"), named(F.lit(api_names[0])).alias("stat")),
        F.struct(F.lit(3).alias("base_stat"), named(F.lit(None).cast("string")).alias("stat")),
        *[F.struct(F.col(c).alias("base_stat"), named(F.lit(a)).alias("stat")) for c, a in zip(STAT_COLUMNS, api_names)],
        F.struct(F.lit(1).alias("base_stat"), named(F.lit("accuracy")).alias("stat")),
    )
    sprites = F.struct(F.when(F.col("grp2").isNotNull(), F.col("image_url")).alias("front_default"))
    doc = F.to_json(F.struct("id", "name", types.alias("types"), stats.alias("stats"), sprites.alias("sprites")))
    failed = (F.when(F.col("id") % 30 == 0, F.lit(None).cast("string")).when(F.col("id") % 30 == 10, F.lit("{bad"))
              .otherwise(F.lit("[]")))
    records = F.when(F.col("id") % 10 == 0, F.array(failed, doc)).otherwise(F.array(doc))
    return competitors.select("id", F.explode(records).alias("payload"))


def skills_payloads(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """``(entity, payload)``: per order, a skills document built from its lines.

    Each line is a skill named after its part (words joined by ``-``) with two
    details: ``{level: line number - 1, method: machine if returned else level-up}``
    and ``{level: quantity, method: level-up}``. Grouping is per order, so each
    document is bounded by the lines of one order.
    """
    li = lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag")
    j = li.join(part.select("p_partkey", "p_name"), li.l_partkey == part.p_partkey)
    method = F.when(F.col("l_returnflag") == "R", F.lit("machine")).otherwise(F.lit("level-up"))
    detail = lambda lvl, m: F.struct(lvl.cast("int").alias("level_learned_at"),
                                     F.struct(m.alias("name")).alias("move_learn_method"))
    move = F.struct(
        F.struct(F.regexp_replace("p_name", " ", "-").alias("name")).alias("move"),
        F.array(detail(F.col("l_linenumber") - 1, method),
                detail(F.floor("l_quantity"), F.lit("level-up"))).alias("version_group_details"),
    )
    # moves stand in the order of the lines
    lines = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", move.alias("move"))))
    return j.groupBy(F.col("l_orderkey").alias("entity")).agg(
        F.to_json(F.struct(F.transform(lines, lambda x: x["move"]).alias("moves"))).alias("payload"))


def reverse_roles(contests: DataFrame, matchups: DataFrame) -> DataFrame:
    """Swap attacker and defender (the winner is unchanged) and look the multiplier up again."""
    m = matchups.select("att_grp", "def_grp", F.col("multiplier").alias("_m"))
    r = contests.select(
        "contest_id",
        F.col("defender").alias("attacker"),
        F.col("attacker").alias("defender"),
        "winner",
        F.col("def_strength").alias("att_strength"),
        F.col("att_strength").alias("def_strength"),
        F.col("def_grp").alias("att_grp"),
        F.col("att_grp").alias("def_grp"),
        "contest_date",
    )
    r = r.join(m, ["att_grp", "def_grp"], "left").withColumn("multiplier", F.coalesce(F.col("_m"), F.lit(1.0)))
    return r.select(*CONTEST_COLUMNS)


class Tables:
    """Lazily derived model tables for one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._cache: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = table(self.spark, self.sf_dir, name)
        return self._cache[name]

    @property
    def competitors(self) -> DataFrame:
        if "_competitors" not in self._cache:
            self._cache["_competitors"] = competitors_from_tables(
                self.raw("supplier"), self.raw("customer"), self.raw("nation"))
        return self._cache["_competitors"]

    @property
    def matchups(self) -> DataFrame:
        if "_matchups" not in self._cache:
            self._cache["_matchups"] = matchups_from_nation(self.raw("nation"))
        return self._cache["_matchups"]

    @property
    def contests(self) -> DataFrame:
        if "_contests" not in self._cache:
            self._cache["_contests"] = contests_from_tables(
                self.raw("lineitem"), self.raw("orders"), self.raw("supplier"),
                self.raw("customer"), self.raw("nation"), self.matchups)
        return self._cache["_contests"]

    @property
    def outcomes(self) -> DataFrame:
        """Lean contests (no denormalised group / multiplier columns) for the aggregate queries."""
        if "_outcomes" not in self._cache:
            self._cache["_outcomes"] = contest_outcomes_from_tables(
                self.raw("lineitem"), self.raw("orders"), self.raw("supplier"), self.raw("customer"))
        return self._cache["_outcomes"]

    @property
    def outcomes_reversed(self) -> DataFrame:
        if "_outcomes_rev" not in self._cache:
            self._cache["_outcomes_rev"] = reverse_outcomes(self.outcomes)
        return self._cache["_outcomes_rev"]

    @property
    def contests_reversed(self) -> DataFrame:
        if "_contests_rev" not in self._cache:
            self._cache["_contests_rev"] = reverse_roles(self.contests, self.matchups)
        return self._cache["_contests_rev"]

    @property
    def profile_payloads(self) -> DataFrame:
        return profile_payloads(self.competitors)

    @property
    def skills_payloads(self) -> DataFrame:
        return skills_payloads(self.raw("lineitem"), self.raw("part"))

    @property
    def observed_relations(self) -> DataFrame:
        """Relation payloads observed over all contests (see :func:`relations_from_contests`)."""
        return relations_from_contests(self.contests)

    @property
    def groups(self) -> DataFrame:
        return self.raw("nation").select(F.col("n_name").alias("grp"))

    def group_order(self) -> list[str]:
        """Canonical group order (by nation key) for wide output columns.

        A pivot's columns are part of the plan's schema, so the group names, one a column, are needed on the driver.
        """
        return [r["n_name"] for r in self.raw("nation").orderBy("n_nationkey").select("n_name").collect()]

    def expected_counts(self) -> DataFrame:
        """Expected model row counts derived from the source tables (a union and a group-by, no joins)."""
        tag = lambda name, table: self.raw(name).select(F.lit(table).alias("table"))
        rows = tag("supplier", "competitors").unionByName(tag("customer", "competitors")).unionByName(
            tag("lineitem", "contests"))
        counts = rows.groupBy("table").agg(F.count(F.lit(1)).alias("expected"))
        n = self.raw("nation").agg(F.count(F.lit(1)).alias("n"))
        cells = n.select(F.lit("matchups").alias("table"), (F.col("n") * (F.col("n") - 1)).alias("expected"))
        return counts.unionByName(cells)
