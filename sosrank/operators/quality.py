"""Data-quality jobs: row-count expectations and declared constraints.

Spark enforces no keys or constraints, so the declarative rules of the source
schema become distributed checks that report violation counts per rule:
duplicate keys via ``groupBy().having(count > 1)``, NULL counts, orphans via
``left_anti`` joins, and row-level predicates.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``(table, n)`` for each named DataFrame (each count is a distributed aggregate)."""
    parts = [df.agg(F.count(F.lit(1)).cast("bigint").alias("n")).select(F.lit(name).alias("table"), "n")
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def check_row_counts(tables: Mapping[str, DataFrame], expected: DataFrame) -> DataFrame:
    """Actual vs expected row counts per table with an ``ok`` flag and the overall ``all_ok``.

    ``expected`` has columns ``(table, expected)``; a table missing from either
    side reports NULL and is not ok. Actual and expected rows are unioned and
    grouped by table, so no join is needed.
    """
    actual = table_counts(tables).select("table", F.col("n").alias("actual"),
                                         F.lit(None).cast("bigint").alias("expected"))
    exp = expected.select("table", F.lit(None).cast("bigint").alias("actual"),
                          F.col("expected").cast("bigint").alias("expected"))
    j = actual.unionByName(exp).groupBy("table").agg(F.max("actual").alias("actual"),
                                                     F.max("expected").alias("expected"))
    ok = F.coalesce(F.col("actual") == F.col("expected"), F.lit(False))
    # One row per table: the overall flag is a window over a handful of rows.
    all_ok = F.min(ok.cast("int")).over(Window.partitionBy()) == 1
    return j.select("table", "actual", "expected", ok.alias("ok"), all_ok.alias("all_ok"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once, with their multiplicity (partial aggregation first)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_dup")).where(F.col("_dup") > 1)


def check_constraints(df: DataFrame, table: str, pk: Sequence[str] = (), unique: Sequence[Sequence[str]] = (),
                      not_null: Sequence[str] = (), fks: Sequence[tuple[str, DataFrame, str]] = (),
                      predicates: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per rule: ``(rule, violations)``.

    * ``pk`` / ``unique``: number of key values occurring more than once;
    * ``not_null``: number of NULLs per column (the PK columns are implied);
    * ``predicates``: name -> boolean Column that must hold on every row (NULL counts as a violation);
    * ``fks``: ``(column, parent_df, parent_column)``: non-NULL values without a parent.

    ``df`` is read once: one typed grouping set a key and a foreign key, and one for the outcome of all row rules (a
    bit each). Sets are counted by value, combined before the shuffle, so a hot value is one row a task; only keys
    that repeat and foreign values go on to look up their parents.
    """
    row_rules = [(f"{table}.not_null({c})", F.col(c).isNull()) for c in dict.fromkeys([*pk, *not_null])]
    row_rules += [(f"{table}.{name}", ~F.coalesce(cond, F.lit(False))) for name, cond in (predicates or {}).items()]
    keyed = ([(f"{table}.pk({','.join(pk)})", pk)] if pk else []) + [(f"{table}.unique({','.join(u)})", u)
                                                                    for u in unique]
    outcome = F.lit(0).cast("long")
    for i, (_, bad) in enumerate(row_rules):
        outcome = outcome + F.when(bad, F.lit(1 << i)).otherwise(F.lit(0))
    cols = [*dict.fromkeys([c for _, k in keyed for c in k] + [c for c, _, _ in fks]), "_outcome"]
    sets = list(dict.fromkeys([tuple(k) for _, k in keyed] + [(c,) for c, _, _ in fks] + [("_outcome",)]))
    bits = lambda of: sum(1 << (len(cols) - 1 - i) for i, c in enumerate(cols) if c not in of)
    counted = (df.withColumn("_outcome", outcome).select(*cols)
               .groupingSets([[F.col(c) for c in s] for s in sets], *cols)
               .agg(F.grouping_id().cast("long").alias("_set"), F.count(F.lit(1)).alias("_n")))
    of_set = lambda s: F.col("_set") == bits(tuple(s))
    parent_sets = F.col("_set").isin([bits((c,)) for c, _, _ in fks]) if fks else F.lit(False)
    counted = counted.where(parent_sets | of_set(["_outcome"]) | (F.col("_n") > 1))
    known = F.lit(False)
    if fks:
        text = F.coalesce(*[F.when(of_set([c]), F.col(c).cast("string")) for c, _, _ in fks])
        parents = None
        for c, parent, pcol in fks:
            p = parent.select(F.lit(bits((c,))).cast("long").alias("_set"), F.col(pcol).cast("string").alias("_value"))
            parents = p if parents is None else parents.unionByName(p)
        parents = parents.distinct().withColumn("_known", F.lit(True))
        counted = counted.withColumn("_value", text).join(parents, ["_set", "_value"], "left")
        known = F.coalesce(F.col("_known"), F.lit(False))
    found = [(rule, F.count_if(of_set(k) & (F.col("_n") > 1))) for rule, k in keyed]
    found += [(f"{table}.fk({c})", F.sum(F.when(of_set([c]) & F.col("_value").isNotNull() & ~known, F.col("_n"))))
              for c, _, _ in fks]
    found += [(rule, F.sum(F.when(of_set(["_outcome"]) & (F.col("_outcome").bitwiseAND(F.lit(1 << i)) != 0),
                                  F.col("_n")))) for i, (rule, _) in enumerate(row_rules)]
    one = counted.agg(*[n.alias(f"r{i}") for i, (_, n) in enumerate(found)])
    rules = [F.struct(F.lit(rule).alias("rule"), F.coalesce(F.col(f"r{i}"), F.lit(0)).cast("bigint").alias("violations"))
             for i, (rule, _) in enumerate(found)]
    return one.select(F.inline(F.array(*rules)))


def seed_violations(contests: DataFrame) -> DataFrame:
    """Contests with known faults, by the strengths of the sides: unknown sides, missing and foreign winners, contests
    with oneself, repeated and missing ids."""
    s = F.col("att_strength") + F.col("def_strength")
    fault = lambda r, value, col: F.when(s % 101 == r, value).otherwise(F.col(col))
    none = F.lit(None).cast("string")
    changed = {"attacker": fault(1, F.lit("nobody"), "attacker"),
               "defender": F.when(s % 101 == 2, none).when(s % 101 == 3, F.col("attacker")).otherwise(F.col("defender")),
               "winner": F.when(s % 101 == 4, none).when(s % 101 == 5, F.lit("nobody")).otherwise(F.col("winner")),
               "contest_id": F.when(s % 101 == 6, F.concat(F.lit("x"), s.cast("string"))).when(s % 101 == 7, none)
               .otherwise(F.col("contest_id"))}
    return contests.select(*[changed.get(c, F.col(c)).alias(c) for c in contests.columns])


def require_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Return ``df`` or raise ``ValueError`` listing the missing columns."""
    missing = sorted(set(cols) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def require_path(spark: SparkSession, path: str, fmt: str = "parquet", schema=None,
                 options: dict | None = None) -> DataFrame:
    """Open a source, failing fast with ``FileNotFoundError`` when the path does not exist.

    File listing is eager, so a missing path surfaces when the DataFrame is
    defined, before any target is touched.
    """
    reader = spark.read.format(fmt).options(**(options or {}))
    if schema is not None:
        reader = reader.schema(schema)
    try:
        return reader.load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            raise FileNotFoundError(path) from e
        raise
