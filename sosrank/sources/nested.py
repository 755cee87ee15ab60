"""Nested-payload ingestion: one JSON document per row in a string column.

Payloads are parsed once, to a VARIANT or with ``from_json`` against a declared
schema, and unpacked with built-in array functions (``transform``, ``filter``,
``inline``) -- no per-row Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sosrank.functions.labels import skill_display_name
from sosrank.schemas import PROFILE_PAYLOAD, SKILLS_PAYLOAD, STAT_COLUMNS

# Payload stat names -> column names; other names are ignored.
STAT_NAME_MAP = [("hp", "hp"), ("attack", "attack"), ("defense", "defense"),
                 ("special-attack", "sp_atk"), ("special-defense", "sp_def"), ("speed", "speed")]
LEVEL_UP_METHOD = "level-up"
TOP_SKILLS = 8


def parse_json(df: DataFrame, col: str, schema, out: str = "_doc") -> DataFrame:
    """Parse a JSON string column (PERMISSIVE: NULL input gives NULL, malformed input a struct of NULLs)."""
    return df.withColumn(out, F.from_json(F.col(col), schema))


def drop_failed(df: DataFrame, *required: str) -> DataFrame:
    """Drop records whose payload is missing or failed to parse: one of the ``required`` fields is NULL then."""
    for field in required:
        df = df.where(F.col(field).isNotNull())
    return df


def stats_from_array(stats: Column) -> list[Column]:
    """``[{base_stat, stat:{name}}]`` -> one column per known stat: its last entry; other and missing names are ignored."""
    def last(api: str) -> Column:
        own = F.filter(stats, lambda e: e["stat"]["name"] == F.lit(api))
        return F.try_element_at(own, F.lit(-1))["base_stat"]

    return [last(api).alias(col) for api, col in STAT_NAME_MAP]


def value_or_default(doc: Column, path: str, default: str = "") -> Column:
    """Text at ``path`` of a VARIANT; ``default`` only where the key is absent (an explicit null stays NULL)."""
    found = F.try_variant_get(doc, path, "variant")
    return F.when(found.isNull(), F.lit(default)).otherwise(F.try_variant_get(doc, path, "string"))


def profiles_from_json(df: DataFrame, payload_col: str = "payload") -> DataFrame:
    """Competitor rows from profile payloads, each parsed once to a VARIANT.

    Ordered type list: the first is the group, the second (or NULL) the second
    group; strength is the sum of the six stats; the image URL defaults to ""
    only when the ``front_default`` key is absent. Failed payloads are dropped.
    """
    field = {f.name: f.dataType.simpleString() for f in PROFILE_PAYLOAD.fields}

    def unpacked(doc: Column) -> Column:
        part = lambda name: F.try_variant_get(doc, f"$.{name}", field[name])
        return F.struct(part("id").alias("id"), part("name").alias("name"), part("types").alias("types"),
                        part("stats").alias("stats"),
                        value_or_default(doc, "$.sprites.front_default").alias("image_url"))

    # unpacked as the one entry of a list: filters on its fields then stay above the parse instead of repeating it
    once = F.transform(F.array(F.try_parse_json(F.col(payload_col))), unpacked)
    p = drop_failed(df.select(F.explode(once).alias("_doc")), "_doc.id", "_doc.name")
    types = F.transform(F.col("_doc.types"), lambda t: t["type"]["name"])
    out = p.select(
        F.col("_doc.id").alias("id"),
        F.col("_doc.name").alias("name"),
        F.get(types, 0).alias("grp"),
        F.get(types, 1).alias("grp2"),
        *stats_from_array(F.col("_doc.stats")),
        F.col("_doc.image_url").alias("image_url"),
    )
    strength = None
    for c in STAT_COLUMNS:
        strength = F.col(c) if strength is None else strength + F.col(c)
    return out.withColumn("strength", strength).select(
        "id", "name", "grp", "grp2", *STAT_COLUMNS, "strength", "image_url")


def levelled_skills(df: DataFrame, entity_col: str = "entity", payload_col: str = "payload") -> DataFrame:
    """``(entity, pos, skill, level)``: for each skill, by its place in the payload, the *first* level-up detail, kept only if level > 0.

    The first matching detail is chosen before the level test, so a skill whose
    first level-up detail has level 0 is excluded even if a later one is positive.
    """
    p = drop_failed(parse_json(df, payload_col, SKILLS_PAYLOAD), "_doc.moves")
    moves = p.select(F.col(entity_col).alias("entity"), F.posexplode(F.col("_doc.moves")).alias("pos", "_m"))
    first = F.get(F.filter(F.col("_m.version_group_details"),
                           lambda d: d["move_learn_method"]["name"] == F.lit(LEVEL_UP_METHOD)), 0)
    s = moves.select("entity", "pos", F.col("_m.move.name").alias("_raw"), first["level_learned_at"].alias("level"))
    s = s.where(F.coalesce(F.col("level"), F.lit(0)) > 0)
    return s.select("entity", "pos", skill_display_name("_raw").alias("skill"), "level")


def first_k_distinct(df: DataFrame, entity: str, key: str, order: list[str], k: int) -> DataFrame:
    """Keep-first dedup by ``key`` (lowest ``order``), then the first k per entity by ``order``."""
    d = df.groupBy(entity, key).agg(F.min(F.struct(*order)).alias("_first")).select(entity, key, "_first.*")
    w = Window.partitionBy(entity).orderBy(*order)
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_skills(df: DataFrame, entity_col: str = "entity", payload_col: str = "payload",
               k: int = TOP_SKILLS) -> DataFrame:
    """Per entity, up to k distinct skills with the lowest levels; ties stand in the order of the payload."""
    s = levelled_skills(df, entity_col, payload_col)
    return first_k_distinct(s, "entity", "skill", ["level", "pos"], k).select("entity", "rank", "skill", "level")


def json_scalar(json_col, path: str) -> Column:
    """Scalar at a JSONPath as a string (NULL when absent)."""
    col = F.col(json_col) if isinstance(json_col, str) else json_col
    return F.get_json_object(col, path)
