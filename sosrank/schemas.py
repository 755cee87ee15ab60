"""Canonical schemas of the three input tables and the nested payloads."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names, types and orders of the model and of its payloads.
STAT_COLUMNS = ["hp", "attack", "defense", "sp_atk", "sp_def", "speed"]

COMPETITORS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("grp", T.StringType(), False),
        T.StructField("grp2", T.StringType(), True),
        *[T.StructField(c, T.IntegerType(), False) for c in STAT_COLUMNS],
        T.StructField("strength", T.IntegerType(), False),
        T.StructField("image_url", T.StringType(), True),
    ]
)

MATCHUPS = T.StructType(
    [
        T.StructField("att_grp", T.StringType(), False),
        T.StructField("def_grp", T.StringType(), False),
        T.StructField("multiplier", T.DoubleType(), False),
        T.StructField("label", T.StringType(), False),
    ]
)

CONTESTS = T.StructType(
    [
        T.StructField("contest_id", T.StringType(), False),
        T.StructField("attacker", T.StringType(), False),
        T.StructField("defender", T.StringType(), False),
        T.StructField("winner", T.StringType(), False),
        T.StructField("att_strength", T.IntegerType(), True),
        T.StructField("def_strength", T.IntegerType(), True),
        T.StructField("multiplier", T.DoubleType(), True),
        T.StructField("att_grp", T.StringType(), True),
        T.StructField("def_grp", T.StringType(), True),
        T.StructField("contest_date", T.DateType(), True),
    ]
)

# Column order used when contests are written out (writer order of the fact table).
CONTEST_COLUMNS = [f.name for f in CONTESTS.fields]
COMPETITOR_COLUMNS = [f.name for f in COMPETITORS.fields]
MATCHUP_COLUMNS = [f.name for f in MATCHUPS.fields]

# --- nested payloads (one JSON string per row) ------------------------------

_NAMED = T.StructType([T.StructField("name", T.StringType(), True)])

PROFILE_PAYLOAD = T.StructType(
    [
        T.StructField("id", T.LongType(), True),
        T.StructField("name", T.StringType(), True),
        T.StructField(
            "types",
            T.ArrayType(T.StructType([T.StructField("slot", T.IntegerType(), True),
                                      T.StructField("type", _NAMED, True)])),
            True,
        ),
        T.StructField(
            "stats",
            T.ArrayType(T.StructType([T.StructField("base_stat", T.IntegerType(), True),
                                      T.StructField("stat", _NAMED, True)])),
            True,
        ),
        T.StructField("sprites", T.StructType([T.StructField("front_default", T.StringType(), True)]), True),
    ]
)

RELATIONS_PAYLOAD = T.StructType(
    [
        T.StructField("double_damage_to", T.ArrayType(_NAMED), True),
        T.StructField("half_damage_to", T.ArrayType(_NAMED), True),
        T.StructField("no_damage_to", T.ArrayType(_NAMED), True),
    ]
)

SKILLS_PAYLOAD = T.StructType(
    [
        T.StructField(
            "moves",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("move", _NAMED, True),
                        T.StructField(
                            "version_group_details",
                            T.ArrayType(
                                T.StructType(
                                    [
                                        T.StructField("level_learned_at", T.IntegerType(), True),
                                        T.StructField("move_learn_method", _NAMED, True),
                                    ]
                                )
                            ),
                            True,
                        ),
                    ]
                )
            ),
            True,
        )
    ]
)
