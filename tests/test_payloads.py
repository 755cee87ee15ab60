"""Payload cases: ties of level, repeated and missing stat names, failed records."""

import json

from sosrank.sources import nested


def test_level_ties_keep_payload_order(spark):
    names = list("zyxwvutsrq")
    moves = [{"move": {"name": n}, "version_group_details": [
        {"level_learned_at": 1, "move_learn_method": {"name": "level-up"}}]} for n in names]
    df = spark.createDataFrame([(1, json.dumps({"moves": moves}))], "entity long, payload string")
    got = [r.skill for r in nested.top_skills(df).orderBy("rank").collect()]
    assert got == [n.upper() for n in names[:8]]


def test_failed_records_go_and_the_last_stat_counts(spark):
    stat = lambda n, v: {"base_stat": v, "stat": {"name": n}}
    doc = {"id": 5, "name": "e", "types": [{"type": {"name": "g"}}], "sprites": {},
           "stats": [stat("hp", 1), stat(None, 3), stat("hp", 7), stat("attack", 2), stat("defense", 2),
                     stat("special-attack", 2), stat("special-defense", 2), stat("speed", 2)]}
    rows = [(1, None), (2, "{bad"), (3, "[]"), (4, ""), (5, json.dumps(doc))]
    out = nested.profiles_from_json(spark.createDataFrame(rows, "k long, payload string")).collect()
    assert len(out) == 1 and out[0].hp == 7 and out[0].strength == 17


def test_profiles_parse_once_and_tell_an_absent_key_from_a_null(spark):
    base = {"id": 1, "name": "e", "types": [{"type": {"name": "g"}}], "stats": []}
    docs = [{**base, "id": i, "sprites": s} for i, s in enumerate(({}, {"front_default": None}, {"front_default": "u"}))]
    rows = [(json.dumps(d),) for d in [*docs, {**base, "id": 3}, {**base, "id": 4, "sprites": None}]]
    out = nested.profiles_from_json(spark.createDataFrame(rows, "payload string"))
    assert {r.id: r.image_url for r in out.collect()} == {0: "", 1: None, 2: "u", 3: "", 4: ""}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json") + plan.count("ParseJson") == 1 or plan.count("parseJson") == 1, plan
