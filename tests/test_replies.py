"""Replies whose values keep their types."""

import json

from pyspark.sql import functions as F

from quartzite.operators import params

CASES = [
    ('Try ```json {"k": 3.5, "g": {"mode": "strict", "tags": ["a", 3]}, "on": true} ``` then ```{"k": 4, "n": null}```', {"g": {"mode": "strict", "tags": ["a", 3]}, "k": 4, "n": None, "on": True}),
    ('so: {"k": "x", "deep": {"a": {"b": 2}}}', {"deep": {"a": {"b": 2}}, "k": "x"}),
    ("```json [1,2]``` {\"q\": 1}", {"q": 1}),
    ("```{broken}``` and ```{\"z\": [] }```", {"z": []}),
    ("{}", None),
    ("", None),
    (None, None),
    ('```{"k": 1', None),
    ("nothing", None),
]


def replies(spark):
    return spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string").select("i", params.typed_reply(F.col("t")).alias("reply"))


def test_groups_lists_and_unknown_keys_stay(spark):
    got = replies(spark).select("i", F.to_json(F.to_variant_object("reply")).alias("j")).collect()
    assert {r.i: r.j and json.loads(r.j) for r in got} == {i: want for i, (_, want) in enumerate(CASES)}


def test_typed_values_and_kinds(spark):
    m = F.col("reply")
    row = replies(spark).filter("i < 2").orderBy("i").select(params.typed(m, "k", "$", "double").alias("k"), params.typed(m, "g", "$.tags[1]", "int").alias("t"), params.typed(m, "deep", "$.a.b", "int").alias("b"), params.kind_of(F.try_element_at(m, F.lit("n"))).alias("n")).collect()
    assert [tuple(r) for r in row] == [(4.0, 3, None, "null"), (None, None, 2, None)]
    fields = {(r.key, r.kind): r.n for r in params.reply_fields(replies(spark)).collect()}
    assert fields == {("k", "number"): 1, ("k", "text"): 1, ("g", "object"): 1, ("on", "truth"): 1, ("n", "null"): 1, ("deep", "object"): 1, ("q", "number"): 1, ("z", "array"): 1}
