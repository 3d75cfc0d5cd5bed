"""JSON Schema compiled to types and checks."""

import pytest
from pyspark.sql import functions as F

from marlstone.functions import json_schema


def run(spark, texts, schema):
    df = spark.createDataFrame(list(enumerate(texts)), "n long, text string")
    return {r["n"]: r for r in json_schema.extracted(df, "text", schema).withColumn("record", F.to_json("record")).collect()}


def test_types_of_the_presets():
    assert json_schema.spark_type(json_schema.PRESETS["faq_qna"]) == "STRUCT<`topic`: STRING, `items`: ARRAY<STRUCT<`question`: STRING, `answer`: STRING, `category`: STRING, `keyTakeaway`: STRING>>>"
    assert list(json_schema.PRESETS) == ["api_reference", "pricing_tiers", "faq_qna", "product_specs", "entities_relations", "course_syllabus"]
    assert json_schema.spark_type({}) == json_schema.spark_type({"type": "object"}) == "VARIANT"


def test_every_keyword(spark):
    schema = {"type": "object", "properties": {"n": {"type": "integer"}, "x": {"type": "number"}, "any": {}, "deep": {"type": "object", "properties": {"kind": {"enum": ["a", "b"]}}, "required": ["kind"]}, "grid": {"type": "array", "items": {"type": "array", "items": {"type": "boolean"}}}}, "required": ["n"]}
    got = run(
        spark,
        ['{"n": 1, "x": 2.5, "any": {"q": [1]}, "deep": {"kind": "a"}, "grid": [[true], []], "more": 1}', '{"n": 1.5, "x": "2", "deep": {}, "grid": [[true, 1], 3]}', '{"n": null, "x": null, "deep": {"kind": "c"}}', "[1]", "no", None, '```JSON\n{"n": 3}\n```', "5", "{}"],
        schema,
    )
    assert (got[0]["valid"], got[0]["issues"], got[0]["extra"]) == (True, [], ["more"]) and got[0]["data"]["n"] == 1 and got[0]["data"]["grid"] == [[True], []]
    assert got[1]["issues"] == ["n: expected integer", "x: expected number", "deep.kind: required", "grid[0][1]: expected boolean", "grid[1]: expected array"]
    assert got[2]["issues"] == ["n: required", "deep.kind: not one of a|b"]
    assert got[3]["issues"] == got[7]["issues"] == ["record: expected object"]
    assert got[4]["issues"] == ["not JSON"] and got[4]["data"] is None and not got[4]["valid"]
    assert (got[5]["valid"], got[5]["issues"], got[5]["data"]) == (None, None, None)
    assert got[6]["valid"] and got[6]["data"]["n"] == 3
    assert got[8]["issues"] == ["n: required"]


def test_default_and_wrong_schemas(spark):
    got = run(spark, ['{"title": "t", "keyItems": [{"name": "a"}]}'], None)
    assert got[0]["issues"] == ["keyItems[0].description: required"] and got[0]["record"] == '{"keyItems":[{"name":"a"}],"title":"t"}'
    assert run(spark, ['{"a": 1}'], '{"type": "object", "properties": {"a": {"type": "string"}}}')[0]["issues"] == ["a: expected string"]
    for wrong in ({"type": "array"}, {"type": "object"}):
        with pytest.raises(ValueError):
            run(spark, ["{}"], wrong)
    with pytest.raises(ValueError):
        run(spark, ["{}"], "no schema")
