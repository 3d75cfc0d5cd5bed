"""JSON records by JSON Schema: typed columns, issues by path, and what the schema does not name.

A schema is compiled twice: to a Spark type for ``from_json``, and to an expression over the record as
VARIANT that lists what is wrong with it. Everything is native and runs in one narrow pass.

Keywords: type (object, array, string, number, integer, boolean), properties, required, items, enum. Other
keywords are ignored; a schema without a type takes anything, as VARIANT. A JSON null is a missing value:
an issue where the field is required, and nothing else. Text in a Markdown fence is read without it. What is no JSON
has the one issue "not JSON", and no data; a null text is no record: all its columns are null.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The schemas of the extraction presets.
PRESETS = {
    "api_reference": json.loads("""{"type": "object", "properties": {
        "apiName": {"type": "string"}, "baseUrl": {"type": "string"}, "description": {"type": "string"},
        "endpoints": {"type": "array", "items": {"type": "object", "properties": {
            "method": {"type": "string", "enum": ["GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS"]},
            "path": {"type": "string"}, "summary": {"type": "string"},
            "parameters": {"type": "array", "items": {"type": "object", "properties": {
                "name": {"type": "string"}, "in": {"type": "string", "enum": ["query", "header", "path", "body"]},
                "required": {"type": "boolean"}, "type": {"type": "string"}, "description": {"type": "string"}
            }, "required": ["name", "in", "type"]}},
            "responseFormat": {"type": "string"}, "exampleResponse": {"type": "string"}
        }, "required": ["method", "path", "summary"]}}
    }, "required": ["endpoints"]}"""),
    "pricing_tiers": json.loads("""{"type": "object", "properties": {
        "productName": {"type": "string"}, "currency": {"type": "string"},
        "plans": {"type": "array", "items": {"type": "object", "properties": {
            "name": {"type": "string"}, "priceMonthly": {"type": "string"}, "priceAnnual": {"type": "string"},
            "targetAudience": {"type": "string"}, "isPopular": {"type": "boolean"},
            "featuresIncluded": {"type": "array", "items": {"type": "string"}},
            "limits": {"type": "array", "items": {"type": "string"}}, "ctaText": {"type": "string"}
        }, "required": ["name", "featuresIncluded"]}},
        "faq": {"type": "array", "items": {"type": "object", "properties": {
            "question": {"type": "string"}, "answer": {"type": "string"}
        }, "required": ["question", "answer"]}}
    }, "required": ["plans"]}"""),
    "faq_qna": json.loads("""{"type": "object", "properties": {
        "topic": {"type": "string"},
        "items": {"type": "array", "items": {"type": "object", "properties": {
            "question": {"type": "string"}, "answer": {"type": "string"}, "category": {"type": "string"}, "keyTakeaway": {"type": "string"}
        }, "required": ["question", "answer"]}}
    }, "required": ["items"]}"""),
    "product_specs": json.loads("""{"type": "object", "properties": {
        "productTitle": {"type": "string"}, "brand": {"type": "string"}, "modelNumber": {"type": "string"},
        "price": {"type": "string"}, "availability": {"type": "string"},
        "technicalSpecs": {"type": "array", "items": {"type": "object", "properties": {
            "specName": {"type": "string"}, "value": {"type": "string"}, "category": {"type": "string"}
        }, "required": ["specName", "value"]}},
        "keyFeatures": {"type": "array", "items": {"type": "string"}},
        "pros": {"type": "array", "items": {"type": "string"}}, "cons": {"type": "array", "items": {"type": "string"}}
    }, "required": ["productTitle", "technicalSpecs"]}"""),
    "entities_relations": json.loads("""{"type": "object", "properties": {
        "entities": {"type": "array", "items": {"type": "object", "properties": {
            "id": {"type": "string"}, "name": {"type": "string"},
            "type": {"type": "string", "enum": ["Person", "Organization", "Concept", "Location", "Technology", "Event", "Metric"]},
            "description": {"type": "string"}
        }, "required": ["id", "name", "type"]}},
        "relations": {"type": "array", "items": {"type": "object", "properties": {
            "sourceId": {"type": "string"}, "predicate": {"type": "string"}, "targetId": {"type": "string"}, "context": {"type": "string"}
        }, "required": ["sourceId", "predicate", "targetId"]}}
    }, "required": ["entities", "relations"]}"""),
    "course_syllabus": json.loads("""{"type": "object", "properties": {
        "courseTitle": {"type": "string"}, "instructor": {"type": "string"}, "duration": {"type": "string"},
        "prerequisites": {"type": "array", "items": {"type": "string"}},
        "modules": {"type": "array", "items": {"type": "object", "properties": {
            "moduleNumber": {"type": "number"}, "title": {"type": "string"}, "description": {"type": "string"},
            "topics": {"type": "array", "items": {"type": "string"}}, "learningOutcomes": {"type": "array", "items": {"type": "string"}}
        }, "required": ["moduleNumber", "title", "topics"]}}
    }, "required": ["courseTitle", "modules"]}"""),
}
# The schema where none is given.
DEFAULT = json.loads("""{"type": "object", "properties": {
    "title": {"type": "string"}, "summary": {"type": "string"},
    "keyItems": {"type": "array", "items": {"type": "object", "properties": {
        "name": {"type": "string"}, "description": {"type": "string"}, "details": {"type": "string"}
    }, "required": ["name", "description"]}}
}, "required": ["title", "keyItems"]}""")

_SCALARS = {"string": "STRING", "number": "DOUBLE", "integer": "BIGINT", "boolean": "BOOLEAN"}
_SHOWN = {"string": "^STRING$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL)", "integer": r"^(BIGINT|DECIMAL\(\d+,0\))", "boolean": "^BOOLEAN$", "array": "^ARRAY<", "object": "^OBJECT<"}


def spark_type(schema: dict) -> str:
    """The DDL type of a schema."""
    kind = schema.get("type")
    if kind == "object" and schema.get("properties"):
        return "STRUCT<" + ", ".join(f"`{name}`: {spark_type(s)}" for name, s in schema["properties"].items()) + ">"
    if kind == "array":
        return f"ARRAY<{spark_type(schema.get('items', {}))}>"
    return _SCALARS.get(kind, "VARIANT")


def issues(record: Column, schema: dict, at: Column | None = None) -> Column:
    """What is wrong with a VARIANT, as "path: reason", in the order of the schema; empty for a missing value."""
    none = F.expr("cast(array() as array<string>)")
    say = lambda reason: F.array(F.concat(at if at is not None else F.lit("record"), F.lit(": " + reason)))
    below = lambda name: F.lit(name) if at is None else F.concat(at, F.lit("." + name))
    kind, inner = schema.get("type"), none
    if kind == "object":
        parts = []
        for name, s in schema.get("properties", {}).items():
            value = F.try_variant_get(record, f"$.{name}", "variant")
            missing = value.isNull() | F.is_variant_null(value)
            absent = F.array(F.concat(below(name), F.lit(": required"))) if name in schema.get("required", ()) else none
            parts.append(F.when(missing, absent).otherwise(issues(value, s, below(name))))
        inner = F.concat(*parts) if parts else none
    elif kind == "array" and schema.get("items"):
        here = at if at is not None else F.lit("record")
        each = F.transform(F.try_variant_get(record, "$", "array<variant>"), lambda x, i: issues(x, schema["items"], F.concat(here, F.lit("["), i.cast("string"), F.lit("]"))))
        inner = F.flatten(each)
    elif schema.get("enum"):
        inner = F.when(F.try_variant_get(record, "$", "string").isin(*map(str, schema["enum"])), none).otherwise(say("not one of " + "|".join(map(str, schema["enum"]))))
    if kind in _SHOWN:
        inner = F.when(F.regexp_like(F.schema_of_variant(record), F.lit(_SHOWN[kind])), inner).otherwise(say(f"expected {kind}"))
    return F.when(record.isNull() | F.is_variant_null(record), none).otherwise(inner)


def extracted(records: DataFrame, text_col: str, schema: dict | str | None = None) -> DataFrame:
    """The records with data (typed), record (VARIANT), extra (names that the schema lacks), valid and issues.

    schema: a JSON Schema, as a dict or text, the name of a preset, or None for the default. Where a value
    has another type than the schema's, data has a null for it, or for the array around it, and issues tell.
    """
    if schema is None:
        schema = DEFAULT
    elif isinstance(schema, str):
        schema = PRESETS[schema] if schema in PRESETS else json.loads(schema)
    if schema.get("type") != "object" or not schema.get("properties"):
        raise ValueError("a schema of an object with properties is needed")
    given = F.col(text_col)
    bare = F.trim(F.regexp_replace(F.regexp_replace(given, r"(?i)^```json\s*", ""), r"```$", ""))
    text = F.when(F.try_parse_json(given).isNull(), bare).otherwise(given)
    found = records.withColumn("record", F.try_parse_json(text)).withColumn("_text", text)
    wrong = F.when(F.col("record").isNull(), F.array(F.lit("not JSON"))).otherwise(issues(F.col("record"), schema))
    names = F.array(*(F.lit(n) for n in schema["properties"]))
    data = F.when(F.col("record").isNotNull(), F.from_json("_text", spark_type(schema)))
    found = found.withColumn("data", data).withColumn("extra", F.array_except(F.json_object_keys("_text"), names)).withColumn("issues", F.when(given.isNotNull(), wrong))
    return found.withColumn("valid", F.when(F.col("issues").isNotNull(), F.size("issues") == 0)).drop("_text")
