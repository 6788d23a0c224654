import json

from pyspark.sql import functions as F

from tessella.functions import validate

SCHEMA = {
    "type": "object",
    "required": ["name", "at"],
    "properties": {
        "name": {"type": "string", "minLength": 2, "maxLength": 5, "pattern": "^[a-z]+$"},
        "at": {"type": "object", "properties": {"port": {"type": "integer", "minimum": 1, "exclusiveMaximum": 100}}, "required": ["port"], "additionalProperties": False},
        "tags": {"type": "array", "minItems": 1, "maxItems": 2, "items": {"type": ["string", "null"]}},
        "rows": {"type": "array", "items": {"type": "array", "items": {"type": "object", "properties": {"k": {"enum": ["a", 1, None]}}}}},
        "limits": {"type": "object", "additionalProperties": {"type": "number", "maximum": 1}},
        "mode": {"const": "on"},
    },
}


def found(spark, *docs, schema=SCHEMA):
    rows = [(k, d if d is None or isinstance(d, str) else json.dumps(d)) for k, d in enumerate(docs)]
    df = spark.createDataFrame(rows, "k int, t string").select("k", validate.json_errors(F.col("t"), schema).alias("e"))
    return [r.e for r in df.orderBy("k").collect()]


def test_right_documents(spark):
    ok = {"name": "abc", "at": {"port": 99}}
    more = ok | {"tags": ["x", None], "rows": [[{"k": "a"}, {"k": 1}], [], [{"k": None}, {}]], "limits": {"a": 0.5, "b": 1}, "mode": "on", "other": [1]}
    assert found(spark, ok, more, ok | {"at": {"port": 8.0}}) == [[], [], []]


def test_errors_name_their_place(spark):
    bad = {"name": "A", "at": {"port": 0, "x": 1, "b": 2}, "tags": [], "rows": [[], [{"k": "a"}, {"k": "b"}, 5]], "limits": {"z": 2, "a": "1", "m": 0}, "mode": "off"}
    assert found(spark, bad)[0] == [
        "$.name: shorter than 2",
        "$.name: doesn't match the pattern",
        "$.at.port: below 1",
        "$.at.b: unknown",
        "$.at.x: unknown",
        "$.tags: fewer than 1 items",
        "$.rows[1][1].k: not in enum",
        "$.rows[1][2]: not of type object",
        "$.limits.a: not of type number",
        "$.limits.z: above 1",
        "$.mode: not the constant",
    ]
    assert found(spark, {"name": "abcdef", "at": {}, "tags": [1, "x", "y"]})[0] == ["$.name: longer than 5", "$.at.port: required", "$.tags: more than 2 items", "$.tags[0]: not of type string or null"]
    assert found(spark, {"name": 5, "at": {"port": 1.5}})[0] == ["$.name: not of type string", "$.at.port: not of type integer"]
    assert found(spark, {"name": "ab", "at": {"port": 100}})[0] == ["$.at.port: not below 100"]


def test_other_documents(spark):
    assert found(spark, None, "{", "[1]", "null", "{}") == [["$: not JSON"], ["$: not JSON"], ["$: not of type object"], ["$: not of type object"], ["$.name: required", "$.at: required"]]
    assert found(spark, "[1]", "3", schema={}) == [[], []]


def test_no_python_in_the_plan(spark):
    plan = spark.range(1).select(validate.json_errors(F.lit("{}"), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
