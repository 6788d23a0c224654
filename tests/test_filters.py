import pytest
from pyspark.sql import functions as F

from tessella.functions import ignore, scalar
from tessella.operators import filters


def kept(spark, paths, patterns=None):
    df = spark.createDataFrame([(p, 10) for p in paths], "path string, size long")
    return {r.path for r in df.where(filters.should_index(F.col("path"), F.col("size"), patterns)).collect()}


def test_layers(spark):
    paths = ["app.js", "a.min.js", "a.min.css", "a.bundle.js", "package-lock.json", "yarn.lock", ".env", ".hidden.py", ".github/x.md", "node_modules/x.js", "src/dist/y.py", "x.exe", "noext", "B.PY"]
    assert kept(spark, paths) == {"app.js", ".github/x.md", "B.PY"}


def test_sizes(spark):
    df = spark.createDataFrame([("a.py", 0), ("b.py", 1), ("c.py", 5 << 20), ("d.py", (5 << 20) + 1)], "path string, size long")
    assert [r.path for r in df.where(filters.should_index(F.col("path"), F.col("size"))).collect()] == ["b.py", "c.py"]


@pytest.mark.parametrize(
    ("lines", "path", "expected"),
    [
        (["*.log"], "a/b.log", True),
        (["*.log", "!keep.log"], "a/keep.log", False),
        (["/top.py"], "a/top.py", False),
        (["/top.py"], "top.py", True),
        (["tmp/"], "a/tmp/x.py", True),
        (["tmp/"], "a/tmp", False),
        (["a/**/z.py"], "a/b/c/z.py", True),
        (["a/**/z.py"], "a/z.py", True),
        (["a/**"], "a/q/r.py", True),
        (["doc?.md"], "x/doc1.md", True),
        (["doc[0-3].md"], "doc4.md", False),
        (["doc[!0-3].md"], "doc4.md", True),
        (["# no", "", "\\#yes"], "#yes", True),
        (["a/b"], "x/a/b", False),
        (["build"], "build/x.o", True),
    ],
)
def test_ignore_lines(spark, lines, path, expected):
    assert spark.range(1).select(ignore.ignored(F.lit(path), lines).alias("x")).first().x is expected


def test_directories(spark):
    df = spark.createDataFrame([(p,) for p in ("src", ".github", "a/node_modules", "logs")], "path string")
    assert {r.path for r in df.where(filters.dir_allowed(F.col("path"), ["logs/"])).collect()} == {"src", ".github"}


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(scalar.path_score("api handler", F.lit("/src/api/handler.py"))) == 1.0
    assert one(scalar.path_score("api database", F.lit("\\src\\api\\routes.py"))) == 0.5
    assert one(scalar.path_score("", F.lit("/x"))) == 0.0
    assert one(scalar.snippet(F.lit("a" * 250))) == "a" * 200 + "..."
    assert one(scalar.snippet(F.lit("ab " * 100))) == ("ab " * 66).rstrip() + "..."
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    assert one(scalar.recency_boost(F.lit("2024-01-09 23:00:00"), now)) > 1.09
    assert one(scalar.recency_boost(F.lit("2023-12-01 00:00:00"), now)) == 1.0
    assert one(scalar.recency_boost(F.lit(None).cast("string"), now)) == 1.0
    assert one(scalar.signature(F.lit("@a\n@b\ndef f():\n  pass"), F.lit("python"))) == "def f():"
    assert one(scalar.agent_class(F.lit("log"))) == "LogAgent"
    assert one(scalar.format_duration(F.lit(3725.0))) == "1h 2m"
    assert one(filters.critical_label(F.lit("x SEGFAULT at; Out of memory"))) == "oom"


def test_parameters(spark):
    from tessella.functions import validate

    schema = {"type": "object", "properties": {"n": {"type": "integer"}, "all": {"type": "boolean"}, "how": {"enum": ["a", "b"]}}, "required": ["n"], "additionalProperties": False}
    rows = [({"n": " 5 ", "all": "YES", "how": "a"},), ({"all": "maybe", "how": "c", "z": "1"},), ({"n": "x"},)]
    df = spark.createDataFrame(rows, "p map<string,string>").select(validate.coerced(F.col("p"), schema).alias("p"))
    got = [(r.p, r.e) for r in df.select("p", validate.errors(F.col("p"), schema).alias("e")).collect()]
    assert got[0] == ({"n": "5", "all": "true", "how": "a"}, [])
    assert got[1][1] == ["n: required", "how: not in enum", "z: unknown"] and got[1][0]["all"] == "false"
    assert got[2][1] == ["n: not of type integer"]
