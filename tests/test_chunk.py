import pytest
from pyspark.sql import functions as F

from tessella.functions import chunk


def chunks(spark, build, text):
    return spark.createDataFrame([(text,)], "text string").select(build(F.col("text")).alias("c")).first().c


def test_short_text_stays_whole(spark):
    assert chunks(spark, lambda t: chunk.fixed(t, 20, 5), "  a  b\n c ") == ["a  b\n c"]
    assert chunks(spark, lambda t: chunk.fixed(t, 20, 5), " \n ") == []


def test_windows(spark):
    words = [f"w{i}" for i in range(50)]
    got = chunks(spark, lambda t: chunk.fixed(t, 20, 5), " ".join(words))
    assert [g.split() for g in got] == [words[0:20], words[15:35], words[30:50]]


@pytest.mark.parametrize("build", [chunk.fixed, chunk.prose, chunk.markdown])
def test_words_are_split_once_for_all_windows(spark, build):
    df = spark.createDataFrame([("x",)], "text string").select(build(F.col("text"), 20, 5).alias("c"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "slice(" in plan and "slice(filter(split(" not in plan


def test_yaml_is_read_whole_only_if_it_is_a_mapping(monkeypatch):
    yaml = pytest.importorskip("yaml")
    read, load = [], yaml.safe_load
    monkeypatch.setattr(yaml, "safe_load", lambda t: read.append(t) or load(t))
    assert chunk._yaml_lines("- a:\n[1\ntail") == ["- a:", "[1", "tail"]
    assert chunk._yaml_lines("just words") == ["just words"] and chunk._yaml_lines("") == [] and chunk._yaml_lines("# note") == ["# note"]
    assert chunk._yaml_lines("!!map [a]") == ["!!map [a]"]
    assert read == []
    assert chunk._yaml_lines("# note\n---\na: 1\nb: [x, y]") == ["a: 1", "b[0]: x", "b[1]: y"]
    assert chunk._yaml_lines("{a: 1}") == ["a: 1"] and chunk._yaml_lines("a: [1\nb") == ["a: [1", "b"] and len(read) == 3


def test_overlap_must_be_smaller(spark):
    with pytest.raises(ValueError):
        chunk.fixed(F.lit("x"), 5, 5)


def test_markdown_sections(spark):
    assert chunks(spark, chunk.markdown, "intro\n# A\nalpha\n## B\nbeta") == ["intro", "# A\nalpha", "## B\nbeta"]


def test_long_section_repeats_heading(spark):
    body = " ".join(f"x{i}" for i in range(1000))
    got = chunks(spark, lambda t: chunk.markdown(t, 200, 20), f"# Big\n{body}")
    words = f"# Big {body}".split()
    assert got[0] == " ".join(words[:200])
    assert got[1] == "# Big\n" + " ".join(words[180:380])
    assert got[-1].split()[-1] == "x999"


def test_heading_may_span_lines(spark):
    assert chunks(spark, chunk.markdown, "a\n#\nTitle\nb") == ["a", "#\nTitle\nb"]


def test_prose_carries_last_paragraph(spark):
    got = chunks(spark, lambda t: chunk.prose(t, 5, 1), "a b\n\nc d\n\ne f\n\ng")
    assert got == ["a b\n\nc d", "c d\n\ne f\n\ng"]
    assert chunks(spark, lambda t: chunk.prose(t, 5, 0), "a b\n\nc d\n\ne f\n\ng") == ["a b\n\nc d", "e f\n\ng"]
    assert chunks(spark, chunk.prose, " \n\n ") == []


def test_pages(spark):
    assert chunks(spark, chunk.document, "one\n\n\n\ntwo\fthree") == ["one", "two", "three"]


def test_json(spark):
    text = '{"a": {"b": [1, true]}, "c": null}'
    assert chunks(spark, chunk.json_chunks, text) == ["a.b[0]: 1\na.b[1]: True\nc: None"]
    assert chunks(spark, chunk.json_chunks, "{") == []
    got = chunks(spark, chunk.json_chunks, str(list(range(100))))[0].split("\n")
    assert got[0] == ": [100 items]" and got[1] == "[0]: 0" and got[-1] == "... and 90 more items" and len(got) == 12


def test_yaml_sections(spark):
    assert chunks(spark, chunk.yaml_chunks, "- a\n  b\n- c") == ["- a\n  b\n- c"]


def test_csv_repeats_header(spark):
    text = "h1,h2\n" + "\n".join(f"a{i} b{i}" for i in range(200))
    got = chunks(spark, lambda t: chunk.csv(t, 50), text)
    assert all(g.startswith("Headers: h1,h2\n") for g in got) and sum(g.count("\n") for g in got) == 200
    assert chunks(spark, chunk.csv, "h1,h2") == []


def test_code_symbols():
    small, big = "def f():\n  pass", "@d\ndef g():\n" + " ".join(["x"] * 1100)
    got = chunk.symbol_chunks([small, small, big], "python")
    assert got[0] == f"{small}\n\n{small}"
    assert got[1].startswith("# Symbol: def g():\n") and len(got) == 4
    middle = "def h():\n" + " ".join(["y"] * 100)
    assert chunk.symbol_chunks([middle], "python") == [f"# Symbol: def h():\n{middle}"]


def test_dispatch_and_fallback(spark):
    rows = [("a.md", "# T\nx"), ("b.json", "{bad json"), ("c.unknown", "p q"), ("d.txt", "  ")]
    got = chunk.chunk_text(spark.createDataFrame(rows, "path string, text string")).orderBy("path").collect()
    assert [(r.path, r.chunk_index, r.chunk_text, r.token_count) for r in got] == [("a.md", 0, "# T\nx", 3), ("b.json", 0, "{bad json", 2), ("c.unknown", 0, "p q", 2)]


def test_all_documents_against_plain_python(spark, small):
    """Prose chunks of all documents, folded in Python for comparison."""

    def plain(text, size, overlap):
        parts = [p.strip() for p in text.split("\n") if p.strip()]
        out, cur = [], []
        for p in parts:
            if cur and sum(len(x.split()) for x in cur) + len(p.split()) > size:
                out.append("\n\n".join(cur))
                cur = [cur[-1]] if overlap else []
            cur.append(p)
        return out + ["\n\n".join(cur)]

    docs = spark.read.parquet(f"{small}/documents.parquet").where("text like '%\n%'")
    got = docs.select("text", chunk.prose(F.regexp_replace("text", "\n", "\n\n"), 100, 10).alias("c")).collect()
    many = [r for r in got if len([p for p in r.text.split("\n") if p.strip()]) > 1]
    assert many and all(r.c == plain(r.text, 100, 10) for r in many)


def test_prose_query_has_every_document(spark, small):
    """chunk_prose leaves out documents of one line; chunk_prose_all has them, as windows of 100 words that share 10."""
    import hashlib

    from tessella.plans.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = {}
    for r in QUERIES["chunk_prose_all"](spark, small).collect():
        got.setdefault(r.doc_id, {})[r.chunk_index] = r.chunk_md5
    assert set(got) == {i for i, t in texts.items() if t.split()}
    single = [i for i, t in texts.items() if sum(bool(x.strip()) for x in t.split("\n")) == 1]
    assert any(len(texts[i].split()) > 100 for i in single)
    for i in single:
        w = texts[i].split()
        expected = [texts[i].strip()] if len(w) <= 100 else [" ".join(w[s : s + 100]) for s in range(0, len(w) - 10, 90)]
        assert [got[i][k] for k in sorted(got[i])] == [hashlib.md5(c.encode()).hexdigest() for c in expected]
