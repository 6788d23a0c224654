"""Chunkers: from a text, the ordered array of its chunks, as Column builders.

Packing chunkers are left folds with `aggregate`; window chunkers slice the array of words. Only nested data (JSON, YAML)
and source code need Python, and then get Arrow batches. Chunkers that find nothing give an empty array, for which
`chunk_text` falls back to fixed windows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.scalar import let, strip, suffix, token_count, words

HEADING = r"(?m)^(#{1,6})\s+(.+)$"
PAGE = r"\n{3,}|---\s*\n|===\s*\n|\f"


def _check(size: int, overlap: int) -> None:
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the chunk size")


def _windows(w: Column, size: int, overlap: int) -> Column:
    """Windows over an array of words, the last one as long as words last."""
    step = size - overlap

    def cut(w: Column) -> Column:
        last = F.ceil((F.size(w) - size) / float(step)).cast("int") * step
        return F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(step)), lambda s: F.array_join(F.slice(w, s + 1, F.lit(size)), " "))

    return let(w, cut)


def fixed(text: Column, size: int = 512, overlap: int = 50) -> Column:
    """A short text whole and stripped, a longer one as windows of words."""
    _check(size, overlap)
    t = strip(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(let(words(text), lambda w: F.when(F.size(w) <= size, F.array(t)).otherwise(_windows(w, size, overlap))))


def _present(parts: Column) -> Column:
    return F.filter(F.transform(parts, lambda x: strip(x)), lambda x: x != "")


def _pack(parts: Column, size: int, carry: bool, glue: str) -> Column:
    """Parts packed greedily; a chunk closes before the part that would exceed size words, and with `carry` the next begins with its last part."""
    item = "struct<t:string,n:int>"
    items = F.transform(parts, lambda p: F.struct(p.alias("t"), token_count(p).alias("n")))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast(f"array<{item}>").alias("open"), F.lit(0).alias("n"))
    text_of = lambda xs: F.array_join(F.transform(xs, lambda x: x["t"]), glue)

    def add(acc: Column, x: Column) -> Column:
        full = (acc["n"] + x["n"] > size) & (F.size(acc["open"]) > 0)
        tail = F.slice(acc["open"], -1, 1) if carry else F.array().cast(f"array<{item}>")
        tail_n = F.element_at(acc["open"], -1)["n"] if carry else F.lit(0)
        closed = F.struct(F.concat(acc["done"], F.array(text_of(acc["open"]))).alias("done"), F.concat(tail, F.array(x)).alias("open"), (tail_n + x["n"]).alias("n"))
        grown = F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.array(x)).alias("open"), (acc["n"] + x["n"]).alias("n"))
        return F.when(full, closed).otherwise(grown)

    return F.aggregate(items, start, add, lambda a: F.when(F.size(a["open"]) > 0, F.concat(a["done"], F.array(text_of(a["open"])))).otherwise(a["done"]))


def prose(text: Column, size: int = 512, overlap: int = 50) -> Column:
    """Paragraphs packed greedily, each chunk beginning with the last paragraph of the one before if chunks overlap; a single paragraph as windows."""
    _check(size, overlap)
    parts = _present(F.split(text, r"\n\s*\n"))
    one = F.get(parts, F.lit(0))
    single = F.when(token_count(one) <= size, F.array(one)).otherwise(_windows(words(one), size, overlap))
    return F.when(F.size(parts) == 0, F.array().cast("array<string>")).when(F.size(parts) == 1, single).otherwise(_pack(parts, size, overlap > 0, "\n\n"))


def markdown(text: Column, size: int = 512, overlap: int = 50) -> Column:
    """Sections by heading; windows of a long one, after the first, repeat its heading. Texts without headings count as prose."""
    _check(size, overlap)
    mark = "\ue000"
    sections = _present(F.split(F.regexp_replace(text, HEADING, f"{mark}$0"), mark))

    def windows(s: Column) -> Column:
        heading = F.regexp_extract(s, r"^((#{1,6})\s+([^\n]+))", 1)
        rest = F.transform(_windows(words(s), size, overlap), lambda c, i: F.when((i > 0) & (heading != ""), F.concat(heading, F.lit("\n"), c)).otherwise(c))
        return F.when(token_count(s) <= size, F.array(s)).otherwise(rest)

    return F.when(text.rlike(HEADING), F.flatten(F.transform(sections, windows))).otherwise(prose(text, size, overlap))


def document(text: Column, size: int = 512, overlap: int = 50) -> Column:
    """By headings if there are any, else by pages if there are several, else as prose."""
    pages = _present(F.split(text, PAGE))
    paged = F.flatten(F.transform(pages, lambda p: prose(p, size, overlap)))
    return F.when(text.rlike(HEADING), markdown(text, size, overlap)).when(F.size(pages) > 1, paged).otherwise(prose(text, size, overlap))


def merge_lines(lines: Column, size: int = 512) -> Column:
    return _pack(lines, size, False, "\n")


def csv(text: Column, size: int = 512, overlap: int = 50) -> Column:
    """Rows packed greedily under a line that repeats the header; a header alone gives nothing."""
    lines = F.split(strip(text), "\n")
    head = F.get(lines, F.lit(0))
    n = token_count(head)
    rows = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("open"), n.alias("n"))
    whole = lambda xs: F.concat(F.lit("Headers: "), head, F.lit("\n"), F.array_join(xs, "\n"))

    def add(acc: Column, x: Column) -> Column:
        m = token_count(x)
        full = (acc["n"] + m > size) & (F.size(acc["open"]) > 0)
        closed = F.struct(F.concat(acc["done"], F.array(whole(acc["open"]))).alias("done"), F.array(x).alias("open"), (n + m).alias("n"))
        return F.when(full, closed).otherwise(F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.array(x)).alias("open"), (acc["n"] + m).alias("n")))

    return F.aggregate(rows, start, add, lambda a: F.when(F.size(a["open"]) > 0, F.concat(a["done"], F.array(whole(a["open"])))).otherwise(a["done"]))


def flatten_value(value, name: str = "", depth: int = 0) -> list[str]:
    """`a.b[0]: v` lines of nested data; of lists over 50 items the first 10, below 10 levels the text of what is left."""
    if depth > 10:
        return [f"{name}: {str(value)[:200]}"]
    if isinstance(value, dict):
        named = [(f"{name}.{k}" if name else k, v) for k, v in value.items()]
        return [line for k, v in named for line in (flatten_value(v, k, depth + 1) if isinstance(v, dict | list) else [f"{k}: {v}"])]
    if isinstance(value, list):
        many = len(value) > 50
        inner = [line for i, v in enumerate(value[:10] if many else value) for line in flatten_value(v, f"{name}[{i}]", depth + 1)]
        return [f"{name}: [{len(value)} items]", *inner, f"... and {len(value) - 10} more items"] if many else inner
    return [f"{name}: {value}"]


def _lines_udf(read: Callable[[str], list[str]]):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def lines(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: read(t) if isinstance(t, str) else [])

    return lines


def _json_lines(text: str) -> list[str]:
    try:
        return flatten_value(json.loads(text))
    except ValueError:
        return []


def _yaml_lines(text: str) -> list[str]:
    try:
        import yaml

        # only a mapping counts: a text whose first node (behind the starts of stream and document) is none isn't read on
        if any(isinstance(e, yaml.MappingStartEvent) for e in islice(yaml.parse(text, yaml.SafeLoader), 2, 3)):
            data = yaml.safe_load(text)
            if isinstance(data, dict):
                return flatten_value(data)
    except Exception:  # not YAML, or no reader for it: sections by what starts a line
        pass
    parts, out = [], []
    for line in text.split("\n"):
        if parts and line and not line[0].isspace():
            out.append("\n".join(parts).strip())
            parts = []
        parts.append(line)
    return [x for x in [*out, "\n".join(parts).strip()] if x]


json_lines, yaml_lines = _lines_udf(_json_lines), _lines_udf(_yaml_lines)


def json_chunks(text: Column, size: int = 512, overlap: int = 50) -> Column:
    return merge_lines(json_lines(text), size)


def yaml_chunks(text: Column, size: int = 512, overlap: int = 50) -> Column:
    return merge_lines(yaml_lines(text), size)


#: Code symbols of fewer words are merged with their neighbours, of more words parted.
LEAST_WORDS, MOST_WORDS = 64, 1024


def symbol_chunks(symbols: list[str], language: str = "", size: int = 512, overlap: int = 50) -> list[str]:
    """Chunks of the symbols that a code parser found: small ones merged, large ones as windows, each but merged ones under its signature."""
    _check(size, overlap)
    out, small, n = [], [], 0

    def first_line(code: str) -> str:
        lines = [x.strip() for x in code.strip().split("\n")]
        plain = [x for x in lines if not x.startswith("@")]
        return plain[0] if language == "python" and lines[0].startswith("@") and plain else lines[0]

    for code in [*symbols, None]:
        w = code.split() if code is not None else []
        if code is not None and len(w) < LEAST_WORDS:
            small, n = [*small, code], n + len(w)
            if n < LEAST_WORDS:
                continue
        if small and (n >= LEAST_WORDS or code is None or len(w) >= LEAST_WORDS):
            out.append("\n\n".join(small))
            small, n = [], 0
        if len(w) >= LEAST_WORDS:
            head = f"# Symbol: {first_line(code)}\n"
            starts = range(0, max(1, len(w) - overlap), size - overlap)
            out += [head + " ".join(w[s : s + size]) for s in starts] if len(w) > MOST_WORDS else [head + code]
    return out


def code_chunks(parse: Callable[[str], list[str]] | None, language: str = "") -> Callable[..., Column]:
    """A chunker for source code; `parse` gives the outermost symbols of a text. Without one there are no chunks, and so fixed windows."""

    def chunker(text: Column, size: int = 512, overlap: int = 50) -> Column:
        if parse is None:
            return F.array().cast("array<string>")

        def read(t: str) -> list[str]:
            try:
                return symbol_chunks(parse(t), language, size, overlap)
            except Exception:  # what can't be parsed falls back to fixed windows
                return []

        return _lines_udf(read)(text)

    return chunker


#: Chunkers by suffix; `register` adds to them.
CHUNKERS: dict[str, Callable[..., Column]] = {}


def register(suffixes: list[str], chunker: Callable[..., Column]) -> None:
    CHUNKERS.update({s.lower(): chunker for s in suffixes})


register([".md", ".txt", ".rst", ".org", ".adoc"], markdown)
register([".html", ".htm", ".xml", ".xhtml"], prose)
register([".pdf", ".docx", ".pptx", ".epub", ".rtf"], document)
register([".json"], json_chunks)
register([".yaml", ".yml", ".toml", ".ini", ".cfg", ".conf"], yaml_chunks)
register([".csv", ".tsv"], csv)


def chunk_text(df: DataFrame, text: str = "text", path: str = "path", size: int = 512, overlap: int = 50) -> DataFrame:
    """df's rows by chunk: chunk_index, chunk_text and token_count replace the text. The suffix picks the chunker; what finds nothing gets fixed windows."""
    _check(size, overlap)
    out, own = df.where(strip(text) != "").withColumn("__kind", suffix(path)), F.col(text)
    by: dict[Callable, list[str]] = {}
    for s, c in CHUNKERS.items():
        by.setdefault(c, []).append(s)
    # a column for each chunker, which is given null for rows of other types: Python parsers run before any CASE is decided
    picked = F.lit(None).cast("array<string>")
    for k, (chunker, suffixes) in enumerate(by.items()):
        out = out.withColumn(f"__c{k}", chunker(F.when(F.col("__kind").isin(suffixes), own), size, overlap))
        picked = F.when(F.col("__kind").isin(suffixes), F.col(f"__c{k}")).otherwise(picked)
    out = out.withColumn("__picked", picked)
    out = out.withColumn("__chunks", F.when(F.size("__picked") > 0, F.col("__picked")).otherwise(fixed(own, size, overlap)))
    rest = [c for c in df.columns if c != text]
    # outer, since a filter on the array's size would make every chunker run twice
    out = out.select(*rest, F.posexplode_outer("__chunks").alias("chunk_index", "chunk_text")).where("chunk_text is not null")
    return out.withColumn("token_count", token_count("chunk_text"))
