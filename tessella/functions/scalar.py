"""Scalar functions as Column builders; all run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, as str.split() and str.strip() know it.
WS = r"(?U)\s+"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once; what stands in a lambda as an expression is worked out anew for each item."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), r"(?U)^\s+|\s+$", "")


def words(text: Column | str) -> Column:
    """The words of a text, parted by Unicode white space."""
    return F.filter(F.split(_c(text), WS), lambda w: w != "")


def token_count(text: Column | str) -> Column:
    return F.size(words(text))


def snippet(text: Column | str, most: int = 200) -> Column:
    """A stripped text, or its first characters up to the last space among them, with dots."""
    t = strip(text)
    return F.when(F.char_length(t) <= most, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, most), r" [^ ]*$", ""), F.lit("...")))


def path_score(query: Column | str, path: Column | str) -> Column:
    """The share of a query's words that the path holds; 0 without words. `query` is a Column or the query's text."""
    terms = words(F.lower(query if isinstance(query, Column) else F.lit(query)))
    where = F.translate(F.lower(_c(path)), "\\", "/")
    hits = F.size(F.filter(terms, lambda t: F.contains(where, t)))
    return F.when(F.size(terms) > 0, hits / F.size(terms)).otherwise(F.lit(0.0))


def recency_boost(modified: Column | str, as_of: Column, days: int = 7) -> Column:
    """1.1 for what changed at as_of, falling to 1 within `days`; 1 for older or unknown times, more for later ones."""
    age = (F.unix_micros(as_of) - F.unix_micros(_c(modified).cast("timestamp"))) / F.lit(86_400e6)
    return F.when(age <= days, 1 + F.lit(0.1) * (1 - age / F.lit(float(days)))).otherwise(F.lit(1.0))


def extension(path: Column | str) -> Column:
    """Lower-cased text behind the last dot, else ''."""
    p = _c(path)
    return F.when(F.contains(p, F.lit(".")), F.lower(F.substring_index(p, ".", -1))).otherwise(F.lit(""))


def suffix(path: Column | str) -> Column:
    """Lower-cased suffix of a file name with its dot; '' for none, for a leading or a closing dot."""
    return F.lower(F.regexp_extract(F.substring_index(_c(path), "/", -1), r"^.+(\.[^.]+)$", 1))


def rrf(rank: Column, k: int = 60) -> Column:
    """The share that a place (from 1) adds under reciprocal rank fusion."""
    return F.lit(1.0) / (F.lit(k) + rank)


def provider_of(model: Column | str) -> Column:
    m = _c(model)
    return F.when(F.contains(m, F.lit("/")), F.substring_index(m, "/", 1)).otherwise(F.lit(""))


def model_name(model: Column | str) -> Column:
    m = _c(model)
    return F.regexp_replace(m, r"^[^/]*/", "")


def resolve_model(model: Column | str, default: Column) -> tuple[Column, Column]:
    """(provider, name): an empty model is the default; without a provider the default's counts, else ollama."""
    m = F.when(F.coalesce(_c(model), F.lit("")) == "", default).otherwise(_c(model))
    own, other = provider_of(m), provider_of(default)
    return F.when(own != "", own).when(other != "", other).otherwise(F.lit("ollama")), model_name(m)


def is_embedder(name: Column, family: Column) -> Column:
    base = F.substring_index(name, ":", 1)
    return F.contains(base, F.lit("embed")) | F.contains(F.lower(F.coalesce(family, F.lit(""))), F.lit("embed"))


def capabilities(name: Column, family: Column) -> Column:
    return F.when(is_embedder(name, family), F.array(F.lit("embed"))).otherwise(F.array(F.lit("generate"), F.lit("chat")))


def format_size(n: Column | str) -> Column:
    n = _c(n)
    return (
        F.when(n >= 1 << 30, F.format_string("%.2f GB", F.bround(n / float(1 << 30), 2)))
        .when(n >= 1 << 20, F.format_string("%.1f MB", F.bround(n / float(1 << 20), 1)))
        .when(n >= 1 << 10, F.format_string("%.1f KB", F.bround(n / float(1 << 10), 1)))
        .otherwise(F.format_string("%d B", n.cast("long")))
    )


def format_duration(seconds: Column | str) -> Column:
    s = _c(seconds)
    whole = F.floor(s).cast("long")
    return (
        F.when(s < 60, F.format_string("%.0fs", F.rint(s)))
        .when(s < 3600, F.format_string("%dm %ds", F.floor(whole / 60), whole % 60))
        .otherwise(F.format_string("%dh %dm", F.floor(whole / 3600), F.floor(whole % 3600 / 60)))
    )


#: TCP states by the code of the kernel's table.
TCP_STATES = {
    "01": "ESTABLISHED",
    "02": "SYN_SENT",
    "03": "SYN_RECV",
    "04": "FIN_WAIT1",
    "05": "FIN_WAIT2",
    "06": "TIME_WAIT",
    "07": "CLOSE",
    "08": "CLOSE_WAIT",
    "09": "LAST_ACK",
    "0A": "LISTEN",
    "0B": "CLOSING",
}


def tcp_state(code: Column | str) -> Column:
    table = F.create_map(*[F.lit(x) for kv in TCP_STATES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.upper(_c(code))), F.lit("UNKNOWN"))


def hex_port(address: Column | str) -> Column:
    """The port of an address such as 0100007F:0035."""
    return F.conv(F.substring_index(_c(address), ":", -1), 16, 10).cast("int")


def dump_id(pid: Column, timestamp: Column) -> Column:
    return F.concat(F.coalesce(pid.cast("string"), F.lit("")), F.lit("-"), F.coalesce(timestamp.cast("string"), F.lit("")))


def strip_tags(html: Column | str) -> Column:
    """Text without tags and with single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(_c(html), "<[^>]+>", " "), r"\s+", " "))


def output_of(stdout: Column, kind: Column) -> Column:
    """A tool's output by its declared format: nothing for exitcode, compact JSON (or the raw text) for json, else the text."""
    json = F.coalesce(F.to_json(F.try_parse_json(stdout)), stdout)
    return F.when(kind == "exitcode", F.lit("")).when(kind == "json", F.when(strip(stdout) == "", F.lit("{}")).otherwise(json)).otherwise(stdout)


def valid_agent_name(name: Column | str) -> Column:
    return _c(name).rlike("^[a-z][a-z0-9-]*$")


def agent_class(name: Column | str) -> Column:
    """log-agent and log both give LogAgent."""
    parts = F.transform(F.split(_c(name), "-"), lambda x: F.initcap(x))
    joined = F.array_join(parts, "")
    return F.when(joined.endswith("Agent"), joined).otherwise(F.concat(joined, F.lit("Agent")))


def coerce_param(value: Column, kind: Column) -> Column:
    """A text parameter as text of its declared type: integers and numbers as they parse, booleans true or false; unchanged where it can't be."""
    return (
        F.when(kind == "integer", F.coalesce(F.trim(value).try_cast("long").cast("string"), value))
        .when(kind == "number", F.coalesce(F.trim(value).try_cast("double").cast("string"), value))
        .when(kind == "boolean", F.lower(value).isin("true", "1", "yes").cast("string"))
        .otherwise(value)
    )


def content_hash(content: Column | str) -> Column:
    return F.sha2(_c(content), 256)


def signature(code: Column | str, language: Column) -> Column:
    """The first line of a code block; of Python blocks the first one that isn't a decorator."""
    lines = F.transform(F.split(strip(code), "\n"), lambda x: strip(x))
    first = F.get(lines, F.lit(0))
    plain = F.get(F.filter(lines, lambda x: ~x.startswith("@")), F.lit(0))
    return F.when((language == "python") & first.startswith("@"), F.coalesce(plain, first)).otherwise(first)


#: How many characters of a text alerts and reports keep, by what it is.
KEPT = {"message": 200, "line": 500, "output": 1000, "log": 2000, "backtrace": 3000}


def truncated(text: Column | str, what: str = "message") -> Column:
    """The first characters of a text, as many as its kind may have."""
    return F.left(_c(text), F.lit(KEPT[what]))
