"""Tables from system text: sockets of the kernel, JSON dumps, journal entries, tool manifests."""

from __future__ import annotations

import tomllib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.scalar import hex_port, tcp_state


def sockets(lines: DataFrame, line: str = "value") -> DataFrame:
    """Rows of (local_port, remote_port, state) from the lines of /proc/net/tcp; the header and short lines are left out."""
    cols = F.split(F.trim(line), r"\s+")
    rows = lines.select(cols.alias("c")).where((F.size("c") >= 4) & F.get("c", F.lit(1)).rlike("^[0-9A-Fa-f]+:[0-9A-Fa-f]+$"))
    at = lambda i: F.get("c", F.lit(i))
    return rows.select(hex_port(at(1)).alias("local_port"), hex_port(at(2)).alias("remote_port"), tcp_state(at(3)).alias("state"))


DUMPS = "array<struct<pid:bigint,exe:string,comm:string,sig:string,timestamp:string>>"


def core_dumps(texts: DataFrame, text: str = "value") -> DataFrame:
    """Rows of a JSON array of dumps; exe falls back to comm, then to unknown (an explicit null counts as missing)."""
    rows = texts.select(F.explode(F.from_json(text, DUMPS)).alias("d")).select("d.*")
    return rows.select("pid", F.coalesce("exe", "comm", F.lit("unknown")).alias("exe"), F.coalesce("sig", F.lit("unknown")).alias("signal"), F.coalesce("timestamp", F.lit("")).alias("timestamp"))


def journal(lines: DataFrame, line: str = "value", unit: Column | None = None) -> DataFrame:
    """Journal entries from JSON lines: unit, message, priority and timestamp. A message of bytes is read as UTF-8, with marks for what isn't."""
    j = lambda name: F.get_json_object(line, f"$.{name}")
    raw = F.from_json(j("MESSAGE"), "array<int>")
    text = F.make_valid_utf8(F.unhex(F.array_join(F.transform(raw, lambda b: F.lpad(F.hex(b), 2, "0")), "")).cast("string"))
    message = F.when(j("MESSAGE").rlike(r"^\[[0-9, ]*\]$") & raw.isNotNull() & F.get_json_object(line, "$.MESSAGE[0]").isNotNull(), text).otherwise(j("MESSAGE"))
    rows = lines.select(
        F.coalesce(j("_SYSTEMD_UNIT"), F.lit("unknown")).alias("unit"),
        F.coalesce(message, F.lit("")).alias("message"),
        F.coalesce(j("PRIORITY").try_cast("int"), F.lit(6)).alias("priority"),
        F.coalesce(j("__REALTIME_TIMESTAMP"), F.lit("")).alias("timestamp"),
    )
    return rows if unit is None else rows.where(F.col("unit") == unit)


def parameters_schema(params: list[dict] | dict) -> dict:
    """A JSON Schema; a list of parameters becomes an object's properties."""
    if isinstance(params, dict):
        return params
    named = [p for p in params if p.get("name")]
    optional = lambda p: {k: p[k] for k in ("description", "default", "enum") if k in p}
    items = lambda p: {"items": {"type": p["items"]}} if "items" in p else {}
    schema = {"type": "object", "properties": {p["name"]: {"type": p.get("type", "string")} | optional(p) | items(p) for p in named}}
    must = [p["name"] for p in named if p.get("required")]
    return schema | ({"required": must} if must else {})


def manifests(spark: SparkSession, texts: list[str]) -> DataFrame:
    """Tools from TOML manifests: name, binary, description, capabilities, and the names of actions with their parameters' schema as JSON."""
    import json

    rows = []
    for text in texts:
        tool = (doc := tomllib.loads(text)).get("tool", doc)
        actions = tool.get("schemas", doc.get("schemas", {}))
        made = {k: json.dumps(parameters_schema(v.get("parameters", v.get("params", {})))) for k, v in actions.items() if isinstance(v, dict)}
        rows.append((tool.get("name", ""), tool.get("binary", ""), tool.get("description", ""), list(tool.get("capabilities", [])), made))
    return spark.createDataFrame(rows, "name string, binary string, description string, capabilities array<string>, schemas map<string,string>")


def write_json(df: DataFrame, path: str) -> None:
    """Rows as lines of JSON."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
