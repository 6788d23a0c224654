"""Statistics of the index and of monitored things."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def totals(files: DataFrame, chunks: DataFrame, size: str = "size_bytes") -> DataFrame:
    a = files.agg(F.count("*").alias("files"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))
    b = chunks.agg(F.count("*").alias("chunks"))
    return a.crossJoin(b).withColumn("size_mb", F.round(F.col("bytes") / (1 << 20), 1))


def by_type(files: DataFrame, extension: str = "extension") -> DataFrame:
    named = files.where(F.coalesce(F.col(extension), F.lit("")) != "")
    return named.groupBy(extension).agg(F.count("*").alias("files")).orderBy(F.desc("files"), extension)


def by_top_dir(files: DataFrame, indexable: Column, path: str = "path", size: str = "size_bytes") -> DataFrame:
    top = F.regexp_extract(path, r"^/?([^/]+)/", 1).alias("dir")
    return files.groupBy(top).agg(F.count("*").alias("files"), F.sum(size).alias("bytes"), F.count_if(indexable).alias("indexable"))


def kept_share(files: DataFrame, keep: Column, size: str = "size_bytes") -> DataFrame:
    """Files and bytes in all, kept and ignored, with the share of bytes kept and seven times these as the expected index size."""
    kept, lost = F.when(keep, F.col(size)).otherwise(0), F.when(keep, 0).otherwise(F.col(size))
    out = files.agg(F.count("*").alias("files"), F.sum(size).alias("bytes"), F.count_if(keep).alias("kept_files"), F.sum(kept).alias("kept_bytes"), F.sum(lost).alias("ignored_bytes"))
    return out.withColumns({"kept_pct": F.coalesce(F.try_divide(F.col("kept_bytes"), F.col("bytes")) * 100, F.lit(0.0)), "index_bytes": F.col("kept_bytes") * 7})


def top_extensions(files: DataFrame, keep: Column, n: int = 5, extension: str = "extension", size: str = "size_bytes") -> DataFrame:
    named = F.when(F.coalesce(F.col(extension), F.lit("")) == "", F.lit("no_extension")).otherwise(F.col(extension)).alias("extension")
    return files.where(keep).groupBy(named).agg(F.sum(size).alias("bytes")).orderBy(F.desc("bytes"), "extension").limit(n)


def connections(rows: DataFrame, by: list[str]) -> DataFrame:
    """Of rows (…, state, port): connections by state, and the set of listening ports."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("state") == "ESTABLISHED").alias("established"),
        F.count_if(F.col("state") == "LISTEN").alias("listening"),
        F.count_if(F.col("state") == "TIME_WAIT").alias("time_wait"),
        F.array_sort(F.collect_set(F.when(F.col("state") == "LISTEN", F.col("port")))).alias("listening_ports"),
    )


def units_seen(entries: DataFrame, by: list[str], unit: str = "unit") -> DataFrame:
    return entries.groupBy(*by).agg(F.count("*").alias("entries"), F.array_sort(F.collect_set(unit)).alias("units"))


def fleet_health(agents: DataFrame, by: list[str]) -> DataFrame:
    """Of agents (…, state, cycles): how many run, failed or are degraded; a fleet is degraded if any failed or is degraded, else healthy."""
    failed, weak = F.count_if(F.col("state").isin("failed", "crash_loop")), F.count_if(F.col("state") == "degraded")
    return agents.groupBy(*by).agg(
        F.count("*").alias("agents"),
        F.count_if(F.col("state") == "running").alias("running"),
        failed.alias("failed"),
        weak.alias("degraded"),
        F.sum("cycles").alias("cycles"),
        F.when((failed > 0) | (weak > 0), F.lit("degraded")).otherwise(F.lit("healthy")).alias("status"),
    )


def provider_health(providers: DataFrame, by: list[str]) -> DataFrame:
    return providers.groupBy(*by).agg(F.when(F.bool_or("healthy"), F.lit("healthy")).otherwise(F.lit("degraded")).alias("status"))


def error_rate(cycles: DataFrame, by: list[str]) -> DataFrame:
    """Errors per successful cycle, and whether that is over one half; no successful cycle counts as one."""
    ok, bad = F.count_if("ok"), F.count_if(~F.col("ok"))
    rate = bad / F.greatest(ok, F.lit(1))
    return cycles.groupBy(*by).agg(ok.alias("cycles"), bad.alias("errors"), rate.alias("error_rate"), (rate > 0.5).alias("unhealthy"))


def join_tokens(tokens: DataFrame, by: list[str], order: str, token: str = "token", done: Column | None = None) -> DataFrame:
    """Tokens of a stream joined in order, up to the first that is done."""
    item = F.struct(F.col(order).alias("o"), F.coalesce(F.col(token), F.lit("")).alias("t"), (F.lit(False) if done is None else done).alias("d"))
    xs = tokens.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("xs"))
    end = F.array_position(F.transform("xs", lambda x: x["d"]), True)
    taken = F.when(end > 0, F.slice("xs", F.lit(1), F.greatest(end.cast("int") - 1, F.lit(0)))).otherwise(F.col("xs"))
    return xs.select(*by, F.array_join(F.transform(taken, lambda x: x["t"]), "").alias("text"), F.size(taken).alias("n_tokens"))


def limit_tokens(tokens: DataFrame, by: list[str], order: str, most: int) -> DataFrame:
    """The first `most` tokens of each stream, with `truncated` on the last of a stream that was stopped there."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*by).orderBy(order)
    rows = tokens.withColumns({"place": F.row_number().over(w)}).where(F.col("place") <= most)
    return rows.withColumn("truncated", F.col("place") == most)


def flatten_models(providers: DataFrame) -> DataFrame:
    """A row for each model of each enabled provider (name, enabled, models)."""
    return providers.where("enabled").select(F.col("name").alias("provider"), F.explode("models").alias("model"))


def requests_by(requests: DataFrame, by: list[str]) -> DataFrame:
    """Requests in all, and those begun but not ended."""
    return requests.groupBy(*by).agg(F.count("*").alias("requests"), F.count_if(F.col("ended_at").isNull()).alias("in_flight"))
