"""Capacity of model slots: memory estimates, idle and least recently used slots, plans to make room."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.operators.parts import prefix_sum

#: Memory that models take, in MB.
MODEL_MB = {
    "phi3:mini": 2400,
    "phi3": 2400,
    "llama3.2:1b": 1200,
    "llama3.2:3b": 2200,
    "llama3.2": 2200,
    "mistral": 4500,
    "qwen2:1.5b": 1200,
    "qwen2:7b": 4800,
    "gemma2:2b": 1800,
    "nomic-embed-text": 300,
    "mxbai-embed-large": 700,
    "all-minilm": 200,
    "snowflake-arctic-embed": 700,
}
OTHER_MB = 2000


def estimate_mb(model: Column, known: dict[str, int] | None = None, other: int = OTHER_MB) -> Column:
    """By the whole name, else by what stands before the colon, else `other`."""
    table = F.create_map(*[F.lit(x) for kv in (MODEL_MB if known is None else known).items() for x in kv])
    return F.coalesce(F.try_element_at(table, model), F.try_element_at(table, F.substring_index(model, ":", 1)), F.lit(other))


def idle(slots: DataFrame, as_of: Column, seconds: float = 300, used: str = "last_used", id_: str = "model_id") -> DataFrame:
    """Slots unused for more than `seconds`, longest first."""
    since = (F.unix_micros(as_of) - F.unix_micros(F.col(used).cast("timestamp"))) / F.lit(1e6)
    return slots.withColumn("idle_sec", since).where(F.col("idle_sec") > seconds).orderBy(F.desc("idle_sec"), id_)


def to_evict(slots: DataFrame, needed: int, by: list[str] | None = None, used: str = "last_used", mb: str = "vram_mb", id_: str = "model_id") -> DataFrame:
    """The least recently used slots that free `needed` MB, of each host in `by`."""
    return prefix_sum(slots, by or [], [used, id_], F.col(mb), "freed_before").where(F.col("freed_before") < needed)


def plan(hosts: DataFrame, slots: DataFrame, needed: Column, max_pct: float = 90, host: str = "host") -> DataFrame:
    """For each host (host, total_mb, used_mb): whether `needed` MB fit, what must be freed, what eviction frees, and the outcome."""
    limit = F.floor(F.col("total_mb") * max_pct / 100)
    fits = F.col("used_mb") + needed <= F.col("total_mb") * max_pct / 100
    short = F.when(fits, F.lit(0)).otherwise(F.col("used_mb") + needed - limit)
    want = hosts.withColumns({"shortfall": short.cast("long")})
    ranked = prefix_sum(slots, [host], ["last_used", "model_id"], F.col("vram_mb"), "freed_before")
    freed = want.join(ranked, host, "left").groupBy(host, "total_mb", "used_mb", "shortfall").agg(F.coalesce(F.sum(F.when(F.col("freed_before") < F.col("shortfall"), F.col("vram_mb"))), F.lit(0)).alias("can_free"))
    outcome = F.when(F.col("shortfall") <= 0, F.lit("fits")).when(F.col("can_free") < F.col("shortfall"), F.lit("insufficient")).otherwise(F.lit("evict"))
    return freed.withColumn("outcome", outcome)


#: How often a request touches a known slot, by method and by whether its provider is local.
TOUCHES = {("embed", True): 3, ("embed", False): 2, ("generate", True): 2, ("generate", False): 1, ("chat", True): 2, ("chat", False): 1}


def slots_of(requests: DataFrame) -> DataFrame:
    """From requests (model_id, provider, method, ts): the slots with their last use, touches and requests. The request that registers a slot starts its touches at 0."""
    local = F.col("provider").isin("ollama", "local")
    touches = F.lit(0)
    for (method, is_local), n in TOUCHES.items():
        touches = F.when((F.col("method") == method) & (local == F.lit(is_local)), F.lit(n)).otherwise(touches)
    first = F.row_number().over(W.partitionBy("model_id").orderBy("ts")) == 1
    rows = requests.withColumn("__t", F.when(first, 0).otherwise(touches))
    return rows.groupBy("model_id", "provider").agg(F.min("ts").alias("loaded_at"), F.max("ts").alias("last_used"), F.sum("__t").alias("request_count"), F.count("*").alias("requests"))
