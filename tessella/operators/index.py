"""The index as immutable tables: what changed, what went, and replacement of all chunks of a path.

Tables: files (path, …, size_bytes, mtime_ns, content_hash, chunk_count) and chunks (path, chunk_index, chunk_text,
token_count[, embedding]). Functions here derive new tables from old ones; `tessella.operators.logindex` keeps them in storage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.scalar import content_hash, extension, token_count


def needs_indexing(now: DataFrame, indexed: DataFrame) -> DataFrame:
    """Rows of (path, size_bytes, mtime_ns, content_hash or null) that are new, or differ in size or time and in content. Unreadable content counts as changed."""
    old = indexed.select("path", F.col("size_bytes").alias("__size"), F.col("mtime_ns").alias("__mtime"), F.col("content_hash").alias("__hash"))
    both = now.join(old, "path", "left")
    same_stat = F.col("size_bytes").eqNullSafe(F.col("__size")) & F.col("mtime_ns").eqNullSafe(F.col("__mtime"))
    changed = F.col("__size").isNull() & F.col("__hash").isNull() | ~same_stat & ~F.coalesce(F.col("content_hash") == F.col("__hash"), F.lit(False))
    return both.where(changed).select(*now.columns)


def to_hash(now: DataFrame, indexed: DataFrame) -> DataFrame:
    """The paths whose content must be hashed at all: known ones that differ in size or time. Joined without contents, so that those of other files are never read."""
    old = indexed.select("path", F.col("size_bytes").alias("__size"), F.col("mtime_ns").alias("__mtime"))
    both = now.select("path", "size_bytes", "mtime_ns").join(old, "path")
    return both.where(~(F.col("size_bytes").eqNullSafe(F.col("__size")) & F.col("mtime_ns").eqNullSafe(F.col("__mtime")))).select("path")


def orphans(indexed: DataFrame, valid: DataFrame) -> DataFrame:
    """Indexed paths that are no longer valid."""
    return indexed.select("path").join(valid.select("path"), "path", "left_anti")


def remove(table: DataFrame, paths: DataFrame) -> DataFrame:
    return table.join(paths.select("path").distinct(), "path", "left_anti")


def upsert(table: DataFrame, new: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """All rows of the new rows' paths (or of `paths`, for files that have none left) replaced."""
    return remove(table, new if paths is None else paths).unionByName(new, allowMissingColumns=True)


def file_rows(files: DataFrame, chunks: DataFrame, as_of: Column) -> DataFrame:
    """The files table for (path, size_bytes, mtime_ns, content) and the chunks of those files."""
    counted = chunks.groupBy("path").agg(F.count("*").cast("int").alias("chunk_count"))
    return files.join(counted, "path", "left").select(
        F.xxhash64("path").alias("id"),
        "path",
        F.substring_index("path", "/", -1).alias("filename"),
        extension("path").alias("extension"),
        "size_bytes",
        F.timestamp_micros((F.col("mtime_ns") / 1000).cast("long")).alias("modified_at"),
        "mtime_ns",
        as_of.alias("indexed_at"),
        content_hash("content").alias("content_hash"),
        F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"),
    )


def zip_shorter(chunks: Column, vectors: Column) -> Column:
    """Chunks with their vectors, as many as the shorter list has."""
    n = F.least(F.size(chunks), F.size(vectors))
    return F.arrays_zip(F.slice(chunks, F.lit(1), n).alias("chunk_text"), F.slice(vectors, F.lit(1), n).alias("embedding"))


def postings(chunks: DataFrame, id_: str = "chunk_id", text: str = "chunk_text") -> DataFrame:
    """An inverted index: for each term and chunk the positions, and the chunk's length."""
    from tessella.operators.search import tokens

    words = chunks.select(id_, tokens(F.col(text)).alias("w"))
    flat = words.select(id_, F.size("w").alias("n_tokens"), F.posexplode("w").alias("position", "term"))
    return flat.groupBy("term", id_).agg(F.sort_array(F.collect_list("position")).alias("positions"), F.first("n_tokens").alias("n_tokens"))


def latest_by_key(writes: DataFrame, *keys: str, order: str = "updated_at") -> DataFrame:
    """Of a log of writes (…, key, value, updated_at; a null value deletes) the last of each key."""
    best = writes.groupBy(*keys).agg(F.max_by(F.struct("value", order), order).alias("x"))
    return best.select(*keys, "x.value", f"x.{order}").where("value is not null")


def counted_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("token_count", token_count("chunk_text"))


def dedup_content(df: DataFrame, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """Of equal contents the row with the smallest id, and how many there are."""
    h = content_hash(F.col(text).cast("binary"))
    best = df.groupBy(h.alias("content_hash")).agg(F.min(id_).alias(id_), F.count("*").alias("copies"))
    return best.select(id_, "content_hash", "copies")


def batches(files: DataFrame, least: int = 50, path: str = "path", n: str = "chunk_count", per_bucket: int = 5000) -> DataFrame:
    """Embedding batches: whole files, a batch closing once it holds `least` chunks. Files go in order of path within buckets of their hash, each of about `per_bucket` files however many there are."""
    bucket = F.pmod(F.xxhash64(path), F.lit(max(1, files.count() // per_bucket))).alias("bucket")
    listed = files.groupBy(bucket).agg(F.array_sort(F.collect_list(F.struct(path, n))).alias("xs"))

    def add(acc: Column, x: Column) -> Column:
        total = acc["open"] + x[n]
        out = F.concat(acc["out"], F.array(F.struct(x[path].alias(path), acc["batch"].alias("batch"))))
        return F.struct(F.when(total >= least, F.lit(0)).otherwise(total).cast("long").alias("open"), (acc["batch"] + (total >= least).cast("int")).alias("batch"), out.alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("open"), F.lit(0).alias("batch"), F.array().cast(f"array<struct<{path}:string,batch:int>>").alias("out"))
    return listed.select("bucket", F.explode(F.aggregate("xs", start, add, lambda a: a["out"])).alias("x")).select("bucket", "x.*")

