"""Hybrid search: exact nearest neighbours, BM25 of a phrase, and path matches, fused by reciprocal ranks.

Each ranker keeps the best 2 k rows (`TakeOrderedAndProject`, so only 2 k rows of a task travel), then ranks those; ranks
over the corpus never exist. The query vector is a literal. Ties go by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.functions.scalar import extension, path_score, recency_boost, rrf

K1, B = 1.2, 0.75
DIGITS = 9


def l2(vector: Column, query: list[float]) -> Column:
    q = F.array(*[F.lit(float(x)) for x in query])
    return F.sqrt(F.aggregate(F.zip_with(vector, q, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x))


def cosine(vector: Column, query: list[float]) -> Column:
    """Cosine distance; null for a zero vector."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with(vector, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    own = sum(float(x) ** 2 for x in query) ** 0.5
    return 1 - F.try_divide(dot, norm * F.lit(own))


def ranked(df: DataFrame, k: int, *order: Column, out: str = "rank") -> DataFrame:
    """The first k rows with their place from 1."""
    return df.orderBy(*order).limit(k).withColumn(out, F.row_number().over(W.orderBy(*order)))


def nearest(vectors: DataFrame, query: list[float], k: int, id_: str = "id", vector: str = "embedding", metric: str = "l2") -> DataFrame:
    """The k nearest rows, with distance and rank; vectors of another length are left out."""
    distance = {"l2": l2, "cosine": cosine}[metric](F.col(vector), query)
    own = vectors.where(F.size(vector) == len(query)).withColumn("distance", F.round(distance, DIGITS)).drop(vector)
    return ranked(own, k, F.col("distance"), F.col(id_))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def phrase_hits(text: Column, phrase: str) -> Column:
    """How often the words of a phrase follow one another in a text, overlaps counted."""
    import re

    w = re.findall(r"[^\W_]+", phrase.lower())
    if not w:
        return F.lit(0)
    spaced = F.concat(F.lit(" "), F.array_join(tokens(text), "  "), F.lit(" "))
    ahead = "".join(f" {x} " for x in w[1:])
    return F.regexp_count(spaced, F.lit(f" {w[0]} (?={ahead})" if ahead else f" {w[0]} "))


def phrase_bm25(docs: DataFrame, phrase: str, k: int, id_: str = "id", text: str = "text") -> DataFrame:
    """The k best rows by BM25 of one phrase: term frequency and length norm (the phrase's rarity is the same for all rows)."""
    counted = docs.withColumns({"tf": phrase_hits(F.col(text), phrase), "n_tokens": F.size(tokens(F.col(text)))})
    mean = counted.agg(F.avg("n_tokens").alias("mean_tokens"))
    # one row
    scored = counted.where("tf > 0").crossJoin(F.broadcast(mean))
    score = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n_tokens") / F.col("mean_tokens")))
    return ranked(scored.withColumn("bm25", F.round(score, DIGITS)).drop("mean_tokens"), k, F.desc("bm25"), F.col(id_))


def fuse(lists: list[DataFrame], id_: str = "id", k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists of (id, rank)."""
    parts = [x.select(id_, rrf(F.col("rank"), k).alias("share")) for x in lists]
    both = parts[0]
    for x in parts[1:]:
        both = both.unionByName(x)
    return both.groupBy(id_).agg(F.sum("share").alias("score"))


def hybrid_search(docs: DataFrame, vectors: DataFrame, query_text: str, query_vector: list[float], top_k: int = 10, as_of: Column | None = None, rrf_k: int = 60, index=None) -> DataFrame:
    """The top_k rows of (id, text, path[, modified_at]) for a query, with (id, embedding) beside them.

    Candidates are the best 2 top_k by vector and by phrase. Those whose path holds words of the query are ranked by that,
    equal ones in the order of the candidates (vector list, then the phrase list's own); recency multiplies at the end.
    With `index`, a `PhraseIndex` of the documents, the phrase is looked up in its postings and no texts are scanned for it."""
    vec = nearest(vectors.select("id", "embedding"), query_vector, 2 * top_k).select("id", F.col("rank").alias("vec_rank"))
    by_phrase = index.search(query_text, 2 * top_k) if index is not None else phrase_bm25(docs.select("id", "text"), query_text, 2 * top_k)
    fts = by_phrase.select("id", F.col("rank").alias("fts_rank"))
    found = vec.join(fts, "id", "full_outer")
    found = found.withColumn("place", F.coalesce("vec_rank", F.lit(2 * top_k) + F.col("fts_rank")))
    # at most 4 top_k rows
    rows = docs.join(F.broadcast(found), "id")
    rows = rows.withColumn("on_path", path_score(query_text, "path"))
    order = W.partitionBy(F.col("on_path") > 0).orderBy(F.desc("on_path"), "place")
    rows = rows.withColumn("path_rank", F.when(F.col("on_path") > 0, F.row_number().over(order)))
    share = lambda c: F.when(F.col(c).isNotNull(), rrf(F.col(c), rrf_k)).otherwise(0.0)
    score = share("vec_rank") + share("fts_rank") + share("path_rank")
    if as_of is not None and "modified_at" in docs.columns:
        score = score * recency_boost("modified_at", as_of)
    out = rows.withColumns({"score": score, "file_type": extension("path")})
    return ranked(out, top_k, F.desc("score"), F.col("place"), out="result_rank").drop("place", "vec_rank", "fts_rank", "on_path", "path_rank")
