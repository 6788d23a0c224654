"""The registered queries: each operator over the tables of a data folder, with SQL that means the same.

A query is a function of (tables, spark); `t("events")` reads a table. Columns have the same names on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import chunk, embed, ignore, scalar, validate
from tessella.operators import capacity, detect, filters, index, search, stats
from tessella.operators.logindex import LogIndex
from tessella.operators.phraseindex import PhraseIndex
from tessella.session import shared_folder
from tessella.sources import system

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
AS_OF = "2024-02-01 00:00:00"


def query(sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def as_of():
    return F.lit(AS_OF).cast("timestamp")


# Files: the documents as a tree of paths.
PATH_SQL = (
    "concat(CASE WHEN doc_id % 7 = 3 THEN 'node_modules/' WHEN doc_id % 13 = 5 THEN 'tmp/' ELSE '' END, source, '/', CASE WHEN doc_id % 11 = 4 THEN '.' ELSE '' END, 'doc', CAST(doc_id AS STRING), "
    "CASE doc_id % 8 WHEN 0 THEN '.py' WHEN 1 THEN '.md' WHEN 2 THEN '.TXT' WHEN 3 THEN '.json' WHEN 4 THEN '.min.js' WHEN 5 THEN '.exe' WHEN 6 THEN '.csv' ELSE '' END)"
)
SIZE_SQL = "CASE WHEN doc_id % 17 = 0 THEN 0 ELSE n_chars * 1500 END"
FILES_SQL = f"files AS (SELECT doc_id, {PATH_SQL} AS path, CAST({SIZE_SQL} AS BIGINT) AS size_bytes FROM documents)"
KEEP_SQL = (
    "(size_bytes > 0 AND size_bytes <= 5242880 AND NOT starts_with(regexp_extract(path, '[^/]*$'), '.') AND path NOT LIKE 'node_modules/%' AND path NOT LIKE '%.min.js' "
    "AND path NOT LIKE 'tmp/%' AND lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)) IN ('.py', '.md', '.txt', '.json', '.csv'))"
)


def files(t) -> DataFrame:
    return t("documents").select("doc_id", F.expr(PATH_SQL).alias("path"), F.expr(SIZE_SQL).cast("long").alias("size_bytes"))


def keep():
    return filters.should_index(F.col("path"), F.col("size_bytes"), ["# scratch", "tmp/", "*.log", "!keep.log"])


# Search
PHRASE = "on the"
DOC_PATH = "concat(CASE WHEN doc_id % 5 = 0 THEN '/on/the/doc' WHEN doc_id % 3 = 0 THEN '/on/doc' ELSE '/doc' END, CAST(doc_id AS STRING))"
Q = "q AS (SELECT embedding::DOUBLE[] e FROM embeddings WHERE vec_id = 0)"
VEC = "v AS (SELECT vec_id id, round(list_distance(embedding::DOUBLE[], e), 9) distance FROM embeddings, q ORDER BY 2, 1 LIMIT 20), vr AS (SELECT *, row_number() OVER (ORDER BY distance, id) r FROM v)"
BM = (
    "w AS (SELECT doc_id id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') w FROM documents), "
    "c AS (SELECT id, len(w) n_tokens, (length(s) - length(replace(s, ' on  the ', ''))) // 9 tf FROM (SELECT id, w, ' ' || array_to_string(w, '  ') || ' ' s FROM w)), "
    "f AS (SELECT id, tf::INTEGER tf, n_tokens::INTEGER n_tokens, round(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n_tokens / (SELECT avg(n_tokens) FROM c))), 9) bm25 FROM c WHERE tf > 0 ORDER BY 4 DESC, 1 LIMIT 20), "
    "fr AS (SELECT *, row_number() OVER (ORDER BY bm25 DESC, id) r FROM f)"
)


def query_vector(vectors: DataFrame) -> list[float]:
    row = vectors.where("vec_id = 0").select("embedding").first()
    return [float(x) for x in row[0]]


@query(
    f"WITH {Q}, {VEC}, {BM}, b AS (SELECT coalesce(vr.id, fr.id) id, vr.r vr, fr.r fr, coalesce(vr.r, 20 + fr.r) place FROM vr FULL JOIN fr ON vr.id = fr.id), "
    f"p AS (SELECT b.*, {DOC_PATH.replace('STRING', 'VARCHAR')} path FROM b JOIN documents d ON d.doc_id = b.id), "
    "s AS (SELECT *, ((contains(path, 'on'))::INT + (contains(path, 'the'))::INT) / 2.0 sc FROM p), "
    "k AS (SELECT *, CASE WHEN sc > 0 THEN row_number() OVER (PARTITION BY sc > 0 ORDER BY sc DESC, place) END pr FROM s), "
    "z AS (SELECT id, path, place, coalesce(1.0::DOUBLE / (60 + vr), 0) + coalesce(1.0::DOUBLE / (60 + fr), 0) + coalesce(1.0::DOUBLE / (60 + pr), 0) score FROM k) "
    "SELECT id, path, round(score, 12) score, (row_number() OVER (ORDER BY score DESC, place))::INTEGER AS result_rank FROM z ORDER BY score DESC, place LIMIT 10"
)
def hybrid_search(t):
    docs = t("documents").select(F.col("doc_id").alias("id"), "text", F.expr(DOC_PATH).alias("path"))
    vectors = t("embeddings")
    found = search.hybrid_search(docs, vectors.select(F.col("vec_id").alias("id"), "embedding"), PHRASE, query_vector(vectors))
    return found.select("id", "path", F.round("score", 12).alias("score"), "result_rank")


@query(f"WITH {Q}, {VEC} SELECT id, distance, r::INTEGER AS rank FROM vr")
def knn_l2(t):
    return search.nearest(t("embeddings").select(F.col("vec_id").alias("id"), "embedding"), query_vector(t("embeddings")), 20)


@query(f"WITH {Q} SELECT id, distance, (row_number() OVER (ORDER BY distance, id))::INTEGER AS rank FROM (SELECT vec_id id, round(list_cosine_distance(embedding::DOUBLE[], e), 9) distance FROM embeddings, q ORDER BY 2, 1 LIMIT 20)")
def knn_cosine(t):
    found = search.nearest(t("embeddings").select(F.col("vec_id").alias("id"), "embedding"), query_vector(t("embeddings")), 20, metric="cosine")
    return found.select("id", (F.col("distance") + 0.0).alias("distance"), "rank")


@query(f"WITH {BM} SELECT id, tf, n_tokens, bm25, r::INTEGER AS rank FROM fr")
def phrase_bm25(t):
    return search.phrase_bm25(t("documents").select(F.col("doc_id").alias("id"), "text"), PHRASE, 20).drop("text")


_STORED: dict[tuple[str, str], str] = {}


def stored_index(t) -> PhraseIndex:
    """The index of the documents' words, built once for each application and table."""
    docs = t("documents")
    spark = docs.sparkSession
    key, n = (spark.sparkContext.applicationId, docs.inputFiles()[0] if docs.inputFiles() else ""), int(spark.conf.get("spark.sql.shuffle.partitions"))
    if key not in _STORED:
        at = shared_folder(spark, "phrases")
        PhraseIndex(spark, at, n).add(docs.select(F.col("doc_id").alias("id"), "text"))
        _STORED[key] = at
    return PhraseIndex(spark, _STORED[key], n)


@query(f"WITH {BM.replace('lower(text)', 'strip_accents(lower(text))')} SELECT id, tf, n_tokens, bm25, r::INTEGER AS rank FROM fr")
def phrase_bm25_stored(t):
    return stored_index(t).search(PHRASE, 20)


@query(ORACLE_SQL["hybrid_search"].replace("lower(text)", "strip_accents(lower(text))"))
def hybrid_search_stored(t):
    docs, vectors = t("documents").select(F.col("doc_id").alias("id"), "text", F.expr(DOC_PATH).alias("path")), t("embeddings")
    found = search.hybrid_search(docs, vectors.select(F.col("vec_id").alias("id"), "embedding"), PHRASE, query_vector(vectors), index=stored_index(t))
    return found.select("id", "path", F.round("score", 12).alias("score"), "result_rank")


@query(
    f"WITH {Q}, {VEC}, l AS (SELECT vec_id id, row_number() OVER (ORDER BY label, vec_id) r FROM embeddings ORDER BY label, vec_id LIMIT 20) "
    "SELECT id, round(sum(1.0::DOUBLE / (60 + r)), 12) AS score FROM (SELECT id, r FROM vr UNION ALL SELECT id, r FROM l) GROUP BY id"
)
def rrf_fuse_two_lists(t):
    e = t("embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    a = search.nearest(e, query_vector(t("embeddings")), 20)
    b = search.ranked(e, 20, F.col("label"), F.col("id"))
    return search.fuse([a, b]).withColumn("score", F.round("score", 12))


@query("SELECT page_id, ((contains(lower(url), 'https'))::INT + (contains(lower(url), 'page'))::INT + (contains(lower(url), '1'))::INT) / 3.0::DOUBLE AS score FROM pages")
def path_score(t):
    return t("pages").select("page_id", scalar.path_score("HTTPS page 1", "url").alias("score"))


@query(
    "WITH s AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') t FROM documents) "
    "SELECT doc_id, CASE WHEN length(t) <= 200 THEN t ELSE regexp_replace(substr(t, 1, 200), ' [^ ]*$', '') || '...' END AS snippet FROM s"
)
def snippet(t):
    return t("documents").select("doc_id", scalar.snippet("text").alias("snippet"))


@query("SELECT page_id, CASE WHEN contains(url, '.') THEN lower(string_split(url, '.')[-1]) ELSE '' END AS extension FROM pages")
def ext_from_path(t):
    return t("pages").select("page_id", scalar.extension("url").alias("extension"))


@query(
    "WITH m AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN replace(p_name, ' ', '/') WHEN 2 THEN p_brand || '/' || p_name ELSE p_brand END m FROM part), "
    "r AS (SELECT p_partkey, coalesce(m, 'ollama/phi3:mini') m FROM m) "
    "SELECT p_partkey, CASE WHEN contains(m, '/') THEN split_part(m, '/', 1) ELSE 'ollama' END AS provider, CASE WHEN contains(m, '/') THEN substr(m, strpos(m, '/') + 1) ELSE m END AS model FROM r"
)
def resolve_model(t):
    m = F.expr("CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN replace(p_name, ' ', '/') WHEN 2 THEN concat(p_brand, '/', p_name) ELSE p_brand END")
    provider, name = scalar.resolve_model(m, F.lit("ollama/phi3:mini"))
    return t("part").select("p_partkey", provider.alias("provider"), name.alias("model"))


@query("SELECT p_partkey, CASE WHEN contains(split_part(n, ':', 1), 'embed') OR contains(lower(p_type), 'embed') THEN 'embed' ELSE 'generate,chat' END AS capabilities FROM (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN 'nomic-embed:v' || p_size ELSE p_name || ':embed' END n FROM part)")
def capabilities(t):
    name = F.expr("CASE WHEN p_partkey % 3 = 0 THEN concat('nomic-embed:v', p_size) ELSE concat(p_name, ':embed') END")
    return t("part").select("p_partkey", F.array_join(scalar.capabilities(name, F.col("p_type")), ",").alias("capabilities"))


@query("SELECT doc_id, len(regexp_extract_all(text, '\\S+'))::INTEGER AS n FROM documents")
def token_count(t):
    return t("documents").select("doc_id", scalar.token_count("text").alias("n"))


@query(
    "WITH a AS (SELECT o_orderkey, (epoch_us(TIMESTAMP '1998-01-01') - epoch_us(o_orderdate)) / 86400e6 age FROM orders) "
    "SELECT o_orderkey, round(CASE WHEN age <= 7 THEN 1 + 0.1 * (1 - age / 7.0) ELSE 1.0 END, 9) AS boost FROM a"
)
def recency_boost(t):
    return t("orders").select("o_orderkey", F.round(scalar.recency_boost("o_orderdate", F.lit("1998-01-01").cast("timestamp")), 9).alias("boost"))


@query(
    "SELECT p_partkey, CASE WHEN n >= 1073741824 THEN printf('%.2f GB', n / 1073741824.0) WHEN n >= 1048576 THEN printf('%.1f MB', n / 1048576.0) WHEN n >= 1024 THEN printf('%.1f KB', n / 1024.0) ELSE n::VARCHAR || ' B' END AS size FROM (SELECT p_partkey, (p_partkey * p_partkey * p_size)::BIGINT n FROM part)"
)
def format_size(t):
    return t("part").select("p_partkey", scalar.format_size(F.expr("p_partkey * p_partkey * p_size")).alias("size"))


@query(
    "SELECT p_partkey, CASE WHEN n < 60 THEN n::VARCHAR || 's' WHEN n < 3600 THEN (n // 60)::VARCHAR || 'm ' || (n % 60)::VARCHAR || 's' ELSE (n // 3600)::VARCHAR || 'h ' || (n % 3600 // 60)::VARCHAR || 'm' END AS duration FROM (SELECT p_partkey, (p_partkey * p_size)::BIGINT n FROM part)"
)
def format_duration(t):
    return t("part").select("p_partkey", scalar.format_duration(F.expr("cast(p_partkey * p_size as double)")).alias("duration"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM pages")
def html_strip(t):
    return t("pages").select("page_id", scalar.strip_tags("html").alias("text"))


@query(
    "SELECT event_id, CASE event_id % 13 WHEN 1 THEN 'ESTABLISHED' WHEN 2 THEN 'SYN_SENT' WHEN 3 THEN 'SYN_RECV' WHEN 4 THEN 'FIN_WAIT1' WHEN 5 THEN 'FIN_WAIT2' WHEN 6 THEN 'TIME_WAIT' WHEN 7 THEN 'CLOSE' WHEN 8 THEN 'CLOSE_WAIT' WHEN 9 THEN 'LAST_ACK' WHEN 10 THEN 'LISTEN' WHEN 11 THEN 'CLOSING' ELSE 'UNKNOWN' END AS state, (user_id % 65536)::INTEGER AS port FROM events"
)
def tcp_decode(t):
    code, address = F.lpad(F.hex(F.expr("event_id % 13")), 2, "0"), F.concat(F.lit("0100007F:"), F.lpad(F.hex(F.expr("user_id % 65536")), 4, "0"))
    return t("events").select("event_id", scalar.tcp_state(code).alias("state"), scalar.hex_port(address).alias("port"))


@query("SELECT event_id, coalesce(CASE WHEN event_id % 5 > 0 THEN user_id END::VARCHAR, '') || '-' || event_type AS dump_id FROM events")
def dump_ids(t):
    return t("events").select("event_id", scalar.dump_id(F.expr("CASE WHEN event_id % 5 > 0 THEN user_id END"), F.col("event_type")).alias("dump_id"))


@query(
    "SELECT event_id, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN replace(props, ' ', '') WHEN 2 THEN '{}' ELSE props END AS output FROM events"
)
def tool_output(t):
    kind = F.expr("CASE event_id % 4 WHEN 0 THEN 'exitcode' WHEN 1 THEN 'json' WHEN 2 THEN 'json' ELSE 'text' END")
    out = F.expr("CASE event_id % 4 WHEN 2 THEN '  ' ELSE props END")
    return t("events").select("event_id", scalar.output_of(out, kind).alias("output"))


@query(
    "SELECT event_id, CASE event_id % 3 WHEN 0 THEN coalesce(trim(v)::BIGINT::VARCHAR, v) WHEN 1 THEN (lower(v) IN ('true', '1', 'yes'))::VARCHAR ELSE v END AS value FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN ' ' || user_id || ' ' WHEN 1 THEN CASE WHEN user_id % 2 = 0 THEN 'YES' ELSE 'off' END ELSE event_type END v FROM events)"
)
def coerce_params(t):
    v = F.expr("CASE event_id % 3 WHEN 0 THEN concat(' ', user_id, ' ') WHEN 1 THEN CASE WHEN user_id % 2 = 0 THEN 'YES' ELSE 'off' END ELSE event_type END")
    kind = F.expr("CASE event_id % 3 WHEN 0 THEN 'integer' WHEN 1 THEN 'boolean' ELSE 'string' END")
    return t("events").select("event_id", scalar.coerce_param(v, kind).alias("value"))


@query("SELECT p_partkey, regexp_matches(n, '^[a-z][a-z0-9-]*$') AS valid, array_to_string(list_transform(string_split(n, '-'), lambda x: upper(substr(x, 1, 1)) || lower(substr(x, 2))), '') || CASE WHEN n LIKE '%-agent' THEN '' ELSE 'Agent' END AS class FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN lower(replace(p_brand, '#', '-')) || '-agent' ELSE p_brand END n FROM part)")
def agent_names(t):
    n = F.expr("CASE WHEN p_partkey % 2 = 0 THEN concat(lower(replace(p_brand, '#', '-')), '-agent') ELSE p_brand END")
    return t("part").select("p_partkey", scalar.valid_agent_name(n).alias("valid"), scalar.agent_class(n).alias("class"))


# Chunks
def _fixed_sql(size: int, overlap: int) -> str:
    step = size - overlap
    return (
        "WITH w AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') t, regexp_extract_all(text, '\\S+') w FROM documents), "
        f"s AS (SELECT doc_id, t, w, unnest(range(0, greatest(0, ceil((len(w) - {size}) / {step}.0)::BIGINT * {step}) + 1, {step})) s FROM w WHERE t <> '') "
        f"SELECT doc_id, (s // {step})::INTEGER AS chunk_index, md5(CASE WHEN len(w) <= {size} THEN t ELSE array_to_string(w[s + 1 : s + {size}], ' ') END) AS chunk_md5 FROM s"
    )


def _exploded(df: DataFrame, chunks) -> DataFrame:
    return df.select("doc_id", F.posexplode(chunks).alias("chunk_index", "c")).select("doc_id", "chunk_index", F.md5("c").alias("chunk_md5"))


@query(_fixed_sql(512, 50))
def chunk_fixed(t):
    return _exploded(t("documents"), chunk.fixed(F.col("text")))


@query(_fixed_sql(20, 5))
def chunk_fixed_small(t):
    return _exploded(t("documents"), chunk.fixed(F.col("text"), 20, 5))


def _pack_sql(size: int, carry: bool, glue: str) -> str:
    """Lines of documents packed greedily by a recursive query; a row each, with the chunk it falls in."""
    reset = "p.n + x.n" if carry else "x.n"
    own = f"string_agg(line, '{glue}' ORDER BY i)"
    text = f"CASE WHEN lag(last_line) OVER (PARTITION BY doc_id ORDER BY k) IS NOT NULL THEN lag(last_line) OVER (PARTITION BY doc_id ORDER BY k) || '{glue}' ELSE '' END || own" if carry else "own"
    return (
        "WITH RECURSIVE a AS (SELECT doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) i0 FROM documents), "
        "l AS (SELECT doc_id, regexp_replace(line, '^\\s+|\\s+$', '', 'g') line, len(regexp_extract_all(line, '\\S+')) n, row_number() OVER (PARTITION BY doc_id ORDER BY i0) i FROM a WHERE regexp_matches(line, '\\S')), "
        f"r AS (SELECT doc_id, i, n, n total, 0 k FROM l WHERE i = 1 UNION ALL SELECT x.doc_id, x.i, x.n, CASE WHEN p.total + x.n > {size} THEN {reset} ELSE p.total + x.n END, CASE WHEN p.total + x.n > {size} THEN p.k + 1 ELSE p.k END FROM r p JOIN l x ON x.doc_id = p.doc_id AND x.i = p.i + 1), "
        f"g AS (SELECT doc_id, k, {own} own, max_by(line, i) last_line FROM r JOIN l USING (doc_id, i) GROUP BY doc_id, k) "
        f"SELECT doc_id, k::INTEGER AS chunk_index, md5({text}) AS chunk_md5 FROM g"
    )


@query(_pack_sql(100, False, "' || chr(10) || '"))
def merge_lines(t):
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: scalar.strip(x)), lambda x: x != "")
    return _exploded(t("documents"), chunk.merge_lines(lines, 100))


@query(
    _pack_sql(100, True, "' || chr(10) || chr(10) || '").replace("FROM documents)", "FROM documents WHERE len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S'))) > 1)")
)
def chunk_prose(t):
    """Documents of several lines, as its SQL says; chunk_prose_all has the others too."""
    docs = t("documents").where(F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"\S"))) > 1)
    return _exploded(docs, chunk.prose(F.regexp_replace("text", "\n", "\n\n"), 100, 10))


LINES_SQL = "len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S')))"


@query(
    f"SELECT * FROM ({ORACLE_SQL['chunk_prose']}) UNION ALL SELECT * FROM ({_fixed_sql(100, 10).replace('FROM documents)', f'FROM documents WHERE {LINES_SQL} <= 1)')})"
)
def chunk_prose_all(t):
    """All documents: those of chunk_prose, which has only documents of several lines, and single paragraphs as windows."""
    return _exploded(t("documents"), chunk.prose(F.regexp_replace("text", "\n", "\n\n"), 100, 10))


@query(
    "WITH RECURSIVE a AS (SELECT doc_id, unnest(string_split(t, chr(10))) line, generate_subscripts(string_split(t, chr(10)), 1) i FROM (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') t FROM documents)), "
    "l AS (SELECT *, len(regexp_extract_all(line, '\\S+')) n FROM a), h AS (SELECT doc_id, line head, n hn FROM l WHERE i = 1), "
    "r AS (SELECT doc_id, i, n + hn total, 0 k FROM l JOIN h USING (doc_id) WHERE i = 2 UNION ALL SELECT x.doc_id, x.i, CASE WHEN p.total + x.n > 200 THEN hn + x.n ELSE p.total + x.n END, CASE WHEN p.total + x.n > 200 THEN p.k + 1 ELSE p.k END FROM r p JOIN l x ON x.doc_id = p.doc_id AND x.i = p.i + 1 JOIN h ON h.doc_id = x.doc_id) "
    "SELECT doc_id, k::INTEGER AS chunk_index, md5('Headers: ' || max(head) || chr(10) || string_agg(line, chr(10) ORDER BY i)) AS chunk_md5 FROM r JOIN l USING (doc_id, i) JOIN h USING (doc_id) GROUP BY doc_id, k"
)
def chunk_csv(t):
    return _exploded(t("documents"), chunk.csv(F.col("text"), 200))


HEADING_SQL = "(?m)^(#{1,6})\\s+(.+)$"


@query(
    "WITH m AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN (i - 1) % 5 = 0 THEN '# ' || x ELSE x END), chr(10)) t FROM documents), "
    f"s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(t, '{HEADING_SQL}', chr(57344) || '\\0', 'g'), chr(57344)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') s FROM m), "
    "u AS (SELECT doc_id, unnest(s) x, generate_subscripts(s, 1) k FROM s), w AS (SELECT *, regexp_extract_all(x, '\\S+') w, regexp_extract(x, '^(#{1,6}\\s+[^\\n]+)', 1) h FROM u), "
    "c AS (SELECT *, unnest(range(0, CASE WHEN len(w) <= 60 THEN 1 ELSE ceil((len(w) - 60) / 50.0)::BIGINT * 50 + 1 END, 50)) b FROM w) "
    "SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k, b) - 1)::INTEGER AS chunk_index, md5(CASE WHEN len(w) <= 60 THEN x ELSE CASE WHEN b > 0 AND h <> '' THEN h || chr(10) ELSE '' END || array_to_string(w[b + 1 : b + 60], ' ') END) AS chunk_md5 FROM c"
)
def chunk_markdown(t):
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 5 == 0, F.concat(F.lit("# "), x)).otherwise(x))
    return _exploded(t("documents"), chunk.markdown(F.array_join(lines, "\n"), 60, 10))


@query("SELECT event_id AS doc_id, 0 AS chunk_index, md5('k: ' || (props->>'k')) AS chunk_md5 FROM events")
def json_flatten(t):
    return _exploded(t("events").select(F.col("event_id").alias("doc_id"), "props"), chunk.json_chunks(F.col("props")))


LINE_SQL = "unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) i"


@query("WITH l AS (SELECT event_id AS doc_id, 'a: ' || user_id AS a, 'b[0]: ' || event_type AS b, 'c.d: ' || (props->>'k') AS c FROM events) SELECT doc_id, 0 AS chunk_index, md5('kind: ' || 'event' || chr(10) || a || chr(10) || b || chr(10) || c) AS chunk_md5 FROM l")
def chunk_json_nested(t):
    """Nested objects and lists as lines."""
    nested = F.to_json(F.struct(F.lit("event").alias("kind"), F.col("user_id").alias("a"), F.array("event_type").alias("b"), F.struct(F.get_json_object("props", "$.k").alias("d")).alias("c")))
    return _exploded(t("events").select(F.col("event_id").alias("doc_id"), nested.alias("j")), chunk.json_chunks(F.col("j")))


@query(
    "WITH w AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9]+') w FROM documents), l AS (SELECT doc_id, len(w) n, list_transform(CASE WHEN len(w) > 50 THEN w[1:10] ELSE w END, lambda x, i: 'words[' || (i - 1) || ']: ' || x) ls FROM w WHERE len(w) > 0) "
    "SELECT doc_id, 0 AS chunk_index, md5(CASE WHEN n > 50 THEN 'words: [' || n || ' items]' || chr(10) ELSE '' END || array_to_string(ls, chr(10)) || CASE WHEN n > 50 THEN chr(10) || '... and ' || (n - 10) || ' more items' ELSE '' END) AS chunk_md5 FROM l"
)
def chunk_json_lists(t):
    """The words of a document as a list: of more than 50 items the first ten and how many there are."""
    listed = F.to_json(F.struct(F.expr("regexp_extract_all(text, '[A-Za-z0-9]+', 0)").alias("words")))
    return _exploded(t("documents").select("doc_id", listed.alias("j")), chunk.json_chunks(F.col("j")))


@query(f"SELECT event_id AS doc_id, 0 AS chunk_index, md5('{'.'.join('a' * 11)}: {{' || chr(39) || 'a' || chr(39) || ': ' || chr(39) || event_type || chr(39) || '}}') AS chunk_md5 FROM events")
def chunk_json_deep(t):
    """Twelve objects within one another: below ten levels the text of what is left."""
    deep = F.concat(F.lit('{"a":' * 12 + '"'), F.col("event_type"), F.lit('"' + "}" * 12))
    return _exploded(t("events").select(F.col("event_id").alias("doc_id"), deep.alias("j")), chunk.json_chunks(F.col("j")))


CALL_SCHEMA = {
    "type": "object",
    "properties": {
        "user": {"type": "object", "required": ["id", "name"], "properties": {"id": {"type": "integer", "minimum": 10}}},
        "events": {"type": "array", "items": {"type": "object", "properties": {"type": {"enum": ["click", "view"]}, "value": {"type": "number", "maximum": 300}}}},
    },
}


@query(
    "SELECT event_id, array_to_string(list_filter([CASE WHEN user_id % 2 <> 0 THEN '$.user.name: required' END, CASE WHEN user_id < 10 THEN '$.user.id: below 10' END, "
    "CASE WHEN event_type NOT IN ('click', 'view') THEN '$.events[0].type: not in enum' END, CASE WHEN value > 300 THEN '$.events[0].value: above 300' END], lambda x: x IS NOT NULL), '; ') AS errors FROM events"
)
def nested_schema(t):
    """Events as nested documents against a schema."""
    user = F.struct(F.col("user_id").alias("id"), F.expr("CASE WHEN user_id % 2 = 0 THEN event_type END").alias("name"))
    doc = F.to_json(F.struct(user.alias("user"), F.array(F.struct(F.col("event_type").alias("type"), "value")).alias("events")))
    return t("events").select("event_id", F.array_join(validate.json_errors(doc, CALL_SCHEMA), "; ").alias("errors"))


@query("SELECT event_id AS doc_id, 0 AS chunk_index, md5('- ' || event_type || ':' || chr(10) || '[' || user_id || chr(10) || 'tail') AS chunk_md5 FROM events")
def chunk_yaml(t):
    """Text that no YAML reader takes: sections by what starts a line."""
    text = F.concat(F.lit("- "), F.col("event_type"), F.lit(":\n["), F.col("user_id"), F.lit("\ntail"))
    return _exploded(t("events").select(F.col("event_id").alias("doc_id"), text.alias("y")), chunk.yaml_chunks(F.col("y")))


@query(
    "WITH p AS (SELECT conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') x FROM conversations WHERE regexp_matches(text, '\\S')), w AS (SELECT *, regexp_extract_all(x, '\\S+') w, count(*) OVER (PARTITION BY conv_id) pages FROM p), "
    "c AS (SELECT *, unnest(range(0, CASE WHEN len(w) <= 40 THEN 1 ELSE ceil((len(w) - 40) / 30.0)::BIGINT * 30 + 1 END, 30)) b FROM w) "
    "SELECT conv_id AS doc_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, b) - 1)::INTEGER AS chunk_index, md5(CASE WHEN len(w) <= 40 THEN x ELSE array_to_string(w[b + 1 : b + 40], ' ') END) AS chunk_md5 FROM c"
)
def chunk_document(t):
    """The turns of a conversation as the pages of a document."""
    turns = F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    docs = t("conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(turns, "\f").alias("text"))
    return _exploded(docs, chunk.document(F.col("text"), 40, 10))


@query(
    "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'def f' || doc_id || '():' ELSE '@cached' END AS signature FROM documents"
)
def code_signature(t):
    code = F.concat(F.lit("\n  @cached\n  def f"), F.col("doc_id").cast("string"), F.lit("():\n    return 1\n"))
    return t("documents").select("doc_id", scalar.signature(code, F.expr("CASE WHEN doc_id % 2 = 0 THEN 'python' ELSE 'rust' END")).alias("signature"))


@query("SELECT doc_id, md5(substr(text, 1, 200)) AS message, md5(substr(text, 1, 500)) AS line, md5(substr(text, 1, 1000)) AS output, md5(substr(text, 1, 2000)) AS log, md5(substr(text, 1, 3000)) AS backtrace FROM documents")
def truncations(t):
    return t("documents").select("doc_id", *[F.md5(scalar.truncated("text", k)).alias(k) for k in scalar.KEPT])


@query("SELECT conv_id, turn FROM conversations WHERE regexp_matches(CASE WHEN turn % 3 = 0 THEN ' ' || chr(10) || ' ' ELSE text END, '\\S')")
def blank_texts(t):
    own = F.when(F.col("turn") % 3 == 0, F.lit(" \n ")).otherwise(F.col("text"))
    return t("conversations").withColumn("own", own).where(filters.not_blank(F.col("own"))).select("conv_id", "turn")


@query("SELECT doc_id, NOT (source IN ('node_modules', '.git') OR doc_id % 6 IN (1, 4) OR source = 'src3') AS entered FROM documents")
def dirs_entered(t):
    """Directories that a walk goes into: ignored names and patterns prune it."""
    name = F.expr("CASE doc_id % 6 WHEN 1 THEN 'node_modules' WHEN 4 THEN '__pycache__' WHEN 2 THEN '.config' ELSE 'docs' END")
    return t("documents").select("doc_id", filters.dir_allowed(F.concat_ws("/", "source", name), ["src3/"]).alias("entered"))


@query(
    "SELECT event_id, CASE event_id % 11 WHEN 1 THEN 'oom' WHEN 2 THEN 'oom' WHEN 3 THEN 'segfault' WHEN 4 THEN 'kernel_panic' WHEN 5 THEN 'connection_refused' WHEN 6 THEN 'permission_denied' WHEN 7 THEN 'service_failed' WHEN 8 THEN 'disk_full' WHEN 9 THEN 'disk_full' END AS label FROM events"
)
def critical_defaults(t):
    """The nine messages that are critical by themselves, in any case, within other text."""
    said = F.get(F.array(*[F.lit(x) for x in ["all is well", *[m.upper() if k % 2 else m for k, (m, _) in enumerate(filters.CRITICAL)], "disk is fine"]]), F.expr("cast(event_id % 11 as int)"))
    return t("events").select("event_id", filters.critical_label(F.concat(F.col("event_type"), F.lit(": "), said, F.lit(" at "), F.col("user_id"))).alias("label"))


@query("SELECT CASE WHEN event_id % 4 = 0 THEN 'unknown' ELSE event_type || '.service' END AS unit, CASE WHEN event_id % 5 = 0 THEN '' ELSE 'value ' || user_id END AS message, CASE WHEN event_id % 3 = 0 THEN 6 ELSE (event_id % 8)::INTEGER END AS priority, event_id::VARCHAR AS timestamp FROM events WHERE event_id % 7 > 0")
def journal_entries(t):
    """Journal lines, some without a unit, message or priority; lines that aren't JSON give defaults and are left out here."""
    fields = {
        "_SYSTEMD_UNIT": F.expr("CASE WHEN event_id % 4 > 0 THEN concat(event_type, '.service') END"),
        "MESSAGE": F.expr("CASE WHEN event_id % 5 > 0 THEN concat('value ', user_id) END"),
        "PRIORITY": F.expr("CASE event_id % 3 WHEN 0 THEN CASE WHEN event_id % 2 = 0 THEN 'high' END ELSE cast(event_id % 8 as string) END"),
        "__REALTIME_TIMESTAMP": F.col("event_id").cast("string"),
    }
    lines = t("events").select(F.when(F.col("event_id") % 7 > 0, F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))).otherwise("-- reboot --").alias("value"))
    return system.journal(lines).where("timestamp <> ''")


@query("SELECT (user_id % 65536)::INTEGER AS local_port, (event_id % 65536)::INTEGER AS remote_port, CASE event_id % 3 WHEN 0 THEN 'ESTABLISHED' WHEN 1 THEN 'LISTEN' ELSE 'UNKNOWN' END AS state FROM events WHERE event_id % 5 > 0")
def socket_table(t):
    """Lines of the kernel's socket table, with a header and short lines between."""
    port = lambda x: F.concat(F.lit("0100007F:"), F.lpad(F.hex(F.expr(f"{x} % 65536")), 4, "0"))
    line = F.concat_ws(" ", F.lit("  0:"), port("user_id"), port("event_id"), F.expr("CASE event_id % 3 WHEN 0 THEN '01' WHEN 1 THEN '0A' ELSE 'FF' END"), F.lit("00000000:00000000 00:00000000"))
    header = F.expr("CASE WHEN event_id % 2 = 0 THEN 'sl local_address rem_address st' ELSE 'x 1' END")
    return system.sockets(t("events").select(F.when(F.col("event_id") % 5 > 0, line).otherwise(header).alias("value")))


@query("SELECT user_id AS pid, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN 'c' || event_id ELSE 'unknown' END AS exe, CASE WHEN event_id % 2 = 0 THEN '11' ELSE 'unknown' END AS signal, event_id::VARCHAR AS timestamp FROM events")
def core_dump_rows(t):
    """JSON arrays of dumps; names and signals fall back."""
    one = F.struct(F.col("user_id").alias("pid"), F.expr("CASE WHEN event_id % 3 = 0 THEN event_type END").alias("exe"), F.expr("CASE WHEN event_id % 3 < 2 THEN concat('c', event_id) END").alias("comm"), F.expr("CASE WHEN event_id % 2 = 0 THEN '11' END").alias("sig"), F.col("event_id").cast("string").alias("timestamp"))
    return system.core_dumps(t("events").select(F.to_json(F.array(one)).alias("value")))


@query()
def chunk_by_type(t):
    docs = t("documents").select("doc_id", F.expr(PATH_SQL).alias("path"), "text")
    return chunk.chunk_text(docs, size=128, overlap=16).select("doc_id", "path", "chunk_index", F.md5("chunk_text").alias("chunk_md5"), "token_count")


@query()
def hash_embedding(t):
    e = embed.embed(t("documents").select("doc_id", "text"), "text", embed.HashingEmbedder(16))
    return e.select("doc_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 5)).alias("embedding"))


# Filters
@query(f"WITH {FILES_SQL.replace('STRING', 'VARCHAR')} SELECT doc_id, path FROM files WHERE {KEEP_SQL}")
def filter_files(t):
    return files(t).where(keep()).select("doc_id", "path")


@query("SELECT doc_id, CASE WHEN regexp_matches(p, '(^|/)doc[^/]*2$') THEN FALSE WHEN regexp_matches(p, '(^|/)doc[^/]*[0-4]$') OR starts_with(p, 'src1/') OR regexp_matches(p, '^src2/(.*/)?doc7[^/]$') THEN TRUE ELSE FALSE END AS ignored FROM (SELECT doc_id, source || '/' || lang || '/doc' || doc_id p FROM documents)")
def ignore_patterns(t):
    path = F.concat_ws("/", "source", "lang", F.concat(F.lit("doc"), F.col("doc_id").cast("string")))
    return t("documents").select("doc_id", ignore.ignored(path, ["doc*[0-4]", "/src1/", "src2/**/doc7?", "!doc*2"]).alias("ignored"))


@query(
    "SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)password=') THEN 'secret' WHEN regexp_matches(text, '(?i)idiot|moron') THEN 'insult' WHEN regexp_matches(text, '(?i)license') THEN 'license' END AS label FROM documents"
)
def critical_classify(t):
    return t("documents").select("doc_id", filters.critical_label(F.col("text"), [("password=", "secret"), ("idiot|moron", "insult"), ("license", "license")]).alias("label"))


@query("SELECT event_id, CASE WHEN value >= 90 THEN 'critical' WHEN value >= 80 THEN 'warning' END AS tier FROM events")
def threshold_tiers(t):
    return t("events").select("event_id", filters.tier(F.col("value")).alias("tier"))


@query(
    f"WITH {FILES_SQL.replace('STRING', 'VARCHAR')}, k AS (SELECT * FROM files ORDER BY size_bytes DESC, doc_id LIMIT 100) SELECT doc_id, path FROM k WHERE path LIKE '%.py' OR path LIKE '%.md'"
)
def type_filter(t):
    top = files(t).orderBy(F.desc("size_bytes"), "doc_id").limit(100)
    return top.where(filters.of_types(F.col("path"), "py, .md")).select("doc_id", "path")


@query("SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'e') AND list_contains(string_split(p_type, ' '), string_split((SELECT min(p_type) FROM part), ' ')[1])")
def tool_search(t):
    tools = t("part").select("p_partkey", F.col("p_name").alias("name"), F.split("p_type", " ").alias("capabilities"))
    first = t("part").agg(F.min("p_type")).first()[0].split(" ")[0]
    return filters.find_tools(tools, capability=first, name="e").select("p_partkey", F.col("name").alias("p_name"))


# Index
NOW_SQL = "SELECT doc_id, 'doc' || doc_id path, n_chars + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END size_bytes, doc_id * 10 + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END mtime_ns, CASE WHEN doc_id % 10 = 0 THEN 'new' ELSE md5(text) END content_hash FROM documents WHERE doc_id % 4 > 0"
OLD_SQL = "SELECT 'doc' || doc_id path, n_chars size_bytes, doc_id * 10 mtime_ns, md5(text) content_hash FROM documents WHERE doc_id % 3 > 0"


def _now(t):
    h = F.expr("CASE WHEN doc_id % 10 = 0 THEN 'new' ELSE md5(text) END").alias("content_hash")
    return t("documents").where("doc_id % 4 > 0").select(F.expr("concat('doc', doc_id) path"), F.expr("n_chars + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END size_bytes"), F.expr("doc_id * 10 + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END mtime_ns"), h)


def _old(t):
    return t("documents").where("doc_id % 3 > 0").select(F.expr("concat('doc', doc_id) path"), F.col("n_chars").alias("size_bytes"), F.expr("doc_id * 10 mtime_ns"), F.md5("text").alias("content_hash"))


@query(f"WITH n AS ({NOW_SQL}), o AS ({OLD_SQL}) SELECT n.path FROM n LEFT JOIN o ON n.path = o.path WHERE o.path IS NULL OR ((n.size_bytes <> o.size_bytes OR n.mtime_ns <> o.mtime_ns) AND n.content_hash <> o.content_hash)")
def change_detect(t):
    return index.needs_indexing(_now(t), _old(t)).select("path")


@query(f"WITH n AS ({NOW_SQL}), o AS ({OLD_SQL}) SELECT n.path FROM n JOIN o ON n.path = o.path WHERE n.size_bytes <> o.size_bytes OR n.mtime_ns <> o.mtime_ns")
def stat_mismatch(t):
    return index.to_hash(_now(t), _old(t))


@query(f"WITH n AS ({NOW_SQL}), o AS ({OLD_SQL}) SELECT path FROM o WHERE path NOT IN (SELECT path FROM n)")
def orphans(t):
    return index.orphans(_old(t), _now(t))


@query(f"WITH n AS ({NOW_SQL}), o AS ({OLD_SQL}) SELECT path, content_hash FROM o WHERE path NOT IN (SELECT path FROM n) UNION ALL SELECT path, content_hash FROM n")
def upsert_replace(t):
    return index.upsert(_old(t), _now(t)).select("path", "content_hash")


@query(
    f"WITH n AS ({NOW_SQL}), o AS ({OLD_SQL}), u AS (SELECT path, content_hash, size_bytes FROM o WHERE path NOT IN (SELECT path FROM n) UNION ALL SELECT path, content_hash, size_bytes FROM n) "
    "SELECT * FROM u WHERE path NOT IN (SELECT 'doc' || doc_id FROM documents WHERE doc_id % 6 = 1)"
)
def log_index(t):
    """An index written, added to, removed from, compacted, added to again and read."""
    spark = t("documents").sparkSession
    at = LogIndex(spark, shared_folder(spark, "log-index"), buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))
    at.upsert(_old(t).select("path", "content_hash", "size_bytes"))
    at.upsert(_now(t).select("path", "content_hash", "size_bytes").where("pmod(hash(path), 2) = 0"))
    at.compact()
    at.upsert(_now(t).select("path", "content_hash", "size_bytes").where("pmod(hash(path), 2) = 1"))
    at.remove(t("documents").where("doc_id % 6 = 1").select(F.expr("concat('doc', doc_id) path")))
    return at.read()


@query(f"WITH n AS ({NOW_SQL} AND doc_id % 2 = 0), o AS ({OLD_SQL}) SELECT path, size_bytes FROM o WHERE path NOT IN (SELECT path FROM n)")
def remove_files(t):
    return index.remove(_old(t), _now(t).where("cast(substring(path, 4) as long) % 2 = 0")).select("path", "size_bytes")


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS content_hash, count(*) AS copies FROM documents GROUP BY text")
def dedup_content(t):
    return index.dedup_content(t("documents"))


@query("WITH w AS (SELECT conv_id * 1000 + turn chunk_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') w FROM conversations), p AS (SELECT chunk_id, len(w)::INTEGER n_tokens, unnest(w) term, (generate_subscripts(w, 1) - 1)::INTEGER i FROM w) SELECT term, chunk_id, array_to_string(list(i ORDER BY i), ',') AS positions, max(n_tokens) AS n_tokens FROM p GROUP BY term, chunk_id")
def postings(t):
    c = t("conversations").select(F.expr("conv_id * 1000 + turn").alias("chunk_id"), F.col("text").alias("chunk_text"))
    return index.postings(c).withColumn("positions", F.array_join("positions", ","))


@query("SELECT user_id, event_type AS key, max_by(value, event_id) AS value, max(event_id) AS updated_at FROM events GROUP BY ALL")
def latest_by_key(t):
    writes = t("events").select("user_id", F.col("event_type").alias("key"), "value", F.col("event_id").alias("updated_at"))
    return index.latest_by_key(writes, "user_id", "key")


@query()
def embed_batches(t):
    f = t("documents").select(F.expr(PATH_SQL).alias("path"), F.expr("cast(n_chars div 2000 + 1 as long)").alias("chunk_count"))
    return index.batches(f, per_bucket=100)


# Statistics
@query(f"WITH {FILES_SQL.replace('STRING', 'VARCHAR')} SELECT (SELECT count(*) FROM files) AS files, (SELECT sum(size_bytes)::BIGINT FROM files) AS bytes, (SELECT count(*) FROM conversations) AS chunks")
def stats_total(t):
    return stats.totals(files(t), t("conversations")).drop("size_mb")


@query(f"WITH {FILES_SQL.replace('STRING', 'VARCHAR')} SELECT extension, count(*) AS files FROM (SELECT CASE WHEN contains(path, '.') THEN lower(string_split(path, '.')[-1]) ELSE '' END extension FROM files) WHERE extension <> '' GROUP BY 1")
def stats_by_type(t):
    return stats.by_type(files(t).withColumn("extension", scalar.extension("path")))


@query(f"WITH {FILES_SQL.replace('STRING', 'VARCHAR')} SELECT split_part(path, '/', 1) AS dir, count(*) AS files, sum(size_bytes)::BIGINT AS bytes, count(*) FILTER ({KEEP_SQL}) AS indexable FROM files GROUP BY 1")
def dir_stats(t):
    return stats.by_top_dir(files(t), keep())


@query(f"WITH {FILES_SQL.replace('STRING', 'VARCHAR')}, k AS (SELECT count(*) AS files, sum(size_bytes)::BIGINT AS bytes, count(*) FILTER ({KEEP_SQL}) AS kept_files, sum(CASE WHEN {KEEP_SQL} THEN size_bytes ELSE 0 END)::BIGINT AS kept_bytes, sum(CASE WHEN {KEEP_SQL} THEN 0 ELSE size_bytes END)::BIGINT AS ignored_bytes FROM files) SELECT *, round(kept_bytes / bytes * 100, 6) AS kept_pct, kept_bytes * 7 AS index_bytes FROM k")
def kept_share(t):
    return stats.kept_share(files(t), keep()).withColumn("kept_pct", F.round("kept_pct", 6))


@query(f"WITH {FILES_SQL.replace('STRING', 'VARCHAR')} SELECT lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS extension, sum(size_bytes)::BIGINT AS bytes FROM files WHERE {KEEP_SQL} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def top5_ext(t):
    return stats.top_extensions(files(t).withColumn("extension", scalar.suffix("path")), keep())


STATE = "CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'degraded' ELSE 'running' END"


@query(f"SELECT user_id, count(*) AS agents, count(*) FILTER (s = 'running') AS running, count(*) FILTER (s = 'failed') AS failed, count(*) FILTER (s = 'degraded') AS degraded, sum(event_id)::BIGINT AS cycles, CASE WHEN count(*) FILTER (s <> 'running') > 0 THEN 'degraded' ELSE 'healthy' END AS status FROM (SELECT *, {STATE} s FROM events) GROUP BY user_id")
def fleet_health(t):
    return stats.fleet_health(t("events").withColumns({"state": F.expr(STATE), "cycles": F.col("event_id")}), ["user_id"])


@query("SELECT user_id, CASE WHEN bool_or(value > 450) THEN 'healthy' ELSE 'degraded' END AS status FROM events GROUP BY 1")
def provider_health(t):
    return stats.provider_health(t("events").withColumn("healthy", F.col("value") > 450), ["user_id"])


@query("SELECT user_id, count(*) FILTER (event_type <> 'error') AS cycles, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'error') / greatest(count(*) FILTER (event_type <> 'error'), 1) AS error_rate, count(*) FILTER (event_type = 'error') / greatest(count(*) FILTER (event_type <> 'error'), 1) > 0.5 AS unhealthy FROM events GROUP BY 1")
def error_rate(t):
    return stats.error_rate(t("events").withColumn("ok", F.col("event_type") != "error"), ["user_id"])


@query("SELECT event_type, count(*) AS total, count(*) FILTER (s = 1) AS established, count(*) FILTER (s = 0) AS listening, count(*) FILTER (s = 2) AS time_wait, array_to_string(list_sort(list(DISTINCT user_id) FILTER (s = 0)), ',') AS listening_ports FROM (SELECT *, event_id % 4 s FROM events) GROUP BY 1")
def connection_counts(t):
    rows = t("events").select("event_type", F.expr("CASE event_id % 4 WHEN 0 THEN 'LISTEN' WHEN 1 THEN 'ESTABLISHED' WHEN 2 THEN 'TIME_WAIT' ELSE 'CLOSE' END").alias("state"), F.col("user_id").alias("port"))
    return stats.connections(rows, ["event_type"]).withColumn("listening_ports", F.array_join("listening_ports", ","))


@query("SELECT user_id, count(*) AS entries, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS units FROM events GROUP BY 1")
def units_seen(t):
    return stats.units_seen(t("events"), ["user_id"], "event_type").withColumn("units", F.array_join("units", ","))


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text, count(*)::INTEGER AS n_tokens FROM (SELECT *, min(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) stop FROM conversations) WHERE stop IS NULL OR turn < stop GROUP BY 1 UNION ALL SELECT conv_id, '', 0 FROM conversations GROUP BY 1 HAVING min(turn) = min(CASE WHEN role = 'assistant' THEN turn END)")
def collect_stream(t):
    return stats.join_tokens(t("conversations").withColumn("token", F.col("text")), ["conv_id"], "turn", done=F.col("role") == "assistant")


@query("SELECT conv_id, turn, md5(text) AS token_md5, place::INTEGER AS place, place = 3 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) place FROM conversations) WHERE place <= 3")
def limit_stream(t):
    return stats.limit_tokens(t("conversations"), ["conv_id"], "turn", 3).select("conv_id", "turn", F.md5("text").alias("token_md5"), "place", "truncated")


@query("SELECT user_id, count(*) AS requests, count(*) FILTER (value < 50) AS in_flight FROM events GROUP BY 1")
def request_counts(t):
    return stats.requests_by(t("events").withColumn("ended_at", F.when(F.col("value") >= 50, F.col("ts"))), ["user_id"])


@query("SELECT p_brand AS provider, unnest(string_split(p_name, ' ')) AS model FROM part WHERE p_size > 25")
def flatten_models(t):
    return stats.flatten_models(t("part").select(F.col("p_brand").alias("name"), F.expr("p_size > 25").alias("enabled"), F.split("p_name", " ").alias("models")))


# Detectors
def _ewma_sql(alpha: float) -> str:
    return f"SELECT event_type, count(*) AS n, round(list_reduce(list(value::DOUBLE ORDER BY ts, event_id), lambda a, x: CASE WHEN a = 0 THEN x ELSE {alpha}::DOUBLE * x + {1 - alpha}::DOUBLE * a END), 9) AS ewma FROM events GROUP BY 1"


@query(_ewma_sql(0.1))
def ewma_01(t):
    return detect.ewma(t("events"), "value", 0.1, ["event_type"], ["ts", "event_id"]).withColumn("ewma", F.round("ewma", 9))


@query(_ewma_sql(0.2))
def ewma_02(t):
    return detect.ewma(t("events"), "value", 0.2, ["event_type"], ["ts", "event_id"]).withColumn("ewma", F.round("ewma", 9))


RATE_SQL = (
    "a AS (SELECT event_id, user_id, event_type, epoch_us(ts) us FROM events), "
    "n AS (SELECT *, count(*) OVER w c, min(us) OVER w f FROM a WINDOW w AS (PARTITION BY event_type ORDER BY us RANGE BETWEEN {0} PRECEDING AND CURRENT ROW)), "
    "r AS (SELECT event_id, event_type, us, CASE WHEN c < 2 OR us = f THEN 0.0 ELSE c / ((us - f) / 60e6) END rate FROM n)"
)


@query(f"WITH {RATE_SQL.format(86400 * 10**6 - 1)} SELECT event_id, event_type, round(rate, 9) AS rate FROM r")
def rate_per_min(t):
    return detect.rate_per_minute(t("events"), "ts", ["event_type"], seconds=86400, most=100000).select("event_id", "event_type", F.round("rate", 9).alias("rate"))


@query(
    "WITH a AS (SELECT event_id, user_id, epoch_us(ts) us FROM events), n AS (SELECT *, count(*) OVER w c, min(us) OVER w f, min(us) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) g FROM a WINDOW w AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN 431999999999 PRECEDING AND CURRENT ROW)) "
    "SELECT event_id, round(CASE WHEN least(c, 10) < 2 OR us = greatest(f, g) THEN 0.0 ELSE least(c, 10) / ((us - greatest(f, g)) / 60e6) END, 9) AS rate FROM n"
)
def rate_of_newest(t):
    """The rule of the newest rows: ten here, which windows of five days exceed."""
    return detect.rate_per_minute(t("events"), "ts", ["user_id"], seconds=5 * 86400, most=10).select("event_id", F.round("rate", 9).alias("rate"))


def _daily(t) -> DataFrame:
    return t("events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").cast("double").alias("n"))


BASE_SQL = (
    "WITH RECURSIVE d AS (SELECT event_type, ts::DATE AS d, count(*)::DOUBLE n, row_number() OVER (PARTITION BY event_type ORDER BY ts::DATE) i FROM events GROUP BY 1, 2), "
    "b AS (SELECT event_type, d, n, i, 0.0::DOUBLE before, n after FROM d WHERE i = 1 UNION ALL SELECT d.event_type, d.d, d.n, d.i, b.after, CASE WHEN b.after = 0 THEN d.n ELSE 0.1::DOUBLE * d.n + 0.9::DOUBLE * b.after END FROM b JOIN d ON d.event_type = b.event_type AND d.i = b.i + 1) "
)


@query(BASE_SQL + "SELECT event_type, d::VARCHAR AS day, n, round(before, 9) AS before, round(after, 9) AS after FROM b")
def baseline_series(t):
    return detect.baselines(_daily(t), "n", 0.1, ["event_type"], ["day"]).withColumns({"day": F.col("day").cast("string"), "before": F.round("before", 9), "after": F.round("after", 9)})


@query(BASE_SQL + "SELECT event_type, d::VARCHAR AS day, n, round(before, 9) AS before, round(n / before, 9) AS multiplier FROM b WHERE before > 0 AND n > before * 1.1")
def rate_spike(t):
    found = detect.spikes(_daily(t), "n", ["event_type"], ["day"], 1.1)
    return found.withColumns({"day": F.col("day").cast("string"), "before": F.round("before", 9), "multiplier": F.round("multiplier", 9)})


@query(
    "WITH d AS (SELECT user_id % 5 host, ts::DATE::VARCHAR AS day, list_sort(list(DISTINCT user_id)) m FROM events GROUP BY 1, 2), p AS (SELECT *, lag(m) OVER (PARTITION BY host ORDER BY day) b FROM d) "
    "SELECT host, day, CASE WHEN b IS NULL THEN '' ELSE array_to_string(list_filter(m, lambda x: NOT list_contains(b, x) AND x NOT IN (22, 53, 80, 443, 631, 5353, 8080)), ',') END AS added FROM p"
)
def new_members(t):
    d = t("events").groupBy(F.expr("user_id % 5").alias("host"), F.to_date("ts").alias("day")).agg(F.collect_set("user_id").alias("m"))
    return detect.new_members(d, "m", ["host"], "day", detect.EXPECTED_PORTS).select("host", F.col("day").cast("string").alias("day"), F.array_join("added", ",").alias("added"))


@query(
    "WITH d AS (SELECT event_type, ts::DATE::VARCHAR AS day, sum(value) v, epoch_us(ts::DATE::TIMESTAMP) / 1e6 s FROM events GROUP BY 1, 2, 4), "
    "w AS (SELECT *, v - first_value(v) OVER k dv, s - first_value(s) OVER k dt, row_number() OVER (PARTITION BY event_type ORDER BY s) n FROM d WINDOW k AS (PARTITION BY event_type ORDER BY s ROWS 29 PRECEDING)) "
    "SELECT event_type, day, round(CASE WHEN n < 10 OR dt = 0 OR dv / dt <= 0 THEN NULL WHEN 20000 - v <= 0 THEN 0 ELSE (20000 - v) / (dv / dt) END, 2) AS eta FROM w"
)
def trend_predict(t):
    d = t("events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))
    return detect.time_to_threshold(d, "v", "day", ["event_type"], 20000.0).select("event_type", F.col("day").cast("string").alias("day"), F.round("eta", 2).alias("eta"))


@query(
    "WITH r AS (SELECT *, sum(CASE WHEN value > 150 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) g FROM events), s AS (SELECT event_id, user_id, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id, g)) / 1e6 AS sustained_sec FROM r WHERE value > 150) SELECT * FROM s WHERE sustained_sec > 3600"
)
def sustained_high(t):
    return detect.sustained(t("events"), "value", "ts", ["user_id"], ["ts", "event_id"], 150, 3600).select("event_id", "user_id", "sustained_sec")


@query(
    f"WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) i FROM events WHERE event_type = 'error'), "
    "r AS (SELECT user_id, event_id, i, [us] held, TRUE allowed FROM e WHERE i = 1 UNION ALL SELECT user_id, event_id, i, CASE WHEN len(h) < 2 THEN list_append(h, us) ELSE h END, len(h) < 2 FROM "
    f"(SELECT e.*, list_filter(r.held, lambda t: e.us - t <= {86400 * 5 * 10**6}) h FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)) SELECT user_id, event_id, allowed FROM r"
)
def restart_limiter(t):
    return detect.restart_limiter(t("events").where("event_type = 'error'"), "ts", ["user_id"], "event_id", most=2, seconds=86400 * 5)


@query("SELECT event_id, event_type FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 200) WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_id % 3 = 0)")
def last_n_unseen(t):
    return detect.last_unseen(t("events"), t("events").where("event_id % 3 = 0"), "event_id", 200, F.desc("ts"), F.desc("event_id")).select("event_id", "event_type")


@query(
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END s FROM events), i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) k FROM g) "
    "SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 21600000000 AS end_us, count(*) AS n FROM i GROUP BY user_id, k"
)
def debounce_sessions(t):
    return detect.sessions(t("events"), "ts", ["user_id"], "6 hours").select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query(
    "WITH a AS (SELECT o_custkey k, bool_or(o_orderstatus = 'O') running, bool_or(o_totalprice > 200000) healthy FROM orders WHERE o_custkey % 5 > 0 GROUP BY 1), d AS (SELECT c_custkey k FROM customer WHERE c_acctbal > 0) "
    "SELECT coalesce(d.k, a.k) AS k, CASE WHEN d.k IS NULL THEN 'stop' WHEN a.k IS NULL THEN 'start' WHEN NOT running THEN 'restart' WHEN NOT healthy THEN 'degraded' ELSE 'none' END AS action FROM d FULL JOIN a ON d.k = a.k"
)
def reconcile_actions(t):
    actual = t("orders").where("o_custkey % 5 > 0").groupBy(F.col("o_custkey").alias("k")).agg(F.bool_or(F.col("o_orderstatus") == "O").alias("running"), F.bool_or(F.col("o_totalprice") > 200000).alias("healthy"))
    return detect.reconcile(t("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k")), actual, "k")


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 'restart' WHEN 'view' THEN 'start' END AS action FROM events")
def service_actions(t):
    state = F.expr("CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'inactive' ELSE 'active' END")
    return t("events").select("event_id", detect.service_action(state).alias("action"))


@query("SELECT s_name, row_number() OVER (ORDER BY s_suppkey DESC)::INTEGER AS stop_place, row_number() OVER (ORDER BY s_suppkey)::INTEGER AS start_place FROM supplier WHERE s_suppkey >= 5")
def rest_for_one(t):
    s = t("supplier").select("s_name", F.col("s_suppkey").alias("start_order"))
    failed = s.where("start_order = 5").first().s_name
    return detect.after(s, failed, "s_name").select("s_name", "stop_place", "start_place")


@query("SELECT event_id, 'alert' AS tool, 'memory_critical' AS action, value::VARCHAR AS value FROM events WHERE value >= 400")
def alert_rows(t):
    a = detect.alert("alert", F.lit("memory_critical"), F.concat(F.lit("Critical: value at "), F.format_string("%.0f", "value")), value=F.col("value"))
    rows = t("events").where("value >= 400").select("event_id", a.alias("a"))
    return rows.select("event_id", "a.tool", "a.action", F.col("a.params")["value"].alias("value"))


# Capacity
@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 2400 WHEN 1 THEN 4800 WHEN 2 THEN 2200 WHEN 3 THEN 300 ELSE 2000 END AS mb FROM part")
def vram_estimate(t):
    m = F.expr("CASE p_partkey % 5 WHEN 0 THEN 'phi3:mini' WHEN 1 THEN 'qwen2:7b' WHEN 2 THEN 'llama3.2:70b' WHEN 3 THEN 'nomic-embed-text:latest' ELSE p_name END")
    return t("part").select("p_partkey", capacity.estimate_mb(m).alias("mb"))


SLOTS = "SELECT p_partkey model_id, p_brand host, p_size vram_mb, TIMESTAMP '2024-01-01' + to_seconds(p_partkey * 37 % 86400) last_used FROM part"


def _slots(t) -> DataFrame:
    return t("part").select(F.col("p_partkey").alias("model_id"), F.col("p_brand").alias("host"), F.col("p_size").cast("long").alias("vram_mb"), F.expr("timestamp'2024-01-01' + make_dt_interval(0, 0, 0, p_partkey * 37 % 86400)").alias("last_used"))


@query(f"SELECT host, model_id FROM (SELECT *, coalesce(sum(vram_mb) OVER (PARTITION BY host ORDER BY last_used, model_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) b FROM ({SLOTS})) WHERE b < 100")
def lru_evict(t):
    return capacity.to_evict(_slots(t), 100, ["host"]).select("host", "model_id")


@query(f"SELECT model_id, epoch_us(TIMESTAMP '2024-01-01 12:00:00') / 1e6 - epoch_us(last_used) / 1e6 AS idle_sec FROM ({SLOTS}) WHERE last_used < TIMESTAMP '2024-01-01 11:55:00'")
def idle_models(t):
    return capacity.idle(_slots(t), F.lit("2024-01-01 12:00:00").cast("timestamp")).select("model_id", "idle_sec")


@query(
    f"WITH s AS ({SLOTS}), h AS (SELECT host, 1000::BIGINT total_mb, (host_n * 20 % 1000)::BIGINT used_mb FROM (SELECT host, count(*) host_n FROM s GROUP BY 1)), w AS (SELECT *, CASE WHEN used_mb + 300 <= total_mb * 90 / 100.0 THEN 0 ELSE used_mb + 300 - floor(total_mb * 90 / 100.0)::BIGINT END shortfall FROM h), "
    "r AS (SELECT *, coalesce(sum(vram_mb) OVER (PARTITION BY host ORDER BY last_used, model_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) b FROM s), "
    "f AS (SELECT w.host, used_mb, shortfall, coalesce(sum(vram_mb) FILTER (b < shortfall), 0)::BIGINT can_free FROM w JOIN r ON w.host = r.host GROUP BY ALL) SELECT *, CASE WHEN shortfall <= 0 THEN 'fits' WHEN can_free < shortfall THEN 'insufficient' ELSE 'evict' END AS outcome FROM f"
)
def capacity_plan(t):
    s = _slots(t)
    hosts = s.groupBy("host").agg(F.count("*").alias("n")).select("host", F.lit(1000).cast("long").alias("total_mb"), F.expr("n * 20 % 1000").alias("used_mb"))
    return capacity.plan(hosts, s, F.lit(300)).select("host", "used_mb", "shortfall", "can_free", "outcome")


@query(
    "WITH r AS (SELECT user_id::VARCHAR m, CASE WHEN user_id % 2 = 0 THEN 'local' ELSE 'openai' END provider, CASE WHEN event_type IN ('click', 'view') THEN 'embed' ELSE 'chat' END method, event_id FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY event_id) k FROM r) "
    "SELECT m AS model_id, provider, min(event_id) AS loaded_at, max(event_id) AS last_used, sum(CASE WHEN k = 1 THEN 0 WHEN method = 'embed' THEN 2 ELSE 1 END + CASE WHEN k > 1 AND provider = 'local' THEN 1 ELSE 0 END)::BIGINT AS request_count, count(*) AS requests FROM n GROUP BY 1, 2"
)
def slot_usage(t):
    r = t("events").select(F.col("user_id").cast("string").alias("model_id"), F.expr("CASE WHEN user_id % 2 = 0 THEN 'local' ELSE 'openai' END").alias("provider"), F.expr("CASE WHEN event_type IN ('click', 'view') THEN 'embed' ELSE 'chat' END").alias("method"), F.col("event_id").alias("ts"))
    return capacity.slots_of(r)


@query("SELECT user_id % 10 AS host, sum(vram)::BIGINT AS total_vram_used_mb FROM (SELECT user_id, max(event_id) % 1000 vram FROM events GROUP BY 1) GROUP BY 1")
def vram_used(t):
    s = t("events").groupBy("user_id").agg(F.expr("max(event_id) % 1000").alias("vram"))
    return s.groupBy(F.expr("user_id % 10").alias("host")).agg(F.sum("vram").alias("total_vram_used_mb"))
