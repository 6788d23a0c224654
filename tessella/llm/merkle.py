"""Merkle manifests of a dataset: a digest for each row, each group and the whole, and a proof for each row.

A row's leaf is the hash of its columns. Within a group (a source) leaves stand in order, and as long as there are several
nodes every three neighbours become one; what remains is the group's subroot, and the subroots, in order of their groups,
become the root in the same way.

Nodes get their place by a range partitioning whose partitions are counted, so no task sees a whole group. Aligned blocks
of `ARITY ** HEIGHT` nodes are then traversed in postorder, a block in one task: each call returns its subtree's digest, and
while the recursion unwinds it appends the siblings to all leaves that the subtree holds. Block roots are the nodes of
the next traversal, of a table that is smaller by that factor, until each group has one node; subroots go the same way. Going
down again, a node's siblings are joined to those of the nodes in its block, at most `ARITY ** HEIGHT` rows a key, so that a
group that holds a third of all rows is spread like any other.

Defined results: nulls hash as `-`, so a null differs from an empty text; a null group comes first; rows without a doc_id
stand before the others of their group, rows with equal doc_ids in the order of their leaves, repeated rows one by one, each with
its own proof; a group of one row has its leaf as subroot; a single group's subroot is the root; an empty table gives an empty
result. Only the hashed columns are read, whatever else there is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tessella.llm.common import Scratch, partitions, table
from tessella.llm.sharding import crc32_sql

#: Nodes that become one, and levels that one traversal of a block goes up.
ARITY, HEIGHT = 3, 6
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def _part(c: Column) -> Column:
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(*columns: Column) -> Column:
    """The digest (32 bytes) of a row's columns: `-` for null, else byte count, colon, value."""
    return F.unhex(F.sha2(F.concat(*[_part(c) for c in columns]).cast("binary"), 256))


def combine(nodes: list[bytes]) -> bytes:
    """The digest of neighbours, which enter as hex text."""
    return hashlib.sha256("".join([n.hex() for n in nodes]).encode()).digest()


def levels(n: int, arity: int = ARITY) -> int:
    """How often n nodes are combined until one remains."""
    k = 0
    while n > 1:
        n, k = -(-n // arity), k + 1
    return k


def traverse(nodes: list[bytes], up: int, arity: int = ARITY) -> tuple[bytes, list[list[bytes]]]:
    """The digest of one aligned block after `up` levels, and the proof steps of each node in it: a byte with its place in the run, then its siblings."""
    steps: list[list[bytes]] = [[] for _ in nodes]

    def visit(low: int, level: int) -> bytes:
        if level == 0:
            return nodes[low]
        width = arity ** (level - 1)
        starts = [at for at in range(low, low + arity * width, width) if at < len(nodes)]
        children = [visit(at, level - 1) for at in starts]
        for k, at in enumerate(starts):
            step = bytes([k]) + b"".join(children[:k] + children[k + 1 :])
            for own in steps[at : at + width]:
                own.append(step)
        return combine(children)

    return visit(0, up), steps


def fold(digest: bytes, steps: list[bytes]) -> bytes:
    """The root that a leaf's digest and its proof steps give."""
    for s in steps:
        run = [s[i : i + 32] for i in range(1, len(s), 32)]
        run.insert(s[0], digest)
        digest = combine(run)
    return digest


def proof_digest(steps: list[bytes]) -> str:
    """The hash of all siblings of a proof, level by level, left to right."""
    return hashlib.sha256("".join([s[1:].hex() for s in steps]).encode()).hexdigest()


def placed(nodes: DataFrame, group: str, order: list[str], work: Scratch) -> DataFrame:
    """nodes with `pos`, the place of each within its group from 0, and `n`, the group's size. `order` must tell all rows of a group apart."""
    n = partitions(nodes.sparkSession)
    dealt = work.save(nodes.repartitionByRange(n, group, *order).withColumn("part", F.spark_partition_id()))
    # a row for each group and partition that it reaches into
    counts = dealt.groupBy("part", group).agg(F.count("*").alias("own"))
    before = W.partitionBy(group).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(F.col("part").alias("of"), F.col(group).alias("of_group"), F.coalesce(F.sum("own").over(before), F.lit(0)).alias("skip"), F.sum("own").over(W.partitionBy(group)).alias("n"))
    counts = work.save(counts)
    ranked = dealt.withColumn("at", F.row_number().over(W.partitionBy("part", group).orderBy(*order)))
    both = ranked.join(counts, (F.col("part") == F.col("of")) & F.col(group).eqNullSafe(F.col("of_group")))
    return both.withColumn("pos", F.col("skip") + F.col("at") - 1).drop("part", "of", "of_group", "skip", "at")


def _climb(nodes: DataFrame, height: int, work: Scratch) -> DataFrame:
    """One traversal: nodes (g, pos, n, digest) with `block`, `root` (the block's digest, on its first node only) and `steps` within the block, saved."""
    size = ARITY**height
    block = F.expr(f"pos div {size}").alias("block")
    dealt = nodes.select("g", "pos", "n", "digest", block).repartition(partitions(nodes.sparkSession), "g", "block").sortWithinPartitions("g", "pos")
    schema = dealt.select("g", "pos", "n", "block").schema.add("root", "binary").add("steps", T.ArrayType(T.BinaryType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            root, steps = traverse([r[3] for r in held], min(height, levels(held[0][2])))
            g, pos, n, _, own = zip(*held, strict=True)
            columns = [*map(pa.array, (g, pos, n, own)), pa.array([root, *[None] * (len(held) - 1)], pa.binary()), pa.array(steps, pa.list_(pa.binary()))]
            return pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, kinds, strict=True)], names=schema.names)

        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary())]
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (r[0], r[4]) != (held[0][0], held[0][4]):
                    yield out()
                    held = []
                held.append(r)
        if held:
            yield out()

    return work.save(dealt.mapInArrow(run, schema))


def _roots(done: DataFrame, height: int) -> DataFrame:
    """The nodes of the next traversal."""
    return done.where("root is not null").select("g", F.col("block").alias("pos"), F.expr(f"(n + {ARITY**height - 1}) div {ARITY**height}").alias("n"), F.col("root").alias("digest"))


def _trees(nodes: DataFrame, height: int, work: Scratch) -> tuple[DataFrame, list[DataFrame]]:
    """The roots (g, digest) of all groups of nodes (g, pos, n, digest), and the tables of the traversals from leaves up."""
    done = []
    while True:
        done.append(_climb(nodes, height, work))
        nodes = _roots(done[-1], height)
        # one number
        if (done[-1].agg(F.max("block")).first()[0] or 0) == 0:
            return nodes.select("g", "digest"), done


def _down(tables: list[DataFrame], above: DataFrame, carry: list[str], work: Scratch) -> DataFrame:
    """(g, pos, steps, carry) of the lowest table's nodes, steps going on with those of `above` (g, steps, carry)."""
    top = above.select("g", F.lit(0).cast("long").alias("pos"), "steps", *carry)
    for t in reversed(tables):
        over = top.select(F.col("g").alias("g_"), F.col("pos").alias("pos_"), F.col("steps").alias("more"), *carry)
        top = t.join(over, (F.col("g") == F.col("g_")) & (F.col("block") == F.col("pos_"))).select("g", "pos", F.concat("steps", "more").alias("steps"), *carry)
    return top


def manifest(rows: DataFrame, group: str, order: list[str], digest: str = "leaf", height: int = HEIGHT) -> tuple[DataFrame, bytes | None]:
    """rows with `steps` (their proof) and `subroot` (their group's digest), and the root of all; None for no rows.

    `order` must tell all rows of a group apart, and rows must be a saved table."""
    spark, work = rows.sparkSession, Scratch(rows.sparkSession, "merkle")
    # groups get their place first, which is then their number
    groups = placed(rows.select(F.col(group).alias("name")).distinct().withColumn("all", F.lit(0)), "all", ["name"], work)
    groups = work.save(groups.select("name", F.col("pos").alias("g"), F.col("n").alias("groups")))
    at = placed(rows, group, order, work)
    # a table of its own, so that the join can split a group with very many rows
    nodes = work.save(at.join(groups, F.col(group).eqNullSafe(F.col("name"))).drop("name", "groups"))
    roots, below = _trees(nodes.withColumn("digest", F.col(digest)), height, work)
    subroots = work.save(roots.join(groups, "g").select(F.lit(0).cast("long").alias("g"), F.col("g").alias("pos"), F.col("groups").alias("n"), "digest"))
    root, above = _trees(subroots, height, work)
    whole = root.first()
    over = spark.range(1).select(F.col("id").alias("g"), F.array().cast("array<binary>").alias("steps"))
    paths = _down(above, over, [], work).withColumnRenamed("pos", "at")
    paths = paths.join(subroots.select(F.col("pos").alias("at"), F.col("digest").alias("subroot")), "at").select(F.col("at").alias("g"), "steps", "subroot")
    proofs = _down(below, paths, ["subroot"], work).select(F.col("g").alias("g_"), F.col("pos").alias("pos_"), "steps", "subroot")
    done = nodes.join(proofs, (F.col("g") == F.col("g_")) & (F.col("pos") == F.col("pos_"))).drop("g", "pos", "n", "g_", "pos_")
    return done, whole.digest if whole else None


def verified(proofs: DataFrame, leaf_: str, root: bytes | None, keep: list[str]) -> DataFrame:
    """keep, `proof_sha256`, and `folded_root`: what the leaf in column `leaf_` and the row's steps give; `verified` where it is the root."""
    source = proofs.select(*keep, F.col(leaf_).alias("leaf__"), F.col("steps").alias("steps__"))
    schema = proofs.select(*keep).schema.add("proof_sha256", "string").add("folded_root", "string").add("verified", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, steps = (batch.column(batch.num_columns - k).to_pylist() for k in (2, 1))
            folded = [fold(d, s) for d, s in zip(digests, steps, strict=True)]
            columns = [pa.array([proof_digest(s) for s in steps], pa.string()), pa.array([d.hex() for d in folded], pa.string()), pa.array([d == root for d in folded], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *columns], names=schema.names)

    return source.mapInArrow(run, schema)


def leaves(df: DataFrame, work: Scratch) -> DataFrame:
    """doc_id, source, leaf, leaf after tampering (texts lose line feeds where 2 divides the CRC-32 of doc_id), and a number that tells rows apart."""
    text = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    own = [F.col(c) for c in COLUMNS]
    return work.save(df.select("doc_id", "source", leaf(*own).alias("leaf"), leaf(*own[:-1], text).alias("tampered"), F.monotonically_increasing_id().alias("u")))


def document_proofs(df: DataFrame, height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each document, after tampering."""
    rows = leaves(df, Scratch(df.sparkSession, "merkle"))
    proofs, root = manifest(rows, "source", ["doc_id", "leaf", "u"], height=height)
    named = proofs.select("doc_id", F.lower(F.hex("leaf")).alias("leaf"), F.lower(F.hex("subroot")).alias("subroot"), F.lit(root.hex() if root else None).cast("string").alias("root"), "tampered", "steps")
    return verified(named, "tampered", root, ["doc_id", "leaf", "subroot", "root"])


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_proofs(table(spark, sf_dir, "documents"))


def op11_sql() -> str:
    part = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    leaf_of = lambda text: f"sha256({' || '.join([*map(part, COLUMNS[:-1]), part(text)])})"
    crc = crc32_sql("encode(doc_id::VARCHAR)")
    return (
        f"WITH RECURSIVE d AS (SELECT row_number() OVER () u, doc_id, source, {leaf_of('text')} leaf, {leaf_of(f'''(CASE WHEN doc_id IS NOT NULL AND ({crc}) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END)''')} bad FROM documents), "
        "l AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, u) - 1 pos, count(*) OVER (PARTITION BY source) n FROM d), "
        "a(k, g, pos, n, h) AS (SELECT 0, g, pos, n, leaf FROM l UNION ALL SELECT k + 1, g, pos // 3, any_value((n + 2) // 3), sha256(string_agg(h, '' ORDER BY pos)) FROM a WHERE n > 1 GROUP BY k, g, pos // 3), "
        "s AS (SELECT g, k, h FROM a WHERE n = 1), c AS (SELECT count(*) m FROM s), "
        "b(k, pos, n, h) AS (SELECT 0, g - 1, (SELECT m FROM c), h FROM s UNION ALL SELECT k + 1, pos // 3, any_value((n + 2) // 3), sha256(string_agg(h, '' ORDER BY pos)) FROM b WHERE n > 1 GROUP BY k, pos // 3), "
        "t AS (SELECT h AS root FROM b WHERE n = 1), "
        # folds within groups, then over subroots
        "f(u, g, k, pos, h, proof) AS (SELECT u, g, 0, pos, bad, '' FROM l UNION ALL "
        "SELECT f.u, any_value(f.g), any_value(f.k) + 1, any_value(f.pos) // 3, "
        "sha256(string_agg(CASE WHEN x.pos = f.pos THEN f.h ELSE x.h END, '' ORDER BY x.pos)), any_value(f.proof) || coalesce(string_agg(x.h, '' ORDER BY x.pos) FILTER (x.pos <> f.pos), '') "
        "FROM f JOIN a x ON x.g = f.g AND x.k = f.k AND x.pos // 3 = f.pos // 3 AND x.n > 1 GROUP BY f.u), "
        "e AS (SELECT f.* FROM f JOIN s ON s.g = f.g AND s.k = f.k), "
        "w(u, k, pos, h, proof) AS (SELECT u, 0, g - 1, h, proof FROM e UNION ALL "
        "SELECT w.u, any_value(w.k) + 1, any_value(w.pos) // 3, sha256(string_agg(CASE WHEN x.pos = w.pos THEN w.h ELSE x.h END, '' ORDER BY x.pos)), any_value(w.proof) || coalesce(string_agg(x.h, '' ORDER BY x.pos) FILTER (x.pos <> w.pos), '') "
        "FROM w JOIN b x ON x.k = w.k AND x.pos // 3 = w.pos // 3 AND x.n > 1 GROUP BY w.u), "
        "z AS (SELECT w.* FROM w WHERE w.k = (SELECT max(k) FROM b)) "
        "SELECT l.doc_id, l.leaf, s.h AS subroot, root, sha256(z.proof) AS proof_sha256, z.h AS folded_root, z.h = root AS verified FROM l JOIN s ON s.g = l.g JOIN z ON z.u = l.u, t"
    )
