"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Fingerprints of 64 bits are eight bytes at eight positions. Two of them that differ in at most two bits differ in at most
two bytes, so they share six (position, byte) postings at least, and of the four quarters (two positions each) two at least.
The index posts each distinct fingerprint under the bytes of any two quarters, six times: single bytes would give lists that
grow with the corpus over 256. Within a list the positional bytes that each pair shares are tallied, pairs that reach the
guaranteed six are retained and verified bit by bit. Lists of more than `LONG` fingerprints are split: their members are
posted again under two more bytes each, so that six are shared by all of a list and only two vary; such a list has 65,536
members at most, and links are found by trying all changes of up to two bits.

Verified links (a star for each linked set of a list) feed connected components by alternating star contraction on
tables in the shared folder; nothing is collected.

Defined results: a null or empty text, and one of white space only, has fingerprint zero and links like any other; with
fewer words than a shingle has, the whole sequence is the shingle; repeated shingles count each time; repeated rows and
equal texts share a fingerprint and so a component; an empty table gives an empty result. Only doc_id and the text column
are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, partitions, row_key, table, text_or_empty, unused


LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def majority(each: np.ndarray) -> int:
    """The number whose bits most of some hashes (big-endian) have."""
    bits = np.unpackbits(each.view(np.uint8).reshape(-1, 8), axis=1)
    ones = bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(each)).tobytes(), "big")


def fingerprint(text: str, shingle: int = 3) -> int:
    """The SimHash of a text, as an unsigned number."""
    words = text.encode().translate(LOWER).split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) < shingle:
        each = [h(b" ".join(words), 42)]
    elif shingle == 3:
        each = [h(b"%b %b %b" % x, 42) for x in zip(words, words[1:], words[2:])]
    else:
        each = [h(b" ".join(words[i : i + shingle]), 42) for i in range(len(words) - shingle + 1)]
    return majority(np.array(each, dtype=">u8"))


def fingerprints(df: DataFrame, text: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id, row (the same for rows with equal doc_id and text) and fp, the fingerprint as a signed long."""
    source = df.select("doc_id", row_key(text).alias("row"), text_or_empty(text).alias(unused(df, "text")))
    schema = source.select("doc_id", "row").schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(2)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], names=schema.names)

    return source.mapInArrow(run, schema)


def _mask(positions: tuple[int, ...]) -> int:
    m = sum(0xFF << 8 * (7 - p) for p in positions)
    return m - (1 << 64) if m >> 63 else m


#: Positions of the bytes that a list shares: any two quarters, and for long lists any two of the other positions too.
FOUR = [(2 * a, 2 * a + 1, 2 * b, 2 * b + 1) for a, b in combinations(range(4), 2)]
SIX = [[(*four, *two) for two in combinations([p for p in range(8) if p not in four], 2)] for four in FOUR]
#: Longer lists are split by two more bytes.
LONG = 4096
#: Lists up to this length compare all members; longer ones try all changes.
SHORT = 64


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """How many positional bytes two fingerprints share, from their differing bits."""
    return (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def list_links(fp: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars (member, least of its linked set) of posting lists: fp is uint64, sorted by group and then by fp, without repeats in a group."""
    n = len(fp)
    a, b = [], []
    size = np.bincount(group) if n else np.empty(0, np.int64)
    short = size[group] <= SHORT if n else np.empty(0, bool)
    at = np.arange(n)
    for d in range(1, SHORT):
        live = at[:-d][short[:-d] & (group[:-d] == group[d:])] if d < n else at[:0]
        if not len(live):
            break
        x = fp[live] ^ fp[live + d]
        enough = shared_bytes(x) >= 6
        live, x = live[enough], x[enough]
        near = live[np.bitwise_count(x) <= 2]
        a.append(near)
        b.append(near + d)
    for g in np.flatnonzero(size > SHORT):
        lo, hi = np.searchsorted(group, [g, g + 1])
        own = fp[lo:hi]
        varied = int(np.bitwise_or.reduce(own ^ own[0]))
        places = [p for p in range(64) if varied >> p & 1]
        for i, p in enumerate(places):
            for q in places[i:]:
                to = own ^ np.uint64(1 << p if p == q else 1 << p | 1 << q)
                k = np.minimum(np.searchsorted(own, to), len(own) - 1)
                hit = np.flatnonzero((own[k] == to) & (own < to))
                a.append(lo + hit)
                b.append(lo + k[hit])
    if not a:
        return fp[:0], fp[:0]
    a, b = np.concatenate(a), np.concatenate(b)
    # least member of each linked set, by hooking and pointer jumping
    parent = at.copy()
    while len(a):
        ra, rb = parent[a], parent[b]
        open_ = ra != rb
        if not open_.any():
            break
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        parent = _roots(parent)
    child = np.flatnonzero(parent != at)
    return fp[child], fp[parent[child]]


def fingerprint_links(distinct: DataFrame, long: int = LONG) -> DataFrame:
    """Links (a, b) that span the linked sets of distinct fingerprints (column fp)."""
    # dealt out anew: each row becomes several, and a small table would be read by a task or two
    spread = distinct.select("fp").repartition(partitions(distinct.sparkSession), "fp")
    posted = spread.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_mask(m))) for m in FOUR])).alias("four", "four_bytes"))
    # a table of its own, so that the joins can be made with whatever its size calls for
    hot = Scratch(distinct.sparkSession, "postings").save(posted.groupBy("four", "four_bytes").count().where(F.col("count") > long).select("four", "four_bytes"))
    few = posted.join(hot, ["four", "four_bytes"], "left_anti").select("fp", F.col("four").alias("list"), F.col("four_bytes").alias("bytes"))
    more = F.array(*[F.array(*[F.struct(F.lit(6 * (k + 1) + j).alias("list"), F.col("fp").bitwiseAND(F.lit(_mask(m))).alias("bytes")) for j, m in enumerate(six)]) for k, six in enumerate(SIX)])
    many = posted.join(hot, ["four", "four_bytes"]).select("fp", F.explode(F.get(more, F.col("four"))).alias("x")).select("fp", "x.list", "x.bytes")
    lists = few.unionByName(many).groupBy("list", "bytes").agg(F.count("*").alias("n"), F.collect_list("fp").alias("fps")).where("n > 1").select("fps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(0)
            fp = col.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            group = np.repeat(np.arange(len(col)), np.diff(col.offsets.to_numpy()))
            order = np.lexsort((fp, group))
            a, b = list_links(fp[order], group[order])
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return lists.mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the least node that each linked node reaches, by alternating large and small stars until nothing changes."""
    work = Scratch(links.sparkSession, "components")

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    edges = work.save(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = state(edges)
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # a table of its own, so that the join shuffles both sides and a node with very many links can be split
        least = work.save(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = work.save(large.where("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        shifted = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = work.save(shifted.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        for used in (edges, least, large):
            work.drop(used)
        edges, now = after, state(after)
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
    raise RuntimeError(f"components: still changing after {rounds} rounds")


def near_duplicates(df: DataFrame, text: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id, row, fp, component_id (the smallest doc_id that is reachable over links) and root (names the component) of each row."""
    work = Scratch(df.sparkSession, "simhash")
    marks = work.save(fingerprints(df, text, shingle))
    distinct = work.save(marks.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(fingerprint_links(distinct.select("fp")))
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    # tables of their own, so that the joins can split a component or fingerprint with very many rows
    named = work.save(named)
    least = work.save(named.groupBy("root").agg(F.min("first").alias("component_id")))
    by_fp = work.save(named.join(least, "root").select(F.col("fp").alias("of"), "component_id", "root"))
    return marks.join(by_fp, F.col("fp") == F.col("of")).select("doc_id", "row", "fp", "component_id", "root")


def one_of_each_group(df: DataFrame, text: str = "text", shingle: int = 3, likeness: float | None = None) -> DataFrame:
    """Of each component of near-duplicates, the row of the smallest doc_id (of equal ones one, by a hash of the text).

    Links are those of `near_duplicates`, or with `likeness` a Jaccard index of shingles of at least that much. In
    `tessella.llm.overlap` the byte-position index then proposes links, which whole sets confirm; such texts may differ in more bits
    than positional bytes can vouch for, so the shingles themselves give those that are left."""
    if likeness is not None:
        from tessella.llm import overlap

        return overlap.one_of_each_group(df, text, shingle, likeness)
    work = Scratch(df.sparkSession, "simhash")
    found = near_duplicates(df, text, shingle)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    keep = work.save(found.groupBy("root").agg(F.min_by("row", order).alias("__row")).select("__row"))
    return df.withColumn("__row", row_key(text)).join(keep, "__row", "left_semi").dropDuplicates(["__row"]).select(*df.columns)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
