"""Near-duplicates by SetSketch registers: banded, compared by their joint likelihood, then confirmed on whole sets.

A document's set holds its distinct word shingles, hashed. A SetSketch has `REGISTERS` registers; each takes the least of
exponentially distributed values that all members of the set have for it, and keeps only its place on an exponentially
spaced scale, truncated to 16 bits. Registers of a union are the maxima of registers, so sketches merge, and two registers agree
with a probability of about the Jaccard index, so they are locality-sensitive.

Bands of four registers each are posted. Sets with an index of 0.8 or more share none of the `BANDS` bands with a probability of
(1 - 0.8 ** 4) ** 48 = 1e-11 at most. First the members of a band's bucket meet one of them only, that which shares buckets with
most others, a pair a member. Pairs are dropped if sizes alone rule them out, or if the registers' joint likelihood (how many are
greater, less and equal, given both sizes) is lower by `DOUBT` at the threshold than at its best, which a pair at the threshold
meets with a probability of about 1e-11; all others are confirmed on their whole sets. Buckets whose members are then linked
with one another, over whatever way, are done. Of each other one, all members outside of its largest linked set are queries against
the members of other linked sets: both are dealt into cells of bounded size, whole sets are compared within a cell, and a cell
gives one link at most for each linked set that it joins. So no pair that is not linked already goes untried and nothing is capped.
A member is written once for each `CELL` shingles that its bucket has outside of its largest linked set: a bucket of many sets that
share a band but aren't linked costs rows by its square over `CELL`, one whose members are mostly linked costs rows by its members.

Defined results: ASCII letters count without case; with fewer words than a shingle has, the whole sequence is the shingle; a null or
empty text, and one without words, has an empty set and is linked with nothing, not even with another one; repeated shingles
count once; equal texts and repeated rows share a set and so a component; component ids are the least doc_id that isn't null, and
null only if all are; an empty table gives an empty result. Shingles are told apart by 64 bits of hash within a pair of sets, sets by 128.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, may_have, partitions, row_key, table, text_or_empty
from tessella.llm.simhash import LOWER, components

#: Words of a shingle, and the least Jaccard index of a link in percent.
SHINGLE, PERCENT = 4, 80
#: Bands, registers of a band, and registers.
BANDS, ROWS = 48, 4
REGISTERS = BANDS * ROWS
#: The scale: base, rate, greatest register.
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 1
#: Shingles that the queries and the members of a cell have, about.
CELL = 1 << 19
#: Nats by which the likelihood at the threshold may fall short of the best.
DOUBT = 25.0

_rng = np.random.default_rng(12)
_FACTOR = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """The set of hashed shingles of a text, ascending."""
    words = text.encode().translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    each = np.array([xxhash.xxh64_intdigest(w, 12) for w in words], dtype=np.uint64)
    k = min(shingle, len(words))
    x = np.full(len(words) - k + 1, k, dtype=np.uint64)
    for j in range(k):
        x = _mixed(x * np.uint64(0x9E3779B97F4A7C15) + each[j : len(each) - k + 1 + j])
    return np.unique(x)


def registers(own: np.ndarray) -> np.ndarray:
    """The sketch of a set of hashes."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for lo in range(0, len(own), 1024):
        # order is kept by the step to exponential values, so that it is made of the least ones only
        np.minimum(least, (own[lo : lo + 1024, None] * _FACTOR + _SHIFT).min(axis=0), out=least)
    value = -np.log1p(-((least >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / RATE
    return np.clip(np.floor(1 - np.log(value) / np.log(BASE)), 0, TOP).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def _log_likelihood(j: np.ndarray, more: np.ndarray, less: np.ndarray, same: np.ndarray, u: np.ndarray) -> np.ndarray:
    def chance(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def part(n: np.ndarray, p: np.ndarray) -> np.ndarray:
        return np.where(n > 0, n * np.log(np.maximum(p, 1e-300)), 0.0)

    up, down = chance(u - (1 - u) * j), chance((1 - u) - u * j)
    return part(more, up) + part(less, down) + part(same, 1 - up - down)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of sketches (rows) with the sizes of their sets: the likeliest Jaccard index, its log-likelihood, and counts of registers that are greater, less and equal."""
    counts = np.stack([(a > b).sum(axis=1), (a < b).sum(axis=1), (a == b).sum(axis=1)])
    u = na / (na + nb)
    lo, hi = np.zeros(len(u)), np.minimum(na, nb) / np.maximum(na, nb)
    for _ in range(60):  # the likelihood is concave
        left, right = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        rises = _log_likelihood(left, *counts, u) < _log_likelihood(right, *counts, u)
        lo, hi = np.where(rises, left, lo), np.where(rises, hi, right)
    best = (lo + hi) / 2
    return best, _log_likelihood(best, *counts, u), counts


def likely(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Which pairs the registers don't rule out."""
    best, top, counts = estimate(a, b, na, nb)
    at = _log_likelihood(np.full(len(best), percent / 100), *counts, na / (na + nb))
    return (best * 100 >= percent) | (top - at <= DOUBT)


def alike(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two ascending sets have a Jaccard index of `percent` or more, in whole numbers."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def cell_links(queries: list[tuple], members: list[tuple], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links (query, member) between (id, root, set) of different roots, one at most for each two linked sets that they join."""
    roots = np.unique([r for _, r, _ in [*queries, *members]])
    name = np.arange(len(roots))
    of_query, of_member = (np.searchsorted(roots, [r for _, r, _ in x]) for x in (queries, members))
    size = np.array([len(s) for _, _, s in members])
    owner = np.repeat(np.arange(len(members)), size)
    values = np.concatenate([s for _, _, s in members])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    out = []
    for (i, _, own), r in zip(queries, of_query, strict=True):
        if (name[of_member] == name[r]).all():
            continue
        # the postings of the query's shingles
        lo, hi = np.searchsorted(values, own), np.searchsorted(values, own, side="right")
        count = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        both = np.bincount(owner[at], minlength=len(members))
        hits = np.flatnonzero((100 * both >= percent * (size + len(own) - both)) & (name[of_member] != name[r]))
        for k in hits:
            if name[of_member[k]] != name[r]:
                out.append((i, members[k][0]))
                name[name == name[of_member[k]]] = name[r]
    return out


def sketches(df: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, row (the same for rows with equal doc_id and text), n (size of the set), key (names the set) and sketch; both null for an empty set."""
    source = df.select("doc_id", row_key(text).alias("row"), text_or_empty(text).alias("text__"))
    schema = source.select("doc_id", "row").schema.add("n", "long").add("key", "binary").add("sketch", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, key, sketch = [], [], []
            for x in batch.column(2):
                own = shingles(x.as_py(), shingle)
                n.append(len(own))
                key.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                sketch.append(registers(own).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sketch, pa.binary())], names=schema.names)

    return source.mapInArrow(run, schema)


class _Links:
    """Tries pairs of sets (by their ids) and gathers what is linked."""

    def __init__(self, sets: DataFrame, texts: DataFrame, work: Scratch, shingle: int, percent: int) -> None:
        self.sets, self.texts, self.work, self.shingle, self.percent = sets, texts, work, shingle, percent
        self.found: DataFrame

    def _both(self, pairs: DataFrame, of: DataFrame) -> DataFrame:
        """pairs with the other columns of `of` (id, …) for a and for b, as <name>_a and <name>_b."""
        for side in ("a", "b"):
            pairs = pairs.join(of.select(*[F.col(c).alias(f"{c}_{side}") for c in of.columns]), F.col(side) == F.col(f"id_{side}")).drop(f"id_{side}")
        return pairs

    def add(self, pairs: DataFrame) -> None:
        """Tries pairs (a, b)."""
        pairs = self.work.save(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        self.found = self._confirmed(self._likely(pairs))

    def _likely(self, pairs: DataFrame) -> DataFrame:
        percent = self.percent
        both = self._both(pairs, self.sets.select("id", "n", "sketch")).where(F.least("n_a", "n_b") * 100 >= percent * F.greatest("n_a", "n_b"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = [np.frombuffer(b"".join(batch[c].to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS) for c in ("sketch_a", "sketch_b")]
                ok = pa.array(likely(*x, *(batch[c].to_numpy().astype(np.float64) for c in ("n_a", "n_b")), percent)) if len(x[0]) else pa.array([], pa.bool_())
                yield batch.select(["a", "b"]).filter(ok)

        return self.work.save(both.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long"))

    def whole(self, ids: DataFrame) -> DataFrame:
        """(id, set) for some ids, saved."""
        shingle = self.shingle
        self.work.free()
        rows = self.work.save(self.sets.join(ids, "id").select("id", F.col("row").alias("row_")))
        # few texts are asked for, and only those are shuffled; once, as a row names one set
        some = may_have(self.texts, "row", rows.select("row_"))
        own = some.join(rows, F.col("row") == F.col("row_")).dropDuplicates(["row"]).select("id", "text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(x.as_py(), shingle).tobytes() for x in batch.column(1)], pa.binary())], names=["id", "set"])

        done = self.work.save(own.mapInArrow(run, "id long, set binary"))
        self.work.drop(rows)
        return done

    def _confirmed(self, pairs: DataFrame) -> DataFrame:
        percent = self.percent
        whole = self.whole(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, y = ((np.frombuffer(v.as_py(), dtype=np.uint64) for v in batch[c]) for c in ("set_a", "set_b"))
                yield batch.select(["a", "b"]).filter(pa.array([alike(i, j, percent) for i, j in zip(x, y, strict=True)], pa.bool_()))

        done = self.work.save(self._both(pairs, whole).select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long"))
        self.work.drop(whole)
        return done

    def across(self, rest: DataFrame) -> None:
        """Tries, within each bucket of rest (bucket, id, root), all pairs of different roots."""
        percent = self.percent
        # sets that share several bands share buckets with the same members: one of those does
        same = rest.groupBy("bucket").agg(F.count("*").alias("members"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
        rest = self.work.save(rest.join(same.groupBy("members", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket"), "bucket"))
        own = rest.join(self.sets.select("id", "n"), "id")
        sizes = own.groupBy("bucket", "root").agg(F.count("*").alias("members"), F.sum("n").alias("n"))
        plan = sizes.groupBy("bucket").agg(F.max_by("root", F.struct("members", "root")).alias("main"), F.max_by("n", F.struct("members", "root")).alias("n_main"), F.sum("n").alias("n_all"))
        cells = lambda n: F.ceil(n / F.lit(CELL)).cast("int")
        plan = self.work.save(plan.select("bucket", "main", cells(F.col("n_all")).alias("blocks"), cells(F.col("n_all") - F.col("n_main")).alias("chunks")))
        dealt = rest.join(plan, "bucket")
        block, chunk = F.pmod(F.xxhash64("id"), "blocks"), F.pmod(F.xxhash64("id", F.lit(1)), "chunks")
        up_to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - F.lit(1).cast("long")))
        members = dealt.select("bucket", up_to("chunks").alias("chunk"), block.alias("block"), F.lit(1).alias("member"), "id", "root")
        queries = dealt.where("root <> main").select("bucket", chunk.alias("chunk"), up_to("blocks").alias("block"), F.lit(0).alias("member"), "id", "root")
        whole = self.whole(rest.select("id").distinct())
        self.work.free()  # the texts' shuffle files, before the cells' are written
        rows = members.unionByName(queries).join(whole, "id").select("bucket", "chunk", "block", "member", "id", "root", "set")
        rows = rows.repartition(partitions(rest.sparkSession), "bucket", "chunk", "block").sortWithinPartitions("bucket", "chunk", "block", "member")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cell, held = None, ([], [])

            def out() -> pa.RecordBatch:
                links = cell_links(*held, percent) if all(held) else []
                return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

            for batch in batches:
                keys = zip(*(batch[c].to_pylist() for c in ("bucket", "chunk", "block")), strict=True)
                for key, member, i, root, own in zip(keys, *(batch[c].to_pylist() for c in ("member", "id", "root", "set")), strict=True):
                    if key != cell:
                        yield out()
                        cell, held = key, ([], [])
                    held[member].append((i, root, np.frombuffer(own, dtype=np.uint64)))
            yield out()

        links = self.work.save(rows.mapInArrow(run, "a long, b long").distinct())
        self.found = self.found.unionByName(links)


def linked_sets(sets: DataFrame, texts: DataFrame, work: Scratch, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(node, root): the least id that each linked set reaches. sets: (id, row, n, sketch), saved; texts: (row, text)."""
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.substring("sketch", i * (2 * ROWS) + 1, F.lit(2 * ROWS)))
    posted = sets.select("id", F.posexplode(bands).alias("band", "value")).select(F.xxhash64("band", "value").alias("bucket"), "id")
    links = _Links(sets, texts, work, shingle, percent)
    several = work.save(posted.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1"))
    rest = work.save(posted.join(several, "bucket"))
    met_most = work.save(rest.groupBy("id").agg(F.sum("members").alias("others")))
    rest = rest.join(met_most, "id").select("bucket", "id", "others")
    hubs = work.save(rest.groupBy("bucket").agg(F.max_by("id", F.struct("others", "id")).alias("hub")))
    # the hub then leaves the bucket: it has met all others
    met = work.save(rest.join(hubs, "bucket").where("id <> hub").select("bucket", "id", "hub"))
    links.add(met.select(F.col("hub").alias("a"), F.col("id").alias("b")))
    rest = _unlinked(met.select("bucket", "id"), components(links.found), work)
    work.drop(several, met_most, hubs, met)
    links.across(rest)
    return components(links.found)


def _unlinked(members: DataFrame, roots: DataFrame, work: Scratch) -> DataFrame:
    """members (bucket, id) with `root`, of buckets that have more than one."""
    own = work.save(members.join(roots, F.col("id") == F.col("node"), "left").select(*members.columns, F.coalesce("root", "id").alias("root")))
    mixed = own.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("bucket")
    out = work.save(own.join(work.save(mixed), "bucket"))
    work.drop(own)
    return out


def near_duplicates(df: DataFrame, text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id that is reachable over links) of each row."""
    work = Scratch(df.sparkSession, "setsketch")
    marks = work.save(sketches(df, text, shingle))
    once = marks.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("first"), F.min("row").alias("row"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    # saved, so that a set's number is the same whenever it is read
    sets = work.save(once.withColumn("id", F.monotonically_increasing_id()))
    texts = df.select(row_key(text).alias("row"), text_or_empty(text).alias("text"))
    roots = linked_sets(sets, texts, work, shingle, percent)
    named = work.save(sets.join(roots, F.col("id") == F.col("node"), "left").select("key", "first", F.coalesce("root", "id").alias("root")))
    # tables of their own, so that the joins can split a component or a set with very many rows
    least = work.save(named.groupBy("root").agg(F.min("first").alias("component_id")))
    by_key = work.save(named.join(least, "root").select(F.col("key").alias("of"), "component_id"))
    done = marks.join(by_key, F.col("key") == F.col("of"), "left")
    return done.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
