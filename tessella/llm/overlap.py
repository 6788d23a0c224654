"""Near-duplicates by the overlap of word shingles: exact set-similarity join with prefix filtering.

The likeness of two texts is the Jaccard index of their sets of shingles. In any fixed order of all shingles, two sets
that are alike enough share a shingle among the first few of each (the prefix), so only texts that meet in the posting
list of a prefix shingle are compared, and no pair is missed. The order puts shingles last that are frequent in a sample
of the texts; it only decides how long lists get. Lists are parted where sizes differ too much for a link, and long ones
into pairs of blocks, so what a task holds is bounded. Members of a list that only share a passage with all others leave it by a
bound that holds without exception: the shingles of a set are dealt by hash to as many bits as it has shingles, about, and each bit
is the parity of its shingles. Two parities differ only where an odd number of the shingles that one of the two sets lacks
falls, so they differ in no more bits than the sets in shingles, and sets that are alike enough differ in few. Within what is left of a
list, sets are compared by counting shared shingles, and texts already linked are not compared again.

The byte-position index of `tessella.llm.simhash` comes first: pairs that it links by fingerprints of the same shingles are confirmed on
their whole sets, and these links are kept. It vouches for two bits only, and alike sets may differ in more, so the join above is the
exact way for the rest: it compares the lists that hold sets which the index hasn't brought together.

Defined results: ASCII letters count without case; a text without words has one shingle of its own, so that all such
texts are alike; with fewer words than a shingle has, the whole sequence is the shingle; repeated shingles count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import Scratch, partitions, row_key, text_or_empty
from tessella.llm.simhash import LOWER, components, fingerprint_links, majority

#: Words of a shingle, and the least Jaccard index of a link.
SHINGLE, LIKENESS = 5, 0.8
#: Texts of the sample for the order of shingles, and frequent shingles that are remembered.
SAMPLE, FREQUENT = 20_000, 200_000
#: Longer lists are compared as pairs of blocks of this length.
BLOCK = 4096
#: Bits of the parities of the smallest and of the largest sets, powers of two. Beyond the latter the bound holds, but tells less apart.
LEAST_BITS, MOST_BITS = 64, 1 << 14
#: Numbers that a comparison of parities holds at a time.
AT_ONCE = 1 << 20
#: Against rounding.
EPS = 1e-9


def hashed(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """The hashes of a text's shingles, repeats included."""
    words = text.encode().translate(LOWER).split()
    h = xxhash.xxh3_64_digest
    each = b"".join([h(b" ".join(words[i : i + shingle]), 42) for i in range(max(1, len(words) - shingle + 1))])
    return np.frombuffer(each, dtype=np.uint64)


def shingles(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """The set of hashed shingles of a text, ascending."""
    return np.unique(hashed(text, shingle))


def parity(own: np.ndarray) -> bytes:
    """Of each of a power of two of bits, whether an odd number of the set's shingles falls to it by its last digits."""
    bits = min(max(LEAST_BITS, 1 << (len(own) - 1).bit_length()), MOST_BITS)
    odd = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(marks: list[bytes], width: int) -> np.ndarray:
    """Parities of some width (bytes), as rows of numbers, cut to a smaller one: the halves of a parity make that of half as many bits."""
    rows = np.frombuffer(b"".join(marks), dtype=np.uint64).reshape(len(marks), -1)
    while rows.shape[1] * 8 > width:
        rows = rows[:, : rows.shape[1] // 2] ^ rows[:, rows.shape[1] // 2 :]
    return rows


def near_members(sizes: np.ndarray, marks: list[bytes], likeness: float = LIKENESS) -> list[np.ndarray]:
    """Members of a list in sets of two or more that connect all pairs whose sizes and parities allow a link."""
    width, name = np.array([len(m) for m in marks]), np.arange(len(marks))
    share = (1 - likeness) / (1 + likeness)
    for w in np.unique(width).tolist():
        # sets alike enough have parities of the same or, about, the next width
        levels = [np.flatnonzero(width == v) for v in np.unique(width).tolist() if w <= v < 2 * w / likeness]
        own, other = levels[0], np.concatenate(levels)
        rows = np.concatenate([_folded([marks[k] for k in x], w) for x in levels])
        step = max(1, AT_ONCE // rows.size)
        for lo in range(0, len(own), step):
            some = own[lo : lo + step]
            a, b = sizes[some, None], sizes[other]
            differ = np.bitwise_count(rows[lo : lo + len(some), None, :] ^ rows[None, :, :]).sum(axis=2, dtype=np.int64)
            near = (differ <= share * (a + b) + EPS) & (np.minimum(a, b) >= likeness * np.maximum(a, b) - EPS)
            for hits in near:
                # the sets of all near ones become one
                old = np.unique(name[other[hits]])
                if len(old) > 1:
                    name[np.isin(name, old)] = old[0]
    order = np.argsort(name, kind="stable")
    return [x for x in np.split(order, np.flatnonzero(np.diff(name[order])) + 1) if len(x) > 1]


def prefix(own: np.ndarray, frequent: np.ndarray, counts: np.ndarray, likeness: float = LIKENESS) -> np.ndarray:
    """The first shingles of a set, by frequency and hash, of which two sets that are alike share one."""
    seen = np.zeros(len(own), dtype=np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
        seen = np.where(frequent[at] == own, counts[at], 0)
    return own[np.lexsort((own, seen))[: len(own) - int(np.ceil(likeness * len(own) - EPS)) + 1]]


def units(sizes: np.ndarray, likeness: float = LIKENESS, block: int = BLOCK) -> Iterator[np.ndarray]:
    """Members (indexes) of a list that are to be compared together; sizes ascend."""
    cuts = np.flatnonzero(sizes[:-1] < likeness * sizes[1:] - EPS) + 1
    for part in np.split(np.arange(len(sizes)), cuts):
        blocks = [part[i : i + block] for i in range(0, len(part), block)]
        for i, a in enumerate(blocks):
            if len(blocks) == 1 and len(a) > 1:
                yield a
            for b in blocks[i + 1 :]:
                if sizes[a[-1]] >= likeness * sizes[b[0]] - EPS:
                    yield np.concatenate([a, b])


def linked(sets: list[np.ndarray], likeness: float = LIKENESS) -> list[tuple[int, int]]:
    """(member, first of its linked set) of sets of shingles, without the first ones themselves."""
    size = np.array([len(s) for s in sets])
    if len(sets) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return [(1, 0)] if both >= likeness * (size.sum() - both) - EPS else []
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    of = np.split(codes, np.cumsum(size)[:-1])
    owner = np.repeat(np.arange(len(sets)), size)
    mark = np.zeros(codes.max() + 1, dtype=bool)
    new, out = np.ones(len(sets), dtype=bool), []
    for first in range(len(sets)):
        if not new[first]:
            continue
        new[first] = False
        queue = [first]
        while queue:
            x = queue.pop()
            mark[of[x]] = True
            both = np.bincount(owner[mark[codes]], minlength=len(sets))
            mark[of[x]] = False
            hits = np.flatnonzero(new & (both >= likeness * (size + size[x] - both) - EPS))
            new[hits] = False
            out += [(k, first) for k in hits.tolist()]
            queue += hits.tolist()
            # only what is not linked yet is compared on
            if 2 * np.count_nonzero(new) < len(np.unique(owner)) or not new.any():
                live = new[owner]
                codes, owner = codes[live], owner[live]
            if not len(owner):
                return out
    return out


def _frequent(texts: DataFrame, n: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of a sample of distinct texts (ascending) and their counts."""
    share = min(1 << 20, (SAMPLE << 20) // max(n, 1) + 1)
    sample = texts.where(F.col("of").bitwiseAND(F.lit((1 << 20) - 1)) < share).dropDuplicates(["of"]).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(x.as_py(), shingle).view(np.int64))], names=["x"])

    counts = sample.mapInArrow(run, "x long").groupBy("x").agg(F.count("*").alias("n")).where("n > 1")
    top = counts.orderBy(F.desc("n"), "x").limit(FREQUENT).toArrow()
    x, c = top["x"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(x)
    return x[order], c[order]


def indexed_pairs(firsts: DataFrame, work: Scratch, likeness: float) -> DataFrame:
    """Pairs of sets (row_a, key_a, size_a, row_b, key_b, size_b) that the byte-position index links and sizes allow, a few for each set, saved."""
    own = firsts.select("fp", F.struct(F.col("first.row").alias("row"), "key", "size").alias("set"))
    # sets with one fingerprint meet the least of them, and that meets those of fingerprints near by
    heads = work.save(own.groupBy("fp").agg(F.min_by("set", "set.key").alias("head")))
    same = own.join(heads, "fp").where("set.key <> head.key").select(F.col("set").alias("a"), F.col("head").alias("b"))
    near = fingerprint_links(heads.select("fp"))
    for side in ("a", "b"):
        near = near.join(heads.select(F.col("fp").alias(side), F.col("head").alias(f"head_{side}")), side)
    both = same.unionByName(near.select(F.col("head_a").alias("a"), F.col("head_b").alias("b")))
    both = both.select(*[F.col(f"{side}.{c}").alias(f"{c}_{side}") for side in ("a", "b") for c in ("row", "key", "size")])
    out = work.save(both.where(F.least("size_a", "size_b") >= likeness * F.greatest("size_a", "size_b") - EPS))
    work.drop(heads)
    return out


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, likeness: float) -> DataFrame:
    """Links (a, b) between keys, of pairs as from `indexed_pairs`, by their whole sets."""
    for side in ("a", "b"):
        pairs = pairs.join(texts.select(F.col("row").alias(f"row_{side}"), F.col("text").alias(f"text_{side}")), f"row_{side}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # pairs with the same second text mostly follow one another
        before, other = None, None
        for batch in batches:
            ok = []
            for x, y, total in zip(*(batch[c].to_pylist() for c in ("text_a", "text_b", "total")), strict=True):
                if y != before:
                    before, other = y, shingles(y, shingle)
                both = len(np.intersect1d(shingles(x, shingle), other, assume_unique=True))
                ok.append(both >= likeness * (total - both) - EPS)
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.select(F.col("key_a").alias("a"), F.col("key_b").alias("b"), (F.col("size_a") + F.col("size_b")).alias("total"), "text_a", "text_b")
    return both.mapInArrow(run, "a binary, b binary")


def links(marks: DataFrame, texts: DataFrame, firsts: DataFrame, work: Scratch, shingle: int, likeness: float) -> DataFrame:
    """Links (a, b) between keys of alike sets; they span the linked sets."""
    spark = marks.sparkSession
    once = marks.join(firsts.select("first.row"), "row", "left_semi")
    postings = once.select(F.explode("prefix").alias("x"), "size", "short")
    sorted_ = postings.repartition(partitions(spark), "x").sortWithinPartitions("x")

    def unit_of(keys: np.ndarray) -> int:
        return xxhash.xxh64_intdigest(keys.tobytes())

    def rows(units_: list[np.ndarray]) -> pa.RecordBatch:
        names = [np.full(len(u), unit_of(u), dtype=np.uint64).view(np.int64) for u in units_]
        names, keys = (np.concatenate([np.empty(0, np.int64), *c]) for c in (names, units_))
        return pa.RecordBatch.from_arrays([pa.array(names), pa.array(keys)], names=["unit", "short"])

    def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """What was read, cut so that rows with the same first column stay together."""
        left = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            left = t if left is None else pa.concat_tables([left, t])
            first = left.column(0).to_numpy()
            whole = int(np.searchsorted(first, first[-1])) if len(first) else 0
            if whole:
                yield left.slice(0, whole)
                left = left.slice(whole)
        if left is not None and left.num_rows:
            yield left

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches):
            x, size, key = (c.to_numpy() for c in t.columns)
            at = np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1, [len(x)]])
            out = []
            for k in np.flatnonzero(np.diff(at) > 1):
                own, first = np.unique(key[at[k] : at[k + 1]], return_index=True)
                n = size[at[k] : at[k + 1]][first]
                order = np.lexsort((own, n))
                out += [own[order[u]] for u in units(n[order], likeness)]
            yield rows(out)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches):
            unit, key, size = (t[c].to_numpy() for c in ("unit", "short", "size"))
            marks_ = t["parity"].to_pylist()
            at = np.concatenate([[0], np.flatnonzero(unit[1:] != unit[:-1]) + 1, [len(unit)]])
            lists = zip(at, at[1:], strict=False)
            yield rows([np.sort(key[a:b][m]) for a, b in lists for m in near_members(size[a:b].astype(np.int64), marks_[a:b], likeness)])

    # many shingles have the same list
    found = work.save(sorted_.mapInArrow(part, "unit long, short long").distinct())
    listed = found.join(firsts.select("short", "size", "parity"), "short").select("unit", "short", "size", "parity")
    dealt = listed.repartition(partitions(spark), "unit").sortWithinPartitions("unit")
    near = work.save(dealt.mapInArrow(prune, "unit long, short long").distinct())
    work.drop(found)
    work.free()
    near_rows = work.save(near.join(firsts.select("short", "key", F.col("first.row").alias("row")), "short").select("unit", "row", "key"))
    work.drop(near)
    pairs = indexed_pairs(firsts, work, likeness)
    rows_ = near_rows.select("row").unionByName(pairs.select(F.explode(F.array("row_a", "row_b")).alias("row"))).distinct()
    needed = work.save(texts.join(rows_, "row", "left_semi").select("row", "text").dropDuplicates(["row"]))
    work.free()
    first = work.save(confirmed(pairs, needed, shingle, likeness))
    work.drop(pairs)
    open_ = unlinked(near_rows, components(first), work)
    work.drop(near_rows)
    work.free()
    dealt = open_.join(needed, "row").select("unit", "text").repartition(partitions(spark), "unit").sortWithinPartitions("unit")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, keys, sets = None, [], []

        def out() -> pa.RecordBatch:
            pairs = linked(sets, likeness) if len(sets) > 1 else []
            a, b = (pa.array([keys[p[k]] for p in pairs], pa.binary()) for k in (0, 1))
            return pa.RecordBatch.from_arrays([a, b], names=["a", "b"])

        for batch in batches:
            for u, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if u != unit:
                    yield out()
                    unit, keys, sets = u, [], []
                sets.append(shingles(t, shingle))
                keys.append(xxhash.xxh3_128_digest(sets[-1].tobytes()))
        yield out()

    done = work.save(dealt.mapInArrow(compare, "a binary, b binary").unionByName(first).distinct())
    work.drop(needed, open_, first)
    work.free()
    return done


def unlinked(rows: DataFrame, roots: DataFrame, work: Scratch) -> DataFrame:
    """rows (unit, row, key) of units that hold more than one linked set, saved."""
    own = work.save(rows.join(roots, F.col("key") == F.col("node"), "left").select("unit", "row", F.coalesce("root", "key").alias("root")))
    several = own.groupBy("unit").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("unit")
    out = work.save(own.join(work.save(several), "unit").select("unit", "row"))
    work.drop(own)
    return out


def one_of_each_group(df: DataFrame, text: str = "text", shingle: int = SHINGLE, likeness: float = LIKENESS) -> DataFrame:
    """Of each group that links of at least this likeness connect, the row of the smallest doc_id (of equal ones one, by a hash of the text)."""
    work = Scratch(df.sparkSession, "overlap")
    texts = df.select("doc_id", row_key(text).alias("row"), F.xxhash64(text_or_empty(text)).alias("of"), text_or_empty(text).alias("text"))
    frequent, counts = _frequent(texts, df.count(), shingle)
    kept = texts.select("doc_id", "row", "text")
    schema = kept.select("doc_id", "row").schema.add("key", "binary").add("short", "long").add("size", "integer").add("parity", "binary").add("prefix", T.ArrayType(T.LongType())).add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, size, parities, first, fps = [], [], [], [], []
            for x in batch.column(2):
                each = hashed(x.as_py(), shingle)
                own = np.unique(each)
                fps.append(majority(each))
                key.append(xxhash.xxh3_128_digest(own.tobytes()))
                size.append(len(own))
                parities.append(parity(own))
                first.append(prefix(own, frequent, counts, likeness).view(np.int64))
            short = np.frombuffer(b"".join(key), dtype=np.int64)[::2]
            columns = [pa.array(key, pa.binary()), pa.array(short), pa.array(size, pa.int32()), pa.array(parities, pa.binary()), pa.array(first, pa.list_(pa.int64())), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=schema.names)

    marks = work.save(kept.mapInArrow(run, schema))
    firsts = work.save(marks.groupBy("key", "short", "size", "parity").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "row")).alias("first"), F.min("fp").alias("fp")))
    found = links(marks, texts, firsts, work, shingle, likeness)
    work.drop(marks)
    roots = components(found)
    named = firsts.join(roots, firsts.key == roots.node, "left").select("first", F.coalesce("root", "key").alias("root"))
    keep = work.save(named.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("__row")))
    return df.withColumn("__row", row_key(text)).join(keep, "__row", "left_semi").dropDuplicates(["__row"]).select(*df.columns)
