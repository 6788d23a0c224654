"""Phrase collocations by vertical positional lists.

Texts are dealt into blocks, each of one language, and every block has positional inverted lists: for each word the positions it
stands at, with a gap between pieces so that no phrase crosses one. The occurrences of a phrase of k + 1 words are those of
its first k whose position, k further on, is in the last word's postings: a merge-join of two ascending lists, within the
block. A list's length is the phrase's exact number of occurrences there, and the sum over blocks, one small row each, is the
exact frequency; only phrases that reach the threshold are extended, and only where their last k words are
frequent too. A block's postings keep only positions that the next step can meet.

Nothing is gathered by phrase but a count for each block that has it, so a very common word or phrase is as spread as its
blocks are, and no task or broadcast holds the frequent phrases. Blocks are saved in buckets and stay where they are; only counts
and the names of frequent phrases move: pairs of a phrase and a word are dealt to parts by hash, packed for each block and part.

Defined results: ASCII letters count without case; a null text is empty; texts, pieces and languages without words add nothing; a null
language counts as `und`; words may hold any characters but separators; an empty table gives an empty result. Only the language and
the text are read, so repeated rows count each time and other columns don't matter.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.llm.common import Scratch, partitions, table, text_or_empty
from tessella.llm.simhash import LOWER

#: Words of the longest phrase, least frequency, rows of a language.
LONGEST, LEAST, TOP = 5, 100, 2000
#: Words of a block, about.
BLOCK = 1 << 21
#: Splits pieces; a mark for each takes a position of its own.
ENDS = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else LOWER[c] for c in range(256))
TOKEN = re.compile(rb"[^ \t\n]+|\n")

LISTS = "ids array<long>, sizes array<int>, steps array<int>"


def positions(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different words of some texts, how often each occurs, and the ascending positions of each, one word's after the other's."""
    code: dict[bytes, int] = defaultdict()
    code.default_factory = code.__len__
    mark = code[b"\n"]
    codes = np.array([c for t in texts for c in (*map(code.__getitem__, TOKEN.findall(t.encode().translate(ENDS))), mark)], dtype=np.int32)
    order = np.argsort(codes, kind="stable").astype(np.int32)
    sizes = np.bincount(codes, minlength=len(code))
    return [w.decode() for w in list(code)[1:]], sizes[1:], order[sizes[0] :]


def packed(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lists from the id of each occurrence and its position: the ids, their lengths, and positions as steps from one to the next, which compress well."""
    order = np.lexsort((at, ids))
    ids, at = ids[order], at[order]
    own, sizes = np.unique(ids, return_counts=True)
    return own, sizes.astype(np.int32), np.diff(at, prepend=0).astype(np.int32)


def flat(ids: np.ndarray, sizes: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The id of each occurrence and its position, by ascending position."""
    at = np.cumsum(steps, dtype=np.int64)
    order = np.argsort(at, kind="stable")
    return np.repeat(ids, sizes)[order], at[order]


def meet(at: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge-join: the indexes, in both ascending lists, of the positions that they share."""
    k = np.searchsorted(other, at)
    hit = np.flatnonzero((k < len(other)) & (other[np.minimum(k, len(other) - 1)] == at)) if len(other) else np.empty(0, np.int64)
    return hit, k[hit]


def extended(phrases: tuple, words: tuple, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where a phrase of k words goes on to a word of the postings: the phrase's id, the word's, and the position, ascending."""
    (ids, at), (word_ids, word_at) = flat(*phrases), flat(*words)
    if k > 1:
        # the last k words are frequent too
        some, _ = meet(at + 1, at)
        ids, at = ids[some], at[some]
    i, j = meet(at + k, word_at)
    return ids[i], word_ids[j], at[i]


def _blocks(df: DataFrame, text: str, lang: str, most: int, work: Scratch) -> DataFrame:
    """Postings of blocks: lang, words, ids (place of each in `words`), sizes and steps of the lists, and `block`."""
    source = df.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), text_or_empty(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[str]] = defaultdict(list)
        size: dict[str, int] = defaultdict(int)

        def out(lang: str) -> pa.RecordBatch:
            words, sizes, at = positions(held.pop(lang))
            size.pop(lang)
            steps = np.diff(at, prepend=0).astype(np.int32)
            columns = [pa.array([lang]), pa.array([words], pa.list_(pa.string())), pa.array([sizes], pa.list_(pa.int32())), pa.array([steps], pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays(columns, names=["lang", "words", "sizes", "steps"])

        for batch in batches:
            for own, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = x.as_py()
                held[own].append(t)
                size[own] += len(t) // 6 + 1
                if size[own] >= most:
                    yield out(own)
        for own in list(held):
            yield out(own)

    made = source.mapInArrow(run, "lang string, words array<string>, sizes array<int>, steps array<int>")
    return work.save(made.withColumn("block", F.monotonically_increasing_id()), by="block")


def _parts(spark: SparkSession) -> int:
    """Into how many parts keys are dealt by their hash, to be counted and numbered."""
    return 2 * partitions(spark)


def _frequent(counts: DataFrame, by: list[str], least: int, work: Scratch) -> tuple[DataFrame, DataFrame]:
    """From counts (by, block, n, …) of the blocks: the frequent keys (by, f, id), and the blocks' rows of those with their `id`, saved."""
    # a row for each block that has the key; rows of a key are together and need no join; numbers of few digits, which pack well
    n = _parts(counts.sparkSession)
    rows = counts.withColumn("part", F.pmod(F.xxhash64(*by), F.lit(n))).repartition("part")
    rows = rows.withColumn("f", F.sum("n").over(W.partitionBy("part", *by))).where(F.col("f") >= least)
    rows = rows.withColumn("id", (F.dense_rank().over(W.partitionBy("part").orderBy(*by)) - 1).cast("long") * n + F.col("part"))
    rows = work.save(rows.drop("part"))
    work.free()
    return work.save(rows.groupBy(*by).agg(F.first("f").alias("f"), F.first("id").alias("id"))), rows


def _named(rows: DataFrame, *fields: str) -> DataFrame:
    """(of, names): for each block its rows' fields, which name its frequent keys."""
    return rows.groupBy(F.col("block").alias("of")).agg(F.collect_list(F.struct(*fields)).alias("names"))


def _numpy(x: pa.Scalar, kind: type) -> np.ndarray:
    return x.values.to_numpy(zero_copy_only=False).astype(kind) if x.is_valid else np.empty(0, kind)


def _words(blocks: DataFrame, names: DataFrame, work: Scratch) -> DataFrame:
    """Blocks with the postings of frequent words only, under their ids, as phrases and as words."""
    both = blocks.join(names, F.col("block") == F.col("of")).select("block", "lang", "sizes", "steps", F.col("names.at").alias("at"), F.col("names.id").alias("name"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sizes, steps, place, name = (_numpy(batch[c][i], kind) for c, kind in (("sizes", np.int64), ("steps", np.int64), ("at", np.int64), ("name", np.int64)))
                ids = np.full(len(sizes), -1)
                ids[place] = name
                each = np.repeat(ids, sizes)
                lists = packed(each[each >= 0], np.cumsum(steps)[each >= 0])
                yield _row(batch["block"][i], batch["lang"][i], lists, None)

    return work.save(both.mapInArrow(run, f"block long, lang string, {LISTS}, w_ids array<long>, w_sizes array<int>, w_steps array<int>"), by="block")


def _row(block: pa.Scalar, lang: pa.Scalar, phrases: tuple, words: tuple | None) -> pa.RecordBatch:
    kinds = [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
    columns = [pa.array([x], k) for lists in (phrases, words or (None, None, None)) for x, k in zip(lists, kinds, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([block.as_py()], pa.int64()), pa.array([lang.as_py()], pa.string()), *columns], names=["block", "lang", "ids", "sizes", "steps", "w_ids", "w_sizes", "w_steps"])


def _lists(batch: pa.RecordBatch, i: int) -> tuple[tuple, tuple]:
    """Phrases and words of a block; where words aren't given they are the phrases."""
    phrases = tuple(_numpy(batch[c][i], np.int64) for c in ("ids", "sizes", "steps"))
    return phrases, tuple(_numpy(batch[c][i], np.int64) for c in ("w_ids", "w_sizes", "w_steps")) if batch["w_ids"][i].is_valid else phrases


def pack(*columns: np.ndarray) -> bytes:
    """Columns of integers, compressed: all lowest bytes stand together, then the next ones, so that the many zeros take next to nothing."""
    return pa.compress(b"".join(c.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns), codec="zstd", asbytes=True)


def unpack(data: bytes, n: int, columns: int = 3) -> list[np.ndarray]:
    """The columns of n integers that were packed."""
    planes = np.frombuffer(pa.decompress(data, 8 * n * columns, codec="zstd", asbytes=True), np.uint8).reshape(columns, 8, n)
    return [np.ascontiguousarray(c.T).view("<i8").ravel() for c in planes]


def starts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    return np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)])) if len(columns[0]) else np.empty(0, np.int64)


def part_of(p: np.ndarray, w: np.ndarray, parts: int) -> np.ndarray:
    """The part of each pair, by its hash, so that a very common word's pairs are in all parts."""
    h = p.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ w.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return ((h >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def _counts(state: DataFrame, k: int, parts: int) -> DataFrame:
    """(part, block, size, pairs): how often each phrase of k words goes on to each word, for each block and part of the pairs (p, w, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                p, w, _ = extended(*_lists(batch, i), k)
                order = np.lexsort((w, p))
                p, w = p[order], w[order]
                first = starts(p, w)
                n = np.diff(first, append=len(p))
                p, w = p[first], w[first]
                part = part_of(p, w, parts)
                order = np.argsort(part, kind="stable")
                p, w, n, part = p[order], w[order], n[order], part[order]
                lo = starts(part)
                hi = np.append(lo, len(part))[1:]
                pairs = [pack(np.diff(p[a:b], prepend=0), w[a:b], n[a:b]) for a, b in zip(lo, hi, strict=True)]
                block = np.full(len(lo), batch["block"][i].as_py(), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(part[lo]), pa.array(block), pa.array(hi - lo), pa.array(pairs, pa.binary())], names=["part", "block", "size", "pairs"])

    return state.drop("lang").mapInArrow(run, "part long, block long, size long, pairs binary")


def _frequent_pairs(counts: DataFrame, least: int, parts: int, work: Scratch) -> tuple[DataFrame, DataFrame]:
    """From `_counts`: the frequent pairs (p, w, f, id), and for each block and part those of the block (block, size, pairs), as (p, w, id); saved."""

    def run(group: pa.Table) -> pa.Table:
        part, sizes = group["part"][0].as_py(), group["size"].to_numpy()
        steps, w, n = (np.concatenate(c) for c in zip(*(unpack(x.as_py(), m) for x, m in zip(group["pairs"], sizes, strict=True)), strict=True))
        ends = np.cumsum(sizes)
        p = np.concatenate([np.cumsum(steps[b - m : b]) for b, m in zip(ends, sizes, strict=True)])
        order = np.lexsort((w, p))
        first = starts(p[order], w[order])
        f = np.add.reduceat(n[order], first)
        ids = np.where(f >= least, (np.cumsum(f >= least) - 1) * parts + part, -1)
        name = np.empty(len(p), np.int64)
        name[order] = np.repeat(ids, np.diff(first, append=len(p)))
        rows = []
        for block, b, m in zip(group["block"].to_pylist(), ends, sizes, strict=True):
            some = np.flatnonzero(name[b - m : b] >= 0) + b - m
            if len(some):
                rows.append({"block": block, "size": len(some), "pairs": pack(np.diff(p[some], prepend=0), w[some], np.diff(name[some], prepend=0))})
        if rows:
            some = order[first[f >= least]]
            rows.append({"p": p[some], "w": w[some], "f": f[f >= least], "id": name[some]})
        long = pa.list_(pa.int64())
        return pa.Table.from_pylist(rows, pa.schema([("block", pa.int64()), ("size", pa.int64()), ("pairs", pa.binary()), ("p", long), ("w", long), ("f", long), ("id", long)]))

    some = counts.groupBy("part").applyInArrow(run, "block long, size long, pairs binary, p array<long>, w array<long>, f array<long>, id array<long>")
    some = work.save(some)
    work.free()
    return some.where("block is null").select(F.inline(F.arrays_zip("p", "w", "f", "id"))), some


def places(own: tuple[np.ndarray, np.ndarray], pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The place of each pair among `own`, different pairs in any order, or -1."""
    key, other = np.zeros(len(own[0]), np.int64), np.zeros(len(pairs[0]), np.int64)
    if not len(key):
        return other - 1
    ok = True
    for x, y in zip(own, pairs, strict=True):
        known, code = np.unique(x, return_inverse=True)
        j = np.minimum(np.searchsorted(known, y), len(known) - 1)
        ok = ok & (known[j] == y)
        key, other = key * len(known) + code, other * len(known) + j
    order = np.argsort(key)
    j = order[np.minimum(np.searchsorted(key, other, sorter=order), len(key) - 1)]
    return np.where(ok & (key[j] == other), j, -1)


def _longer(state: DataFrame, names: DataFrame, k: int, work: Scratch) -> DataFrame:
    """Blocks with the lists of frequent phrases of k + 1 words, and postings of the words that these may go on to."""
    both = state.join(names, F.col("block") == F.col("of")).drop("of").select(*state.columns, F.col("names.size").alias("size"), F.col("names.pairs").alias("pairs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                phrases, words = _lists(batch, i)
                p, w, at = extended(phrases, words, k)
                own = [unpack(x, m) for x, m in zip(batch["pairs"][i].as_py(), batch["size"][i].as_py(), strict=True)]
                own_p, own_w, name = (np.concatenate(c) for c in zip(*((np.cumsum(a), b, np.cumsum(c)) for a, b, c in own), strict=True))
                j = places((own_p, own_w), (p, w))
                at, ids = at[j >= 0], name[j[j >= 0]]
                word_ids, word_at = flat(*words)
                # words stand one after a phrase's end, or can't be met
                keep, _ = meet(word_at - k - 1, at)
                yield _row(batch["block"][i], batch["lang"][i], packed(ids, at), packed(word_ids[keep], word_at[keep]))

    return work.save(both.mapInArrow(run, state.schema), by="block")


def frequent_phrases(df: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, block: int = BLOCK, work: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases up to `longest` words with f >= least, and (lang, n), all words of each language."""
    work = work or Scratch(df.sparkSession, "phrases")
    blocks = _blocks(df, text, lang, block, work)
    listed = blocks.select("lang", "block", F.posexplode(F.arrays_zip("words", "sizes")).alias("at", "x"))
    counts = listed.select("lang", F.col("x.words").alias("word"), "block", "at", F.col("x.sizes").cast("long").alias("n"))
    totals = blocks.select("lang", F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x).alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    words, rows = _frequent(counts, ["lang", "word"], least, work)
    state = _words(blocks, _named(rows, "at", "id"), work)
    level = words.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("words"), "f", "id")
    found, totals = level, work.save(totals)
    work.drop(blocks, rows)
    work.free()
    last, parts = words.select(F.col("id").alias("w_"), "word"), _parts(df.sparkSession)
    for k in range(1, longest):
        more, rows = _frequent_pairs(_counts(state, k, parts), least, parts, work)
        head = level.select(F.col("id").alias("p_"), "lang", "phrase")
        level = more.join(head, F.col("p") == F.col("p_")).join(last, F.col("w") == F.col("w_"))
        level = work.save(level.select("lang", F.concat_ws(" ", "phrase", "word").alias("phrase"), F.lit(k + 1).alias("words"), "f", "id"))
        found = found.unionByName(level)
        if k + 1 < longest:
            before, state = state, _longer(state, _named(rows.where("block is not null"), "size", "pairs"), k, work)
            work.drop(before)
            work.free()
        work.drop(rows)
    work.drop(state)
    return work.save(found.drop("id")), totals


def _sub(first: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice(F.split("phrase", " "), first, n), " ")


def score(a: str, n: str, l: str, r: str) -> Column:  # noqa: E741
    """floor(1000 a n / (l r)) for counts of up to 15 digits, exactly: products have up to 34."""
    wide = lambda c: f"cast({c} as decimal(16,0))"
    return F.expr(f"(1000BD * {wide(a)} * {wide(n)}) div ({wide(l)} * {wide(r)})")


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """The first `top` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase's score is the least over its cuts of floor(1000 a n / (l r)), with l and r the frequencies of both parts; phrases inside
    a longer one that is as frequent are left out."""
    work = Scratch(df.sparkSession, "phrases")
    found, totals = frequent_phrases(df, text, lang, least, longest, block, work)
    candidates = found.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    # what is inside a phrase two words longer is also inside one that is one longer, with a frequency between
    inner = candidates.where("words > 2").select("lang", F.explode(F.array(_sub(F.lit(1), F.col("words") - 1), _sub(F.lit(2), F.col("words") - 1))).alias("phrase"), "a").distinct()
    cuts = candidates.join(inner, ["lang", "phrase", "a"], "left_anti").join(totals, "lang").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumns({"left": _sub(F.lit(1), F.col("k")), "right": _sub(F.col("k") + 1, F.col("words") - F.col("k"))})
    for side, out in (("left", "l"), ("right", "r")):
        of = found.select(F.col("lang").alias("lang_"), F.col("phrase").alias("part_"), F.col("f").alias(out))
        cuts = cuts.join(of, (F.col("lang") == F.col("lang_")) & (F.col(side) == F.col("part_"))).drop("lang_", "part_")
    cuts = cuts.withColumn("score", score("a", "n", "l", "r"))
    # lowest score first, then smallest k
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score")
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_sql() -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    grams = " UNION ALL ".join(f"SELECT lang, {k} AS words, array_to_string(w[i : i + {k - 1}], ' ') AS phrase FROM (SELECT lang, w, unnest(range(1, len(w) - {k - 2})) AS i FROM p WHERE len(w) >= {k})" for k in range(1, LONGEST + 1))
    return (
        f"WITH p AS (SELECT lang, regexp_extract_all(piece, '[^ \\t]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({lower}, '[.,;:!?\\n\\x0B\\x0C\\r]')) AS piece FROM documents)), "
        f"f AS (SELECT lang, words, phrase, count(*) AS f FROM ({grams}) GROUP BY ALL HAVING count(*) >= {LEAST}), "
        "t AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang), c AS (SELECT lang, words, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE words > 1), "
        f"s AS (SELECT DISTINCT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, a FROM (SELECT *, unnest(range(1, words - m + 2)) AS i FROM (SELECT *, unnest(range(2, words)) AS m FROM c))), "
        "k AS (SELECT lang, phrase, a, w, unnest(range(1, words)) AS k FROM c ANTI JOIN s USING (lang, phrase, a)), "
        "x AS (SELECT k.lang, k.phrase, a, k, l.f AS l, r.f AS r, n, (1000 * a::HUGEINT * n::HUGEINT) // (l.f::HUGEINT * r.f::HUGEINT) AS score FROM k JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(w[1 : k], ' ') "
        "JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(w[k + 1 :], ' ') JOIN t ON t.lang = k.lang), "
        "b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1), "
        "o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b) "
        f"SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM o WHERE rank <= {TOP}"
    )
