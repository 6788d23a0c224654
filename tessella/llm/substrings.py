"""Substring deduplication by relative Lempel-Ziv parsing against reference blocks.

Every text is a reference for every other. The least hash of the short phrases (`PHRASE` words) in a window of `WINDOW` words
is the window's anchor; equal windows have equal anchors. Texts are cut into passages, runs of windows with one anchor, and
the different passages with one anchor are an indexed reference block: whatever a passage shares for a window's length with
any text of the corpus stands in its own block, so parsing it against that block is parsing it against all of them.

Each passage is factored greedily against its block: a factor is the longest sequence of words from where it begins that
also starts at another place of the block (`longest_matches`: the block's suffixes are sorted by doubling, and of all of them
a neighbour in that order shares most). A factor of a window's length or more is a duplicate span; the windows that cross the end
of a factor are checked by the longest match from their own first word. A passage that stands elsewhere as a whole needs
no factors: all its windows are duplicates.

Blocks may be large (a passage that a third of all documents share): passages are counted with map-side sums and each
different one is indexed once. Where a block has more than `BLOCK` different passages, its windows are counted by an
aggregation over all of them instead, which gives the same spans with any number of tasks.

Defined results: a null text counts as empty; a text with fewer words than a window keeps all; rows that repeat doc_id and
text count as occurrences of their windows, and so lose them; an empty table gives an empty result. Only doc_id and the
text column are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, chunks, partitions, row_key, table, text_or_empty

WINDOW, PHRASE = 35, 8
#: Windows of a factor at most; longer runs are parted.
LONGEST = 28
#: Different passages of a block that one task indexes at most.
BLOCK = 4096
U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE = _mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
BASE = 0x2545F4914F6CDD1D | 3
INVERSE = pow(BASE, -1, 1 << 64)
SPACES = np.zeros(256, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


class Powers:
    """Powers of the base and of its inverse modulo 2 ** 64, as far as they were needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            n = 1 << n.bit_length()
            self.up, self.down = (np.multiply.accumulate(np.append(U(1), np.full(n - 1, b, dtype=U))) for b in (BASE, INVERSE))
        return self.up, self.down


def _spans_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    """A hash of values[start:end] for each start and end."""
    up, down = powers.get(len(values) + 1)
    sums = np.append(U(0), np.add.accumulate(values * up[: len(values)]))
    return (sums[end] - sums[start]) * down[start]


def word_hashes(texts: list[bytes], powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after another, and the text of each."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    space = SPACES[raw]
    inside = ~space
    first = np.flatnonzero(inside & np.append(True, space[:-1]))
    last = np.flatnonzero(inside & np.append(space[1:], True)) + 1
    ends = np.cumsum(np.array([len(t) + 1 for t in texts]))
    of = np.searchsorted(ends, first, side="right")
    return _mix(_spans_hash(BYTE[raw], first, last, powers) + (last - first).astype(U)), of


def windows_of(words: np.ndarray, of: np.ndarray, powers: Powers, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, hashes and anchors of all windows that lie within one text."""
    n = len(words) - window + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, U), np.empty(0, U)
    at = np.arange(len(words) - phrase + 1)
    least = _mix(_spans_hash(words, at, at + phrase, powers))
    need, have = window - phrase + 1, 1
    while 2 * have <= need:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < need:
        least = np.minimum(least[: len(least) - (need - have)], least[need - have :])
    start = np.flatnonzero(of[:n] == of[window - 1 :])
    return start, _mix(_spans_hash(words, start, start + window, powers)), least[start]


def passages_of(words: np.ndarray, of: np.ndarray, powers: Powers, window: int = WINDOW, phrase: int = PHRASE) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor: anchor, passage hash, text, first window (by word in the text), number of windows, and whether a window repeats inside."""
    start, hashes, anchor = windows_of(words, of, powers, window, phrase)
    if not len(start):
        return {k: np.empty(0, d) for k, d in (("anchor", U), ("passage", U), ("of", np.int64), ("start", np.int64), ("n", np.int64), ("inner", bool))}
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1))
    head = np.flatnonzero(new)
    place = np.arange(len(start)) - np.repeat(head, np.diff(np.append(head, len(start))))
    head = np.flatnonzero(place % LONGEST == 0)
    n = np.diff(np.append(head, len(start)))
    unit = np.repeat(np.arange(len(head)), n)
    inner = np.zeros(len(head), dtype=bool)
    for d in range(1, min(LONGEST, int(n.max()))):
        same = np.flatnonzero(hashes[:-d] == hashes[d:])
        inner[unit[same[unit[same] == unit[same + d]]]] = True
    s = start[head]
    passage = _mix(_spans_hash(words, s, s + n + window - 1, powers) + n.astype(U))
    firsts = np.searchsorted(of, of[s], side="left")
    return {"anchor": anchor[head], "passage": passage, "of": of[s], "start": s - firsts, "n": n, "inner": inner}


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _raw(col: pa.Array) -> list[bytes]:
    return col.cast(pa.binary()).to_pylist()


def parse(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """Passages of (row, text): anchor, passage, row, start, n, inner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            row = batch.column(0)
            for lo, hi in chunks(batch.num_rows, pc.binary_length(batch.column(1)).to_pylist(), 1 << 20):
                f = passages_of(*word_hashes(_raw(batch.column(1).slice(lo, hi - lo)), powers), powers, window, phrase)
                cols = [_signed(f["anchor"]), _signed(f["passage"]), row.slice(lo, hi - lo).take(pa.array(f["of"])), pa.array(f["start"].astype(np.int32)), pa.array(f["n"].astype(np.int32)), pa.array(f["inner"])]
                yield pa.RecordBatch.from_arrays(cols, names=["anchor", "passage", "row", "start", "n", "inner"])

    return docs.mapInArrow(run, "anchor long, passage long, row binary, start int, n int, inner boolean")


def longest_matches(words: np.ndarray, block: np.ndarray, end: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each place the length of the longest sequence of words from there that starts at another place of its block too.

    `end` is where a place's passage ends, which no sequence crosses; a place counts `weight` times."""
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.int64)
    here = np.arange(n)
    rank = lambda high, low: np.unique(high << 32 | low, return_inverse=True)[1].astype(np.int64)
    number = lambda x: np.unique(x, return_inverse=True)[1].astype(np.int64)
    # ranks[j] orders the sequences of 2 ** j words, cut at their passage's end; the last one orders all suffixes
    ranks = [rank(number(block), number(words))]
    while 1 << len(ranks) - 1 < int((end - here).max()):
        half = 1 << len(ranks) - 1
        after = np.zeros(n, dtype=np.int64)
        at = np.flatnonzero(here + half < end)
        after[at] = ranks[-1][at + half] + 1
        ranks.append(rank(ranks[-1], after))
    order = np.argsort(ranks[-1], kind="stable")
    # of all suffixes of a block, a neighbour in this order shares most
    p, q = order[:-1], order[1:]
    same = np.zeros(n - 1, dtype=np.int64)
    for j in range(len(ranks) - 1, -1, -1):
        at = np.flatnonzero((p + same + (1 << j) <= end[p]) & (q + same + (1 << j) <= end[q]))
        at = at[ranks[j][p[at] + same[at]] == ranks[j][q[at] + same[at]]]
        same[at] += 1 << j
    length = np.zeros(n, dtype=np.int64)
    length[order] = np.maximum(np.append(0, same), np.append(same, 0))
    return np.where(weight > 1, end - here, length)


def duplicate_windows(lists: list[np.ndarray], block: np.ndarray, count: np.ndarray, window: int) -> list[int]:
    """Of passages (their words, the block and how often each stands in the corpus): a bit for each window that starts elsewhere too."""
    sizes = np.array([len(x) for x in lists])
    ends = np.cumsum(sizes)
    of = np.repeat(np.arange(len(lists)), sizes)
    length = longest_matches(np.concatenate(lists), block[of], ends[of], count[of])
    hit = np.flatnonzero(length >= window)
    place = hit - (ends - sizes)[of[hit]]
    masks = np.zeros(len(lists), dtype=np.int64)
    np.bitwise_or.at(masks, of[hit], np.int64(1) << place)
    return masks.tolist()


PASSAGE = "anchor long, id long, count int, n int, different long, words array<long>"


def index_passages(chosen: DataFrame, window: int) -> DataFrame:
    """The reference blocks: from (text, list of {anchor, id, start, n, count, different}) the words' hashes of each passage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for k in range(batch.num_rows):
                words, _ = word_hashes(_raw(batch.column(0).slice(k, 1)), powers)
                items = batch.column(1).slice(k, 1).flatten()
                anchor, id_, start, n, count, different = (items.field(i) for i in range(6))
                s, e = start.to_numpy(), start.to_numpy() + n.to_numpy() + window - 1
                for lo, hi in chunks(len(s), (8 * (e - s)).tolist()):
                    lists = [words[x:y].view(np.int64) for x, y in zip(s[lo:hi], e[lo:hi], strict=True)]
                    own = [x.slice(lo, hi - lo) for x in (anchor, id_, count, n, different)]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(lists, pa.list_(pa.int64()))], names=["anchor", "id", "count", "n", "different", "words"])

    return chosen.mapInArrow(run, PASSAGE)


def factor_blocks(index: DataFrame, window: int) -> DataFrame:
    """Masks (anchor, id, mask) of the passages of blocks that come whole and together to a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: pa.Table | None = None

        def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
            # some whole blocks at a time
            anchor = t["anchor"].to_numpy()
            cuts = np.append(np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])), len(anchor))
            sizes = np.diff(cuts)
            for lo, hi in chunks(len(sizes), sizes.tolist(), 8192):
                part = t.slice(cuts[lo], cuts[hi] - cuts[lo]).combine_chunks()
                words = part["words"].chunk(0)
                lists = np.split(words.flatten().to_numpy().view(np.uint64), np.cumsum(pc.list_value_length(words).to_numpy())[:-1])
                masks = duplicate_windows(lists, part["anchor"].to_numpy(), np.minimum(part["count"].to_numpy(), 2), window)
                yield pa.RecordBatch.from_arrays([part["anchor"].chunk(0), part["id"].chunk(0), pa.array(masks, pa.int64())], names=["anchor", "id", "mask"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            left = t if left is None else pa.concat_tables([left, t])
            if not left.num_rows:
                continue
            # the last block may go on in the next batch
            whole = int(np.searchsorted(left["anchor"].to_numpy(), left["anchor"][-1].as_py()))
            if whole:
                yield from out(left.slice(0, whole))
                left = left.slice(whole)
        if left is not None and left.num_rows:
            yield from out(left)

    dealt = index.repartition(partitions(index.sparkSession), "anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, "anchor long, id long, mask long")


def count_windows(index: DataFrame, window: int) -> DataFrame:
    """The same masks, by counting all windows of a block: for blocks of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            anchor, id_, count, n = (batch.column(i).to_numpy() for i in range(4))
            words = batch.column(5)
            flat, size = words.flatten().to_numpy().view(np.uint64), pc.list_value_length(words).to_numpy()
            first = np.cumsum(size) - size
            at = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            s = first[at] + place
            h = [_signed(_mix(_spans_hash(x, s, s + window, powers))) for x in (flat, _mix(flat))]
            yield pa.RecordBatch.from_arrays([pa.array(anchor[at]), pa.array(id_[at]), *h, pa.array(place.astype(np.int32)), pa.array(count[at])], names=["anchor", "id", "h1", "h2", "place", "count"])

    windows = index.mapInArrow(run, "anchor long, id long, h1 long, h2 long, place int, count int")
    twice = windows.groupBy("anchor", "h1", "h2").agg(F.sum("count").alias("count")).where("count > 1").drop("count")
    return windows.join(twice, ["anchor", "h1", "h2"]).groupBy("anchor", "id").agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("mask"))


def repeated_windows(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, block: int = BLOCK) -> DataFrame:
    """Of (row, text): row and a list of {start, n, mask}: those of the n windows from start whose bit is set also start elsewhere."""
    work = Scratch(docs.sparkSession, "substrings")
    units = work.save(parse(docs, window, phrase))
    blocks = work.save(units.groupBy("anchor").agg(F.count("*").alias("size"), F.max("inner").alias("any_inner")).where("size > 1 or any_inner").select("anchor"))
    shared = work.save(units.join(blocks, "anchor").withColumnRenamed("passage", "id"))
    work.drop(units, blocks)
    passages = work.save(shared.groupBy("anchor", "id").agg(F.count("*").alias("count"), F.max("inner").alias("inner"), F.min(F.struct("row", "start", "n")).alias("at")))
    mixed = work.save(passages.groupBy("anchor").agg(F.count("*").alias("different"), F.max("inner").alias("inner")).where("different > 1 or inner").select("anchor", "different"))
    # one occurrence of each different passage of a mixed block is indexed, by way of its text
    chosen = passages.join(mixed, "anchor").select(F.col("at.row").alias("row"), F.struct("anchor", "id", "at.start", "at.n", F.least("count", F.lit(2)).cast("int").alias("count"), "different").alias("x"))
    lists = chosen.groupBy("row").agg(F.collect_list("x").alias("xs"))
    once = docs.join(lists.withColumnRenamed("row", "of"), F.col("row") == F.col("of")).dropDuplicates(["row"])
    index = work.save(index_passages(once.select("text", "xs"), window))
    work.drop(passages)
    work.free()
    found = factor_blocks(index.where(F.col("different") <= block), window).unionByName(count_windows(index.where(F.col("different") > block), window))
    masks = work.save(found.where("mask <> 0"))
    work.drop(index)
    whole = shared.join(mixed, "anchor", "left_anti").withColumn("mask", F.expr("shiftleft(1L, n) - 1"))
    part = shared.join(masks, ["anchor", "id"])
    marks = whole.select("row", "start", "n", "mask").unionByName(part.select("row", "start", "n", "mask"))
    out = work.save(marks.distinct().groupBy("row").agg(F.collect_list(F.struct("start", "n", "mask")).alias("marks")))
    work.drop(shared, mixed, masks)
    work.free()
    return out


def removed_words(n_words: int, marks: list[tuple[np.ndarray, ...]] | None, window: int) -> np.ndarray:
    """Which words the marked windows cover."""
    cover = np.zeros(n_words + 1, dtype=np.int64)
    if marks is not None:
        start, n, mask = marks
        at = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        hit = mask[at] >> place & 1 == 1
        s = (start[at] + place)[hit]
        np.add.at(cover, s, 1)
        np.add.at(cover, s + window, -1)
    return np.cumsum(cover[:-1]) > 0


def remove_repeats(df: DataFrame, text: str = "text", window: int = WINDOW, phrase: int = PHRASE, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that no repeated window covers, joined by single spaces) of each row."""
    if not phrase <= window:
        raise ValueError("a phrase is no longer than a window")
    docs = df.select("doc_id", row_key(text).alias("row"), text_or_empty(text).alias("text"))
    marks = repeated_windows(docs.select("row", "text"), window, phrase, block)
    joined = docs.join(marks.withColumnRenamed("row", "of"), F.col("row") == F.col("of"), "left").select("doc_id", "text", "marks")
    schema = docs.select("doc_id").schema.add("n_words", "long").add("n_removed", "long").add("kept", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in chunks(batch.num_rows, pc.binary_length(batch.column(1)).to_pylist()):
                part, total, lost, kept = batch.slice(lo, hi - lo), [], [], []
                lists = part.column(2)
                for k, raw in enumerate(_raw(part.column(1))):
                    words = raw.split()
                    gone = None
                    if lists[k].is_valid:
                        items = lists[k].values
                        gone = removed_words(len(words), [items.field(i).to_numpy().astype(np.int64) for i in range(3)], window)
                    total.append(len(words))
                    lost.append(0 if gone is None else int(gone.sum()))
                    kept.append(b" ".join(words if gone is None else [words[i] for i in np.flatnonzero(~gone)]).decode())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(total, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.string())], names=schema.names)

    return joined.mapInArrow(run, schema)


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_sql(window: int = WINDOW) -> str:
    return (
        "WITH d AS (SELECT row_number() OVER () r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') w FROM documents), "
        "p AS (SELECT r, unnest(w) word, generate_subscripts(w, 1) i FROM d), "
        f"s AS (SELECT r, i, md5(array_to_string(w[i : i + {window - 1}], ' ')) h FROM (SELECT r, w, unnest(range(1, len(w) - {window - 2})) i FROM d WHERE len(w) >= {window})), "
        "x AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) c FROM s) WHERE c > 1), "
        f"m AS (SELECT p.r, p.i, word, max(CASE WHEN x.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY p.r ORDER BY p.i ROWS {window - 1} PRECEDING) gone FROM p LEFT JOIN x ON p.r = x.r AND p.i = x.i), "
        "k AS (SELECT r, sum(gone)::BIGINT gone, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) kept FROM m GROUP BY r) "
        "SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)"
    )
