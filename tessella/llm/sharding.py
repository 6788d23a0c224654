"""Sharding by histogram sort: shards of near equal bytes, in one exchange.

Rows are ordered by a hash of their text, then doc_id, then a number that no other row has. The driver refines probes: each
round counts exact bytes and rows below candidate boundaries over all partitions (one aggregation with map-side sums), keeps
for each wanted splitter the one interval that holds its byte position, and divides that again, until every splitter stands
between two neighbouring rows (tolerance 0) or is within `tolerance` bytes. Splitters also cut shards into parts, so that
the one exchange and the ordering within it run on as many tasks as Spark is set to; the exact counts below the splitters
make slots gapless across parts. Equal texts are neighbours; groups of copies and repeated rows are cut like any other.

Law `bytes`: a row's shard is the one in which the bytes before it fall when all bytes are dealt evenly, so no shard is
off by more than the size of one row.

Defined results: a null text has size 1 and checksum 0; rows with equal text and doc_id are ties, which take neighbouring
places in any order; a null doc_id comes first; an empty table gives an empty result; columns of the input stay as they
are (new ones replace those of the same name).
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.llm.common import Scratch, literal_table, partitions, table, text_or_empty

KEY_BITS = 60
#: Candidate boundaries: of the first round, and of each interval in later ones.
FIRST, LATER = 4096, 64
#: Parts of all shards at most; bounds what the driver holds.
PARTS = 4096
#: Rows that each part of a key's rows gets on average at least where these are dealt over several parts.
DEALT = 64
LEAST = -(1 << 63)


def sort_key(text: str = "text") -> Column:
    """60 bits of the text's MD5."""
    return F.conv(F.substring(F.md5(text_or_empty(text)), 1, KEY_BITS // 4), 16, 10).cast("long")


def row_size(text: str = "text") -> Column:
    return F.octet_length(text_or_empty(text)).cast("long") + 1


def _wide(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("decimal(20,0)")


class Splitters:
    """Of rows with long columns `key` and `size`: parts - 1 cuts, each the last key before it, with the rows before it.

    A cut stands behind the last row that has less than the cut's share of all bytes before it. Rows with equal keys are not
    parted: a cut that falls among them stands behind them, and so may several."""

    cuts: list[tuple]
    before: list[int]
    many: dict[tuple, int]

    def __init__(self, rows: DataFrame, key: list[str], parts: int, tolerance: int = 0) -> None:
        self.key, self.cuts, self.before, self.many = key, [], [], {}
        whole = rows.agg(F.sum("size"), F.min(key[0]), F.max(key[0])).first()
        self.total, low, high = whole[0] or 0, whole[1] or 0, whole[2] or 0
        self.low, self.step = low, -(-(high - low + 1) // FIRST)
        if not self.total:
            return
        least, most = F.min(F.struct(*key)).alias("lo"), F.max(F.struct(*key)).alias("hi")
        sums = [F.sum("size").alias("size"), F.count("*").alias("n"), least, most]
        found = sorted((tuple(r.lo), tuple(r.hi), r["size"], r.n) for r in rows.groupBy(self.bucket().alias("b")).agg(*sums).collect())
        want = [-(-self.total * j // parts) for j in range(1, parts)]  # bytes before a cut, at least
        cuts: list[tuple | None] = [None] * (parts - 1)
        open_: dict[tuple, list[int]] = {}
        start: dict[tuple, tuple[int, int]] = {}

        def settle(cells: list[tuple], bytes0: int, rows0: int, of: list[int]) -> None:
            ends = list(accumulate((c[2] for c in cells), initial=bytes0))
            counts = list(accumulate((c[3] for c in cells), initial=rows0))
            for j in of:
                i = min(max(bisect_left(ends, want[j]) - 1, 0), len(cells) - 1)
                lo, hi, _, n = cells[i]
                if lo == hi:
                    self.many[hi] = n
                if lo == hi or ends[i + 1] - want[j] <= tolerance:
                    cuts[j] = (hi, counts[i + 1])
                else:
                    open_.setdefault((lo, hi), []).append(j)
                    start[(lo, hi)] = (ends[i], counts[i])

        settle(found, 0, 0, list(range(parts - 1)))
        while open_:
            todo, at = dict(open_), dict(start)
            open_.clear()
            start.clear()
            spans = []
            for n, (lo, hi) in enumerate(todo):
                level = next(i for i in range(len(key)) if lo[i] != hi[i])  # the first column that differs is divided
                spans.append((n, (lo[0] - low) // self.step, *lo, *hi, level, -(-(hi[level] - lo[level] + 1) // LATER)))
            ends = [f"{c}{e}" for e in "01" for c in key]
            probes = literal_table(rows.sparkSession, spans, ", ".join(["n__ int", "b__ long", *(f"{e} long" for e in ends), "level__ int", "step__ decimal(20,0)"]))
            own = F.struct(*key)
            inside = (own >= F.struct(*ends[: len(key)])) & (own <= F.struct(*ends[len(key) :]))
            # one row for each open splitter at most, parts at most
            hit = rows.withColumn("b__", self.bucket()).join(F.broadcast(probes), "b__").where(inside)
            place = F.coalesce(*[F.when(F.col("level__") == i, _wide(c) - _wide(f"{c}0")) for i, c in enumerate(key)])
            cells = hit.withColumn("at__", place).groupBy("n__", F.expr("at__ div step__").alias("c")).agg(*sums)
            by: dict[int, list[tuple]] = {}
            for r in cells.collect():
                by.setdefault(r.n__, []).append((tuple(r.lo), tuple(r.hi), r["size"], r.n))
            for n, k in enumerate(todo):
                settle(sorted(by[n]), *at[k], todo[k])
        self.cuts, self.before = [c[0] for c in cuts], [c[1] for c in cuts]

    def bucket(self) -> Column:
        """The cell of the first round in which a row's first key column falls."""
        return F.expr(f"cast((cast(`{self.key[0]}` as decimal(20,0)) - {self.low}BD) div {self.step}BD as long)")

    def place(self, df: DataFrame, out: str = "__part") -> DataFrame:
        """df with the part of each row, and in `<out>_more` over how many parts after it the rows of its key may be dealt (all but the first hold no others)."""
        inner: dict[int, list[tuple]] = {}
        for c in self.cuts:
            inner.setdefault((c[0] - self.low) // self.step, []).append(c)
        counts = accumulate((len(inner.get(b, [])) for b in range(FIRST)), initial=0)
        same = Counter(self.cuts)
        more = {c: n - 1 if self.many.get(c, 0) >= DEALT * n else 0 for c, n in same.items()}
        rows = [(b, n, [dict(zip(self.key, c, strict=True)) | {"more__": more[c]} for c in inner.get(b, [])]) for b, n in zip(range(FIRST), counts, strict=False)]
        kind = ",".join([*(f"{c}:long" for c in self.key), "more__:int"])
        lookup = literal_table(df.sparkSession, rows, f"__cell long, __low int, __cuts array<struct<{kind}>>")
        put = df.withColumn("__cell", self.bucket()).join(F.broadcast(lookup), "__cell")  # FIRST rows, PARTS cuts at most
        own = F.struct(*self.key)
        key_of = lambda c: F.struct(*[c[k].alias(k) for k in self.key])
        place = F.col("__low") + F.size(F.filter("__cuts", lambda c: key_of(c) < own))
        at = F.get(F.filter("__cuts", lambda c: key_of(c) == own), F.lit(0))
        return put.withColumns({out: place, f"{out}_more": F.coalesce(at["more__"], F.lit(0))}).drop("__cell", "__low", "__cuts")


def shard(df: DataFrame, shards: int = 16, text: str = "text", tolerance: int = 0, keep: list[str] | None = None) -> DataFrame:
    """The rows of df (its columns `keep`, or all) with size, shard and slot."""
    spark = df.sparkSession
    per = max(1, min(PARTS, partitions(spark)) // shards)
    key, work = ["__k", "__d", "__u"], Scratch(spark, "sharding")
    own = [c for c in (df.columns if keep is None else keep) if c not in ("size", "shard", "slot")]
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST))
    # saved, so that a row's own number is the same whenever it is read
    rows = work.save(df.select(*own, row_size(text).alias("size"), sort_key(text).alias("__k"), doc.alias("__d"), F.monotonically_increasing_id().alias("__u")))
    cuts = Splitters(rows.select(*key, "size"), key, shards * per, tolerance)
    starts = literal_table(spark, list(enumerate([0, *cuts.before])), "__part int, __rows long")
    starts = starts.withColumn("shard", F.expr(f"cast(__part div {per} as int)"))
    starts = starts.withColumn("__from", F.col("__rows") - F.min("__rows").over(W.partitionBy("shard")))
    ranked = cuts.place(rows).withColumn("__at", F.row_number().over(W.partitionBy("__part").orderBy(*key)))
    ranked = ranked.join(F.broadcast(starts), "__part")  # a row for each part
    return ranked.select(*own, "size", "shard", (F.col("__from") + F.col("__at") - 1).alias("slot"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = shard(docs.withColumn("text_crc32", F.crc32(text_or_empty())), keep=["doc_id", "text_crc32"])
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def crc32_sql(blob: str) -> str:
    """DuckDB SQL for the CRC-32 of a blob, byte by byte over a table made from the polynomial."""

    def entry(i: int) -> int:
        for _ in range(8):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        return i

    steps = f"([{', '.join(str(entry(i)) for i in range(256))}]::BIGINT[])"
    values = f"list_transform(regexp_extract_all(hex({blob}), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"CASE WHEN octet_length({blob}) = 0 THEN 0 ELSE xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {values}), lambda c, b: xor(c >> 8, {steps}[(xor(c, b) & 255) + 1]))) END"


def op1_sql(shards: int = 16) -> str:
    return (
        f"WITH d AS (SELECT row_number() OVER () r, doc_id, strlen(coalesce(text, ''))::BIGINT + 1 AS size, ({crc32_sql("encode(coalesce(text, ''))")})::BIGINT AS text_crc32, ('0x' || substr(md5(coalesce(text, '')), 1, {KEY_BITS // 4}))::BIGINT k, coalesce(doc_id, -9223372036854775808) i FROM documents), "
        "c AS (SELECT *, sum(size) OVER (ORDER BY k, i, r ROWS UNBOUNDED PRECEDING) - size below, sum(size) OVER () total FROM d), "
        f"s AS (SELECT *, (below * {shards} // total)::INTEGER AS shard FROM c) "
        "SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY k, i, r) - 1 AS slot, NULL::INTEGER AS grown_shard FROM s"
    )
