"""Document fingerprints from closed syncmers, matched by position.

A k-mer of `K` units is an anchor if, of its inner units' hashes, the least stands at its first or last place. That depends
on the k-mer alone, so equal passages have equal anchors in any context. Units are the words of a text; texts below `LONG`
characters have anchors of characters too, and those below `SHORT` only these.

`anchors` gives hashes with their positions. A fingerprint chains neighbouring anchors: one 64-bit value for two anchor
hashes and the distance between their positions, so a value that two fingerprints share says that the same two anchors
stand as far from each other in both texts, wherever the passage stands. All anchors of a text count, however many. The
likeness of two fingerprints is their matched share: twice the common values over all values of both.

All is built-in array functions. The next document by descending doc_id comes by one exchange: ids are cut into parts of
near equal bytes (exact counts below probes, as for sharding), and a copy of the row at each cut also goes to the part
above, where it is the last one's next. Rows that repeat doc_id and text are dealt over all parts that they fill.

Defined results: a null text counts as empty; a text of fewer than `K` characters has one anchor, the whole text; an empty
one has the empty fingerprint, which is alike (1) to another empty one only; rows with equal doc_id are ordered by a hash of
their text; a null doc_id is the smallest; a single row is its own next; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.llm.common import Scratch, literal_table, partitions, table, text_or_empty
from tessella.llm.mixing import words_of
from tessella.llm.sharding import LEAST, PARTS, Splitters, row_size

#: Units of a k-mer; characters below which a text has only, or also, anchors of characters.
K, SHORT, LONG = 5, 128, 384
ANCHORS = "array<struct<position:int,hash:bigint>>"


def _kmers(h: Column) -> Column:
    """The closed syncmers of an array of unit hashes: {position, hash}."""

    def one(x: Column, i: Column) -> Column:
        inner = [F.get(h, i + j) for j in range(1, K - 1)]
        last = F.get(h, i + K - 1)
        closed = F.least(x, last) <= F.least(*inner)
        return F.when(closed, F.struct(i.alias("position"), F.xxhash64(x, *inner, last).alias("hash")))

    return F.filter(F.transform(F.slice(h, 1, F.greatest(F.size(h) - (K - 1), F.lit(0))), one), lambda x: x.isNotNull())


def _chain(a: Column) -> Column:
    """A value for each two neighbouring anchors and their distance; the last anchor has one of its own."""

    def one(x: Column, i: Column) -> Column:
        after = F.get(a, i + 1)
        return F.xxhash64(x["hash"], F.coalesce(after["hash"], F.lit(0)), F.coalesce(after["position"] - x["position"], F.lit(0)))

    return F.array_distinct(F.transform(a, one))


def with_anchors(df: DataFrame, text: str, words: str, letters: str) -> DataFrame:
    """df with two columns of anchors {position, hash}: of words, and of characters."""
    t, n = text_or_empty(text), F.char_length(text_or_empty(text))
    none = F.array().cast("array<bigint>")
    df = df.withColumns({
        f"__w_{words}": F.when(n >= SHORT, F.transform(words_of(text), lambda w: F.xxhash64(w))).otherwise(none),
        f"__c_{letters}": F.when((n > 0) & (n < LONG), F.transform(F.regexp_extract_all(t, F.lit("(?s)(.)"), F.lit(1)), lambda c: F.xxhash64(c))).otherwise(none),
    })
    w, c = F.col(f"__w_{words}"), F.col(f"__c_{letters}")
    whole = F.array(F.struct(F.lit(0).alias("position"), F.xxhash64(c).alias("hash"))).cast(ANCHORS)
    short = F.when((F.size(c) > 0) & (F.size(c) < K), whole).otherwise(_kmers(c))
    return df.withColumns({words: _kmers(w), letters: short}).drop(f"__w_{words}", f"__c_{letters}")


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the column `out`: the fingerprint as an array of longs."""
    w, c = f"__{out}_words", f"__{out}_letters"
    return with_anchors(df, text, w, c).withColumn(out, F.concat(_chain(F.col(w)), _chain(F.col(c)))).drop(w, c)


def anchors(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns and a row for each anchor: unit (word or letter), position (of its first unit, from 0) and hash."""
    both = with_anchors(df.select(*keep, F.col(text).alias("__text")), "__text", "__words", "__letters")

    def tagged(column: str, unit: str) -> Column:
        return F.transform(column, lambda x: F.struct(F.lit(unit).alias("unit"), x["position"].alias("position"), x["hash"].alias("hash")))

    marks = F.concat(tagged("__words", "word"), tagged("__letters", "letter"))
    return both.select(*keep, F.explode(marks).alias("__x")).select(*keep, "__x.*")


def fingerprint_string(fp: str) -> Column:
    return F.array_join(F.transform(fp, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def likeness(a: str, b: str) -> Column:
    """The matched share of two fingerprints."""
    n = F.size(a) + F.size(b)
    return F.when(n == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / n)


def with_next(df: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """df with next_<c> for each of the columns: its value in the next row by descending doc_id; after the last comes the first."""
    spark = df.sparkSession
    work = Scratch(spark, "syncmers")
    key = ["__d", "__h"]
    df = df.withColumns({"__d": F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)), "__h": F.xxhash64(text_or_empty(text))})
    ids = work.save(df.select(*key, row_size(text).alias("size")))
    parts = min(PARTS, 4 * partitions(spark))  # several to a task, so that tasks are alike in size
    whole, top = ids.agg(F.sum("size"), F.max(F.struct(*key))).first()
    cuts = Splitters(ids, key, parts, (whole or 0) // (parts * 20))
    work.drop(ids)
    # rows of a key that fills several parts are dealt over these
    put = cuts.place(df, "__b").withColumn("__b", F.col("__b") + F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("__b_more") + 1).cast("int"))
    # one row of each key at a cut goes to the part above it, and one of the greatest key to the first
    ends: dict[tuple, list[int]] = {}
    for b, c in enumerate(cuts.cuts):
        ends.setdefault(c, []).append(b + 1)
    if top is not None:
        ends.setdefault(tuple(top), []).append(0)
    above = F.broadcast(literal_table(spark, [(*c, to) for c, to in ends.items()], "__e long, __f long, __to array<int>"))  # as many rows as parts at most
    copies = df.join(above, [df["__d"] == above["__e"], df["__h"] == above["__f"]]).groupBy("__e", "__f", "__to")
    copies = copies.agg(F.first(F.struct(*columns)).alias("__x")).select(F.explode("__to").alias("__b"), F.col("__e").alias("__d"), F.col("__f").alias("__h"), "__x")
    rows = put.select(*[c for c in df.columns if c not in key], *key, "__b", F.struct(*columns).alias("__x"), F.lit(False).alias("__copy"))
    both = rows.unionByName(copies.withColumn("__copy", F.lit(True)), allowMissingColumns=True)
    order = W.partitionBy("__b").orderBy("__copy", F.desc("__d"), F.desc("__h"))
    both = both.withColumn("__next", F.lead("__x").over(order)).where("not __copy")
    return both.select(*[c for c in df.columns if c not in key], *[F.col(f"__next.{c}").alias(f"next_{c}") for c in columns])


def op6_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("text"))
    own = with_next(docs, ["text"])
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (n - third).cast("int")), F.substring(F.col("next_text"), F.lit(1), third))
    own = own.select("doc_id", n.cast("long").alias("n_chars"), "text", "next_text", edited.alias("edited"))
    for column, out in (("text", "fp"), ("next_text", "next_fp"), ("edited", "edited_fp")):
        own = with_fingerprint(own, column, out)
    return own.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint_string("fp").alias("fingerprint"),
        fingerprint_string("edited_fp").alias("edited_fingerprint"),
        likeness("fp", "edited_fp").alias("near_edited"),
        likeness("fp", "next_fp").alias("near_next"),
    )
