"""A stored inverted index with positions, and phrase search over it that reads no texts.

Under the root, `postings/run=<run>/bucket=<k>` holds a row for each term and document with the term's ascending positions and the
document's length, in folders by hash of the term, sorted by term, so that a search reads the folders of its own terms only and skips
row groups of others. `docs` is a `LogIndex` of (id, n_tokens, run): a posting counts where its run is that of its document there. A writer
adds a run of postings first and then its documents in one version, so a search sees all of a batch or nothing, replaced
and removed documents vanish at once, and what a dead writer left counts nowhere.

Terms are runs of letters and digits, lower-cased, without diacritics (precomposed Latin letters count as their base letter, combining
marks as nothing).
"""

from __future__ import annotations

import unicodedata
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.scalar import let
from tessella.operators.logindex import LogIndex
from tessella.operators.search import B, DIGITS, K1, ranked


def _folding() -> tuple[str, str]:
    """Lower-case Latin letters with diacritics and their base letters, and after these the combining marks."""
    pairs = {}
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        base = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if base != c and len(base) == 1 and c == c.lower():
            pairs[c] = base
    return "".join(pairs) + "".join(map(chr, range(0x300, 0x370))), "".join(pairs.values())


FROM, TO = _folding()


def folded(text: Column) -> Column:
    return F.translate(F.lower(text), FROM, TO)


def terms(text: Column) -> Column:
    return F.regexp_extract_all(folded(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def _lists(w: Column) -> Column:
    """Of an array of terms, {term, positions} of each different one: equal terms stand together once they are sorted."""
    placed = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("term"), i.alias("position"))))

    def runs(s: Column) -> Column:
        heads = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1)["term"] != x["term"]), i)), lambda i: i.isNotNull())

        def one(heads: Column) -> Column:
            n = lambda b, k: F.coalesce(F.get(heads, k + 1), F.size(s)) - b
            return F.transform(heads, lambda b, k: F.struct(F.get(s, b)["term"].alias("term"), F.transform(F.slice(s, b + 1, n(b, k)), lambda x: x["position"]).alias("positions")))

        return let(heads, one)

    return let(placed, runs)


def positional(docs: DataFrame, id_: str = "id", text: str = "text") -> DataFrame:
    """(term, id, n_tokens, positions) of documents, positions from 0 and ascending. A document's lists are made where its text is read, without a shuffle."""
    words = docs.select(F.col(id_).alias("id"), terms(F.col(text)).alias("w"))
    return words.select("id", F.size("w").alias("n_tokens"), F.inline(_lists(F.col("w")))).select("term", "id", "n_tokens", "positions")


class PhraseIndex:
    """The index in folder `root`; ids have the type `kind`."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, kind: str = "long") -> None:
        self.spark, self.root, self.buckets, self.kind = spark, root.rstrip("/"), buckets, kind
        self.docs = LogIndex(spark, f"{self.root}/docs", key="id", buckets=buckets)

    def _write(self, postings: DataFrame) -> str:
        run = uuid.uuid4().hex
        dealt = postings.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int"))
        # a common term's rows are dealt by document too
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = dealt.repartitionByRange(n, "bucket", "term", "id").sortWithinPartitions("bucket", "term", "id")
        dealt.write.partitionBy("bucket").parquet(f"{self.root}/postings/run={run}")
        return run

    def add(self, docs: DataFrame, id_: str = "id", text: str = "text") -> int:
        """Adds documents, or puts them in place of those with the same ids; documents without words have a length of 0. Gives the version."""
        run = self._write(positional(docs, id_, text))
        sizes = docs.groupBy(F.col(id_).alias("id")).agg(F.first(F.coalesce(F.size(terms(F.col(text))), F.lit(0))).alias("n_tokens"))
        return self.docs.upsert(sizes.withColumn("run", F.lit(run)))

    def remove(self, ids: DataFrame) -> int:
        """Removes documents by column id."""
        return self.docs.remove(ids)

    def compact(self) -> int:
        """All that counts in one run. The old runs may go once no search reads them."""
        live = self.live(self.postings()).drop("run", "bucket")
        run = self._write(live)
        self.docs.upsert(self.docs.read().withColumn("run", F.lit(run)))
        return self.docs.compact()

    def postings(self) -> DataFrame:
        schema = f"term string, id {self.kind}, n_tokens int, positions array<int>, run string, bucket int"
        return self.spark.read.schema(schema).parquet(f"{self.root}/postings")

    def live(self, postings: DataFrame) -> DataFrame:
        """Postings whose run is their document's."""
        docs = self.docs.read().select(F.col("id").alias("__id"), F.col("run").alias("__run"))
        return postings.join(docs, F.col("id").eqNullSafe(F.col("__id")) & (F.col("run") == F.col("__run")), "left_semi")

    def words(self, phrase: str) -> list[str]:
        """The terms of a phrase, made as those of documents are."""
        return self.spark.range(1).select(terms(F.lit(phrase))).first()[0]

    def matches(self, phrase: str) -> DataFrame:
        """(id, n_tokens, tf) of the documents that hold the phrase: starts are positions p of its first term such that p + k is one of its k-th's."""
        own = self.words(phrase)
        if not own:
            return self.spark.createDataFrame([], f"id {self.kind}, n_tokens int, tf int")
        wanted = sorted(set(own))
        cells = self.spark.createDataFrame([(w,) for w in wanted], "w string").select(F.pmod(F.xxhash64("w"), F.lit(self.buckets)).cast("int")).distinct().collect()
        lists = self.postings().where(F.col("bucket").isin([r[0] for r in cells]) & F.col("term").isin(wanted))
        # a row for each document, with a list for each term of the phrase
        by = lists.groupBy("id", "run", "n_tokens").agg(*[F.max(F.when(F.col("term") == w, F.col("positions"))).alias(f"t{i}") for i, w in enumerate(wanted)])
        by = by.where(" AND ".join(f"t{i} IS NOT NULL" for i in range(len(wanted))))
        starts = F.col(f"t{wanted.index(own[0])}")
        for k, w in enumerate(own[1:], 1):
            starts = F.array_intersect(starts, F.transform(F.col(f"t{wanted.index(w)}"), lambda p: p - F.lit(k)))  # noqa: B023
        found = by.select("id", "run", "n_tokens", F.size(starts).alias("tf")).where("tf > 0")
        return self.live(found).select("id", "n_tokens", "tf")

    def search(self, phrase: str, k: int) -> DataFrame:
        """The k best documents by BM25 of one phrase: id, n_tokens, tf, bm25, rank. Ties go by id."""
        mean = self.docs.read().agg(F.avg("n_tokens").alias("mean_tokens"))
        scored = self.matches(phrase).crossJoin(F.broadcast(mean))  # one row
        score = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n_tokens") / F.col("mean_tokens")))
        return ranked(scored.withColumn("bm25", F.round(score, DIGITS)).drop("mean_tokens"), k, F.desc("bm25"), F.col("id"))
