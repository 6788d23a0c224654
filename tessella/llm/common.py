"""What the operators of this subpackage share: reading tables, and tables in the shared folder that cut lineage."""

from __future__ import annotations

import gc
import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a longest run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir where the cluster names it, a temporary one of our own only where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = at.get() if at.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='tessella-')}"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


class Scratch:
    """Tables written to the shared folder: each cuts lineage and survives lost executors."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def save(self, df: DataFrame, by: str | None = None) -> DataFrame:
        """The table, written and read again; with `by` in as many buckets of that column as shuffles have partitions, so that joins on it leave the table where it is."""
        self.n += 1
        at = f"{self.root}/{self.n}"
        if by:
            name = f"{self.root.rsplit('/', 1)[-1].replace('-', '_')}_{self.n}"
            df.write.option("compression", "zstd").option("path", at).bucketBy(partitions(self.spark), by).saveAsTable(name)
            out = self.spark.table(name)
            out._tessella_at, out._tessella_table = at, name
            return out
        df.write.option("compression", "zstd").parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._tessella_at = at
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no later plan reads."""
        for df in tables:
            if name := getattr(df, "_tessella_table", None):
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df._tessella_at)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def keep(self, *tables: DataFrame) -> None:
        """Deletes all tables that were saved here but these."""
        kept = {df._tessella_at for df in tables}
        for at in [f"{self.root}/{k + 1}" for k in range(self.n)]:
            if at not in kept:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def free(self) -> None:
        """Lets Spark delete the shuffle files of jobs whose results are saved; else they stay until the driver happens to collect garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def row_key(text: str = "text") -> Column:
    """128 bits that name a row by its doc_id and text; rows with both equal share it."""
    return F.unhex(F.md5(F.concat_ws("\0", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), text_or_empty(text))))


#: Bits of the filter that tells, before a shuffle, which rows a join needs.
FILTER = 1 << 25


def may_have(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows of df whose key is in wanted (one column), and a few others: as large a share as wanted has of `FILTER`. Broadcasts `FILTER` bits at most, whatever the input."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER)) + 1
    own = wanted.select(slot(wanted.columns[0]).alias("slot__"))
    bits = own.groupBy(F.bitmap_bucket_number("slot__").alias("bucket__")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot__")).alias("bits__"))
    some = df.withColumn("slot__", slot(key)).join(F.broadcast(bits), F.bitmap_bucket_number("slot__") == F.col("bucket__"))
    some = some.where("(cast(conv(hex(substring(bits__, cast(bitmap_bit_position(slot__) div 8 as int) + 1, 1)), 16, 10) as int) & shiftleft(1, cast(bitmap_bit_position(slot__) % 8 as int))) <> 0")
    return some.select(*df.columns)


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table from the driver's values, without Python workers: its rows stand in the plan as one JSON text."""
    names = [x.split()[0] for x in schema.split(", ")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    fields = ", ".join(":".join(x.split(" ", 1)) for x in schema.split(", "))
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{fields}>>")))


def unused(df: DataFrame, name: str) -> str:
    """A column name like this one that df doesn't have."""
    while name in df.columns:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def chunks(rows: int, sizes, most: int = 4 << 20):
    """(start, end) of runs of rows whose sizes sum to about `most`, one row at least: bounds what a worker holds beside its Arrow batch."""
    start = total = 0
    for i in range(rows):
        if i > start and total + sizes[i] > most:
            yield start, i
            start, total = i, 0
        total += sizes[i]
    if rows > start:
        yield start, rows
