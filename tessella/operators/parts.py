"""Ordered rows in parts: a key of any size lies in many of them, and sums over its order need no task that sees all of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.session import shared_folder


def in_parts(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """df dealt by range of (by, order) and saved, so that a key's rows lie in any number of parts, one after the other: column `__part`."""
    spark = df.sparkSession
    at = shared_folder(spark, "parts")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(n, *by, *order).withColumn("__part", F.spark_partition_id()).write.parquet(at)
    return spark.read.parquet(at)


def same(by: list[str], prefix: str) -> Column:
    """Whether columns `by` are those of another frame, which has them with a prefix; nulls are the same."""
    return reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"{prefix}{c}")) for c in by], F.lit(True))


def prefix_sum(df: DataFrame, by: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """df with the sum of `value` over the rows of the same key (all rows without `by`) that stand before each row, 0 for the first.

    `order` must tell the rows of a key apart. Sums within parts, and a row for each key and part whose sums give the parts' offsets."""
    parts = in_parts(df.withColumn("__value", value), by, order)
    sums = parts.groupBy(*by, "__part").agg(F.sum("__value").alias("__sum"))
    # as many rows as parts, and one more for each key
    before = W.partitionBy(*by).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    skip = sums.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__part").alias("__of"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__skip"))
    own = W.partitionBy(*by, "__part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    ranked = parts.withColumn("__own", F.coalesce(F.sum("__value").over(own), F.lit(0)))
    both = ranked.join(skip, same(by, "__") & (F.col("__part") == F.col("__of")))
    return both.withColumn(out, F.col("__skip") + F.col("__own")).select(*df.columns, out)
