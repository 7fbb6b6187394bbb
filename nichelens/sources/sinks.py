"""Writing results: ranking report, append-only tables, versioned tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_ranking_csv(ranking: DataFrame, path: str) -> None:
    """The ranking report as CSV with blanks for NULL; it is niche-sized by nature."""
    ranking.coalesce(1).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


def append(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Append rows of one run, partitioned so that later reads prune by run or date.

    Rows are clustered by the partition columns first, which keeps the number of
    files per partition small; AQE splits a partition that is too large.
    """
    rows = df.hint("rebalance", *partition_by) if partition_by else df
    writer = rows.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def upsert(
    current: DataFrame,
    incoming: DataFrame,
    keys: Sequence[str],
    update: dict[str, Column] | None = None,
    fill_only: Sequence[str] = (),
) -> DataFrame:
    """New version of a keyed table.

    Incoming values replace stored ones; columns in ``fill_only`` are taken only
    where the stored value is NULL. ``update`` may override a column with an
    expression over ``column`` and ``new_column``. Parquet has no MERGE, so the
    caller writes the result as the next version.
    """
    update = update or {}
    values = [c for c in current.columns if c not in keys]
    fresh = incoming.select(*keys, *[F.col(c).alias(f"new_{c}") for c in values if c in incoming.columns])
    arrived = fresh.withColumn("_arrived", F.lit(True))
    joined = current.join(arrived, list(keys), "full")

    def merged(c: str) -> Column:
        if c in update:
            return update[c].alias(c)
        if c not in incoming.columns:
            return F.col(c)
        if c in fill_only:
            return F.coalesce(c, f"new_{c}").alias(c)
        return F.when(F.col("_arrived"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)

    return joined.select(*keys, *[merged(c) for c in values])


#: Partition column of a bucketed table.
BUCKET = "bucket"


def key_bucket(keys: Sequence[str], buckets: int) -> Column:
    """Number of the bucket that a key belongs to; keys with a NULL have one too."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets).cast("long")).cast("int").alias(BUCKET)


def write_buckets(df: DataFrame, path: str, keys: Sequence[str], buckets: int) -> None:
    """A keyed table as one folder a bucket; what is there of the buckets of ``df`` is replaced, the rest stays."""
    rows = df.withColumn(BUCKET, key_bucket(keys, buckets)).hint("rebalance", BUCKET)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


def read_buckets(spark: SparkSession, path: str, touched: Sequence[int] | None = None) -> DataFrame:
    """The table without its bucket column; with ``touched``, of those buckets only, and no other is listed."""
    rows = spark.read.parquet(path)
    if touched is not None:
        rows = rows.filter(F.col(BUCKET).isin(list(touched)))
    return rows.drop(BUCKET)


def upsert_buckets(
    spark: SparkSession,
    path: str,
    incoming: DataFrame,
    keys: Sequence[str],
    buckets: int,
    update: dict[str, Column] | None = None,
    fill_only: Sequence[str] = (),
) -> list[int]:
    """:func:`upsert` into a bucketed table in place; gives the buckets that were rewritten.

    Only buckets that hold an incoming key are read and written. New files stand
    beside the old ones until the job ends, and a run that failed can be
    repeated: the same rows upserted again give the same table. ``buckets`` must
    be the number the table was written with; it bounds what reaches the driver.
    """
    numbers = incoming.select(key_bucket(keys, buckets)).distinct()
    touched = sorted(r[BUCKET] for r in numbers.collect())
    if touched:
        current = read_buckets(spark, path, touched)
        write_buckets(upsert(current, incoming, keys, update, fill_only), path, keys, buckets)
    return touched


def write_version(df: DataFrame, table_path: str, version: int) -> str:
    """Write a complete table version next to the older ones and return its path."""
    path = f"{table_path}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path
