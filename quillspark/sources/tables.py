"""Parquet tables and text sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Rows of Word files, of long and of short texts that one task takes: some seconds to half a minute of work.
FILES, TEXTS, ROWS = 2_000, 20_000, 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Dealt out over the cores where a scan has fewer splits than cores, as small files have.

    For work that is heavy per row; a scan with enough splits is left as it is, without a shuffle.  Splits say little where
    a table has few row groups, as a group is read by one task however many splits it lies in: with ``rows``, the narrow rows of a table are
    counted (from its footers) and dealt out, about so many to a task, so tasks grow in number and not in size.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if rows is not None:
        return df.repartition(max(cores, -(-df.count() // rows)))
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """Dealt out by columns over all shuffle partitions, before joins on them and work that is heavy per row.

    Adaptive execution keeps a number that is given; else it joins partitions by their bytes, and few bytes of much work come to one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
