"""Writing stage results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def write_table(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = ("location", "scenario"),
    fmt: str = "parquet",
    mode: str = "errorifexists",
    order_by: Sequence[str] = (),
) -> None:
    """One folder per key value; a folder with much data is split over tasks.

    The rebalance hint lets adaptive execution gather small keys and split large
    ones, so neither a flood of small files nor a single writer per key occurs.
    ``order_by`` puts the rows of a folder in order, over all its files by name:
    ranges of keys and order take the hint's place, and a folder with much data
    covers several ranges.
    """
    if order_by:
        spread = df.repartitionByRange(*partition_by, *order_by).sortWithinPartitions(*partition_by, *order_by)
    else:
        spread = df.hint("rebalance", *partition_by)
    writer = spread.write.mode(mode).partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True).option("nullValue", "NA").option(
            "timestampNTZFormat", "yyyy-MM-dd HH:mm:ss"
        )
    writer.format(fmt).save(path)


def read_positions(spark: SparkSession, path: str, partition_by: Sequence[str] = ("location", "scenario")) -> DataFrame:
    """A Parquet table of ``write_table`` with ``position``, each row's place in its folder from 1, files taken by name.

    The place in the file comes with the scan; only counts, one row per file, are summed up.
    """
    rows = spark.read.parquet(path)
    for key in partition_by:  # codes such as 26 are text, whatever their folder's name looks like
        rows = rows.withColumn(key, F.col(key).cast("string"))
    rows = rows.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_index"))
    along = W.partitionBy(*partition_by).orderBy("_file")
    sizes = rows.groupBy(*partition_by, "_file").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(*partition_by, "_file", (F.sum("_n").over(along) - F.col("_n")).alias("_before"))
    placed = rows.join(before, [*partition_by, "_file"])
    return placed.withColumn("position", F.col("_before") + F.col("_index") + 1).drop("_file", "_index", "_before")
