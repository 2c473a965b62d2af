"""Order-dependent operators that never put one series into one task.

A series (one location, one file) can hold a large share of all rows, so a
window partitioned by the series alone would not scale.  Windows here run inside
chunks of a series; what has to cross a chunk border travels separately.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loadcast.params import BROADCAST_ROWS
from loadcast.sources.scratch import materialize

CHUNK_BITS = 18


def attach(df: DataFrame, dim: DataFrame, keys: Sequence[str], rows: int | None = None, how: str = "left") -> DataFrame:
    """Equi-join a dimension table.

    ``rows`` is a proven upper bound on the dimension's row count (for example
    the number of configured sites).  Within the broadcast limit the dimension
    is broadcast; without a bound, or beyond it, the join is left to adaptive
    execution, which decides on measured sizes and splits skewed keys.
    """
    if rows is not None and rows <= BROADCAST_ROWS:
        dim = F.broadcast(dim)
    return df.join(dim, list(keys), how)


def join_nulls(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a NULL key meets a NULL key."""
    other = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = [left[k].eqNullSafe(other[f"_right_{k}"]) for k in keys]
    return left.join(other, on, how).drop(*[f"_right_{k}" for k in keys])


def previous_row(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Mapping[str, str],
    chunk: Column,
) -> DataFrame:
    """Add ``values`` (new name -> column) taken from the previous row of a series.

    ``chunk`` must not decrease along the order.  A window works inside chunks.
    What crosses a border is the last row of the chunk before: one row per chunk
    (with calendar chunks, one per month) goes through a window by series and is
    joined to the chunk's first row, along the partitioning the rows have.
    """
    inside = W.partitionBy(*keys, "_chunk").orderBy(*order)
    current = F.struct(*[F.col(c).alias(n) for n, c in values.items()])
    marked = df.withColumn("_chunk", chunk).withColumns(
        {
            "_prev": F.lag(current).over(inside),
            "_first": F.lag(F.lit(1)).over(inside).isNull(),
            "_last": F.lead(F.lit(1)).over(inside).isNull(),
        }
    )
    tails = marked.filter("_last").select(*keys, "_chunk", current.alias("_tail"))
    along = W.partitionBy(*keys).orderBy("_chunk")
    borders = tails.select(*keys, "_chunk", F.lag("_tail").over(along).alias("_carry"))
    carried = join_nulls(marked, borders, [*keys, "_chunk"], "left")
    picked = {
        n: F.when(F.col("_first"), F.col(f"_carry.{n}")).otherwise(F.col(f"_prev.{n}")) for n in values
    }
    return carried.withColumns(picked).drop("_chunk", "_prev", "_first", "_last", "_carry")


def month_chunk(t: str | Column) -> Column:
    """Calendar chunk: one number per month, increasing with time."""
    return F.year(t) * 12 + F.month(t)


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, row: str = "row", total: str = "total"
) -> DataFrame:
    """Add the row number within a series and the series' row count.

    Rows are numbered inside chunks; the chunks' counts, one row per chunk, give
    the offsets.  ``chunk`` must not decrease along the order.
    """
    cut = df.withColumn("_chunk", chunk)
    along = W.partitionBy(*keys).orderBy("_chunk")
    counts = cut.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        *keys,
        "_chunk",
        (F.sum("_n").over(along) - F.col("_n")).alias("_offset"),
        F.sum("_n").over(W.partitionBy(*keys)).alias(total),
    )
    inside = W.partitionBy(*keys, "_chunk").orderBy(*order)
    numbered = join_nulls(cut.withColumn("_i", F.row_number().over(inside)), offsets, [*keys, "_chunk"])
    return numbered.withColumn(row, F.col("_i") + F.col("_offset")).drop("_chunk", "_i", "_offset")


def range_chunks(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunks: int | None = None
) -> DataFrame:
    """Write ``df`` as a table cut into even, ordered chunks.

    Range partitioning on (keys, order) samples the data, so a series with a
    third of all rows simply covers a third of the ranges; each range is cut
    further every 2**CHUNK_BITS rows, so that chunks spread evenly over tasks.
    ``_chunk`` numbers the chunks and ``_id`` the rows, both increasing along
    each series.  They are
    stored with the rows: later passes, and tasks repeated after an executor
    loss, all see the same cut.  ``order`` must be unique within a series.
    Without ``chunks`` adaptive execution merges neighbouring ranges that are small.
    """
    ranges = df.repartitionByRange(*([chunks] if chunks else []), *keys, *order)
    cut = (
        ranges.sortWithinPartitions(*keys, *order)
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_chunk", F.shiftright("_id", CHUNK_BITS))
    )
    return materialize(cut, "chunks")
