"""CSV series, one file per variable, location and interval of a scenario.

Paths follow ``RCP <x.y>/<interval>/<variable>_<location>_<disagg|daily>.csv``;
folders written by Spark (``name=value`` parts, a folder in place of the file)
read the same way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadcast.functions.calendar import parse_time

# Patterns of the path parts.
SCENARIO_PART = r"RCP(?: |%20)([0-9.]+)(?:/|$)"
INTERVAL_PART = r"RCP(?: |%20)[0-9.]+/(?:[a-z]+=)?([^/]+)/"
SERIES_PART = r"/(?:[a-z]+=)?([^/=]+)_([^_/=]+)_(disagg|daily)(?:\.csv|/)"


def path_keys(path: Column) -> dict[str, Column]:
    """Key columns read off a file path; a location's code has no underscore."""
    return {
        "scenario": F.replace(F.regexp_extract(path, SCENARIO_PART, 1), F.lit("."), F.lit("")),
        "interval": F.regexp_extract(path, INTERVAL_PART, 1),
        "variable": F.regexp_extract(path, SERIES_PART, 1),
        "location": F.regexp_extract(path, SERIES_PART, 2),
        "kind": F.regexp_extract(path, SERIES_PART, 3),
    }


def scan_series(spark: SparkSession, paths: str | Sequence[str], kind: str | None = None) -> DataFrame:
    """All series below ``paths`` in one scan.

    The first two columns of each file are time and value, whatever their
    headers; further columns are ignored.  With a ``kind``, a CSV file whose path
    does not follow the pattern stops the query.  Empty cells and ``NA`` are
    missing; ``bad`` tells what else could not be read: ``time``, ``value`` or
    ``time value``, NULL for a sound line.  ``line`` orders the rows of a series:
    file name (a series may be a folder of part files), byte offset of the
    split, then the row counter inside the task that read it.
    """
    raw = (
        spark.read.schema("time string, value string")
        .option("header", True)
        .option("enforceSchema", True)
        .option("nullValue", "NA")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .csv(paths)
    )
    path = F.col("_metadata.file_path")
    found = path_keys(path)["kind"]
    unknown = F.raise_error(F.concat(F.lit("not the path of a series: "), path))
    if kind:
        raw = raw.filter(F.when(found == "", unknown.cast("string")).otherwise(found) == kind)
    line = F.struct(
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    read = {"time": parse_time(F.col("time")), "value": F.trim("value").try_cast("double")}
    failed = [F.when(F.col(c).isNotNull() & (F.trim(c) != "") & v.isNull(), c) for c, v in read.items()]
    return raw.select(
        *[c.alias(n) for n, c in path_keys(path).items()],
        *[v.alias(c) for c, v in read.items()],
        F.nullif(F.concat_ws(" ", *failed), F.lit("")).alias("bad"),
        line.alias("line"),
    )


def bad_lines(series: DataFrame, keys: Sequence[str] = ("location", "scenario", "interval", "variable")) -> DataFrame:
    """Lines per series of ``scan_series``, and how many of them have a time or a value that could not be read."""
    counts = {f"bad_{c}s": F.count_if(F.coalesce(F.contains("bad", F.lit(c)), F.lit(False))) for c in ("time", "value")}
    return series.groupBy(*keys).agg(F.count(F.lit(1)).alias("lines"), *[c.alias(n) for n, c in counts.items()])


def require_sound(series: DataFrame) -> None:
    """Stop with the first of the series that hold lines which could not be read."""
    found = bad_lines(series.filter(F.col("bad").isNotNull())).orderBy(F.desc("lines")).limit(5).collect()
    if found:
        told = "; ".join(f"{r.scenario}/{r.interval}/{r.variable}_{r.location}: {r.bad_times} times, {r.bad_values} values" for r in found)
        raise ValueError(f"lines that cannot be read, on_bad='null' takes them as missing: {told}")


def scan_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A wide CSV table written by an earlier stage, partition folders included."""
    return spark.read.schema(schema).option("header", True).option("nullValue", "NA").csv(path)
