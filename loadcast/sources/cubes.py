"""Gridded cubes held as arrays, one row per file or tile.

Expected columns: any keys, ``lon``, ``lat`` and ``hours`` coordinate arrays,
``units`` (text such as 'hours since 1900-01-01 00:00:00.0') and one value array
per variable with longitude running fastest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadcast.functions.calendar import decode_hours


def cube_to_rows(cubes: DataFrame, variables: Sequence[str], keys: Sequence[str] = ("location",)) -> DataFrame:
    """One row per cell and time step; rows with a missing value are dropped.

    All variables are zipped before anything is dropped, so they cannot lose
    alignment.  A cube with a single latitude covers the two-dimensional form.
    """
    cell = F.posexplode(F.arrays_zip(*variables)).alias("_i", "_cell")
    # The time axis is decoded once per cube, not once per cell.
    axis = F.transform("hours", lambda h: decode_hours(F.col("units"), h))
    flat = cubes.withColumn("_times", axis).select(*keys, "lon", "lat", "_times", cell)
    nlon, nlat = F.size("lon"), F.size("lat")
    at = {
        "lon": F.get("lon", F.pmod(F.col("_i"), nlon)),
        "lat": F.get("lat", F.pmod(F.floor(F.col("_i") / nlon), nlat).cast("int")),
        "time": F.get("_times", F.floor(F.col("_i") / (nlon * nlat)).cast("int")),
    }
    rows = flat.select(*keys, *[c.alias(n) for n, c in at.items()], *[F.col("_cell")[v].alias(v) for v in variables])
    return rows.dropna("any")
