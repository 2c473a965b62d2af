"""Tables written once so that several passes can read them.

They are removed when the session's JVM ends.  The folder is the one the cluster names in ``spark.checkpoint.dir``.  Only where
that is unset and the master is local (tests) a temporary folder is used.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
_kept: set[str] = set()


def scratch_dir(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    app = spark.sparkContext.applicationId
    if shared:
        return f"{shared.rstrip('/')}/loadcast-{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="loadcast-")
    return _local_dirs[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    folder = scratch_dir(spark)
    if folder not in _kept:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _kept.add(folder)
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the scratch folder and return it as a Parquet scan."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
