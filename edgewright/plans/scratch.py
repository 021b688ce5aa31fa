"""Tables written to the folder shared by driver and executors.

Operators that need a result twice, or that iterate, cut their lineage by writing
it. The folder is the one named by ``spark.checkpoint.dir``; only where a session
names none (tests, notebooks) a temporary local folder is made. Written tables
survive the loss of any executor.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="edgewright-")
    return _own[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; removed when the driver's process ends."""
    if not _made:
        atexit.register(_remove)
    path = f"{shared_folder(spark)}/edgewright/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def stash(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and return it as a scan of what was written."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove() -> None:
    for spark, path in _made:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001 - the session may be gone already
            continue
