"""Results kept in Parquet under the hash of what they were made from."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def content_key(parts: dict) -> str:
    """SHA-1 of the sorted JSON of ``parts``."""
    return hashlib.sha1(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def kept(spark: SparkSession, root: str, parts: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """The table of ``parts`` below ``root``: read if it was finished before, else built and written.

    A table without its success mark (a run that broke off) is built again.
    """
    path = f"{root.rstrip('/')}/{content_key(parts)}.parquet"
    if not _exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def save_features(features: DataFrame, graphs: DataFrame, path: str) -> None:
    """Features keyed by graph_id together with the hash of each graph they were made from."""
    features.join(graphs.select("graph_id", "graph_hash"), "graph_id").write.mode("overwrite").parquet(path)


def load_features(spark: SparkSession, path: str, graphs: DataFrame) -> DataFrame:
    """Stored features of the graphs whose hash is still the same."""
    held = spark.read.parquet(path)
    return held.join(graphs.select("graph_id", "graph_hash"), ["graph_id", "graph_hash"], "left_semi")
