"""Sorted runs of entries in persisted key ranges.

A run is a folder of Parquet files, each sorted by one bigint key and holding one range
of it; a manifest names the runs and the least and largest key of every file. Probes
ask for windows ``[lo, hi]`` of the key order: they are sent to the files whose range
they meet, sorted, and merged with the row groups they fall into. So a run is never
shuffled again and only what lies around a probe is read. Everything lies in one
folder, so another session can open it again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Probed windows are expanded in blocks of this many entries.
BLOCK = 250_000
#: Rows of a row group: the least that is read around a probe.
GROUP_ROWS = 20_000

Visit = Callable[[pa.RecordBatch, pa.Table, np.ndarray, np.ndarray], pa.RecordBatch]


def _local(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a qualified Hadoop path."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def _spans(first: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(probe, entry) of all windows ``[first, end)``, in blocks of bounded size however long a window is."""
    size = np.maximum(end - first, 0)
    before = np.concatenate([[0], np.cumsum(size)])
    for at in range(0, int(before[-1]), BLOCK):
        place = np.arange(at, min(at + BLOCK, before[-1]))
        probe = np.searchsorted(before, place, side="right") - 1
        yield probe, first[probe] + place - before[probe]


class SortedRuns:
    """The runs below ``folder``: several named tables, each with an own key."""

    def __init__(self, spark: SparkSession, folder: str, keys: dict[str, str], fan_in: int = 4, file_rows: int = 500_000) -> None:
        self.spark = spark
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(folder)
        self._fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.folder = self._fs.makeQualified(where).toString()
        self.keys, self.fan_in, self.file_rows = keys, fan_in, file_rows
        #: one entry per run: {"rows": n, "tables": {name: [[path, lo, hi, rows], ...]}}
        self.runs: list[dict] = []
        self._version = 0
        self._open()

    def _path(self, name: str) -> object:
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _open(self) -> None:
        """Take up the latest manifest, if there is any."""
        found = self._fs.globStatus(self._path("manifest-*.json")) or []
        versions = sorted(int(x.getPath().getName()[9:-5]) for x in found)
        if versions:
            self._version = versions[-1]
            text = self.spark.read.text(f"{self.folder}/manifest-{self._version}.json", wholetext=True).first()[0]
            self.runs = json.loads(text)

    def _keep(self) -> None:
        """Write the next manifest, then drop the one before it; a reader finds a whole one at any time."""
        old, self._version = self._version, self._version + 1
        partial = self._path(f"partial-{self._version}")
        out = self._fs.create(partial, True)
        out.write(bytearray(json.dumps(self.runs).encode()))
        out.close()
        self._fs.rename(partial, self._path(f"manifest-{self._version}.json"))
        if old:
            self._fs.delete(self._path(f"manifest-{old}.json"), False)

    def write(self, df: DataFrame, table: str) -> list[list]:
        """``df`` as sorted files of ``table``: path, least and largest key and rows of each. Not yet part of any run."""
        key = self.keys[table]
        path = f"{self.folder}/{table}-{uuid.uuid4().hex}"
        # ties of the key are cut between files by a second column, so no key has to fit one file
        order = [key, *[c for c in df.columns if c != key and df.schema[c].dataType.simpleString() == "bigint"]]
        ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
        ordered.write.option("compression", "zstd").option("parquet.block.row.count.limit", GROUP_ROWS).option("maxRecordsPerFile", self.file_rows).parquet(path)
        files = [x.getPath().toString() for x in self._fs.globStatus(self._path(path[len(self.folder) + 1 :] + "/part-*"))]

        def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name in batch.column(0).to_pylist():
                    system, local = _local(name)
                    told = pq.ParquetFile(local, filesystem=system).metadata
                    at = told.schema.names.index(key)
                    held = [told.row_group(k).column(at).statistics for k in range(told.num_row_groups)]
                    if held:
                        yield pa.RecordBatch.from_pydict({"path": [name], "lo": [min(x.min for x in held)], "hi": [max(x.max for x in held)], "rows": [told.num_rows]})

        if not files:
            return []
        named = self.spark.createDataFrame([(x,) for x in files], "path string")
        return [list(x) for x in named.mapInArrow(footers, "path string, lo bigint, hi bigint, rows bigint").collect()]

    def read(self, files: list[list], schema: str) -> DataFrame:
        """All rows of ``files``."""
        return self.spark.read.schema(schema).parquet(*[x[0] for x in files]) if files else self.spark.createDataFrame([], schema)

    def add(self, **tables: DataFrame) -> None:
        """One more run; runs of like size are compacted when there are ``fan_in`` of them."""
        held = {name: self.write(df, name) for name, df in tables.items()}
        self.runs.append({"rows": sum(x[3] for files in held.values() for x in files), "tables": held})
        self._keep()
        self.compact()

    def _tier(self, run: dict) -> int:
        size, tier = max(run["rows"], 1), 0
        while size >= self.fan_in:
            size, tier = size // self.fan_in, tier + 1
        return tier

    def compact(self) -> None:
        """Merge ``fan_in`` runs of one tier of size into one, as long as there are any; so each entry is rewritten once a tier."""
        while True:
            tiers: dict[int, list[dict]] = {}
            for run in self.runs:
                tiers.setdefault(self._tier(run), []).append(run)
            full = next((runs for _, runs in sorted(tiers.items()) if len(runs) >= self.fan_in), None)
            if full is None:
                return
            merged = {}
            for name in self.keys:
                parts = [self.spark.read.parquet(*[x[0] for x in run["tables"][name]]) for run in full if run["tables"][name]]
                merged[name] = self.write(reduce(DataFrame.unionByName, parts), name) if parts else []
            self.runs = [run for run in self.runs if not any(run is x for x in full)]
            self.runs.append({"rows": sum(run["rows"] for run in full), "tables": merged})
            self._keep()
            self.drop([x for run in full for files in run["tables"].values() for x in files])

    def drop(self, files: list[list]) -> None:
        """Remove the folders of ``files``."""
        for folder in {x[0].rsplit("/", 1)[0] for x in files}:
            self._fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder), True)

    def probe(self, probes: DataFrame, table: str, columns: list[str], visit: Visit, schema: str, fresh: list[list] | None = None) -> DataFrame:
        """What ``visit`` makes of each probe and the entries in its window ``[lo, hi]`` of ``table``.

        ``visit`` gets the probes, the read part of a file, and matching rows of either; it runs on
        blocks of bounded size. ``fresh`` are files beside the runs'; the column ``fresh`` of
        what is read tells them. One small number pair a file goes to every task
        (entries / ``file_rows`` files), and a file that many probes ask for is read by several tasks.
        """
        key = self.keys[table]
        known = [(*x, False) for run in self.runs for x in run["tables"][table]] + [(*x, True) for x in fresh or []]
        if not known:
            return self.spark.createDataFrame([], schema)
        index = self.spark.sparkContext.broadcast(known)

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            low, high = (np.array([x[k] for x in index.value], np.int64) for k in (1, 2))
            for whole in batches:
                step = max(1, BLOCK // len(low))
                for at in range(0, whole.num_rows, step):
                    batch = whole.slice(at, step)
                    lo, hi = (batch.column(x).to_numpy() for x in ("lo", "hi"))
                    row, file = np.nonzero((low[None, :] <= hi[:, None]) & (high[None, :] >= lo[:, None]))
                    yield pa.RecordBatch.from_arrays([*batch.take(pa.array(row)).columns, pa.array(file, pa.int32())], names=[*batch.schema.names, "file"])

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                files = batch.column("file").to_numpy()
                cuts = [0, *(np.flatnonzero(files[1:] != files[:-1]) + 1), len(files)]
                for a, b in zip(cuts, cuts[1:]):
                    if a == b:
                        continue
                    part = batch.slice(a, b - a)
                    lo, hi = (part.column(x).to_numpy() for x in ("lo", "hi"))
                    entries = _around(index.value[files[a]], key, columns, lo, hi)
                    held = entries.column(key).to_numpy()
                    for probe, entry in _spans(np.searchsorted(held, lo, "left"), np.searchsorted(held, hi, "right")):
                        yield visit(part, entries, probe, entry)

        routed = probes.mapInArrow(route, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in probes.schema) + ", file int")
        # a rebalanced shuffle is cut at the advisory size, so a file asked for by very many probes takes several tasks
        return routed.hint("rebalance", "file").sortWithinPartitions("file", "lo").mapInArrow(merge, schema)


def _around(file: tuple, key: str, columns: list[str], lo: np.ndarray, hi: np.ndarray) -> pa.Table:
    """Entries of those row groups of a file that any window ``[lo, hi]`` meets."""
    path, fresh = file[0], file[4]
    system, local = _local(path)
    held = pq.ParquetFile(local, filesystem=system)
    at = held.metadata.schema.names.index(key)
    stats = [held.metadata.row_group(k).column(at).statistics for k in range(held.num_row_groups)]
    reach = np.maximum.accumulate(hi)  # windows are sorted by lo
    wanted = []
    for k, x in enumerate(stats):
        upto = np.searchsorted(lo, x.max, "right")
        if upto and reach[upto - 1] >= x.min:
            wanted.append(k)
    found = held.read_row_groups(wanted, columns=[key, *columns]).combine_chunks()
    return found.append_column("fresh", pa.array(np.full(found.num_rows, fresh)))
