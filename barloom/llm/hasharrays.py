"""Sorted hash arrays: a table of (key, values) that Spark sorts and writes to the shared folder, and every Python worker reads once.

The files go from the executors to the shared folder and from there to the workers; nothing of them passes through the driver. The folder must
be of a kind that Arrow reads (file, HDFS, S3, GCS).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame

from .shared import materialize

EVEN = 64
_loaded: dict[str, HashArray] = {}


def write(rows: DataFrame, key: str, name: str) -> str:
    """Write ``rows`` (key, value) in ranges of the key, each sorted; the folder's name with its file system."""
    spark = rows.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(materialize(rows.repartitionByRange(key).sortWithinPartitions(key), name).written_to)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


class HashArray:
    """Keys in ascending order and their values: one a key, or a list of the same length for each.

    Hashed keys are found through an index of their top bits; others, of which too many share these, by bisection.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable") if len(keys) and (keys[1:] < keys[:-1]).any() else slice(None)
        self.keys, self.values = keys[order], values[order]
        self.shift = 64 - max(1, min(26, len(keys).bit_length()))
        self.index = np.searchsorted(self.keys, (np.arange(1 << (64 - self.shift)) - (1 << (63 - self.shift))) << self.shift).astype(np.int32 if len(keys) < 2**31 else np.int64)
        self.even = len(keys) < 2 or int(np.diff(self.index).max()) <= EVEN
        self.keys = np.append(self.keys, np.iinfo(np.int64).max)  # a sentinel, so that every place can be looked at

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether it is the key's) for each key; places of missing keys are of no use, but inside the values if there are any."""
        if not self.even:
            at = np.searchsorted(self.keys, key)
            hit = (self.keys[at] == key) & (at < len(self.values))
            return np.minimum(at, max(0, len(self.values) - 1)), hit
        at = self.index[(key >> self.shift) + (1 << (63 - self.shift))]
        todo = np.flatnonzero(self.keys[at] < key)
        while len(todo):
            at[todo] += 1
            todo = todo[self.keys[at[todo]] < key[todo]]
        hit = (self.keys[at] == key) & (at < len(self.values))
        return np.minimum(at, max(0, len(self.values) - 1)), hit


def forget() -> None:
    """Let go of what this worker has loaded."""
    _loaded.clear()


def _name(path: str) -> str:
    return path.rpartition("/")[2].rpartition("-")[0]


def load(path: str) -> HashArray:
    """The arrays of a folder, read once in each worker, which keeps the last of each name."""
    if path not in _loaded:
        files, root = fs.FileSystem.from_uri(path)
        parts = sorted(f.path for f in files.get_file_info(fs.FileSelector(root)) if f.path.endswith(".parquet"))
        tables = [pq.read_table(p, filesystem=files) for p in parts]
        key, value = (c.combine_chunks() for c in pa.concat_tables(tables).columns) if tables else (pa.array([], pa.int64()), pa.array([], pa.float32()))
        many = pa.types.is_list(value.type)
        values = (value.flatten() if many else value).to_numpy(zero_copy_only=False)
        for old in [x for x in _loaded if _name(x) == _name(path)]:
            del _loaded[old]
        _loaded[path] = HashArray(key.to_numpy(), values.reshape(len(key), -1) if many and len(key) else values)
    return _loaded[path]
