"""Sorted hash arrays in the shared folder, mapped into memory by the tasks that need them.

The folder is under spark.checkpoint.dir, which must be a path that all machines
mount, as arrays can only be mapped from one. A table has one file a bucket, which
holds all of its arrays; buckets without rows have one too (`for_all_buckets`), so a
file that is missing is an error. A file is written under another name and then
renamed, so a task that runs again leaves the same file. Maps hold no descriptor,
only so many are kept at once, and all go with the task's `Arrays`.
"""

from __future__ import annotations

import json
import mmap
import os
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmap.session import shared_folder

ALIGNED = 64
MAPS = 16384


def new_folder(spark: SparkSession, name: str) -> str:
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if urlparse(folder).scheme not in ("", "file"):
        raise ValueError(f"arrays are mapped into memory: spark.checkpoint.dir must be a mounted path, not {folder}")
    folder = urlparse(folder).path
    os.makedirs(folder, exist_ok=True)
    return folder


def for_all_buckets(rows: DataFrame, buckets: int) -> DataFrame:
    """The rows and one more for each bucket, null but for its number, so that each is written."""
    every = rows.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    return rows.unionByName(every, allowMissingColumns=True)


def saved(folder: str, table: str, bucket: int, **arrays: np.ndarray) -> None:
    head, at = {}, 0
    for name, a in arrays.items():
        head[name] = (a.dtype.str, a.shape, at)
        at += -(-a.nbytes // ALIGNED) * ALIGNED
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % ALIGNED)
    part = f"{folder}/{table}_{bucket}.{uuid.uuid4().hex}.tmp"
    with open(part, "wb") as f:
        f.write(len(text).to_bytes(8, "little") + text)
        for a in arrays.values():
            f.write(np.ascontiguousarray(a).data)
            f.write(b"\0" * (-a.nbytes % ALIGNED))
    os.replace(part, f"{folder}/{table}_{bucket}")


def mapped(path: str) -> dict[str, np.ndarray]:
    with open(path, "rb") as f:
        data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False)
    start = 8 + int.from_bytes(data[:8], "little")
    head = json.loads(data[8:start])
    return {n: np.ndarray(tuple(shape), kind, data, start + at) for n, (kind, shape, at) in head.items()}


def runs(ordered: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, start, end) of each run of equal values: work by the values that stand there, not by all there could be."""
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)
    return zip(ordered[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(ordered)])


class Arrays:
    """A folder's tables; every table has an array `key`, sorted, and others beside it."""

    def __init__(self, folder: str, buckets: int):
        self.folder, self.buckets = folder, buckets
        self.kept: OrderedDict[tuple[str, int], dict[str, np.ndarray]] = OrderedDict()

    def get(self, table: str, k: int) -> dict[str, np.ndarray]:
        if (table, k) not in self.kept:
            self.kept[table, k] = mapped(f"{self.folder}/{table}_{k}")
            if len(self.kept) > MAPS:
                self.kept.popitem(last=False)
        return self.kept[table, k]

    def hits(self, table: str, bucket: np.ndarray, keys: np.ndarray):
        """For each bucket that has some of the keys: its arrays, which keys and where."""
        order = np.lexsort((keys, bucket))
        for k, start, end in runs(bucket[order]):
            there = self.get(table, k)
            if not len(there["key"]):
                continue
            o = order[start:end]
            place = np.minimum(np.searchsorted(there["key"], keys[o]), len(there["key"]) - 1)
            hit = there["key"][place] == keys[o]
            yield there, o[hit], place[hit]

    def find(self, table: str, bucket: np.ndarray, keys: np.ndarray, *names: str) -> list[np.ndarray]:
        """The named values of the keys, zeros for keys that are not there."""
        out = [np.zeros(len(keys), np.int64) for _ in names]
        for there, at, place in self.hits(table, bucket, keys):
            for values, name in zip(out, names):
                values[at] = there[name][place]
        return out

    def has(self, table: str, bucket: np.ndarray, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), bool)
        for _, at, _ in self.hits(table, bucket, keys):
            out[at] = True
        return out


def least_type(values: np.ndarray) -> np.ndarray:
    """Non-negative numbers in the narrowest type that holds them."""
    top = int(values.max()) if len(values) else 0
    return values.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max))
