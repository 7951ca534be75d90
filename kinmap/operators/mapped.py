"""Sparse matrices as arrays in the shared folder, which tasks map: rows are multiplied where they lie and nothing is shuffled for a product."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmap.session import shared_folder

#: Terms of a product that are summed at a time.
TERMS = 1 << 21


def mounted(df: DataFrame) -> str | None:
    """The shared folder as a path that tasks can map files of; none where it has another scheme."""
    scheme, _, path = shared_folder(df.sparkSession).rpartition(":")
    return "/" + path.lstrip("/") if scheme in ("", "file") else None


@dataclass(frozen=True)
class Mapped:
    """The rows (row, to, w) of a matrix in `parts` files by row modulo parts: sorted rows, their bounds, columns in order and weights."""

    folder: str
    parts: int

    @staticmethod
    def of(rows: DataFrame, key: str, part_rows: int = 1 << 22) -> Mapped:
        folder, parts = f"{mounted(rows)}/matrix-{uuid.uuid4().hex}", max(1, -(-rows.count() // part_rows))

        def write(group: pd.DataFrame) -> pd.DataFrame:
            group, name = group.iloc[np.lexsort((group["to"], group.row))], f"{folder}/{int(group.part.iloc[0])}"
            os.makedirs(folder, exist_ok=True)
            ids, first = np.unique(group.row.to_numpy("<i8"), return_index=True)
            for kind, data in (("ids", ids), ("bounds", np.append(first, len(group)).astype("<i8")), ("to", group["to"].to_numpy("<i8")), ("w", group.w.to_numpy("<f8"))):
                mine = f"{name}.{kind}.{uuid.uuid4().hex}"
                with open(mine, "wb") as out:
                    np.save(out, data)
                os.replace(mine, f"{name}.{kind}.npy")  # a task that runs twice leaves whole files
            return pd.DataFrame({"n": [len(group)]})

        dealt = rows.select(F.pmod(key, F.lit(parts)).alias("part"), F.col(key).alias("row"), "to", "w")
        dealt.groupBy("part").applyInPandas(write, "n long").agg(F.sum("n")).collect()
        return Mapped(folder, parts)

    def load(self) -> list[tuple[np.ndarray, ...] | None]:
        """The parts' arrays, mapped; none of a part without rows."""
        names = [f"{self.folder}/{k}" for k in range(self.parts)]
        return [tuple(np.load(f"{n}.{kind}.npy", mmap_mode="r") for kind in ("ids", "bounds", "to", "w")) if os.path.exists(f"{n}.w.npy") else None for n in names]

    def times(self, sums: DataFrame, scale: float) -> DataFrame:
        """(u, v, score): rows (u, v, score, done) times scale times the matrix, with rows that are done added as they are.

        `sums` is dealt by u, and a task has its rows of a u one after the other, by v, so each
        pair is summed where it is made, in one order.
        """
        matrix = self

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = matrix.load()
            left = [np.zeros(0, "<i8"), np.zeros(0, "<i8"), np.zeros(0), np.zeros(0, bool)]
            for batch in batches:
                if batch.num_rows:
                    now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
                    left = [np.concatenate(p) for p in zip(left, now)]
                    cut = int(np.searchsorted(left[0], left[0][-1]))  # the last u can go on in the next batch
                    yield from products([p[:cut] for p in left], parts, scale)
                    left = [p[cut:] for p in left]
            yield from products(left, parts, scale)

        rows = sums.select("u", "v", "score", "done").sortWithinPartitions("u", "v")
        return rows.mapInArrow(multiply, "u long, v long, score double")


class Wide(Exception):
    """More entries than may be made at once."""


def entries(parts: list, rows: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, to, w): how many entries each of the rows has, and the entries one row after the other."""
    start, size, of = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), rows % len(parts)
    for k, part in enumerate(parts):
        mine = np.flatnonzero(of == k)
        if part is None or not len(mine):
            continue
        ids, bounds = part[0], part[1]
        at = np.minimum(np.searchsorted(ids, rows[mine]), len(ids) - 1)
        start[mine], size[mine] = bounds[at], np.where(ids[at] == rows[mine], bounds[at + 1] - bounds[at], 0)
    total = int(size.sum())
    if most is not None and total > most:
        raise Wide
    to, w, place = np.empty(total, np.int64), np.empty(total), np.cumsum(size) - size
    for k in np.unique(of[size > 0]):
        mine = np.flatnonzero((of == k) & (size > 0))
        n = size[mine]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        source, target = np.repeat(start[mine], n) + inside, np.repeat(place[mine], n) + inside
        to[target], w[target] = parts[k][2][source], parts[k][3][source]
    return size, to, w


def path_sums(one: DataFrame, two: DataFrame, by: str = "u") -> DataFrame:
    """(u, v, score): sums over mid of w times w of one(u, mid, w) and two(mid, v, w).

    Rows of a u (or of a v, with `by`) are made in one task and nothing is shuffled by pair, so
    what groups them by it sends a row a group and task; where files can't be mapped they are joined.
    """
    if by not in ("u", "v"):
        raise ValueError(f"unknown end {by}")
    if not mounted(one):
        second = two.select("mid", "v", F.col("w").alias("other"))
        return one.join(second, "mid").groupBy("u", "v").agg(F.sum(F.col("w") * F.col("other")).alias("score"))
    rows, matrix, other = (one, two, "v") if by == "u" else (two, one, "u")
    parts = int(one.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(F.col(by).alias("u"), F.col("mid").alias("v"), F.col("w").alias("score"), F.lit(False).alias("done")).repartition(parts, "u")
    found = Mapped.of(matrix.select("mid", F.col(other).alias("to"), "w"), "mid").times(dealt, 1.0)
    return found.select(F.col("u").alias(by), F.col("v").alias(other), "score").select("u", "v", "score")


def products(rows: list[np.ndarray], parts: list, scale: float) -> Iterator[pa.RecordBatch]:
    """Sums by pair of the terms of whole u, some million at a time; a u with more is one sum."""
    u, v, score, done = rows
    if not len(u):
        return
    start, size = np.zeros(len(u), np.int64), np.where(done, 1, 0)
    of = np.where(done, -1, v % len(parts))
    for k, part in enumerate(parts):
        mine = np.flatnonzero(of == k)
        if part is None or not len(mine):
            continue
        ids, bounds = part[0], part[1]
        at = np.minimum(np.searchsorted(ids, v[mine]), len(ids) - 1)
        there = ids[at] == v[mine]
        start[mine], size[mine] = bounds[at], np.where(there, bounds[at + 1] - bounds[at], 0)
    firsts = np.append(np.flatnonzero(np.append(True, u[1:] != u[:-1])), len(u))
    ahead = np.append(0, np.cumsum(size))[firsts]
    k = 0
    while k + 1 < len(firsts):
        until = max(k + 1, int(np.searchsorted(ahead, ahead[k] + TERMS, "right")) - 1)
        near = slice(firsts[k], firsts[until])
        k, total = until, int(size[near].sum())
        if not total:
            continue
        to, value = np.empty(total, np.int64), np.empty(total)
        place = np.cumsum(size[near]) - size[near]
        for p in np.unique(of[near]):
            mine = np.flatnonzero(of[near] == p)
            if p < 0:
                to[place[mine]], value[place[mine]] = v[near][mine], score[near][mine]
            elif parts[p] is not None:
                n = size[near][mine]
                inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                source, target = np.repeat(start[near][mine], n) + inside, np.repeat(place[mine], n) + inside
                to[target], value[target] = parts[p][2][source], parts[p][3][source] * np.repeat(score[near][mine], n) * scale
        ids, mine = np.unique(u[near], return_inverse=True)
        others = np.unique(to)
        key = np.repeat(mine, size[near]) * len(others) + np.searchsorted(others, to)
        order = np.argsort(key, kind="stable")
        key = key[order]
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        one, two = np.divmod(key[at], len(others))
        yield pa.RecordBatch.from_arrays([pa.array(ids[one]), pa.array(others[two]), pa.array(np.add.reduceat(value[order], at))], ["u", "v", "score"])
