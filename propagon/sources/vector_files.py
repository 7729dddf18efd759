"""Vectors by id in memory-mapped files of the shared folder, which must be a file path that all machines mount."""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propagon.sources.shared import new_path

#: Fixed value: vectors of a file, about.
ROWS = 1 << 18
INTEGERS = ("tinyint", "smallint", "int", "bigint")


def save(vectors: DataFrame, key: str, vector: str) -> list[tuple]:
    """Writes the vectors in order of their ids; (path, rows, width, type, first id, last id) of each file, for ``Vectors``.

    Null ids and null vectors go, an id may occur again, ids are whole numbers, and vectors have one width. Files lie in range
    partitions, so no id is in two of them, and a partition streams into its file.
    """
    types = dict(vectors.dtypes)
    if types[key] not in INTEGERS:
        raise ValueError(f"{key} is {types[key]}; vectors are found by whole numbers")
    folder = urlparse(new_path(vectors.sparkSession, "vectors"))
    if folder.scheme not in ("", "file"):
        raise ValueError(f"vectors need a folder that all machines mount; {folder.geturl()} is not a file path")
    folder, kind = folder.path, "float" if types[vector] == "array<float>" else "double"
    width_of = np.dtype(np.float32 if kind == "float" else np.float64)
    x = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast(f"array<{kind}>").alias("v"))

    def run(batches):
        path, n, width, first, last = f"{folder}/{uuid.uuid4().hex}", 0, None, None, None
        os.makedirs(folder, exist_ok=True)
        with open(f"{path}.ids", "wb") as ids, open(f"{path}.vec", "wb") as vecs:
            for b in batches:
                if not b.num_rows:
                    continue
                v, size = b.column(1).flatten(), np.diff(b.column(1).offsets.to_numpy())
                width = int(size[0]) if width is None else width
                if (size != width).any() or v.null_count:
                    raise ValueError("vectors differ in width or lack a value")
                own = b.column(0).to_numpy()
                first, last, n = own[0] if first is None else first, own[-1], n + b.num_rows
                ids.write(own.astype(np.int64).tobytes())
                vecs.write(v.to_numpy().astype(width_of).tobytes())
        if n:
            yield pa.RecordBatch.from_pydict({"path": [path], "n": [n], "width": [width], "first": [int(first)], "last": [int(last)]})

    parts = max(1, -(-x.count() // ROWS))
    # one row a file
    files = x.repartitionByRange(parts, "id").sortWithinPartitions("id").mapInArrow(run, "path string, n long, width long, first long, last long").collect()
    if len({f["width"] for f in files}) > 1:
        raise ValueError("vectors differ in width")
    return sorted(((f["path"], f["n"], f["width"], width_of.str, f["first"], f["last"]) for f in files), key=lambda f: f[4])


class Vectors:
    """The files of ``save``, mapped into memory when they are first needed."""

    def __init__(self, files: list[tuple]):
        self.files, self.open = files, {}
        self.width = files[0][2] if files else 0
        self.last = np.array([f[5] for f in files], np.int64)

    def _mapped(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self.open:
            path, n, width, kind, _, _ = self.files[k]
            vec = np.memmap(f"{path}.vec", kind, "r", shape=(n, width)) if width else np.zeros((n, 0))
            self.open[k] = np.memmap(f"{path}.ids", np.int64, "r", shape=(n,)), vec
        return self.open[k]

    def take(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, vectors): every vector of every id by the places in ``ids``, in order; ids without one are left out."""
        which = np.searchsorted(self.last, ids, "left")
        places, found = [], []
        for k in np.unique(which[which < len(self.files)]):
            at = np.flatnonzero(which == k)
            own, vec = self._mapped(k)
            low, high = (np.searchsorted(own, ids[at], side) for side in ("left", "right"))
            n = high - low
            # an id that occurs again has its vectors side by side
            rows = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
            places.append(np.repeat(at, n))
            found.append(vec[rows])
        if not places:
            return np.zeros(0, np.int64), np.zeros((0, self.width))
        if len(places) == 1:
            return places[0], found[0]
        places = np.concatenate(places)
        order = np.argsort(places, kind="stable")
        return places[order], np.concatenate(found)[order]


_opened: dict[tuple, Vectors] = {}


def opened(files: list[tuple]) -> Vectors:
    """``Vectors`` of the files, the last ones of a worker kept, for functions that are called for each group."""
    key = tuple(files)
    if key not in _opened:
        _opened.clear()
        _opened[key] = Vectors(files)
    return _opened[key]
