"""Gaussian random projection of vectors with a matrix that every task makes from a seed."""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


@cache
def matrix(rows: int, columns: int, seed: int) -> np.ndarray:
    """Normal numbers of deviation 1/sqrt(columns): Box and Muller's from the md5 of ``seed:row:column``."""
    out = np.empty((rows, columns))
    for i in range(rows):
        for j in range(columns):
            h = hashlib.md5(f"{seed}:{i}:{j}".encode()).digest()
            u, v = ((int.from_bytes(h[k : k + 4], "big") + 0.5) / 2**32 for k in (0, 4))
            out[i, j] = np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)
    return out / np.sqrt(columns)


def project(rows: DataFrame, id_col: str, vector: str, dim: int, seed: int = 0) -> DataFrame:
    """(id_col, vector): each vector by the matrix, at length 1. Null elements count as 0, a null vector and the zero vector
    give zeros. Vectors of another length than the first of their table are refused, and so is a larger ``dim``.

    Arrow batches are multiplied as blocks, so no dimension becomes a row.
    """
    head = rows.where(rows[vector].isNotNull()).select(vector).first()
    width = len(head[0]) if head else dim
    if dim > width:
        raise ValueError(f"{dim} dimensions exceed {width}")
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches):
        m = matrix(width, dim, seed)
        for b in batches:
            x = np.zeros((b.num_rows, width))
            for i, v in enumerate(b.column(1).to_pylist()):
                if v is not None:
                    if len(v) != width:
                        raise ValueError(f"a vector has {len(v)} elements in place of {width}")
                    x[i] = [e or 0.0 for e in v]
            y = x @ m
            y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
            ends = np.arange(0, (b.num_rows + 1) * dim, dim, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, y.ravel())], names=[id_col, vector])

    return rows.select(id_col, vector).mapInArrow(run, f"`{id_col}` {kind}, `{vector}` array<double>")
