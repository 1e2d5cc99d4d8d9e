"""What the two vector searches share: clean vectors, and blocks of them.

A block is one row that holds up to a fixed number of vectors, so searches join
blocks with blocks and multiply matrices, never single pairs of rows.

Defined results for both searches: a vector that is null, empty or holds a null
or non-finite component takes no part; rows that repeat a vec_id count once, by
the smallest vector; a null vec_id takes no part; shorter vectors are padded
with zeros to the longest length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def clean(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id long, v array<double>: the vectors that take part, once each."""
    v = F.col(vec_col).cast("array<double>")
    found = rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & (F.size("v") > 0))
    return found.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).groupBy("vec_id").agg(F.min("v").alias("v"))


def width(vectors: DataFrame) -> int:
    return int(vectors.agg(F.max(F.size("v")).alias("d")).first()["d"] or 0)


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """A list column as rows of d doubles, padded with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(sizes) and (sizes == d).all():
        return flat.reshape(-1, d)
    out = np.zeros((len(sizes), d))
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), at] = flat
    return out


def blob(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to the smaller id, best first."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= edge)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]


def gram(vectors: DataFrame, d: int, change=None) -> np.ndarray:
    """The sum of v v^T over all vectors: d * d numbers, summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            m = matrix(batch.column(0), d)
            m = m if change is None else change(m)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * d)), pa.array(total.ravel())], ["at", "x"])

    out = np.zeros(d * d)
    for row in vectors.select("v").mapInArrow(run, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():
        out[row["at"]] = row["x"]
    return out.reshape(d, d)
