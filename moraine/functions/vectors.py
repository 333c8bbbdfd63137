"""Vectors as little-endian float32 bytes: decoding, checks, and arithmetic as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def from_base64(text: Column) -> Column:
    """Bytes of a base64 text that may be broken over lines; null if it is null, empty or unreadable."""
    plain = F.regexp_replace(text, r"\s+", "")
    return F.when(plain != "", F.try_to_binary(plain, F.lit("base64")))


def to_base64(vector: Column) -> Column:
    """Base64 text of a binary vector, without line breaks."""
    return F.regexp_replace(F.base64(vector), r"\s+", "")


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of a binary column of dim float32 each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if not len(column):
        return np.zeros((0, dim), np.float32)
    start = int(np.frombuffer(column.buffers()[1], np.int32)[column.offset])
    return np.frombuffer(column.buffers()[2], "<f4", count=len(column) * dim, offset=start).reshape(len(column), dim)


def binary(rows: np.ndarray) -> pa.Array:
    """The reverse of matrix."""
    rows = np.ascontiguousarray(rows, "<f4")
    n, dim = rows.shape
    offsets = pa.py_buffer(np.arange(n + 1, dtype=np.int32) * (dim * 4))
    return pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(rows.tobytes())])


def usable(rows: np.ndarray) -> np.ndarray:
    """Which rows hold finite numbers only, and not zeros only."""
    return np.isfinite(rows).all(axis=1) & (rows != 0).any(axis=1)


def clean_vectors(df: DataFrame, vector: str, dim: int, unit: bool = False) -> DataFrame:
    """Rows whose `vector` (binary, or an array of numbers) holds dim finite numbers, not all zero.

    The column becomes binary, with `unit` scaled to length 1; -0.0 becomes 0.0, so equal vectors
    have equal bytes. All other columns are kept.
    """
    kinds = dict(df.dtypes)
    others = [c for c in df.columns if c != vector]
    if kinds[vector] == "binary":
        df = df.filter(F.octet_length(vector) == dim * 4)
    else:
        whole = F.col(vector).cast("array<float>")
        df = df.withColumn(vector, whole).filter((F.size(vector) == dim) & ~F.exists(vector, lambda x: x.isNull()))
    listed = kinds[vector] != "binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            if listed:
                rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
            else:
                rows = matrix(column, dim)
            keep = usable(rows)
            rows = rows[keep] + np.float32(0.0)
            if unit:
                wide = rows.astype(np.float64)
                rows = (wide / np.linalg.norm(wide, axis=1, keepdims=True)).astype(np.float32)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([*[c.filter(mask) for c in batch.columns[:-1]], binary(rows)], [*others, vector])

    schema = ", ".join(f"{c} {kinds[c]}" for c in others) + f", {vector} binary"
    return df.select(*others, vector).mapInArrow(run, schema)


def to_arrays(df: DataFrame, vector: str, dim: int) -> DataFrame:
    """The binary column `vector` as array<float>; other columns are kept."""
    kinds = dict(df.dtypes)
    others = [c for c in df.columns if c != vector]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = matrix(batch.column(batch.num_columns - 1), dim)
            offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * dim)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(offsets, pa.array(rows.ravel()))], [*others, vector])

    return df.select(*others, vector).mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in others) + f", {vector} array<float>")


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def dot(a: str | Column, b: str | Column) -> Column:
    """Inner product of two array columns, in double."""
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def norm_score(score: Column, query_norm: Column, entry_norm: Column) -> Column:
    """Score over the square of the larger norm; null if both are zero."""
    top = F.greatest(query_norm, entry_norm)
    return F.when(top > 0, score / (top * top))


def augment(a: str | Column, phi: float | Column) -> Column:
    """Inner-product search as distance search: append sqrt(phi - |x|^2), phi the largest squared norm."""
    spare = F.sqrt(F.greatest(F.lit(0.0), (phi if isinstance(phi, Column) else F.lit(phi)) - dot(a, a)))
    return F.concat(F.col(a).cast("array<double>") if isinstance(a, str) else a.cast("array<double>"), F.array(spare))
