"""Latent vectors of midlines: products of array columns with a matrix of components, a batch at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def multiply(values: Column, matrix: np.ndarray) -> Column:
    """values (an array of len(matrix) numbers) times matrix; null where the array is null or holds a null."""
    matrix = np.asarray(matrix, float)

    @F.arrow_udf("array<double>")
    def run(rows: pa.Array) -> pa.Array:
        size = pc.fill_null(pc.list_value_length(rows), -1).to_numpy(zero_copy_only=False)
        if ((size >= 0) & (size != len(matrix))).any():
            raise ValueError(f"the arrays must have {len(matrix)} numbers")
        flat = rows.flatten()
        x = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False).reshape(-1, len(matrix))
        held = size >= 0
        out = np.zeros((len(rows), matrix.shape[1]))
        out[held] = x @ matrix
        held[held] = ~flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, len(matrix)).any(1)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * matrix.shape[1], pa.int32()), pa.array(out.ravel()))
        return pc.if_else(pa.array(held), lists, pa.scalar(None, lists.type))

    return run(values.cast("array<double>"))


def project(values: Column, components: np.ndarray) -> Column:
    """Coordinates of flat vectors on the rows of components."""
    return multiply(values, np.asarray(components).T)


def recover(latent: Column, components: np.ndarray, centre: Column | None = None) -> Column:
    """Flat points x0, y0, ... of latent vectors, shifted by a centre (struct x, y)."""
    flat = multiply(latent, components)
    return flat if centre is None else F.transform(flat, lambda v, i: v + F.when(i % 2 == 0, centre["x"]).otherwise(centre["y"]))


def reversal(points: int) -> np.ndarray:
    """The matrix that reverses the order of the points of a flat midline."""
    return np.kron(np.eye(points)[::-1], np.eye(2))


def flip_matrix(components: np.ndarray) -> np.ndarray:
    """What reversing a midline does to its latent vector: A J A'. Latent vectors are rows."""
    a = np.asarray(components, float)
    return a @ reversal(a.shape[1] // 2) @ a.T


def gram(df: DataFrame, values: str, size: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(number, sum, sum of outer products) of the arrays of a column: tasks add up their own rows, and size² + size numbers per task meet."""

    def run(batches):
        n, s, g = 0, np.zeros(size), np.zeros((size, size))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
            n, s, g = n + len(x), s + x.sum(0), g + x.T @ x
        flat = np.concatenate([[n], s, g.ravel()])
        yield pa.RecordBatch.from_pydict({"i": np.arange(len(flat), dtype=np.int32), "v": flat})

    parts = df.select(F.col(values).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))
    total = np.zeros(1 + size + size * size)
    for r in parts.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():  # 1 + size + size² rows
        total[r["i"]] = r["v"]
    return int(total[0]), total[1 : 1 + size], total[1 + size :].reshape(size, size)


def principal_components(df: DataFrame, values: str, size: int, n: int) -> np.ndarray:
    """The n leading principal directions (rows) of a column of arrays, each with a positive greatest entry."""
    count, s, g = gram(df, values, size)
    mean = s / max(count, 1)
    _, vectors = np.linalg.eigh(g / max(count, 1) - np.outer(mean, mean))
    a = vectors[:, ::-1][:, :n].T
    return a * np.sign(a[np.arange(len(a)), np.abs(a).argmax(1)])[:, None]
