"""Vectors of whole numbers: which rows take part, and exact arithmetic on them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SCALE = 256


def whole(rows: DataFrame, *columns: Column) -> DataFrame:
    """``columns`` and ``x``, the vectors of ``rows(…, embedding)`` times 256, rounded down.

    Rows whose vector is null or has null, NaN or infinite components are left out, and so
    are empty vectors and those that differ in length from most of the table.  Components
    beyond the range of a long stay at its ends.
    """
    vector = F.col("embedding").cast("array<double>")
    clean = rows.select(*columns, vector.alias("_vector")).filter(
        "size(_vector) > 0"
        " and forall(_vector, c -> c is not null and not isnan(c) and abs(c) < double('infinity'))"
    )
    sizes = clean.groupBy(F.size("_vector").alias("size")).agg(F.count("*").alias("n"))
    usual = sizes.orderBy(F.desc("n"), "size").limit(1).collect()
    size = usual[0]["size"] if usual else 0
    x = F.transform("_vector", lambda c: F.floor(c * SCALE).cast("long"))
    return clean.filter(F.size("_vector") == size).withColumn("x", x).drop("_vector")


def matrix(column: pa.Array, kind: type = np.int64) -> np.ndarray:
    """The lists of a column, all of one length, as the rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(len(column), -1)


def products(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices of whole numbers, exact; held at a long's ends."""
    if not len(one):
        return np.zeros(0, np.int64)
    largest = float(np.abs(one.astype(np.float64)).max()) * float(np.abs(two.astype(np.float64)).max())
    if largest * one.shape[1] < 2.0**62:
        return np.einsum("ij,ij->i", one, two)
    exact = (one.astype(object) * two.astype(object)).sum(1)
    return np.array([min(max(v, -(2**63)), 2**63 - 1) for v in exact], dtype=np.int64)
