"""Squared Euclidean distance: Catalyst expressions, a SQL function and batch kernels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


#: Distances that a kernel holds at once.
TILE = 1 << 22


def l2sqr(a: Column | str, b: Column | str) -> Column:
    """Left fold of squared differences in double precision."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(squares, F.lit(0.0), lambda s, z: s + z)


def l2sqr_u8(a: Column | str, b: Column | str) -> Column:
    """The same over 8-bit values held as SMALLINT; whole numbers, exact at any dimension."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    squares = F.zip_with(a, b, lambda x, y: (x.cast("long") - y.cast("long")) * (x.cast("long") - y.cast("long")))
    return F.aggregate(squares, F.lit(0).cast("long"), lambda s, z: s + z)


def quantize_u8(a: Column | str) -> Column:
    """Components in [-1, 1] as 0..255."""
    return F.transform(a, lambda x: F.floor((x.cast("double") + 1) * 127.5).cast("smallint"))


def register_functions(spark: SparkSession) -> None:
    """``l2sqr(x, y)`` for SQL text."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION l2sqr(x ARRAY<FLOAT>, y ARRAY<FLOAT>) RETURNS DOUBLE RETURN "
        "aggregate(zip_with(x, y, (a, b) -> (double(a) - double(b)) * (double(a) - double(b))), 0.0D, (s, z) -> s + z)"
    )


def l2sqr_block(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All distances between rows of x and of y, summed dimension by dimension.

    The order of summation is that of the fold in :func:`l2sqr`, so both give the same bits;
    the expanded form would lose the low ones and change ties.
    """
    out = np.zeros((len(x), len(y)))
    for d in range(x.shape[1]):
        gap = x[:, d, None] - y[None, :, d]
        out += gap * gap
    return out


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column as doubles, (rows, dim); a null, a NaN or another length is an error."""
    flat = column.flatten()
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    if column.null_count or flat.null_count or not (lengths == dim).all():
        raise ValueError(f"expected {dim} finite numbers in each vector")
    x = flat.to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
    if np.isnan(x).any():
        raise ValueError(f"expected {dim} finite numbers in each vector")
    return x
