"""Reshaping of arrays and small helpers."""

from __future__ import annotations

import time

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flatten_2d(column: str) -> Column:
    return F.flatten(column)


def nest_2d(column: str, width: int) -> Column:
    """A flat array as rows of ``width``; null if the length isn't a multiple of it."""
    rows = F.transform(F.sequence(F.lit(0), (F.size(column) / width).cast("int") - 1), lambda i: F.slice(column, i * width + 1, width))
    return F.when(F.size(column) == 0, F.expr("array()")).when(F.size(column) % width == 0, rows)


def nest_3d(column: str, middle: int, inner: int) -> Column:
    flat = nest_2d(column, middle * inner)
    return F.transform(flat, lambda r: F.transform(F.sequence(F.lit(0), F.lit(middle - 1)), lambda i: F.slice(r, i * inner + 1, inner)))


def with_units(n: int) -> str:
    """1_000_000 as "1m"; what doesn't fill the unit is dropped."""
    for size, unit in ((1_000_000_000, "b"), (1_000_000, "m"), (1_000, "k")):
        if n >= size:
            return f"{n // size}{unit}"
    return str(n)


def as_folder(path: str) -> str:
    """A path that ends in one more "/" if it doesn't end in any."""
    return path if path.endswith("/") else f"{path}/"


def described(df: DataFrame) -> str:
    """Columns and types, one a line."""
    return "\n".join(f"{name}: {kind}" for name, kind in df.dtypes)


def preview(vectors: DataFrame, n: int = 5, column: str = "embedding", components: int = 8) -> str:
    """The first components of n vectors, one a line."""
    rows = vectors.select("vec_id", F.slice(column, 1, components).alias("head"), F.size(column).alias("dim")).limit(n).collect()
    return "\n".join(f"{r['vec_id']} ({r['dim']}): {' '.join(format(x, 'g') for x in r['head'])}" for r in rows)


def kernels() -> str:
    """What computes the distances: the vector library and the instruction sets it may use."""
    found = np.show_config(mode="dicts").get("SIMD Extensions", {})
    return f"numpy {np.__version__}, {', '.join([*found.get('baseline', []), *found.get('found', [])]) or 'no extensions'}"


class Timer:
    """Adds up the time between starts and stops."""

    def __init__(self):
        self.reset()

    def reset(self) -> None:
        self.total, self.began = 0.0, None

    def start(self) -> None:
        self.began = time.perf_counter()

    def stop(self) -> None:
        if self.began is None:
            raise RuntimeError("the timer isn't running")
        self.total, self.began = self.total + time.perf_counter() - self.began, None
