"""Product quantizer: m codebooks of k centers over consecutive parts of a vector."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.distance import matrix
from .config import check_broadcast
from .kmeans import initial_points, lloyd, nearest, subspaces


class Quantizer:
    """With ``m = 1`` it is a coarse quantizer of any size; with more, codes are bytes."""

    def __init__(self, dim: int, m: int, k: int):
        if m < 1 or dim % m:
            raise ValueError(f"dim {dim} isn't a multiple of m {m}")
        if m > 1 and k > 256:
            raise ValueError("a product quantizer has at most 256 codes a subspace")
        self.dim, self.m, self.k, self.width = dim, m, k, dim // m
        self.centers: np.ndarray | None = None

    def fit(self, vectors: DataFrame, iterations: int = 20, init: str | list[int] = "points", seed: int = 123, starts: DataFrame | None = None) -> Quantizer:
        """Train all subspaces at once, from the same start rows; those given by id come from ``starts``, if there."""
        n = vectors.count()
        if self.k >= n:
            raise ValueError(f"{self.k} centers need more than {n} training rows")
        source = vectors if starts is None or isinstance(init, str) else starts
        start = initial_points(source, self.k, self.dim, init, seed)
        self.centers = lloyd(vectors, subspaces(start, self.m), iterations)
        return self

    def set_centers(self, centers: np.ndarray) -> Quantizer:
        centers = np.asarray(centers, np.float64)
        if centers.shape != (self.m, self.k, self.width):
            raise ValueError(f"expected centers of shape {(self.m, self.k, self.width)}, got {centers.shape}")
        self.centers = centers
        return self

    def encode(self, vectors: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """``vec_id, code`` and the columns in ``keep``; ``code`` has one byte value per subspace."""
        check_broadcast(self._trained().nbytes, "the codebook")
        shared = vectors.sparkSession.sparkContext.broadcast(self._trained())
        dim, m = self.dim, self.m

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                parts = subspaces(matrix(batch["embedding"], dim), m)
                codes = np.stack([nearest(x, shared.value[s]) for s, x in enumerate(parts)], 1).astype(np.int16)
                code = pa.FixedSizeListArray.from_arrays(pa.array(codes.ravel()), m).cast(pa.list_(pa.int16()))
                yield pa.RecordBatch.from_arrays([batch["vec_id"], code, *(batch[c] for c in keep)], ["vec_id", "code", *keep])

        kept = "".join(f", {c} {vectors.schema[c].dataType.simpleString()}" for c in keep)
        return vectors.select("vec_id", "embedding", *keep).mapInArrow(run, f"vec_id long, code array<smallint>{kept}")

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self._trained()[s][codes[:, s]] for s in range(self.m)], axis=1)

    def codebook(self, spark: SparkSession) -> DataFrame:
        """``m, ks, center``."""
        rows = [(s, i, [float(x) for x in c]) for s, book in enumerate(self._trained()) for i, c in enumerate(book)]
        return spark.createDataFrame(rows, "m int, ks int, center array<float>")

    @classmethod
    def from_codebook(cls, book: DataFrame) -> Quantizer:
        rows = book.orderBy("m", "ks").collect()
        m, k = max(r["m"] for r in rows) + 1, max(r["ks"] for r in rows) + 1
        centers = np.array([r["center"] for r in rows], np.float64).reshape(m, k, -1)
        return cls(m * centers.shape[2], m, k).set_centers(centers)

    def _trained(self) -> np.ndarray:
        if self.centers is None:
            raise RuntimeError("the quantizer isn't trained")
        return self.centers


def subvector(column: str, m: int, width: int) -> Column:
    """Part m of a vector."""
    return F.slice(column, m * width + 1, width)
