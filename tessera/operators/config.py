"""Index parameters and checks of what goes into an index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The most that is sent to every executor; a larger query set is searched in blocks.
BROADCAST_BYTES = 256 << 20


@dataclass(frozen=True)
class IVFConfig:
    """``kc`` cells over vectors of ``dim`` components; ``iterations`` rounds of assignment."""

    dim: int
    kc: int
    iterations: int = 12
    sample_rows: int = 100_000
    seed: int = 123

    def __post_init__(self):
        if self.dim < 1 or self.kc < 1 or self.iterations < 0:
            raise ValueError("dim and kc must be positive, iterations not negative")
        check_broadcast(self.kc * self.dim * 8, "the coarse codebook")


@dataclass(frozen=True)
class IVFPQConfig(IVFConfig):
    """``mp`` subspaces with ``kp`` codes each; codes are single bytes."""

    mp: int = 8
    kp: int = 256
    pq_iterations: int = 6

    def __post_init__(self):
        super().__post_init__()
        if self.mp < 1 or self.dim % self.mp:
            raise ValueError(f"dim {self.dim} isn't a multiple of mp {self.mp}")
        if not 1 <= self.kp <= 256:
            raise ValueError("kp must be from 1 to 256")


def check_broadcast(n_bytes: int, what: str) -> None:
    if n_bytes > BROADCAST_BYTES:
        raise ValueError(f"{what} takes {n_bytes} bytes; at most {BROADCAST_BYTES} are broadcast")


def check_probes(w: int, kc: int, clamp: bool) -> int:
    if w < 1:
        raise ValueError("at least one cell must be probed")
    if w > kc and not clamp:
        raise ValueError(f"{w} cells asked for, the index has {kc}")
    return min(w, kc)


def validated(vectors: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """``vectors`` whose scan fails on a null, a NaN or a length other than ``dim``."""
    v = F.col(column)
    bad = v.isNull() | (F.size(v) != dim) | F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")))
    return vectors.withColumn(column, F.when(bad, F.raise_error(F.lit(f"{column}: expected {dim} finite numbers")).cast(vectors.schema[column].dataType)).otherwise(v))
