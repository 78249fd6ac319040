"""Index directories: codebooks and postings as Parquet, cells as partitions."""

from __future__ import annotations

import json
from dataclasses import asdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files
from .config import IVFConfig, IVFPQConfig
from .index import IVFIndex, IVFPQIndex
from .postings import write_postings
from .quantizer import Quantizer


def save(index: IVFIndex, path: str, spark: SparkSession, cells_per_partition: int | None = None) -> None:
    """Write an index; postings lie in ``part=cid div cells_per_partition``, sorted by cell."""
    kind, per_part = "ivfpq" if isinstance(index, IVFPQIndex) else "ivf", cells_per_partition or index.per_part
    meta = json.dumps({"kind": kind, "cells_per_partition": per_part, "config": asdict(index.config)})
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
    index.codebook(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/coarse")
    if kind == "ivfpq":
        index.pq.codebook(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/pq")
    if index.postings is not None:
        write_postings(index.postings.drop("part"), f"{path}/postings", per_part, "overwrite")


def load(path: str, spark: SparkSession) -> IVFIndex:
    """Read an index; its postings are scanned when they are searched, pruned to the cells asked for."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
    index = IVFPQIndex(IVFPQConfig(**meta["config"])) if meta["kind"] == "ivfpq" else IVFIndex(IVFConfig(**meta["config"]))
    index.per_part = meta["cells_per_partition"]
    centers = spark.read.parquet(f"{path}/coarse").orderBy("cid").collect()
    index.coarse = np.array([r["center"] for r in centers], np.float64)
    if meta["kind"] == "ivfpq":
        index.pq = Quantizer.from_codebook(spark.read.parquet(f"{path}/pq"))
    if files.exists(spark, f"{path}/postings"):
        index.path = f"{path}/postings"
        index.attach(spark.read.parquet(index.path))
    return index


def export_cells(index: IVFIndex, path: str) -> None:
    """One directory per cell with ids and payload, beside the sizes of all cells."""
    index._populated().drop("part").write.mode("overwrite").partitionBy("cid").parquet(f"{path}/cells")
    index.sizes().coalesce(1).write.mode("overwrite").parquet(f"{path}/sizes")


def trim(vectors: DataFrame, n: int) -> DataFrame:
    """The vectors with ids below n."""
    return vectors.where(F.col("vec_id") < n)
