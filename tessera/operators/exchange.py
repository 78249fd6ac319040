"""Files in the layouts that other vector tools read: codebooks, cells, ground truth, trimmed sets.

Names and layouts are fixed by the format: ``<prefix>centers.fvecs`` is one record of all centers, ``id_<cell>.uivecs`` one record
of ids, ``pqcode_<cell>.ui8vecs`` a record of codes for each of them, ``posting_lists_lens.ivecs`` one record of all cells' sizes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files
from ..sources.vecs import records_of, write_vecs
from .index import IVFIndex, IVFPQIndex
from .quantizer import Quantizer


def write_codebook(spark: SparkSession, centers: np.ndarray, prefix: str, overwrite: bool = False) -> None:
    """``<prefix>centers.fvecs`` of centers (m, k, width)."""
    files.write(spark, f"{prefix}centers.fvecs", records_of([np.asarray(centers).ravel()], "fvecs"), overwrite)


def read_codebook(spark: SparkSession, prefix: str, m: int, k: int, width: int) -> np.ndarray:
    """Centers (m, k, width) of ``<prefix>centers.fvecs``."""
    path = f"{prefix}centers.fvecs"
    raw = files.head(spark, path, 4 + 4 * m * k * width)
    if len(raw) != files.size(spark, path) or int(np.frombuffer(raw[:4], "<i4")[0]) != m * k * width:
        raise ValueError(f"{path} isn't one record of {m} x {k} x {width} numbers")
    return np.frombuffer(raw, "<f4", offset=4).reshape(m, k, width).astype(np.float64)


def write_codebooks(index: IVFIndex, path: str, spark: SparkSession, overwrite: bool = False) -> None:
    """``cq_centers.fvecs``, and ``pq_centers.fvecs`` of a product-quantized index."""
    write_codebook(spark, index._trained()[None], f"{path}/cq_", overwrite)
    if isinstance(index, IVFPQIndex):
        write_codebook(spark, index.pq._trained(), f"{path}/pq_", overwrite)


def read_codebooks(index: IVFIndex, path: str, spark: SparkSession) -> IVFIndex:
    """Give an index of the same configuration the codebooks under ``path``."""
    c = index.config
    index.coarse = read_codebook(spark, f"{path}/cq_", 1, c.kc, c.dim)[0]
    if isinstance(index, IVFPQIndex):
        index.pq = Quantizer(c.dim, c.mp, c.kp).set_centers(read_codebook(spark, f"{path}/pq_", c.mp, c.kp, c.dim // c.mp))
    return index


def write_cells(index: IVFPQIndex, path: str, spark: SparkSession, overwrite: bool = False) -> None:
    """Files of ids and codes for every cell, empty ones too, and of the sizes.

    Cells arrive at the driver in order, sorted in ranges by Spark, and are written one after the other; the
    driver holds the ids of one cell.
    """
    sizes = [0] * index.config.kc

    def cell(cid: int, rows: Iterator) -> None:
        ids: list[int] = []

        def codes() -> Iterator:
            for r in rows:
                ids.append(r["vec_id"])
                yield r["code"]

        files.write(spark, f"{path}/pqcode_{cid}.ui8vecs", records_of(codes(), "ui8vecs"), overwrite)
        files.write(spark, f"{path}/id_{cid}.uivecs", records_of([ids] if ids else [], "uivecs"), overwrite)
        sizes[cid] = len(ids)

    written = set()
    rows = index._populated().select("cid", "vec_id", "code").orderBy("cid", "vec_id").toLocalIterator()
    for cid, own in groupby(rows, lambda r: r["cid"]):
        cell(cid, own)
        written.add(cid)
    for cid in set(range(index.config.kc)) - written:
        cell(cid, iter(()))
    files.write(spark, f"{path}/posting_lists_lens.ivecs", records_of([sizes], "ivecs"), overwrite)


def read_cells(spark: SparkSession, path: str, cells: list[int], mp: int) -> DataFrame:
    """``cid, vec_id, code`` of the given cells' files; each is read by the task that has it, on any file system."""
    names = [f"{path}/{name}" for c in sorted(set(cells)) for name in (f"id_{c}.uivecs", f"pqcode_{c}.ui8vecs")]
    both = spark.read.format("binaryFile").load(names).select(F.regexp_extract("path", r"_(\d+)\.u", 1).cast("int").alias("cid"), F.col("path").rlike(r"/id_\d+\.uivecs$").alias("ids"), "content")
    pairs = both.groupBy("cid").agg(F.max(F.when(F.col("ids"), F.col("content"))).alias("ids"), F.max(F.when(~F.col("ids"), F.col("content"))).alias("codes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cid, ids, codes in zip(batch["cid"].to_pylist(), batch["ids"].to_pylist(), batch["codes"].to_pylist()):
                own = np.frombuffer(ids or b"", "<u4")[1:].astype(np.int64)
                rows = np.frombuffer(codes or b"", np.uint8).reshape(-1, 4 + mp)[:, 4:]
                if len(own) != len(rows):
                    raise ValueError(f"cell {cid}: {len(own)} ids and {len(rows)} codes")
                lists = pa.FixedSizeListArray.from_arrays(pa.array(rows.astype(np.int16).ravel()), mp).cast(pa.list_(pa.int16()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), cid, np.int32)), pa.array(own), lists], ["cid", "vec_id", "code"])

    return pairs.mapInArrow(run, "cid int, vec_id long, code array<smallint>")


def load_book(index: IVFPQIndex, path: str, cells: list[int], spark: SparkSession) -> IVFPQIndex:
    """Let an index search the given cells of the files under ``path``; what it held before goes."""
    if bad := [c for c in cells if not 0 <= c < index.config.kc]:
        raise ValueError(f"no such cells: {bad}")
    rows = read_cells(spark, path, cells, index.config.mp)
    return index.attach(rows.withColumn("part", F.expr(f"cast(cid div {index.per_part} as int)")))


def write_ground_truth(truth: DataFrame, path: str, overwrite: bool = False) -> None:
    """``train_groundtruth.ivecs`` and ``train_distance.fvecs`` of ``truth(qid, rank, vec_id, dist)``, a record per query in order."""
    lists = truth.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "dist"))).alias("best"))
    for name, column in (("train_groundtruth.ivecs", "vec_id"), ("train_distance.fvecs", "dist")):
        write_vecs(lists.select(F.col("qid").alias("vec_id"), F.col(f"best.{column}").alias("embedding")), f"{path}/{name}", overwrite=overwrite)


def write_trimmed(vectors: DataFrame, n: int, target: str, source: str | None = None, overwrite: bool = False) -> None:
    """The vectors with ids below n as one file at ``target``; never in place of the file they come from."""
    if source is not None and files.same(vectors.sparkSession, source, target):
        raise ValueError(f"{target} is the source itself")
    write_vecs(vectors.where(F.col("vec_id") < n), target, overwrite=overwrite)


def uniform_vectors(spark: SparkSession, n: int, dim: int, seed: int = 5489) -> DataFrame:
    """n vectors of components uniform in [0, 1), by a hash of the seed, the id and the place: the same on any cluster."""
    unit = lambda d: ((F.shiftrightunsigned(F.xxhash64(F.lit(seed), "vec_id", d), 40)) / float(1 << 24)).cast("float")
    return spark.range(n).select(F.col("id").alias("vec_id")).withColumn("embedding", F.transform(F.sequence(F.lit(1), F.lit(dim)), unit))
