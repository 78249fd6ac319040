"""Nearest centers and Lloyd's k-means."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distance import TILE, l2sqr_block, matrix
from .config import check_broadcast


def subspaces(flat: np.ndarray, m: int) -> np.ndarray:
    """(rows, dim) as (m, rows, dim / m)."""
    return flat.reshape(len(flat), m, -1).transpose(1, 0, 2)


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Index of the nearest center of each row, by blocks of bounded size; ties go to the lowest index."""
    out = np.empty(len(x), np.int32)
    block = max(1, TILE // max(1, len(centers)))
    for at in range(0, len(x), block):
        out[at : at + block] = l2sqr_block(x[at : at + block], centers).argmin(axis=1)
    return out


def assign(vectors: DataFrame, centers: np.ndarray, keep: tuple[str, ...] = ()) -> DataFrame:
    """``vec_id, cid`` and the columns in ``keep``; one pass over the vectors, no shuffle."""
    check_broadcast(centers.nbytes, "the centers")
    shared = vectors.sparkSession.sparkContext.broadcast(centers)
    dim = centers.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid = nearest(matrix(batch["embedding"], dim), shared.value)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(cid), *(batch[c] for c in keep)], ["vec_id", "cid", *keep])

    columns = list(dict.fromkeys(["vec_id", "embedding", *keep]))
    kept = "".join(f", {c} {vectors.schema[c].dataType.simpleString()}" for c in keep)
    return vectors.select(*columns).mapInArrow(run, f"vec_id long, cid int{kept}")


def assign_sql(vectors: DataFrame, centers: DataFrame, distance) -> DataFrame:
    """The same as a plan of Catalyst expressions; for small codebooks and as a reference.

    Each vector meets the broadcast codebook as one array, so no row is multiplied.
    """
    book = centers.agg(F.sort_array(F.collect_list(F.struct("cid", "center"))).alias("book"))
    best = F.array_min(F.transform("book", lambda c: F.struct(distance(F.col("embedding"), c["center"]).alias("dist"), c["cid"].alias("cid"))))
    return vectors.join(F.broadcast(book)).select("vec_id", best["cid"].alias("cid"), best["dist"].alias("dist"))


def lloyd(vectors: DataFrame, initial: np.ndarray, iterations: int) -> np.ndarray:
    """Centers after ``iterations`` rounds of assignment, the last of which updates nothing.

    ``initial`` is (m, k, dim / m): the m subspaces of a vector train together, one job a
    round. Tasks send sums and counts per center, m * k rows each at most; an empty center
    stays where it is. The codebook (m * k * dim / m numbers) is all that reaches the driver. Sums are in double
    precision and centers in single, so the order in which tasks' sums arrive can show in a last bit at most.
    """
    check_broadcast(initial.nbytes, "the centers")
    m, k, width = initial.shape
    centers = initial.astype(np.float32).astype(np.float64)
    spark = vectors.sparkSession
    points = vectors.select("embedding").persist()
    try:
        for _ in range(iterations - 1):
            shared = spark.sparkContext.broadcast(centers)

            def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                total, count = np.zeros((m, k, width)), np.zeros((m, k), np.int64)
                for batch in batches:
                    for s, x in enumerate(subspaces(matrix(batch["embedding"], m * width), m)):
                        own = nearest(x, shared.value[s])
                        np.add.at(total[s], own, x)
                        count[s] += np.bincount(own, minlength=k)
                at = np.argwhere(count > 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at[:, 0], pa.int32()), pa.array(at[:, 1], pa.int32()), pa.array(list(total[at[:, 0], at[:, 1]]), pa.list_(pa.float64())), pa.array(count[at[:, 0], at[:, 1]])],
                    ["m", "ks", "total", "n"],
                )

            added = [F.sum(F.get("total", F.lit(d))).alias(f"d{d}") for d in range(width)]
            rows = points.mapInArrow(sums, "m int, ks int, total array<double>, n long").groupBy("m", "ks").agg(F.sum("n").alias("n"), *added).collect()
            centers = centers.copy()
            for r in rows:
                centers[r["m"], r["ks"]] = np.array([r[f"d{d}"] / r["n"] for d in range(width)], np.float32)
            shared.unpersist()
    finally:
        points.unpersist()
    return centers


def initial_points(vectors: DataFrame, k: int, dim: int, init: str | list[int] = "points", seed: int = 123) -> np.ndarray:
    """k start points: different rows by a seeded hash ("points"), rows drawn with replacement ("draws"), rows with given ids, or zeros."""
    if init == "zeros":
        return np.zeros((k, dim))
    if init == "draws":
        found = _drawn(vectors, k, seed)
    else:
        if init == "points":
            chosen = vectors.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(k)
        else:
            chosen = vectors.where(F.col("vec_id").isin(list(init))).orderBy("vec_id")
        found = [r["embedding"] for r in chosen.select("embedding").collect()]
    points = np.array(found, np.float64).reshape(-1, dim)
    if len(points) != k:
        raise ValueError(f"{k} start points asked for, {len(points)} found")
    return points


def _drawn(vectors: DataFrame, k: int, seed: int) -> list[list[float]]:
    """k rows, possibly the same, each the first at or after a random place on the circle of hashes.

    A task sends its first row for each draw at most, whatever it reads.
    """
    draws = np.sort(np.random.default_rng(seed).integers(-(1 << 63), 1 << 63, k, dtype=np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[int, list[float]]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            h = batch["h"].to_numpy()
            order = np.argsort(h, kind="stable")
            at = np.searchsorted(h[order], draws)
            for draw, place in enumerate(np.append(at, 0).tolist()):  # the last is the first row of all, for draws beyond the last
                if place < len(order):
                    own = int(h[order[place]])
                    if draw not in best or own < best[draw][0]:
                        best[draw] = (own, batch["embedding"][int(order[place])].as_py())
        columns = list(zip(*((d, h, e) for d, (h, e) in best.items()))) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.list_(pa.float32()))], ["draw", "h", "embedding"])

    rows = vectors.select(F.xxhash64("vec_id", F.lit(seed)).alias("h"), F.col("embedding").cast("array<float>").alias("embedding")).mapInArrow(run, "draw int, h long, embedding array<float>")
    found = {r["draw"]: r["embedding"] for r in rows.groupBy("draw").agg(F.min_by("embedding", "h").alias("embedding")).collect()}
    return [found.get(d, found[k]) for d in range(k)] if found else []


def training_sample(vectors: DataFrame, rows: int, seed: int) -> DataFrame:
    """About ``rows`` vectors, 100,000 at least, or all that there are, chosen by a seeded hash of the id.

    A threshold of the hash picks them, with some to spare, so they stay in the partitions they come from.
    """
    wanted = max(rows, 100_000)
    n = vectors.count()
    if n <= wanted:
        return vectors
    below = int((1 << 40) * min(1.0, (wanted + 5 * wanted**0.5) / n))
    return vectors.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 40)) < below)


def center_table(spark, centers: np.ndarray, name: str = "cid") -> DataFrame:
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(centers)]
    return spark.createDataFrame(rows, f"{name} int, center array<float>")
