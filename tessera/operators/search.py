"""Exact and probe-limited nearest neighbours over vectors, cells and codes."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import TILE, l2sqr_block, matrix
from .config import BROADCAST_BYTES, check_broadcast, validated

RESULT = "qid long, vec_id long, dist double"


def top_k(scored: DataFrame, k: int, by: str = "qid", tie: str = "vec_id") -> DataFrame:
    """The k rows of least ``dist`` per ``by``, ranked from 1; equal distances by ``tie``."""
    if k < 1:
        raise ValueError("k must be positive")
    window = Window.partitionBy(by).orderBy("dist", tie)
    return scored.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def blocks(queries: DataFrame, row_bytes: int) -> list[DataFrame]:
    """The query set, or parts of it by a hash of ``qid``, each small enough to broadcast."""
    parts = max(1, -(-queries.count() * row_bytes // BROADCAST_BYTES))
    if parts == 1:
        return [queries]
    return [queries.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == i) for i in range(parts)]


def _union(found: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def _best(qid: np.ndarray, vec_id: np.ndarray, dist: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per query the k best of one batch, by distance, then id."""
    for q in range(len(qid)):
        d = dist[:, q]
        near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > k else np.arange(len(d))
        near = near[np.lexsort((vec_id[near], d[near]))][:k]
        yield np.full(len(near), qid[q]), vec_id[near], d[near]


def _batch(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in zip(*found)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["qid", "vec_id", "dist"])


def _nearest_of_block(x: np.ndarray, ids: np.ndarray, qid: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Per query the k best of some vectors, by tiles of queries that bound the distances held at once."""
    step = max(1, TILE // max(1, len(x)))
    for at in range(0, len(qid), step):
        yield from _best(qid[at : at + step], ids, l2sqr_block(x, q[at : at + step]), k)


def exact_knn(vectors: DataFrame, queries: DataFrame, dim: int, k: int) -> DataFrame:
    """``qid, rank, vec_id, dist``: one pass over the vectors for each block of queries.

    A batch sends its k best per query at most, so what is shuffled doesn't grow with the
    vectors' width. A query set that fits a broadcast is one block. Vectors and queries that are null, hold a null or a
    NaN or have another length are errors.
    """
    queries = validated(queries, dim, "q")

    def one(part: DataFrame) -> DataFrame:
        rows = part.select("qid", "q").orderBy("qid").collect()
        own = np.array([r["qid"] for r in rows], np.int64), np.array([r["q"] for r in rows], np.float64).reshape(-1, dim)
        shared = vectors.sparkSession.sparkContext.broadcast(own)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qid, q = shared.value
            for batch in batches:
                if batch.num_rows and len(qid):
                    yield _batch(list(_nearest_of_block(matrix(batch["embedding"], dim), batch["vec_id"].to_numpy(), qid, q, k)))

        return top_k(vectors.select("vec_id", "embedding").mapInArrow(run, RESULT), k).select("qid", "rank", "vec_id", "dist")

    return _union([one(part) for part in blocks(queries, (dim + 1) * 8)])


def nearest_cells(q: np.ndarray, centers: np.ndarray, w: int) -> np.ndarray:
    """(queries, w): the nearest cells, nearest first, equal distances by cell; by tiles of bounded size."""
    step = max(1, TILE // len(centers))
    found = [np.argsort(l2sqr_block(q[at : at + step], centers), axis=1, kind="stable")[:, :w] for at in range(0, len(q), step)]
    return np.concatenate(found).astype(np.int32) if found else np.empty((0, min(w, len(centers))), np.int32)


def coarse_topw(queries: DataFrame, centers: np.ndarray, w: int) -> DataFrame:
    """``qid, rank, cid, q``: the w nearest cells of each query, nearest first."""
    check_broadcast(centers.nbytes, "the centers")
    shared = queries.sparkSession.sparkContext.broadcast(centers)
    dim = centers.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid = nearest_cells(matrix(batch["q"], dim), shared.value, w)
            n, kept = cid.shape
            rows = np.repeat(np.arange(n), kept)
            yield pa.RecordBatch.from_arrays(
                [batch["qid"].take(pa.array(rows)), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), n)), pa.array(cid.ravel()), batch["q"].take(pa.array(rows))],
                ["qid", "rank", "cid", "q"],
            )

    return queries.select("qid", F.col("q").cast("array<float>").alias("q")).mapInArrow(run, "qid long, rank int, cid int, q array<float>")


#: Scores some rows of one cell against some queries: (payload column, ids, query ids, queries, k) to the best per query.
Kernel = Callable[[pa.Array, np.ndarray, np.ndarray, np.ndarray, int], Iterator[tuple[np.ndarray, ...]]]


def _probed(postings: DataFrame, topw: DataFrame, payload: str, dim: int, k: int, kernel: Kernel, per_part: int | None) -> DataFrame:
    """``qid, rank, vec_id, dist`` over the cells in ``topw(qid, cid, q)``; repeats count once.

    Probes that fit a broadcast are sent to the postings, which stay where they are. More of them
    are joined with the postings by cell (:func:`_by_cell`).
    """
    probes = topw.select("qid", "cid", "q")
    most = most_probes(dim)
    rows = [tuple(r) for r in probes.limit(most + 1).collect()]
    if len(rows) > most:
        return top_k(_by_cell(postings, probes.dropDuplicates(["qid", "cid"]), payload, dim, k, kernel), k).select("qid", "rank", "vec_id", "dist")
    return _by_broadcast(postings, rows, payload, k, kernel, per_part)


def most_probes(dim: int) -> int:
    """How many (query, cell) pairs fit a broadcast."""
    return BROADCAST_BYTES // ((dim + 2) * 8)


def _by_broadcast(postings: DataFrame, rows: list[tuple], payload: str, k: int, kernel: Kernel, per_part: int | None) -> DataFrame:
    """The same for probes ``(qid, cid, q)`` that fit a broadcast: each batch of postings sends its k best per query.

    A stored index reads only the partitions of the cells asked for.
    """
    cells: dict[int, set[int]] = defaultdict(set)
    vectors: dict[int, np.ndarray] = {}
    for qid, cid, q in rows:
        cells[cid].add(qid)
        if qid not in vectors:
            vectors[qid] = np.array(q, np.float64)
    shared = postings.sparkSession.sparkContext.broadcast(({c: sorted(qids) for c, qids in cells.items()}, vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, queries = shared.value
        for batch in batches:
            cid, ids = batch["cid"].to_numpy(), batch["vec_id"].to_numpy()
            for c in np.unique(cid):
                if qids := own.get(int(c)):
                    at = np.flatnonzero(cid == c)
                    found = list(kernel(batch[payload].take(pa.array(at)), ids[at], np.array(qids, np.int64), np.stack([queries[q] for q in qids]), k))
                    yield _batch(found)

    found = of_cells(postings, sorted(cells), per_part).select("cid", "vec_id", payload).mapInArrow(run, RESULT)
    return top_k(found, k).select("qid", "rank", "vec_id", "dist")


def of_cells(postings: DataFrame, cells: list[int], per_part: int | None) -> DataFrame:
    """Postings of the cells: on a stored index by its partitions, whatever their number, and by cell."""
    if per_part:
        postings = postings.where(F.col("part").isin(sorted({c // per_part for c in cells})))
    return postings.where(F.col("cid").isin(cells))


def _by_cell(postings: DataFrame, probes: DataFrame, payload: str, dim: int, k: int, kernel: Kernel, most_rows: int = 50_000, most_probes: int = 5_000) -> DataFrame:
    """Probes and postings meet by cell. A crowded cell, or one that many queries ask for, is a grid of tasks:
    its postings are dealt to rows of the grid and its probes to columns, of bounded size each."""
    n = postings.groupBy("cid").agg(F.count("*").alias("n"))
    m = probes.groupBy("cid").agg(F.count("*").alias("m"))
    grid = n.join(m, "cid").select("cid", F.ceil(F.col("n") / most_rows).cast("int").alias("down"), F.ceil(F.col("m") / most_probes).cast("int").alias("across"))
    each = lambda size: F.explode(F.sequence(F.lit(0), F.col(size) - 1))
    left = postings.join(grid, "cid").select("cid", F.pmod(F.xxhash64("vec_id"), "down").cast("int").alias("i"), each("across").alias("j"), "vec_id", payload)
    right = probes.join(grid, "cid").select("cid", F.pmod(F.xxhash64("qid"), "across").cast("int").alias("j"), each("down").alias("i"), "qid", "q")

    def score(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(rows) or not len(asked):
            return pa.table({"qid": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "dist": pa.array([], pa.float64())})
        queries = matrix(asked["q"].combine_chunks(), dim)
        found = kernel(rows[payload].combine_chunks(), rows["vec_id"].to_numpy(), asked["qid"].to_numpy(), queries, k)
        return pa.Table.from_batches([_batch(list(found))])

    keys = ["cid", "i", "j"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, RESULT)


def vector_kernel(dim: int) -> Kernel:
    """Distances to the vectors themselves."""

    def kernel(payload: pa.Array, ids: np.ndarray, qid: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, ...]]:
        return _nearest_of_block(matrix(payload, dim), ids, qid, q, k)

    return kernel


def code_kernel(postings: DataFrame, codebook: np.ndarray) -> Kernel:
    """Asymmetric distances to codes: look-ups in a query's distance table, which is made where it is needed."""
    m = len(codebook)
    check_broadcast(codebook.nbytes, "the codebook")
    shared = postings.sparkSession.sparkContext.broadcast(codebook)

    def kernel(payload: pa.Array, ids: np.ndarray, qid: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, ...]]:
        codes = payload.flatten().to_numpy(zero_copy_only=False).reshape(-1, m)
        for one, vector in zip(qid, q):
            table = distance_table(vector, shared.value)
            dist = np.zeros(len(codes))
            for s in range(m):
                dist += table[s][codes[:, s]]
            yield from _best(np.array([one]), ids, dist[:, None], k)

    return kernel


def probe(postings: DataFrame, topw: DataFrame, payload: str, dim: int, k: int, kernel: Kernel, per_part: int | None = None) -> DataFrame:
    """``qid, rank, vec_id, dist`` over the cells in ``topw(qid, cid, q)``, scored by the kernel."""
    return _probed(postings, topw, payload, dim, k, kernel, per_part)


def search(postings: DataFrame, queries: DataFrame, centers: np.ndarray, w: int, payload: str, k: int, kernel: Kernel, per_part: int | None = None) -> DataFrame:
    """The same over the w cells nearest to each of ``queries(qid, q)``.

    Queries whose probes fit a broadcast are read once, and the driver, which holds the centers, picks their cells.
    """
    dim = centers.shape[1]
    most = most_probes(dim) // w
    rows = queries.select("qid", "q").limit(most + 1).collect()
    if len(rows) > most:
        return _probed(postings, coarse_topw(queries, centers, w), payload, dim, k, kernel, per_part)
    q = np.array([r["q"] for r in rows], np.float32).astype(np.float64).reshape(-1, dim)
    cells = nearest_cells(q, centers, w).tolist()
    return _by_broadcast(postings, [(r["qid"], c, v) for r, v, own in zip(rows, q, cells) for c in own], payload, k, kernel, per_part)


def distance_table(q: np.ndarray, codebook: np.ndarray) -> np.ndarray:
    """(m, ks): squared distance of each part of q to each code's center."""
    m, _, width = codebook.shape
    return np.stack([l2sqr_block(q[None, s * width : (s + 1) * width], codebook[s])[0] for s in range(m)])


def distance_tables(queries: DataFrame, codebook: np.ndarray) -> DataFrame:
    """``qid, m, ks, dist``: the distance table of every query ``(qid, q)``."""
    check_broadcast(codebook.nbytes, "the codebook")
    shared = queries.sparkSession.sparkContext.broadcast(codebook)
    m, k, width = codebook.shape
    step = max(1, TILE // (m * k))
    part, code = (i.ravel().astype(np.int32) for i in np.indices((m, k)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, step) for b in batches for at in range(0, b.num_rows, step)):
            q = matrix(batch["q"], m * width)
            dist = np.stack([l2sqr_block(q[:, s * width : (s + 1) * width], shared.value[s]) for s in range(m)], 1)
            n = len(q)
            yield pa.RecordBatch.from_arrays(
                [batch["qid"].take(pa.array(np.repeat(np.arange(n), m * k))), pa.array(np.tile(part, n)), pa.array(np.tile(code, n)), pa.array(dist.ravel())], ["qid", "m", "ks", "dist"]
            )

    return queries.select("qid", "q").mapInArrow(run, "qid long, m int, ks int, dist double")


def code_distances(postings: DataFrame, queries: DataFrame, codebook: np.ndarray) -> DataFrame:
    """``qid, vec_id, dist``: asymmetric distances of all codes to every query of a stated set, unranked.

    The queries are broadcast in blocks of checked size; nothing is shuffled.
    """
    m, _, width = codebook.shape
    check_broadcast(codebook.nbytes, "the codebook")
    queries = validated(queries, m * width, "q")

    def one(part: DataFrame) -> DataFrame:
        rows = part.select("qid", "q").orderBy("qid").collect()
        shared = postings.sparkSession.sparkContext.broadcast((codebook, [(r["qid"], np.array(r["q"], np.float64)) for r in rows]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            book, own = shared.value
            tables = [(qid, distance_table(q, book)) for qid, q in own]
            for batch in batches:
                codes = batch["code"].flatten().to_numpy(zero_copy_only=False).reshape(-1, m)
                for qid, table in tables:
                    dist = np.zeros(len(codes))
                    for s in range(m):
                        dist += table[s][codes[:, s]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), qid)), batch["vec_id"], pa.array(dist)], ["qid", "vec_id", "dist"])

        return postings.select("vec_id", "code").mapInArrow(run, RESULT)

    return _union([one(part) for part in blocks(queries, (m * width + 1) * 8)])
