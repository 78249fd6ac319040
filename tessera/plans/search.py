"""Registered queries over the ``embeddings`` table.

The query set is every vector whose id is divisible by 50; all vectors are searched. Start
centers are the vectors of the lowest ids, so that any engine trains the same codebooks.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.distance import l2sqr, l2sqr_u8, quantize_u8
from ..operators import evaluate, exchange
from ..operators.config import IVFConfig, IVFPQConfig
from ..operators.index import IVFIndex, IVFPQIndex
from ..operators.kmeans import assign, assign_sql, center_table, initial_points, lloyd
from ..operators.quantizer import Quantizer, subvector
from ..operators.search import blocks, distance_tables, exact_knn
from ..operators.shared import shared_path
from ..sources.vecs import read_vecs
from ..operators.store import trim

DIM, KC, ROUNDS, W, K = 64, 8, 4, 3, 10
MP, KP, PQ_ROUNDS = 8, 16, 3
BOOK = [1, 3, 5]
TRIM = 400


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding")


def query_set(v: DataFrame) -> DataFrame:
    return v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))


def ivf(v: DataFrame, rounds: int = ROUNDS) -> IVFIndex:
    return IVFIndex(IVFConfig(DIM, KC, rounds)).train(v, list(range(KC)), whole=True).populate(v)


def ivfpq(v: DataFrame) -> IVFPQIndex:
    config = IVFPQConfig(DIM, KC, ROUNDS, mp=MP, kp=KP, pq_iterations=PQ_ROUNDS)
    return IVFPQIndex(config).train(v, list(range(KC)), list(range(KP)), whole=True).populate(v)


def _pairs(v: DataFrame, u8: str = "") -> DataFrame:
    """Every query against every vector; the queries are the stated set, broadcast in blocks."""
    q = query_set(v)
    if u8:
        q = q.withColumn("q", quantize_u8("q"))
    x = v.withColumn("embedding", quantize_u8("embedding")) if u8 == "both" else v
    dist = l2sqr_u8("q", "embedding") if u8 == "both" else l2sqr("q", "embedding")

    def one(part: DataFrame) -> DataFrame:
        book = part.agg(F.collect_list(F.struct("qid", "q")).alias("book"))
        each = x.join(F.broadcast(book)).select("vec_id", "embedding", F.explode("book").alias("b")).select("vec_id", "embedding", "b.*")
        return each.select(F.col("qid").alias("i"), F.col("vec_id").alias("j"), dist.alias("dist"))

    return reduce(DataFrame.unionByName, [one(part) for part in blocks(q, (DIM + 1) * 8)])


def _values(df: DataFrame, array: str, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode(array).alias("pos", "value")).select(*keys, "pos", F.col("value").cast("double").alias("value"))


def _start(v: DataFrame) -> np.ndarray:
    return initial_points(v, KC, DIM, list(range(KC)))


def _lloyd(v: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """Centers by k-means itself, without an index."""
    return lloyd(v, _start(v)[None], rounds)[0]


def _centers(spark: SparkSession, d: str, rounds: int) -> DataFrame:
    return _values(center_table(spark, _lloyd(vectors(spark, d), rounds)), "center", "cid")


def _trained(spark: SparkSession, d: str) -> DataFrame:
    """The coarse codebook of a trained index."""
    return _values(IVFIndex(IVFConfig(DIM, KC, ROUNDS)).train(vectors(spark, d), list(range(KC)), whole=True).codebook(spark), "center", "cid")


def _trained_pq(spark: SparkSession, d: str) -> DataFrame:
    """The product codebook of a trained index."""
    config = IVFPQConfig(DIM, KC, ROUNDS, mp=MP, kp=KP, pq_iterations=PQ_ROUNDS)
    return _values(IVFPQIndex(config).train(vectors(spark, d), list(range(KC)), list(range(KP)), whole=True).pq.codebook(spark), "center", "m", "ks")


def _pq(spark: SparkSession, d: str) -> DataFrame:
    q = Quantizer(DIM, MP, KP).fit(vectors(spark, d), PQ_ROUNDS, list(range(KP)))
    return _values(q.codebook(spark), "center", "m", "ks")


def _nearest_center(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return assign_sql(v, center_table(spark, _start(v)), l2sqr)


def _knn(spark: SparkSession, d: str, k: int = K) -> DataFrame:
    v = vectors(spark, d)
    return exact_knn(v, query_set(v), DIM, k)


def _topw(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return ivf(v).topw(query_set(v), W).select("qid", "rank", "cid")


def _codes(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode("code").alias("m", "ks")).select(*keys, "m", F.col("ks").cast("int").alias("ks"))


def _table(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return distance_tables(query_set(v), ivfpq(v).pq._trained())


def _adc(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return ivfpq(v).distances(query_set(v))


def _search(index: Callable[[DataFrame], IVFIndex], spark: SparkSession, d: str, w: int = W) -> DataFrame:
    v = vectors(spark, d)
    return index(v).search(query_set(v), K, w)


def _given(spark: SparkSession, d: str) -> DataFrame:
    """Cells qid % kc and (qid / 50) % kc for each query, whatever is near."""
    v = vectors(spark, d)
    topw = query_set(v).select("qid", "q", F.explode(F.expr(f"array(int(qid % {KC}), int(qid div 50 % {KC}))")).alias("cid"))
    return ivfpq(v).search_cells(topw, K)


def _counts(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    index = ivf(v)
    return index.searched_counts(index.topw(query_set(v), W))


def _stats(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    index = ivfpq(v)
    return evaluate.scan_stats(index.topw(query_set(v), W), index.sizes())


def _subvectors(spark: SparkSession, d: str) -> DataFrame:
    width = DIM // MP
    parts = F.array(*(F.struct(F.lit(m).alias("m"), subvector("embedding", m, width).alias("part")) for m in range(MP)))
    return _values(vectors(spark, d).select("vec_id", F.explode(parts).alias("p")).select("vec_id", "p.*"), "part", "vec_id", "m")


def _book_files(spark: SparkSession, d: str) -> DataFrame:
    """Cells' files written and a book of them read by another index."""
    path = shared_path(spark, "cells")
    index = ivfpq(vectors(spark, d))
    exchange.write_cells(index, path, spark)
    return _codes(exchange.load_book(IVFPQIndex(index.config), path, BOOK, spark).postings, "cid", "vec_id")


def _codebook_files(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "codebooks")
    index = ivfpq(vectors(spark, d))
    exchange.write_codebooks(index, path, spark)
    return _values(exchange.read_codebooks(IVFPQIndex(index.config), path, spark).pq.codebook(spark), "center", "m", "ks")


def _truth_files(spark: SparkSession, d: str) -> DataFrame:
    """The ground truth as its two files have it: records by query, single-precision distances."""
    path = shared_path(spark, "truth")
    exchange.write_ground_truth(_knn(spark, d), path)
    ids = read_vecs(spark, f"{path}/train_groundtruth.ivecs").select("vec_id", F.posexplode("embedding").alias("rank", "neighbour"))
    dist = read_vecs(spark, f"{path}/train_distance.fvecs").select("vec_id", F.posexplode("embedding").alias("rank", "dist"))
    return ids.join(dist, ["vec_id", "rank"]).select(F.col("vec_id").alias("record"), "rank", F.col("neighbour").cast("long").alias("vec_id"), F.col("dist").cast("double").alias("dist"))


def _trim_file(spark: SparkSession, d: str) -> DataFrame:
    path = f"{shared_path(spark, 'trimmed')}/base.fvecs"
    exchange.write_trimmed(vectors(spark, d), TRIM, path)
    return _values(read_vecs(spark, path), "embedding", "vec_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "l2sqr_pairs": lambda s, d: _pairs(vectors(s, d)),
    "l2sqr_u8_pairs": lambda s, d: _pairs(vectors(s, d), "both"),
    "l2sqr_u8_f32": lambda s, d: _pairs(vectors(s, d), "query"),
    "exact_nn1": lambda s, d: _knn(s, d, 1),
    "exact_knn": _knn,
    "nearest_center": _nearest_center,
    "kmeans_update": lambda s, d: _centers(s, d, 2),
    "kmeans_centroids": lambda s, d: _centers(s, d, ROUNDS),
    "kmeans_labels": lambda s, d: assign(vectors(s, d), _lloyd(vectors(s, d))),
    "ivf_train": _trained,
    "ivf_assign": lambda s, d: ivf(vectors(s, d)).postings.select("vec_id", "cid"),
    "ivf_list_sizes": lambda s, d: ivf(vectors(s, d)).sizes(),
    "coarse_topw": _topw,
    "ivf_search": partial(_search, ivf),
    "ivf_searched_cnt": _counts,
    "avg_searched_cnt": lambda s, d: _counts(s, d).agg(F.avg("searched_cnt").alias("avg_searched_cnt")),
    "subvector_slice": _subvectors,
    "pq_codebook": _pq,
    "ivfpq_train": _trained_pq,
    "pq_encode": lambda s, d: _codes(ivfpq(vectors(s, d)).postings, "vec_id"),
    "pq_distance_table": _table,
    "pq_adc": _adc,
    "ivfpq_list_sizes": lambda s, d: ivfpq(vectors(s, d)).sizes(),
    "ivfpq_postings": lambda s, d: _codes(ivfpq(vectors(s, d)).postings, "cid", "vec_id"),
    "ivfpq_search": partial(_search, ivfpq),
    "ivfpq_topk_given_topw": _given,
    "ivfpq_scan_stats": _stats,
    "pq_exhaustive": partial(_search, ivfpq, w=KC),
    "book_scan": lambda s, d: ivf(vectors(s, d)).book(BOOK).select("cid", "vec_id"),
    "gt_hits_per_cluster": lambda s, d: ivf(vectors(s, d)).observe(_knn(s, d)),
    "recall_at_k": lambda s, d: evaluate.recall_at_k(_search(ivf, s, d), _knn(s, d), K),
    "recall_1_at_k": lambda s, d: evaluate.recall_1_at_k(_search(ivf, s, d), _knn(s, d), K),
    "book_files": _book_files,
    "codebook_files": _codebook_files,
    "ground_truth_files": _truth_files,
    "trim_file": _trim_file,
    "trim_dataset": lambda s, d: trim(s.read.parquet(f"{d}/embeddings.parquet"), TRIM).select("vec_id", "label"),
}
