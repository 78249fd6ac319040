"""Recall and scan costs of search results against ground truth, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall_at_k(result: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Share of the true k nearest that the first k results hold; queries count k each."""
    found = result.where(F.col("rank") <= k).select("qid", "vec_id").join(truth.where(F.col("rank") <= k).select("qid", "vec_id"), ["qid", "vec_id"])
    n = truth.select("qid").distinct().agg(F.count("*").alias("nq"))
    return found.agg(F.count("*").alias("hits")).join(F.broadcast(n)).select(F.lit(k).cast("int").alias("k"), (F.col("hits") / (F.col("nq") * k)).alias("recall"))


def recall_1_at_k(result: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Share of queries whose nearest neighbour is among the first k results."""
    first = truth.where(F.col("rank") == 1).select("qid", "vec_id")
    hits = result.where(F.col("rank") <= k).select("qid", "vec_id", F.lit(1).alias("hit"))
    return first.join(hits, ["qid", "vec_id"], "left").agg(F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("recall")).select(F.lit(k).cast("int").alias("k"), "recall")


def list_sizes(postings: DataFrame, kc: int) -> DataFrame:
    """``cid, n`` for all cells, empty ones included."""
    cells = postings.sparkSession.range(kc).select(F.col("id").cast("int").alias("cid"))
    return cells.join(postings.groupBy("cid").agg(F.count("*").alias("n")), "cid", "left").select("cid", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def searched_counts(topw: DataFrame, sizes: DataFrame) -> DataFrame:
    """``qid, searched_cnt``: vectors in the cells that a query probes."""
    return topw.select("qid", "cid").join(sizes, "cid").groupBy("qid").agg(F.sum("n").alias("searched_cnt"))


def scan_stats(topw: DataFrame, sizes: DataFrame) -> DataFrame:
    """Cells and vectors scanned by a batch of queries."""
    return topw.join(sizes, "cid").agg(F.count("*").alias("searched_clusters"), F.sum("n").alias("searched_vectors"))


def truth_per_cell(truth: DataFrame, postings: DataFrame, kc: int) -> DataFrame:
    """``qid, cid, hits``: how many of a query's true neighbours lie in each cell, zeros kept."""
    cells = truth.sparkSession.range(kc).agg(F.collect_list(F.col("id").cast("int")).alias("cells"))
    grid = truth.select("qid").distinct().join(F.broadcast(cells)).select("qid", F.explode("cells").alias("cid"))
    hits = truth.select("qid", "vec_id").join(postings.select("vec_id", "cid"), "vec_id").groupBy("qid", "cid").agg(F.count("*").alias("hits"))
    return grid.join(hits, ["qid", "cid"], "left").select("qid", "cid", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"))
