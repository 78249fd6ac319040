"""Postings as Parquet, partitioned by ranges of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_postings(postings: DataFrame, path: str, per_part: int, mode: str) -> DataFrame:
    """Write ``cid, vec_id`` and a payload in partitions ``part = cid div per_part``, sorted by cell, and read them back.

    The postings are rebalanced by partition: Spark splits those that are large, so a crowded cell is several files, and
    puts small ones together.
    """
    rows = postings.withColumn("part", F.expr(f"cast(cid div {per_part} as int)"))
    dealt = rows.hint("rebalance", "part").sortWithinPartitions("part", "cid", "vec_id")
    dealt.write.mode(mode).partitionBy("part").parquet(path)
    return postings.sparkSession.read.schema(rows.schema).parquet(path)
