"""Search of a stream of queries against a populated index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import IVFIndex


def search_stream(index: IVFIndex, queries: DataFrame, k: int, w: int, path: str, checkpoint: str) -> StreamingQuery:
    """Append the results of each micro-batch of ``queries(qid, q)`` to Parquet at ``path``.

    Every micro-batch is one batch search, and goes to a directory of its own number, so a
    batch that is replayed after a failure replaces what it had written.
    """

    def write(batch: DataFrame, number: int) -> None:
        index.search(batch, k, w).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
