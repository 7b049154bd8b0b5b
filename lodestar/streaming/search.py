"""Structured Streaming: queries arrive as a stream, each micro-batch is searched as a set.

Ranking needs windows that streams don't have, so the search runs in foreachBatch; the batch number in the output path
makes a repeated batch overwrite itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lodestar.operators.kmeans import IvfIndex
from lodestar.operators.search import ivf_search, query_set


def search_stream(stream: DataFrame, index: IvfIndex, nprobe: int, k: int, out: str, checkpoint: str) -> StreamingQuery:
    """stream (vec_id, embedding): results of each micro-batch under out/batch=n. Ends when all that is there is done."""

    def batch(rows: DataFrame, number: int) -> None:
        ivf_search(index, query_set(rows), nprobe, k).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
