"""Extension: score a stream of new queries against a fixed gallery.

Each micro-batch is the batch plan; results are appended to a Parquet sink
under the batch's number, so a batch that is run again replaces its own rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from prismrank.operators import ranking


def score_stream(queries: DataFrame, gallery: DataFrame, path: str, checkpoint: str, k: int = 10, metric: str = "dot", once: bool = True) -> StreamingQuery:
    """``queries``: a stream of query_id and query_vec.  Writes the k best gallery
    rows of each (query_id, gallery_id, sim, rank) to ``path``: k rows a query
    and shard leave a task, not one a pair."""

    def write(batch: DataFrame, number: int) -> None:
        best = ranking.top_blocks(batch, gallery, k, metric)
        best.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = queries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
