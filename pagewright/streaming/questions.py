"""Questions from a stream against a batch of units: each micro-batch is ranked and written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import rank


def answer_stream(questions: DataFrame, units: DataFrame, out_path: str, checkpoint: str, limit: int = rank.SHORTLIST) -> StreamingQuery:
    """Starts a query that writes the shortlist of every question (query_id, doc_id, query) as Parquet.

    A micro-batch that is repeated after a failure writes its own folder again.
    """

    def write(batch: DataFrame, number: int) -> None:
        rank.fuse(batch, units, limit).write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    return questions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
