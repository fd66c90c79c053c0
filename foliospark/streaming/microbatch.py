"""The batch graph over micro-batches: documents have no state in common."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def run_stream(source: DataFrame, graph: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes ``graph`` of every micro-batch below ``sink``, each batch in a folder of its own so that a repeated one replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        graph(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    writer = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
