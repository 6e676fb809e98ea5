"""The mask on a stream: the projection keeps no state, so it runs unchanged; batches that fail the gate stop the query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from palimpsest.operators.mask import ColumnPlan, check_gate, mask


def mask_stream(stream: DataFrame, plans: list[ColumnPlan], seed: str, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write each batch's masked rows to path, in a folder for its number: a batch that is tried again replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        try:
            check_gate(rows, plans, seed)
            mask(rows, plans, seed).write.mode("overwrite").parquet(f"{path}/batch={number}")
        finally:
            rows.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
