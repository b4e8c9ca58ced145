"""A stream's batches against a table: what in each batch differs from the snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.diff import added, changed
from ..options import CompareOptions


def compare_batches(stream: DataFrame, snapshot: DataFrame, key, path: str, checkpoint: str, options: CompareOptions | None = None, available_now: bool = True) -> StreamingQuery:
    """Write, for each batch, the cells that are new or changed against ``snapshot``.

    Every batch goes to a folder of its own number, which a retry overwrites, so
    each batch counts once.
    """

    def one(batch: DataFrame, number: int) -> None:
        o = options or CompareOptions(unique_keys="off")
        batch.persist()
        found = changed(snapshot, batch, key, None, o).unionByName(added(snapshot, batch, key, None, o))
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")
        batch.unpersist()

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
