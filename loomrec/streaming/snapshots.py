"""A stream of snapshots: each micro-batch is a whole snapshot and is compared with the one before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from loomrec.operators.diff import snapshot_diff


def follow(stream: DataFrame, key: str, fields: list[str], out: str, **trigger) -> StreamingQuery:
    """Writes the differences of each snapshot from the one before to ``out``/changes/batch=N.

    ``stream`` gives one snapshot a micro-batch (maxFilesPerTrigger of the file source). The first
    is all added. A snapshot is kept under its batch number in ``out``/snapshots, so a batch that is
    run again after a failure overwrites its own results and compares with the same one before.
    ``out`` is a folder that driver and executors share.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark, here = batch.sparkSession, f"{out}/snapshots/{number}"
        batch.write.mode("overwrite").parquet(here)
        reader = spark.read.schema(batch.schema)
        now = reader.parquet(here)
        before = reader.parquet(f"{out}/snapshots/{number - 1}") if number else spark.createDataFrame([], batch.schema)
        snapshot_diff(before, now, key, fields).write.mode("overwrite").parquet(f"{out}/changes/batch={number}")

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{out}/checkpoint")
    return writer.trigger(**(trigger or {"availableNow": True})).start()
