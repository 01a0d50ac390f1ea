"""The decision log as a stream: new input files are decided once, across restarts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from weftline.sources import ledger


def follow(spark: SparkSession, source: str, schema: str, log: str, log_schema: str, checkpoint: str, decide: Callable[[DataFrame], DataFrame], keys: list[str]) -> StreamingQuery:
    """Decide what arrives in `source` (JSON lines) and append it to the log, then stop.

    The checkpoint keeps which files were read; a batch that is run again finds its keys in the
    log, so each key is decided once. Of repeated keys in a batch one is decided.
    """

    def step(batch: DataFrame, _: int) -> None:
        new = ledger.todo(batch.dropDuplicates(keys), ledger.read(batch.sparkSession, log, log_schema), keys)
        ledger.append(decide(new), log)

    stream = spark.readStream.schema(schema).json(source)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
