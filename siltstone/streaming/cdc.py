"""Change streams into satellites: each micro-batch is replayed in order, once."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.operators.satellite import Satellite, replay
from siltstone.plans.store import Table


#: Batches that may lie beside the base before they are folded into it.
MOST_RUNS = 16


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The identity that Spark gives to a stream with its checkpoint, and that a new checkpoint hasn't."""
    return spark.read.json(f"{checkpoint}/metadata").first()["id"]


def load_batch(batch: DataFrame, stream: str, number: int, sat: Satellite, table: Table, order: list[str], record_source: str, at: datetime | None) -> bool:
    """Replay one batch into the satellite, unless the table's ledger has it; tells whether it was loaded.

    The ledger, batch numbers by stream, is published in one step with the rows, and every version hands it
    on, whoever makes it. So any number of streams may feed a table, beside other loads, in turns.
    """
    version = table.latest()
    if version.ledger.get(stream, -1) >= number:
        return False
    batch = batch.persist()  # its keys are looked up before its rows are replayed; a stream's source can be read again
    try:
        at = at or batch.agg(F.max(order[0])).first()[0]
        done = replay(sat, table.current_of(batch, version), batch, order, at or datetime(1900, 1, 1), record_source, unchanged=False)
        written = table.commit(done, base=version, ledger={stream: number})
        if len(written.runs) > MOST_RUNS:
            table.compact(history=False)
    finally:
        batch.unpersist()
    return True


def into_satellite(changes: DataFrame, sat: Satellite, table: Table, order: list[str], checkpoint: str, record_source: str, clock: Callable[[], datetime] | None = None) -> StreamingQuery:
    """Start a query that takes what is available and ends.

    A batch that is delivered again after a crash isn't loaded twice (see ``load_batch``); a stream that begins
    anew with another checkpoint is another stream. A batch's version date is ``clock()``; without a clock it is
    the latest ``order[0]`` of the batch, a time, so that a batch delivered again gives the same rows. Only
    current rows of the batch's keys are merged, and only what changes is written. The table must exist
    (it may be empty).
    """

    def load(batch: DataFrame, number: int) -> None:
        stream = stream_id(batch.sparkSession, checkpoint)
        load_batch(batch, stream, number, sat, table, order, record_source, clock() if clock else None)

    return changes.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
