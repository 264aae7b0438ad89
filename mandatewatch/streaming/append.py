"""Exactly-once append of arriving rows by id."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mandatewatch.sources.keyed_table import not_stored


def start_deduplicated(
    arriving: DataFrame, key: str, time: str, delay: str, out: str, checkpoint: str
) -> StreamingQuery:
    """With an event time: state holds ids only as long as the watermark allows."""
    timed = arriving.withColumn(time, F.col(time).cast("timestamp"))
    once = timed.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
    return (
        once.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def start_append_by_id(arriving: DataFrame, key: str, out: str, checkpoint: str) -> StreamingQuery:
    """Without an event time: each batch adds the ids the table does not hold yet.

    A manifest beside the table says which files may hold an id, and a batch reads
    only those.

    A batch writes to a folder of its own, named after the query's checkpoint and
    the batch number. A retried batch replaces that folder as a whole; a query
    that starts over with a new checkpoint finds the earlier rows and adds nothing.
    """
    writer = "w" + hashlib.md5(checkpoint.encode()).hexdigest()
    own = re.compile(rf"/writer={writer}/batch=(\d+)/")

    def add_missing(batch: DataFrame, batch_id: int) -> None:
        # What this batch wrote before it was retried does not count.
        earlier = lambda file: not (m := own.search(file)) or int(m.group(1)) < batch_id
        new = not_stored(batch, key, out, earlier)
        new.write.mode("overwrite").parquet(f"{out}/writer={writer}/batch={batch_id}")

    return (
        arriving.writeStream.foreachBatch(add_missing)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
