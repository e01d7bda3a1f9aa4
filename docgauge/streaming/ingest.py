"""Continuous ingestion: new files are evaluated as they arrive.

The query is stateless; its only state is the file log in the checkpoint. The files of a
micro-batch are read once: their texts and outcomes are written to a folder of the attempt,
and both the evaluations and the rejected files come from there, so they agree. The sink
commits a batch as a whole, so one replayed after a lost driver or executor replaces its
own output.
"""

import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from docgauge.plans.evaluate import evaluate
from docgauge.sources import readers, sinks


def file_stream(spark: SparkSession, path: str, max_files_per_trigger: int = 1000) -> DataFrame:
    return readers.file_rows(
        spark.readStream.format("text").schema(readers.FILE_SCHEMA)
        .option("wholetext", "true").option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", max_files_per_trigger).load(path)
    )


def start(spark: SparkSession, path: str, root: str, as_of: str | Callable[[], str] | None, checkpoint: str,
          once: bool = False, limit: int | None = None, **options) -> StreamingQuery:
    """Start the ingestion query; ``once`` drains what is there and stops.

    ``as_of`` is a date, a function that gives the date for each batch, or None for
    the day on which a batch is evaluated. Rejected files are written with each batch.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        day = as_of() if callable(as_of) else as_of or datetime.now(timezone.utc).date().isoformat()
        outcomes = sinks.staged(readers.with_outcome(batch, limit), f"{root}/_staged/{uuid.uuid4().hex}")
        with outcomes as rows:
            accepted, rejected = readers.split_outcomes(rows)
            sinks.write_batch(evaluate(accepted, day, **options), root, batch_id, rejected)

    writer = file_stream(spark, path).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
