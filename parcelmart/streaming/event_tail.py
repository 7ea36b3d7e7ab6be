"""Tail of the event log as a stream: every event once, in batches, up to the end of its run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parcelmart.operators.joins import salted_join
from parcelmart.operators.runlog import EVENT_SCHEMA, terminal

FILES_PER_BATCH = 1000
SNAPSHOT_EVERY = 100
ENDS_SCHEMA = "run_id bigint, end_sequence bigint"


def event_stream(spark: SparkSession, source: str, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """New files of the log folder; the checkpoint of the query is the cursor."""
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(source)


def tail_events(
    spark: SparkSession, source: str, target: str, *, run_id: object = None, cursor: int = 0,
    files_per_batch: int = FILES_PER_BATCH, continuous: bool = False,
) -> StreamingQuery:
    """Delivers events beyond ``cursor`` (of one run or of all) into ``target``.

    A run ends with its first terminal event; what comes later is not delivered. Each batch writes its
    own folders, so a batch that is repeated after a failure replaces itself and nothing is delivered
    twice. Ends of runs are kept as a small table (one row per ended run) beside the delivered events; every
    hundredth batch writes it whole, the others only what they add, so a batch reads few folders.
    """
    events = event_stream(spark, source, files_per_batch).filter(F.col("sequence") > cursor)
    if run_id is not None:
        events = events.filter(F.col("run_id") == F.lit(run_id))

    def deliver(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession

        def ends_of(numbers: range) -> DataFrame:
            return own.read.schema(ENDS_SCHEMA).parquet(*[f"{target}/ends/batch={i}" for i in numbers])

        ends = batch.filter(terminal()).groupBy("run_id").agg(F.min("sequence").alias("end_sequence"))
        still_open = batch
        if batch_id:
            since = (batch_id - 1) // SNAPSHOT_EVERY * SNAPSHOT_EVERY
            earlier = ends_of(range(since, batch_id))
            still_open = salted_join(batch, earlier.select("run_id"), ["run_id"], ["sequence"], "left_anti")
            ends = ends.join(earlier.select("run_id"), "run_id", "left_anti")
            if batch_id % SNAPSHOT_EVERY == 0:
                ends = ends.unionByName(earlier)
        ends.write.mode("overwrite").parquet(f"{target}/ends/batch={batch_id}")
        known = ends_of(range(batch_id, batch_id + 1))
        kept = salted_join(still_open, known, ["run_id"], ["sequence"], "left").filter(
            F.col("end_sequence").isNull() | (F.col("sequence") <= F.col("end_sequence"))
        )
        kept.select("run_id", "sequence", "event_type", "payload", "created_at").write.mode("overwrite").parquet(
            f"{target}/events/batch={batch_id}"
        )

    writer = events.writeStream.foreachBatch(deliver).option("checkpointLocation", f"{target}/checkpoint")
    return (writer if continuous else writer.trigger(availableNow=True)).start()


def delivered(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema(EVENT_SCHEMA).parquet(f"{target}/events/batch=*").select(
        "run_id", "sequence", "event_type", "payload", "created_at"
    )
