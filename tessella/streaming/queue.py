"""The work queue as a stream of files: each micro-batch is handled once, and a replay replaces what it wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessella.operators.state import write_by_run


def enqueue(jobs: DataFrame, folder: str) -> None:
    jobs.write.mode("append").json(folder)


def consume(spark: SparkSession, folder: str, schema: str, work: Callable[[DataFrame], DataFrame], results: str, checkpoint: str, key: str = "comparison_run_id", files_a_batch: int = 2) -> StreamingQuery:
    """Run work on the jobs that arrive and keep its rows by run id."""
    jobs = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).json(folder)

    def handle(batch: DataFrame, _: int) -> None:
        write_by_run(work(batch), results, key)

    return jobs.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def transitions(log: DataFrame, key: str = "job_id") -> DataFrame:
    """The state of each job from its log (key, status, at): the last entry; an end state is never left again."""
    final = F.upper("status").isin("READY", "COMPLETED", "FAILED")
    return log.groupBy(key).agg(F.coalesce(F.min_by(F.when(final, F.col("status")), F.when(final, F.col("at"))), F.max_by("status", "at")).alias("status"))
