"""Progress of streams as a table, through a listener."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener

SCHEMA = ("query string, run string, batch bigint, ts string, input_rows bigint, rows_per_s double, state_rows bigint, state_bytes bigint, "
          "late_rows bigint, batch_ms bigint, event string, message string")


class Progress(StreamingQueryListener):
    """Records a row per micro-batch and end of each stream, at most ``keep`` of them; sees streams of its session from ``watch`` on.

    ``jobs`` names streams by job: only queries whose name is in it are recorded, all if it is None.
    """

    def __init__(self, jobs: set[str] | None = None, keep: int = 100_000):
        self.jobs, self.keep, self.rows, self.names = jobs, keep, [], {}

    def watch(self, spark: SparkSession) -> "Progress":
        spark.streams.addListener(self)
        return self

    def stop(self, spark: SparkSession) -> None:
        spark.streams.removeListener(self)

    def _add(self, run: str, *values) -> None:
        name = self.names.get(run)
        if self.jobs is None or name in self.jobs:
            self.rows.append((name, run, *values))
            del self.rows[:-self.keep]

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.names[str(event.runId)] = event.name

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        state = p.stateOperators
        self._add(str(p.runId), p.batchId, p.timestamp, p.numInputRows, float(p.processedRowsPerSecond or 0), sum(s.numRowsTotal for s in state),
                  sum(s.memoryUsedBytes for s in state), sum(s.numRowsDroppedByWatermark for s in state), p.batchDuration, "progress", None)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._add(str(event.runId), None, None, None, None, None, None, None, None, "failed" if event.exception else "ended", event.exception)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), SCHEMA)


def settled(spark: SparkSession, ms: int = 30_000) -> None:
    """Waits until the listeners have been told of all that has happened."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(ms)


def per_job(progress: DataFrame) -> DataFrame:
    """query, run, batches, input_rows, state_rows after the last batch, busy_ms, late_rows and outcome of each run."""
    from pyspark.sql import functions as F
    step = F.col("event") == "progress"
    return progress.groupBy("query", "run").agg(
        F.count_if(step).alias("batches"), F.sum("input_rows").alias("input_rows"), F.max_by("state_rows", "batch").alias("state_rows"),
        F.max_by("state_bytes", "batch").alias("state_bytes"), F.sum("batch_ms").alias("busy_ms"), F.sum("late_rows").alias("late_rows"),
        F.coalesce(F.max(F.when(~step, F.col("event"))), F.lit("running")).alias("outcome"))
