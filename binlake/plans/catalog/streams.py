"""Streaming forms of the log operators, run over the event table as a file stream.

Each query starts its stream, lets it work off everything there is, and returns what it wrote.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ...functions import outcomes as O
from ...operators import runs
from ...session import shared_folder
from ...streaming import progress, stateful, stream
from .. import relations, tables
from ._register import Catalog
from .graph import N
from .learning import SURPRISE, r6, state

QUERIES = Catalog()
q = QUERIES.query
KEYS = ["campaign"]


class Streamed(relations.Tables):
    """The same relations with ``events`` read as a stream."""

    def read(self, name: str) -> DataFrame:
        if name != "events":
            return super().read(name)
        schema = super().read(name).schema
        return (self.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
                .parquet(self.folder))


def _shared_folder(spark) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"


def finished(t, df: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Run the stream to the end; with keys, the last emitted row of each."""
    root = _shared_folder(t.spark)
    columns, schema = df.columns, df.schema

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{root}/out/b={batch_id}")

    stream.run_available(df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{root}/ckpt"))
    out = t.spark.read.schema(StructType([*schema.fields, StructField("_batch", IntegerType())])).parquet(f"{root}/out/*")
    if keys:
        out = tables.latest(out, keys, "_batch")
    return out.select(*columns)


def live(t):
    return Streamed(t.spark, t.folder)


@q("ev", """SELECT user_id AS job_id, arg_max(event_type, event_id) AS status, 'b' || arg_max(k, event_id) AS binary, arg_max(k, event_id) || '%' AS progress,
    count(*) AS events FROM ev GROUP BY user_id""")
def stream_jobs(t):
    k = F.col("k").cast("string")
    e = live(t).ev().select(F.col("user_id").alias("job_id"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("status"),
                            F.concat(F.lit("b"), k).alias("binary"), F.concat(k, F.lit("%")).alias("progress"))
    return finished(t, stream.jobs(e), "update", ["job_id"])


@q("fuzz_runs", """SELECT DISTINCT campaign, CASE exit_code WHEN 139 THEN 'segv' ELSE 'abort' END || ':' || length(list_distinct(cov_ids)) AS crash_key
    FROM fuzz_runs WHERE exit_code >= 128""")
def stream_crashes(t):
    bad = live(t).fuzz_runs().filter(O.crashed(F.col("exit_code"))).withColumn("crash_key", runs.fuzz_crash_key(F.col("exit_code"), F.col("cov_ids")))
    return finished(t, stream.crashes(bad.select("campaign", "crash_key"), KEYS, None), "append")


@q("live_calls", """SELECT binary, rva, strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS calls, arg_min(ret, ts) AS first_ret
    FROM live_calls GROUP BY binary, rva, time_bucket(INTERVAL '1 hour', ts)""")
def stream_live_counts(t):
    out = finished(t, stream.live_counts(live(t).live_calls(), ["binary", "rva"], 3600), "update", ["binary", "rva", "start"])
    return out.drop("first_arg").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@q("errors", """SELECT campaign, step, round(t_before, 11) AS threshold, round(t_after, 11) AS threshold_after, error > t_before AS surprising,
    round(coalesce(error / (past + 1e-8), error), 11) AS novelty FROM ix JOIN th USING (campaign, idx)""", SURPRISE)
def stream_surprise(t):
    out = finished(t, stateful.surprise(live(t).errors().select("campaign", "step", "error"), KEYS), "append")
    return r6(out.drop("error"), "threshold", "threshold_after", "novelty")


@q("errors", "SELECT * EXCLUDE (raw_mean) FROM st", state("campaign, family", 10))
def stream_competence(t):
    keys = ["campaign", "family"]
    out = finished(t, stateful.competence(live(t).errors().select(*keys, "step", "error"), keys, window=10), "update", keys)
    return r6(out, "mean_error", "progress", "noise_ratio")


@q("errors", """SELECT campaign, family AS signature, step, times_seen, times_seen = 1 AS is_new, round(1 / sqrt(times_seen), 11) AS reward FROM (
    SELECT *, row_number() OVER (PARTITION BY campaign, family ORDER BY step) AS times_seen FROM errors)""")
def stream_novelty(t):
    rows = live(t).errors().select("campaign", F.col("family").alias("signature"), "step")
    return r6(finished(t, stateful.novelty(rows, KEYS), "append"), "reward")


@q("errors", "SELECT campaign, step, round(v, 11) AS ema FROM em JOIN ix USING (campaign, idx)", """ix AS (SELECT *, row_number() OVER (PARTITION BY campaign ORDER BY step) AS idx FROM errors),
em AS (SELECT DISTINCT campaign, 0 AS idx, 0::DOUBLE AS v FROM errors UNION ALL SELECT em.campaign, ix.idx, 0.1 * ix.error + 0.9 * em.v FROM em JOIN ix ON ix.campaign = em.campaign AND ix.idx = em.idx + 1)""")
def stream_ema(t):
    rows = live(t).errors().select("campaign", "step", F.col("error").alias("value"))
    return r6(finished(t, stateful.ema(rows, KEYS), "append"), "ema")


@q("ev", """SELECT user_id, count(*) FILTER (event_type <> 'error') AS processed, count(*) FILTER (event_type = 'error') AS errors,
    round(avg(value) FILTER (event_type <> 'error'), 9) AS avg_latency_ms FROM ev GROUP BY user_id""")
def stream_latency(t):
    e = live(t).ev().select("user_id", (F.col("event_type") != "error").alias("ok"), F.col("value").alias("latency_ms"))
    out = finished(t, stream.latency(e, ["user_id"]), "update", ["user_id"])
    return out.withColumn("avg_latency_ms", F.round("avg_latency_ms", 9))


@q("ev", """SELECT 'bin' || (user_id % 10) AS binary, k AS addr, 'fn_' || k AS name, k * 2 AS size FROM ev GROUP BY ALL""")
def stream_upsert(t):
    """Function rows from the event stream merged into a table, batch by batch."""
    root = _shared_folder(t.spark)
    rows = live(t).ev().select(F.concat(F.lit("bin"), (F.col("user_id") % 10).cast("string")).alias("binary"), F.col("k").alias("addr"),
                               (F.col("k") * 2).alias("size"), F.explode(F.array(F.lit(2), F.lit(1))).alias("v"))
    # each function comes twice in a batch; the lower version must lose
    rows = rows.withColumn("name", F.concat(F.when(F.col("v") == 2, "fn_").otherwise("stale_"), F.col("addr").cast("string")))
    path, schema = f"{root}/functions", rows.schema
    stream.run_available(stream.upsert(rows, path, f"{root}/ckpt", "v"))
    return stream.upserted(t.spark, path, schema, "v").drop("v").filter(N.is_named(F.col("name")))


@q("ev", """SELECT 'events of all users' AS query, count(*) AS input_rows, count(DISTINCT user_id) AS state_rows, 'ended' AS outcome, 0 AS late_rows FROM ev""")
def stream_progress(t):
    """What a listener recorded of a stream that has ended."""
    root, name = _shared_folder(t.spark), "events of all users"
    seen = progress.Progress({name}).watch(t.spark)
    try:
        counts = live(t).ev().groupBy("user_id").count()
        stream.run_available(counts.writeStream.outputMode("update").foreachBatch(lambda batch, _: batch.write.format("noop").mode("overwrite").save())
                             .queryName(name).option("checkpointLocation", f"{root}/ckpt"))
        progress.settled(t.spark)
    finally:
        seen.stop(t.spark)
    return progress.per_job(seen.table(t.spark)).select("query", "input_rows", "state_rows", "outcome", "late_rows")
