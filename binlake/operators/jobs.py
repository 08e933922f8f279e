"""Analysis jobs: log lines, latest status, latency."""
from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window, functions as F

from ..plans import blocks

TAIL = 40
# Log line formats.
SAVED, TOTAL, SHARDS = r"saved.*?->\s*(.+\.i64)", r"total wall: ([0-9.]+)s for ([0-9,]+) funcs", r"([0-9]+)/([0-9]+) shards"


def parse_lines(lines: DataFrame) -> DataFrame:
    """Typed fields of analyser log lines (null where a line says nothing)."""
    def hit(pattern: str, group: int):
        return F.nullif(F.regexp_extract("line", pattern, group), F.lit(""))
    return lines.withColumns({
        "saved_path": F.trim(hit(SAVED, 1)), "wall_s": hit(TOTAL, 1).try_cast("double"),
        "funcs": F.replace(hit(TOTAL, 2), F.lit(","), F.lit("")).try_cast("bigint"),
        "shards_done": hit(SHARDS, 1).try_cast("int"), "shards_total": hit(SHARDS, 2).try_cast("int")})


def parse_log(lines: DataFrame) -> DataFrame:
    """Result per job: last saved path, wall time, function count and progress; rows (job_id, line_no, line)."""
    p = parse_lines(lines.filter(F.col("line") != ""))
    def last(c: str):
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line_no")))
    return p.groupBy("job_id").agg(*[last(c).alias(c) for c in
                                     ("saved_path", "wall_s", "funcs", "shards_done", "shards_total")])


def tail(lines: DataFrame, n: int = TAIL) -> DataFrame:
    w = Window.partitionBy("job_id").orderBy(F.desc("line_no"))
    return (lines.filter(F.col("line") != "").withColumn("_r", F.row_number().over(w))
            .filter(F.col("_r") <= n).drop("_r"))


def status(events: DataFrame) -> DataFrame:
    """Latest record per job; rows (job_id, ts, seq, status, binary, progress)."""
    last = F.max_by(F.struct("status", "binary", "progress"), F.struct("ts", "seq"))
    return events.groupBy("job_id").agg(last.alias("j"), F.min("ts").alias("created")).select(
        "job_id", "j.*", "created")


def latency(events: DataFrame, keys: list[str], step: str = "step") -> DataFrame:
    """Running processed and error counts and mean latency; rows need ok and latency_ms."""
    ok = F.when(F.col("ok"), 1).otherwise(0).cast("bigint")
    sums = {"processed": ok, "errors": F.lit(1) - ok,
            "_total": F.when(F.col("ok"), F.col("latency_ms")).otherwise(0.0)}
    out = blocks.running_sums(events, keys, step, sums)
    return out.withColumn("avg_latency_ms", F.when(F.col("processed") > 0, F.col("_total") / F.col("processed"))
                          .otherwise(0.0)).drop("_total")


def observed(rows: DataFrame, name: str, **metrics) -> tuple[DataFrame, Observation]:
    """The frame with progress metrics that are collected while it is written (row count by default)."""
    seen = Observation(name)
    exprs = [m.alias(k) for k, m in metrics.items()] or [F.count(F.lit(1)).alias("rows")]
    return rows.observe(seen, *exprs), seen
