"""Instruction traces: summaries, indicators, risk areas, signatures and learned patterns."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import addr as A, instructions as I
from ..plans import blocks

# Fixed values.
STACK_TOP = 0x7FFF0000 + 0x10000
NEAR_BASE = 0x7FFF0000 + 0x1000
RISK_BAR = 1.0
KEY = ["trace_id"]


def with_events(instr: DataFrame) -> DataFrame:
    """Adds instruction flags, implied memory events and the branch-taken flag."""
    return instr.select("*", *I.flags(F.col("mnemonic")),
                        I.branch_taken(F.col("regs_after.rip"), F.col("address"), F.col("raw_len")).alias("branch_taken"),
                        I.memory_events(F.col("regs_before"), F.col("regs_after")).alias("memory_events"))


def _has(kind: str) -> Column:
    return F.exists("memory_events", lambda e: e["event_type"] == kind)


def summary(rows: DataFrame, stack_top: int = STACK_TOP) -> DataFrame:
    """Counts per trace.  Reads and writes count all events of instructions with any read or write;
    the exact numbers stand beside them."""
    n = F.size("memory_events")
    def exact(kind: str) -> Column:
        return F.size(F.filter("memory_events", lambda e: e["event_type"] == kind))
    return rows.groupBy(*KEY).agg(
        F.count("*").alias("total_instructions"),
        F.sum(F.when(_has("read"), n).otherwise(0)).alias("total_memory_reads"),
        F.sum(F.when(_has("write"), n).otherwise(0)).alias("total_memory_writes"),
        F.sum(exact("read")).alias("exact_reads"), F.sum(exact("write")).alias("exact_writes"),
        F.greatest(F.lit(0).cast("bigint"), F.max(F.lit(stack_top) - F.col("regs_after.rsp"))).alias("stack_depth_max"),
        F.count_if("is_branch").alias("branch_count"), F.count_if("is_syscall").alias("syscall_count"))


def mnemonics(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY, "mnemonic").agg(F.count("*").alias("n"))


def stats_vector(summaries: DataFrame, counts: DataFrame, crashed: Column) -> DataFrame:
    """Ten scaled values per trace from its summary and mnemonic counts."""
    some = counts.groupBy(*KEY).agg(*[F.sum(F.when(F.col("mnemonic") == m, F.col("n")).otherwise(0)).alias(f"_{m}")
                                      for m in ("call", "ret", "jmp")])
    j = summaries.join(some, KEY, "left")
    scaled = (("total_instructions", 10000.0), ("total_memory_reads", 1000.0), ("total_memory_writes", 1000.0),
              ("stack_depth_max", 10000.0))
    tail = (("branch_count", 1000.0), ("syscall_count", 100.0), ("_call", 10.0), ("_ret", 10.0), ("_jmp", 10.0))
    vec = F.array(*[F.col(c) / s for c, s in scaled], F.when(crashed, 1.0).otherwise(0.0),
                  *[F.col(c) / s for c, s in tail])
    return j.select(*KEY, vec.alias("stats"))


def indicators(rows: DataFrame) -> DataFrame:
    """Suspicious instructions: one row per finding with its weight (0 = only flagged)."""
    m, ops, low = F.col("mnemonic"), F.col("operands"), F.lower("operands")
    text = F.concat_ws(" ", m, ops)
    def found(cond: Column, kind: str, where: Column, weight: float) -> Column:
        return F.when(cond, F.struct(F.lit(kind).alias("type"), where.cast("bigint").alias("address"),
                                     text.alias("instruction"), F.lit(weight).alias("weight")))
    storing = m.isin("mov", "push", "stosb", "stosw", "stosd", "stosq")
    low_writes = F.filter("memory_events", lambda e: storing & e["is_stack"] & (e["event_type"] == "write")
                          & (e["address"] < NEAR_BASE))
    stack = F.transform(low_writes, lambda e: F.struct(
        F.lit("potential_stack_overflow").alias("type"), e["address"].alias("address"),
        text.alias("instruction"), F.lit(0.3).alias("weight")))
    others = F.filter(F.array(
        found((m == "call") & low.contains("printf"), "potential_format_string", F.col("address"), 0.2),
        found(m.isin("add", "imul", "mul") & ops.contains("dword"), "arithmetic_operation",
              F.lit(None), 0.0),
        found(m.isin("call", "jmp") & low.rlike("free|delete|dealloc"), "potential_use_after_free",
              F.col("address"), 0.25)), lambda x: x.isNotNull())
    return rows.select(*KEY, "seq", F.explode(F.concat(stack, others)).alias("f")).select(*KEY, "seq", "f.*")


def risk_scores(found: DataFrame) -> DataFrame:
    return found.groupBy(*KEY).agg(F.least(F.sum("weight"), F.lit(1.0)).alias("risk_score"),
                                   F.count_if(F.col("weight") > 0).alias("indicators"))


def last_traces(rows: DataFrame, n: int | None, order: str = "trace_id") -> DataFrame:
    """Rows of the last ``n`` traces, all without ``n``; the ids are found first and are at most ``n`` values."""
    if n is None:
        return rows
    ids = rows.select(order).distinct().orderBy(F.desc(order)).limit(n)
    return rows.join(F.broadcast(ids), order, "left_semi")


def with_risk(rows: DataFrame) -> DataFrame:
    """Category, context risk and feature row of each instruction (dimension of fixed size)."""
    sem = I.semantics_table(rows.sparkSession)
    m, ops = F.col("mnemonic"), F.col("operands")
    return (rows.join(F.broadcast(sem), "mnemonic", "left")
            .withColumn("features", I.feature_row(F.col("risk"), m, ops))
            .withColumn("context_risk", I.context_risk(F.col("risk"), m, ops))
            .withColumn("category", F.coalesce("category", F.lit("unknown")))
            .withColumn("risk", F.coalesce("risk", F.lit(I.UNKNOWN_RISK))))


def risk_areas(rows: DataFrame, confidence: DataFrame | None = None, last: int | None = None) -> DataFrame:
    """Addresses whose risk over all traces, or the ``last`` ones, exceeds 1; score ``min(risk/10, 1)``."""
    risk = (with_risk(last_traces(rows, last)).groupBy("address").agg(F.sum("context_risk").alias("risk"))
            .filter(F.col("risk") > RISK_BAR))
    if confidence is not None:
        known = confidence.select(F.col("pattern"), "confidence")
        risk = risk.withColumn("pattern", F.concat(F.lit("addr_"), F.col("address").cast("string"))).join(
            known, "pattern", "left").drop("pattern")
    else:
        risk = risk.withColumn("confidence", F.lit(None).cast("double"))
    return risk.select("address", F.least(F.col("risk") / 10, F.lit(1.0)).alias("risk_score"),
                       F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "risk")


def signatures(rows: DataFrame, last: int | None = None) -> DataFrame:
    """Signature rules met by any instruction of all traces, or the ``last`` ones, once per trace and rule."""
    m, ops = F.col("mnemonic"), F.col("operands")
    rules = []
    for pattern, signature, severity, mnemonics_, words in I.SIGNATURES:
        hit = m.isin(*mnemonics_) & ops.rlike("|".join(words))
        rules.append(F.when(hit, F.struct(F.lit(pattern).alias("pattern"), F.lit(signature).alias("signature"),
                                          F.lit(severity).alias("severity"))))
    hits = F.filter(F.array(*rules), lambda x: x.isNotNull())
    return (last_traces(rows, last).select(*KEY, F.explode(hits).alias("r")).select(*KEY, "r.*").distinct())


def patterns(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Mnemonic trigram and indicator frequencies over all traces.

    Trigrams look two instructions back; traces are cut into blocks that overlap by two.
    """
    idx = blocks.dense_index(rows.select(*KEY, "seq", "mnemonic"), KEY, "seq")
    halo = blocks.with_lookback(idx, KEY, "idx", 2)
    w = Window.partitionBy(*KEY, "_blk").orderBy("idx")
    tri = (halo.select("_own", F.concat_ws(",", F.lag("mnemonic", 2).over(w), F.lag("mnemonic", 1).over(w), "mnemonic")
                       .alias("pattern"), F.col("idx") >= 3)
           .toDF("_own", "pattern", "_full").filter("_own and _full").select("pattern"))
    marks = found.filter("weight > 0").select(F.concat_ws("_", "type", F.col("address").cast("string")).alias("pattern"))
    return tri.unionByName(marks).groupBy("pattern").agg(F.count("*").alias("n"))


def confidence(counts: DataFrame, passes: int) -> DataFrame:
    """Confidence of known patterns after a number of update passes."""
    return counts.withColumn("confidence", F.lit(1.0) - F.pow(F.lit(0.9), F.lit(passes)))


def confirmed(original: DataFrame, variation: DataFrame) -> DataFrame:
    """Confidence of indicator types: +0.1 per finding in a variation whose original shows the type too.

    Both frames hold weighted findings keyed by run_id.
    """
    base = original.filter("weight > 0").select("run_id", "type").distinct()
    return (variation.filter("weight > 0").join(base, ["run_id", "type"], "left_semi").groupBy("type")
            .agg(F.least(F.lit(1.0), F.count("*") * 0.1).alias("confidence")))


def pattern_stats(counts: DataFrame, conf: DataFrame, analyses: DataFrame) -> DataFrame:
    one = F.lit(1).alias("_one")
    return (analyses.agg(F.count_distinct("trace_id").alias("total_analyses")).select("*", one)
            .join(counts.agg(F.count_distinct("pattern").alias("known_patterns")).select("*", one), "_one")
            .join(conf.agg(F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence")).select("*", one), "_one")
            .drop("_one"))


def regions(rows: DataFrame, col: str = "address") -> DataFrame:
    return rows.withColumn("region", I.region(F.col(col)))


def save_patterns(counts: DataFrame, conf: DataFrame, path: str) -> None:
    counts.join(conf.select("pattern", "confidence"), "pattern", "left").write.mode("overwrite").parquet(path)


def load_patterns(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def label(rows: DataFrame) -> DataFrame:
    return rows.withColumn("address_text", A.hexify(F.col("address")))
