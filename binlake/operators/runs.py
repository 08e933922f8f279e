"""Fuzz, emulation and live-call logs: verdicts, coverage, unique crashes, summaries."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import addr as A, outcomes as O
from ..plans import blocks

# Fixed values.
CRASH_BONUS = 3.0
SEED_INPUTS = (b"", b"A", b"BX", b"C%s", b"D8")


def parse_exec(records: DataFrame, text: str = "record") -> DataFrame:
    """Exit code, coverage ids and output of raw execution record text; malformed text -> 0, [], ''."""
    t = F.col(text)
    good = t.rlike(r"(?s)===RC:\s*-?\d+[ \t]*\n.*?===OUT")
    rest = F.substring(t, F.instr(t, "===RC:") + 6, F.length(t))
    code = F.regexp_extract(rest, r"^\s*(-?\d+)[ \t]*\n", 1)
    after = F.regexp_replace(rest, r"^[^\n]*\n", "")
    head = F.substring_index(after, "===OUT", 1)
    block = F.when(head.contains("===COV"), F.regexp_replace(head, r"(?s)^.*?===COV", "")).otherwise(head)
    lines = F.filter(F.transform(F.split(block, r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != "")
    out = F.substring(after, F.instr(after, "===OUT") + 6, F.length(after))
    none = F.array().cast("array<string>")
    return records.withColumns({
        "exit_code": F.when(good, code.try_cast("int")).otherwise(0),
        "cov_ids": F.when(good, F.array_sort(F.array_distinct(lines))).otherwise(none),
        "stdout": F.when(good, F.regexp_replace(out, r"^\s+|\s+$", "")).otherwise("")})


def first_seen(runs: DataFrame, keys: list[str]) -> DataFrame:
    """First step at which each coverage id appears in its campaign."""
    ids = runs.select(*keys, "step", F.explode(F.array_distinct("cov_ids")).alias("cov_id"))
    return ids.groupBy(*keys, "cov_id").agg(F.min("step").alias("step"))


def coverage(runs: DataFrame, keys: list[str], crashed: Column) -> DataFrame:
    """New coverage, covered so far and reward (new + 3 per crash) of every run, in step order."""
    fresh = first_seen(runs, keys).groupBy(*keys, "step").agg(F.count("*").alias("new_coverage"))
    rows = (runs.join(fresh, [*keys, "step"], "left")
            .withColumn("new_coverage", F.coalesce("new_coverage", F.lit(0))))
    out = blocks.running_sums(rows, keys, "step", {"covered_so_far": F.col("new_coverage")})
    return out.withColumn("reward", F.col("new_coverage") + F.when(crashed, CRASH_BONUS).otherwise(0.0))


def corpus(covered: DataFrame, keys: list[str], cap: int | None = None) -> DataFrame:
    """Distinct inputs that earned new coverage, in order of discovery; the first only where a corpus size is given."""
    seeds = [F.lit(s) for s in SEED_INPUTS]
    first = (covered.filter((F.col("new_coverage") > 0) & ~F.col("payload").isin(*seeds))
             .groupBy(*keys, "payload").agg(F.min("step").alias("step")))
    placed = blocks.dense_index(first, keys, "step", "pos").withColumn("pos", F.col("pos").cast("int"))
    return placed if cap is None else placed.filter(F.col("pos") <= cap - len(SEED_INPUTS))


def fuzz_crash_key(exit_code: Column, cov_ids: Column) -> Column:
    return F.concat(O.crash_kind(exit_code), F.lit(":"), F.size(F.array_distinct(cov_ids)).cast("string"))


def emu_crash_key(kind: Column, fault_addr: Column) -> Column:
    return F.concat(kind, F.lit("@"), A.hexify(fault_addr))


def unique_crashes(crashes: DataFrame, keys: list[str]) -> DataFrame:
    """First reproducing input per crash key; rows (keys, crash_key, step, payload)."""
    return crashes.groupBy(*keys, "crash_key").agg(
        F.min_by("payload", "step").alias("payload"), F.min("step").alias("first_step"), F.count("*").alias("hits"))


def summary(runs: DataFrame, crashes: DataFrame, keys: list[str]) -> DataFrame:
    """Covered ids, unique crashes and inputs per campaign."""
    cov = (runs.select(*keys, F.explode("cov_ids").alias("c")).groupBy(*keys)
           .agg(F.count_distinct("c").alias("functions_covered")))
    bad = crashes.groupBy(*keys).agg(F.count_distinct("crash_key").alias("unique_crashes"))
    return (runs.groupBy(*keys).agg(F.count("*").alias("inputs")).join(cov, keys, "left").join(bad, keys, "left")
            .fillna(0, ["functions_covered", "unique_crashes"]))


def verdict_of(crash: Column, needs_state: Column, clean: Column) -> Column:
    return (F.when(crash > 0, "candidate_crash").when(needs_state > 0, "needs_state")
            .when(clean > 0, "exercised_clean").otherwise("inconclusive"))


def verdict(emu_runs: DataFrame) -> DataFrame:
    """Per function: verdict by precedence, blocks, status counts, unique crashes and first crash input.

    The status counts are four columns, so nothing grows with the log.
    """
    st = O.emu_status(F.col("crashed"), F.col("fault_addr"), F.col("returned"))
    rows = emu_runs.withColumn("status", st).withColumn(
        "crash_key", F.when(F.col("status") == "crash", emu_crash_key(F.col("crash_kind"), F.col("fault_addr"))))
    s = F.col("status")
    out = rows.groupBy("binary", "addr").agg(
        F.count("*").alias("rounds"), F.max("blocks").alias("blocks"), F.max("stubbed_calls").alias("stubbed_calls"),
        *[F.count_if(s == n).alias(f"n_{n}") for n in ("crash", "needs_state", "clean", "inconclusive")],
        F.count_distinct("crash_key").alias("unique_crashes"),
        F.min(F.when(s == "crash", F.struct("step", "payload"))).alias("_first"))
    return out.select(
        "binary", "addr", verdict_of(F.col("n_crash"), F.col("n_needs_state"), F.col("n_clean")).alias("verdict"),
        (F.col("blocks") > 0).alias("reachable"), "blocks", "stubbed_calls", "rounds", "unique_crashes",
        "n_crash", "n_needs_state", "n_clean", "n_inconclusive", F.hex("_first.payload").alias("crash_input"))


def live_to_function(calls: DataFrame, functions: DataFrame, bases: DataFrame) -> DataFrame:
    """Absolute function address of each live call from the image base of its binary."""
    at = calls.join(bases.select("binary", "image_base"), "binary").withColumn(
        "addr", F.col("image_base") + F.col("rva"))
    return at.join(functions.select("binary", "addr", "name"), ["binary", "addr"], "left")


def _first_values(rows: DataFrame, keys: list[str], value: str, order: list[str], n: int, name: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    kept = (rows.filter(F.col(value).isNotNull()).select(*keys, value, *order)
            .withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n))
    return kept.groupBy(*keys).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("_r", F.col(value).alias("v")))), lambda x: x["v"]).alias(name))


def live_facts(calls: DataFrame, keys: list[str], order: list[str], keep: int = 5) -> DataFrame:
    """Calls, first arguments and first returns per function, plus the total over all functions."""
    out = calls.groupBy(*keys).agg(F.count("*").alias("calls"))
    out = out.join(_first_values(calls, keys, "arg", order, keep, "sample_args"), keys, "left")
    out = out.join(_first_values(calls, keys, "ret", order, keep, "returns"), keys, "left")
    return out.withColumns({
        "sample_args": F.coalesce("sample_args", F.array().cast("array<string>")),
        "returns": F.coalesce("returns", F.array().cast("array<bigint>"))})


def live_values(calls: DataFrame, keys: list[str], step: str, value: str) -> DataFrame:
    """Every value seen per function as rows (keys, pos, value) in step order: the uncut form of the samples, safe for hot functions."""
    rows = calls.filter(F.col(value).isNotNull()).select(*keys, step, value)
    return blocks.dense_index(rows, keys, step, "pos").select(*keys, "pos", value)


def live_fuzz_summary(log: DataFrame, keys: list[str], keep: int = 50) -> DataFrame:
    """Live fuzzing per function; rows (keys, step, detached, crash_addr, payload, ret)."""
    key = F.when(F.col("detached") | F.col("crash_addr").isNotNull(),
                 F.coalesce("crash_addr", F.lit("detached")))
    rows = log.withColumn("crash_key", key)
    ok = F.col("crash_key").isNull()
    out = rows.groupBy(*keys).agg(
        F.count_if(ok).alias("calls"), F.count_distinct("crash_key").alias("unique_crashes"),
        F.count_if(~ok).alias("respawns"))
    rets = _first_values(rows.filter(ok), keys, "ret", ["step"], keep, "returns")
    return out.join(rets, keys, "left").withColumn(
        "returns", F.coalesce("returns", F.array().cast("array<bigint>")))


def live_fuzz_crashes(log: DataFrame, keys: list[str]) -> DataFrame:
    bad = log.filter(F.col("detached") | F.col("crash_addr").isNotNull()).withColumn(
        "crash_key", F.coalesce("crash_addr", F.lit("detached")))
    return unique_crashes(bad, keys)
