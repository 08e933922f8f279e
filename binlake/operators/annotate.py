"""Runtime facts on functions: tall annotation rows, overviews and risk rankings."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans import tables

PREFIX = "dyn_"
STAMP = "yyyy-MM-dd'T'HH:mm:ss"


def text_value(value: Column, data_type: str) -> Column:
    """Scalars as text, anything richer as JSON."""
    if data_type.startswith(("array", "struct", "map")):
        return F.to_json(value)
    return value.cast("string")


def as_facts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Wide fact columns -> one (key, value) row each; nulls carry no fact."""
    types = dict(rows.dtypes)
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), text_value(F.col(c), types[c]).alias("value"))
                      for c in rows.columns if c not in keys])
    return rows.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.key", "p.value").filter("value is not null")


def write(functions: DataFrame, facts: DataFrame, by: str = "addr", prefix: str = PREFIX,
          now: Column | None = None) -> DataFrame:
    """Prefixed annotation rows for existing functions only, found by address or by name.

    ``facts`` has (binary, addr or name, key, value).  One ``updated`` row is added per function.
    """
    if by not in ("addr", "name"):
        raise ValueError("match functions by addr or by name")
    stamp = F.date_format(now if now is not None else F.current_timestamp(), STAMP)
    cols = ["binary", by]
    known = functions.select(*dict.fromkeys(["binary", "addr", by])).filter(F.col("addr").isNotNull())
    rows = facts.join(known, cols).select(
        "binary", "addr", F.when(F.col("key").startswith(prefix), F.col("key"))
        .otherwise(F.concat(F.lit(prefix), F.col("key"))).alias("key"), "value")
    updated = rows.select("binary", "addr").distinct().select(
        "binary", "addr", F.lit(f"{prefix}updated").alias("key"), stamp.alias("value"))
    return rows.unionByName(updated)


def matched(functions: DataFrame, facts: DataFrame, by: str = "addr") -> DataFrame:
    """Number of functions the facts would reach, per binary."""
    return (functions.join(facts.select("binary", by).distinct(), ["binary", by], "left_semi")
            .groupBy("binary").agg(F.count("*").alias("matched")))


def merge(annotations: DataFrame, new_rows: DataFrame, version: str) -> DataFrame:
    """Annotations with the new rows' values; of several for one key the one with the highest ``version`` counts."""
    keys = ["binary", "addr", "key"]
    return tables.merge(annotations, tables.latest(new_rows, keys, version).drop(version), keys)


def read(annotations: DataFrame, prefix: str = PREFIX) -> DataFrame:
    return annotations.filter(F.col("key").startswith(prefix))


def clear(annotations: DataFrame, wanted: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """Annotations without the prefixed keys of the wanted (binary, addr) rows."""
    gone = annotations.filter(F.col("key").startswith(prefix)).join(wanted, ["binary", "addr"], "left_semi")
    return annotations.join(gone.select("binary", "addr", "key"), ["binary", "addr", "key"], "left_anti")


def wide(annotations: DataFrame) -> DataFrame:
    """Typed columns of the facts that reports use, one row per function."""
    def v(key: str) -> Column:
        return F.max(F.when(F.col("key") == PREFIX + key, F.col("value")))
    return annotations.groupBy("binary", "addr").agg(
        v("status").alias("status"), F.coalesce(v("crashes").try_cast("bigint"), F.lit(0)).alias("crashes"),
        F.coalesce(v("live_ran").try_cast("boolean"), F.lit(False)).alias("live_ran"),
        v("crash_input").alias("crash_input"))


def campaign_facts(summary: DataFrame, unique: DataFrame, keys: list[str]) -> DataFrame:
    """Facts of a fuzz campaign: reachability, crash kinds, counts, sample input, verdict text."""
    kinds = unique.groupBy(*keys).agg(
        F.array_sort(F.collect_set(F.substring_index("crash_key", ":", 1))).alias("crash_kinds"),
        F.hex(F.min_by("payload", "first_step")).alias("sample_crash_input"))
    bad = F.col("unique_crashes") > 0
    return (summary.join(kinds, keys, "left").select(
        *keys, F.lit(True).alias("reachable"), bad.alias("crashes"),
        F.coalesce("crash_kinds", F.array().cast("array<string>")).alias("crash_kinds"),
        "functions_covered", "unique_crashes", "sample_crash_input",
        F.when(bad, "crashes on fuzzed input").otherwise("exercised, no crash found").alias("verdict")))


def overview(status: DataFrame) -> DataFrame:
    """Per binary: analysed and live-traced functions and the count of each status."""
    s = F.col("status")
    return status.groupBy("binary").agg(
        F.count_if(s.isNotNull()).alias("functions_analyzed"), F.count_if("live_ran").alias("live_traced"),
        *[F.count_if(s == n).alias(n) for n in ("candidate_crash", "needs_state", "exercised_clean", "inconclusive")])


def top_crashes(status: DataFrame, n: int = 15) -> DataFrame:
    w = Window.partitionBy("binary").orderBy(F.desc("crashes"), "addr")
    return (status.filter(F.col("crashes") > 0).withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= n).select("binary", "rank", "addr", "crashes", "status"))


def risk(status: DataFrame, n: int = 15) -> DataFrame:
    """Functions that crashed or hit a fault, most crash sites first."""
    w = Window.partitionBy("binary").orderBy(F.desc("crashes"), "status", "addr")
    return (status.filter(F.col("status").isin("candidate_crash", "needs_state"))
            .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
            .select("binary", "rank", "addr", "status", "crashes", "crash_input"))
