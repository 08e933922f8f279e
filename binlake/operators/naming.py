"""Naming passes: target selection, demangling by dictionary, coverage reports, exports of samples."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import names as N


def targets(functions: DataFrame, *, seed: int | None = None, skip: int = 0, limit: int | None = None,
            min_size: int = 0, unnamed_only: bool = False) -> DataFrame:
    """Functions to name, in address order or (with a seed) in a reproducible shuffled order."""
    rows = functions.filter(F.lower("name").startswith("sub_")) if unnamed_only else functions
    if seed is not None:
        rows = rows.orderBy(F.xxhash64(F.lit(seed), F.col("binary"), F.col("addr")), "binary", "addr")
    elif skip or limit:
        rows = rows.orderBy("binary", "addr")
    if skip:
        rows = rows.offset(skip)
    if limit:
        rows = rows.limit(limit)
    return rows.withColumn("needs_naming", N.needs_naming(F.col("name"), F.col("size"), min_size))


def seeded_order(functions: DataFrame, seed: str) -> DataFrame:
    """Shuffle key shared with other engines: md5 of seed and identity."""
    return functions.withColumn("shuffle_key", F.md5(F.concat_ws(
        ":", F.lit(seed), F.col("binary"), F.col("addr").cast("string")).cast("binary")))


def apply_dictionary(functions: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Replace mangled names by their readable form where the dictionary (mangled, readable) has one."""
    cols = functions.columns
    d = dictionary.select(F.col("mangled").alias("name"), "readable").dropDuplicates(["name"])
    known = functions.filter(N.mangled(F.col("name"))).join(d, "name", "left")
    other = functions.filter(~F.coalesce(N.mangled(F.col("name")), F.lit(False))).withColumn(
        "readable", F.lit(None).cast("string"))
    return (known.select(*cols, "readable").unionByName(other.select(*cols, "readable"))
            .withColumn("demangled", F.col("readable").isNotNull())
            .withColumn("name", F.coalesce("readable", "name")).drop("readable"))


def baseline(functions: DataFrame, sample_size: int = 100) -> DataFrame:
    """Totals and coverage per binary, and the same counts on an every-Nth sample by size.

    The sample needs each function's position in its binary by size.  Positions come from counts
    per size (few distinct values, combined before the shuffle) plus a rank inside one size.
    """
    named = N.is_named(F.col("name"), "strict")
    rows = functions.select("binary", "addr", "size", named.alias("is_named"),
                            F.floor(F.col("addr") / 65536).alias("_cell"))
    per_size = rows.groupBy("binary", "size").agg(F.count("*").alias("_n"))
    larger = Window.partitionBy("binary").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    per_cell = rows.groupBy("binary", "size", "_cell").agg(F.count("*").alias("_n"))
    lower = (Window.partitionBy("binary", "size").orderBy("_cell")
             .rowsBetween(Window.unboundedPreceding, -1))
    base = (per_cell.withColumn("_b2", F.coalesce(F.sum("_n").over(lower), F.lit(0))).drop("_n")
            .join(per_size.withColumn("_b1", F.coalesce(F.sum("_n").over(larger), F.lit(0))).drop("_n"),
                  ["binary", "size"]))
    totals = rows.groupBy("binary").agg(F.count("*").alias("total"), F.count_if("is_named").alias("named"))
    step = F.greatest(F.lit(1), F.floor(F.col("total") / sample_size))
    inside = Window.partitionBy("binary", "size", "_cell").orderBy("addr")
    pos = F.col("_b1") + F.col("_b2") + F.row_number().over(inside) - 1
    picked = (rows.join(base, ["binary", "size", "_cell"]).withColumn("pos", pos)
              .join(totals.select("binary", step.alias("step")), "binary")
              .filter((F.col("pos") % F.col("step") == 0) & (F.floor(F.col("pos") / F.col("step")) < sample_size)))
    sample = picked.groupBy("binary").agg(F.count("*").alias("sample_size"),
                                          F.count_if("is_named").alias("sample_named"))
    return (totals.join(sample, "binary").select(
        "binary", F.col("total").alias("total_functions"), "named", (F.col("total") - F.col("named")).alias("unnamed"),
        F.bround(100.0 * F.col("named") / F.col("total"), 1).alias("coverage_pct"), "sample_size", "sample_named",
        (F.col("sample_size") - F.col("sample_named")).alias("sample_unnamed")))


def pass_summary(results: DataFrame) -> DataFrame:
    """Totals of a naming run from rows (binary, needs_naming, demangled, pass1_name, pass2_name)."""
    got = F.coalesce("pass1_name", F.lit("")) != ""
    again = F.coalesce("pass2_name", F.lit("")) != ""
    return results.groupBy("binary").agg(
        F.count("*").alias("total"), F.count_if("needs_naming").alias("attempted"),
        F.count_if(F.col("needs_naming") & got).alias("named"), F.count_if("demangled").alias("demangled"),
        F.count_if(F.col("needs_naming") & again
                   & ~F.col("pass2_name").eqNullSafe(F.col("pass1_name"))).alias("renamed_pass2"))


def pass_diff(passes: DataFrame) -> DataFrame:
    """Names that changed between consecutive passes; rows (binary, addr, pass, name)."""
    w = Window.partitionBy("binary", "addr").orderBy("pass")
    return (passes.withColumn("old_name", F.lag("name").over(w))
            .filter((F.coalesce("name", F.lit("")) != "") & F.col("old_name").isNotNull()
                    & (F.col("name") != F.col("old_name")))
            .select("binary", "addr", "pass", "old_name", F.col("name").alias("new_name")))


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Unnamed counts of two snapshots and how many were named in between."""
    both = (before.select("binary", "name", F.lit(0).alias("t"))
            .unionByName(after.select("binary", "name", F.lit(1).alias("t"))))
    unnamed = F.col("name").startswith("sub_")
    return (both.groupBy("binary").agg(F.count_if(unnamed & (F.col("t") == 0)).alias("count_before"),
                                       F.count_if(unnamed & (F.col("t") == 1)).alias("count_after"))
            .withColumn("renamed", F.col("count_before") - F.col("count_after")))


def overview_sample(functions: DataFrame, sample_size: int = 120, pinned: DataFrame | None = None) -> DataFrame:
    """Rows shown in an overview of each binary: pinned, then named, then unnamed by size."""
    rows = functions.select("binary", "addr", "name", "size")
    if pinned is not None:
        mark = pinned.select("binary", "addr").distinct().withColumn("_pin", F.lit(True))
        rows = rows.join(mark, ["binary", "addr"], "left")
    else:
        rows = rows.withColumn("_pin", F.lit(None).cast("boolean"))
    unnamed = F.lower(F.coalesce("name", F.lit(""))).startswith("sub_")
    group = F.when(F.col("_pin"), 0).when(~unnamed, 1).otherwise(2)
    order = Window.partitionBy("binary").orderBy(
        "_group", F.when(F.col("_group") == 2, -F.col("size")).otherwise(0), "addr")
    return (rows.withColumn("_group", group).withColumn("pos", F.row_number().over(order))
            .filter(F.col("pos") <= sample_size).select("binary", "addr", "name", "size", "pos"))


# The text around the number of names shown, the total and the list of names.
OVERVIEW = (
    "Here are up to ", " functions from a binary (", " total functions):\n\n",
    "\n\nBased on these function names and sizes:\n1. What does this binary likely do? (2-3 sentences)\n"
    "2. What are its major subsystems or components?\n3. Anything security-relevant, unusual, or interesting?\n\n"
    "Be concise and specific. If function names are mostly sub_*, say so and give your best guess from patterns you can see.")


def overview_prompt(sample: DataFrame, totals: DataFrame) -> DataFrame:
    """Question text per binary over its (bounded) sample."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", "name", "size"))), lambda r: F.concat(
        F.lit("  "), r["name"], F.lit("  ("), r["size"].cast("string"), F.lit(" bytes)")))
    rows = sample.groupBy("binary").agg(F.array_join(lines, "\n").alias("context"), F.count("*").alias("shown"))
    return rows.join(totals.select("binary", "total"), "binary").select("binary", F.concat(
        F.lit(OVERVIEW[0]), F.col("shown").cast("string"), F.lit(OVERVIEW[1]),
        F.format_number("total", 0), F.lit(OVERVIEW[2]), F.col("context"), F.lit(OVERVIEW[3])).alias("prompt"))
