"""Ordered computations per key without putting one key into one task.

A key (a campaign, a binary) may hold a third of all rows, so a plain ``Window.partitionBy(key)``
would sort that third in a single task.  Here every key is cut into blocks of its integer order
column; windows run inside (key, block), and one small row per block carries the prefix forward.
The order column must be unique within the key.  Where it is an integer that counts up, blocks are equal stretches of it,
and a block never holds more than ``block`` rows whatever the skew; where it is sparse, they lie between its quantiles.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage

BLOCK = 50_000


def with_block(df: DataFrame, step: str, block: int = BLOCK) -> DataFrame:
    return df.withColumn("_blk", F.floor(F.col(step) / block).cast("bigint"))


def with_ranged_block(df: DataFrame, keys: list[str], step: str, parts: int | None = None) -> DataFrame:
    """Blocks between sampled quantiles of (keys, step), about equally full however sparse or clustered the steps are.

    As many blocks as there are shuffle partitions; a key with a third of all rows lies in a third of them.  The rows are
    written once, since sampling anew would draw other bounds.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(df.repartitionByRange(parts, *keys, step).withColumn("_blk", F.spark_partition_id().cast("bigint")))


def running_sums(df: DataFrame, keys: list[str], step: str, sums: dict[str, Column],
                 block: int = BLOCK, sparse: bool = False) -> DataFrame:
    """Inclusive running sums per key in step order, as extra columns.

    ``sparse`` says that the steps don't follow each other closely, as addresses or values; blocks then hold equal numbers of rows.
    """
    names = list(sums)
    src = df.withColumns({f"_v_{n}": c for n, c in sums.items()})
    src = with_ranged_block(src, keys, step) if sparse else with_block(src, step, block)
    totals = src.groupBy(*keys, "_blk").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in names])
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*keys, "_blk", *[
        F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in names])
    inner = Window.partitionBy(*keys, "_blk").orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    local = src.withColumns({f"_l_{n}": F.sum(f"_v_{n}").over(inner) for n in names})
    return (local.join(_rename_keys(bases, keys), _on(local, keys), "inner")
            .withColumns({n: F.col(f"_l_{n}") + F.col(f"_b_{n}") for n in names})
            .select(*df.columns, *names))


def _rename_keys(bases: DataFrame, keys: list[str]) -> DataFrame:
    return bases.withColumnsRenamed({k: f"_k_{k}" for k in [*keys, "_blk"]})


def _on(local: DataFrame, keys: list[str]) -> Column:
    cond = F.col("_blk") == F.col("_k__blk")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return cond


def dense_index(df: DataFrame, keys: list[str], step: str, name: str = "idx",
                block: int = BLOCK, sparse: bool = False) -> DataFrame:
    """1-based position of every row within its key in step order."""
    return running_sums(df, keys, step, {name: F.lit(1).cast("bigint")}, block, sparse)


def with_lookback(df: DataFrame, keys: list[str], idx: str, depth: int, block: int = BLOCK) -> DataFrame:
    """Blocks of a dense index, each preceded by the last ``depth`` rows of the block before.

    ``_own`` marks a block's own rows; rows copied forward only feed the windows and are then
    filtered out.  ``depth`` must not exceed ``block``.
    """
    if depth > block:
        raise ValueError("lookback deeper than a block")
    own = F.floor((F.col(idx) - 1) / block).cast("bigint")
    near_end = (F.col(idx) - 1) % block >= block - depth
    homes = F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))
    return (df.withColumn("_home", own).withColumn("_blk", F.explode(homes))
            .withColumn("_own", F.col("_blk") == F.col("_home")).drop("_home"))


def trailing(keys: list[str], idx: str, first: int, last: int = 0) -> Window:
    return Window.partitionBy(*keys, "_blk").orderBy(idx).rowsBetween(first, last)


def _compose(f: Column, g: Column) -> Column:
    """The step that applies f and then g; steps are structs (a, b, lo, hi)."""
    def through(x: Column) -> Column:
        y = F.when(g["a"] == 0, g["b"]).otherwise(g["a"] * x + g["b"])
        return F.least(F.greatest(y, g["lo"]), g["hi"])
    return F.struct((g["a"] * f["a"]).alias("a"), (g["a"] * f["b"] + g["b"]).alias("b"),
                    through(f["lo"]).alias("lo"), through(f["hi"]).alias("hi"))


#: Rows of a block of a scan.
SCAN_BLOCK = 256


def _scanned(steps: Column, entry: Column) -> Column:
    """(before, after) of each step, from the value in front of the first one.  Arrays grow by copying, so blocks are small."""
    def follow(acc: Column, x: Column) -> Column:
        after = F.least(F.greatest(x["a"] * acc["t"] + x["b"], x["lo"]), x["hi"])
        return F.struct(after.alias("t"), F.concat(acc["out"], F.array(F.struct(acc["t"].alias("before"), after.alias("after")))).alias("out"))
    start = F.struct(entry.cast("double").alias("t"), F.lit([]).cast("array<struct<before:double,after:double>>").alias("out"))
    return F.aggregate(steps, start, follow, lambda acc: acc["out"])


def clamped_scan(df: DataFrame, keys: list[str], idx: str, start: float, block: int = SCAN_BLOCK, whole: bool = False) -> DataFrame:
    """Thread a value through ``t <- min(max(a*t + b, lo), hi)`` along each key.

    ``df`` has a dense 1-based ``idx``, columns ``a, b, lo, hi`` (``a >= 0``) and others of types that can be ordered.  Adds ``before`` and ``after``: the value
    ahead of and behind each row.  Such steps compose into steps of the same form, so each block is reduced to one step, the steps of blocks are
    threaded in the same way a level up, and then every block is filled in on its own, as one array.  ``whole`` takes each key as one block: levels end
    where no key has more blocks than a block has rows.
    """
    rest = [c for c in df.columns if c not in (*keys, "a", "b", "lo", "hi")]
    part = [*keys, "_blk"]
    step = F.struct(F.col(idx).alias("_i"), *[F.col(c).cast("double").alias(c) for c in ("a", "b", "lo", "hi")], F.struct(*rest).alias("_row"))
    grouped = df.withColumn("_blk", F.lit(0).cast("bigint") if whole else F.floor((F.col(idx) - 1) / block).cast("bigint")).groupBy(*part).agg(
        F.array_sort(F.collect_list(step)).alias("_s"))
    if whole:
        placed = grouped.withColumn("_entry", F.lit(float(start)))
    else:
        grouped = cut_lineage(grouped)  # read for the steps and for the rows
        most = (grouped.agg(F.max("_blk")).first()[0] or 0) + 1
        same = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"))
        steps = F.transform("_s", lambda x: F.struct(x["a"], x["b"], x["lo"], x["hi"]))
        blocks = grouped.select(*keys, (F.col("_blk") + 1).alias("_n"), F.aggregate(steps, same, _compose).alias("s")).select(*keys, "_n", "s.*")
        entries = clamped_scan(blocks, keys, "_n", start, block, most <= block).select(
            *[F.col(k).alias(f"_k_{k}") for k in keys], (F.col("_n") - 1).alias("_k__blk"), F.col("before").alias("_entry"))
        placed = grouped.join(entries, _on(grouped, keys))
    filled = F.zip_with("_s", _scanned(F.col("_s"), F.col("_entry")), lambda x, y: F.struct(x["_row"].alias("r"), y["before"].alias("before"), y["after"].alias("after")))
    out = placed.select(*keys, F.explode(filled).alias("x"))
    return out.select(*keys, "x.r.*", "x.before", "x.after").select(*[c for c in df.columns if c not in ("a", "b", "lo", "hi")], "before", "after")
