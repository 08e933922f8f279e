"""Table of known function identities across versions."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def stamped(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("ts", F.coalesce("ts", F.current_timestamp()))


def append(pairs: DataFrame, path: str) -> None:
    stamped(pairs).write.mode("append").parquet(path)


def by_function(pairs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Pairs with a wanted (binary, addr) on either side: two equi-joins instead of an OR join.

    A pair between two wanted functions shows once per wanted function.
    """
    want = wanted.select(F.col("binary").alias("w_binary"), F.col("addr").alias("w_addr")).distinct()
    old = pairs.join(want, (F.col("binary_old") == F.col("w_binary")) & (F.col("addr_old") == F.col("w_addr")))
    new = pairs.join(want, (F.col("binary_new") == F.col("w_binary")) & (F.col("addr_new") == F.col("w_addr")))
    both_sides = (F.col("binary_old") == F.col("binary_new")) & (F.col("addr_old") == F.col("addr_new"))
    return old.unionByName(new.filter(~both_sides))


def by_binary(pairs: DataFrame, binary: str) -> DataFrame:
    return (pairs.filter((F.col("binary_old") == binary) | (F.col("binary_new") == binary))
            .orderBy(F.desc("similarity")))


def stats(pairs: DataFrame) -> DataFrame:
    """Counts; ``binaries`` adds both sides' distinct counts, ``distinct_binaries`` is the true number."""
    sides = pairs.select("verified", "binary_old", "binary_new")
    both = pairs.select(F.explode(F.array("binary_old", "binary_new")).alias("b")).agg(
        F.count_distinct("b").alias("distinct_binaries"))
    head = sides.agg(F.count("*").alias("total_pairs"), F.count_if("verified").alias("verified"),
                     (F.count_distinct("binary_old") + F.count_distinct("binary_new")).alias("binaries"))
    # both frames are single-row aggregates
    return head.withColumn("_one", F.lit(1)).join(both.withColumn("_one", F.lit(1)), "_one").drop("_one")
