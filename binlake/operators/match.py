"""Cross-version matches: ratio gates and name porting."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

AUTO, HINT, GROUND_TRUTH = 0.95, 0.80, 0.95


def gated(matches: DataFrame, auto: float = AUTO, hint: float = HINT) -> DataFrame:
    r = F.coalesce("ratio", F.lit(0.0))
    return matches.withColumn("gate", F.when(r >= auto, "auto").when(r >= hint, "hint").otherwise("discard"))


def gate(matches: DataFrame, auto: float = AUTO, hint: float = HINT) -> DataFrame:
    g = F.col("gate")
    return gated(matches, auto, hint).agg(
        F.count("*").alias("total_matched"), F.count_if(g == "auto").alias("auto_applied"),
        F.count_if(g == "hint").alias("hints"), F.count_if(g == "discard").alias("discarded"))


def ground_truth(matches: DataFrame, min_ratio: float = GROUND_TRUTH) -> DataFrame:
    """High-ratio matches as evaluation pairs; rows whose addresses do not parse are dropped."""
    return (matches.filter(F.col("ratio") >= min_ratio).filter(
        F.col("address").isNotNull() & F.col("address2").isNotNull()).select(
        F.lit("old").alias("binary_a"), F.col("address").alias("addr_a"), F.coalesce("name", F.lit("")).alias("name_a"),
        F.lit("new").alias("binary_b"), F.col("address2").alias("addr_b"),
        F.coalesce("name2", F.lit("")).alias("name_b"), F.col("ratio")))


def port_lines(matches: DataFrame, auto: float = AUTO, hint: float = HINT) -> DataFrame:
    """Rename statements for the automatic gate, one row each, keyed by the new address."""
    from ..functions import addr as A, names as N
    rows = gated(matches, auto, hint).filter("gate = 'auto'")
    return rows.select(F.col("address2").alias("addr"), F.concat(
        F.lit("  set_name("), A.hexify(F.col("address2")), F.lit(', "'), N.escape_quotes(F.coalesce("name", F.lit(""))),
        F.lit('", SN_NOWARN);')).alias("line"))


def hints(matches: DataFrame, auto: float = AUTO, hint: float = HINT) -> DataFrame:
    return (gated(matches, auto, hint).filter("gate = 'hint'").select(
        F.col("address2").alias("address_new"), F.col("name").alias("name_old"),
        F.bround("ratio", 3).alias("ratio"), "description"))
