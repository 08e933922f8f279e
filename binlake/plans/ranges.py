"""Point-in-interval joins as equi-joins on address buckets."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Widths of intervals that share buckets.
SHARED = 4


def range_join(points: DataFrame, intervals: DataFrame, keys: list[str], point: str, start: str = "start", end: str = "end") -> DataFrame:
    """Pair every point with the intervals ``start <= point < end`` of the same keys.

    An interval's buckets are as wide as the largest power of two in its length or up to eight times narrower, so it touches 17 at most, and a point is listed
    once per width that is used (at most 16, one or two in practice).  Intervals of any lengths mix, and none is listed
    along its whole span.  The shuffle key is (keys, width, bucket), so no nested loop is planned and a hot bucket can be split by the skew join.
    """
    sized = intervals.filter(F.col(end) > F.col(start)).withColumn("_rw", F.length(F.bin(F.col(end) - F.col(start))) - 1)
    # one row of at most 63 numbers, found inside the same job; of four widths that follow each other the narrowest is used
    found = sized.agg(F.sort_array(F.collect_set("_rw")).alias("w")).select(F.aggregate(
        "w", F.array().cast("array<int>"), lambda used, w: F.when(w - F.coalesce(F.get(used, F.size(used) - 1), F.lit(-SHARED)) >= SHARED, F.concat(used, F.array(w))).otherwise(used)))
    sized = sized.withColumn("_ws", found.scalar()).withColumn("_rw", F.array_max(F.filter("_ws", lambda w: w <= F.col("_rw")))).drop("_ws")
    right = sized.withColumn("_rb", F.explode(F.expr(f"sequence(shiftright(`{start}`, _rw), shiftright(`{end}` - 1, _rw))"))).withColumnsRenamed(
        {k: f"_r_{k}" for k in keys})
    left = points.withColumn("_w", F.explode(found.scalar())).withColumn("_bucket", F.expr(f"shiftright(`{point}`, _w)"))
    cond = (F.col("_bucket") == F.col("_rb")) & (F.col("_w") == F.col("_rw"))
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_r_{k}"))
    cond = cond & (F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))
    # Spark knows the size of the intervals, not of their listing, and would broadcast what grows with the input
    return left.join(right.hint("merge"), cond).drop("_w", "_rw", "_bucket", "_rb", *[f"_r_{k}" for k in keys])
