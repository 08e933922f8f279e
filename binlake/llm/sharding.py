"""Minimax contiguous partition of documents into shards, with DataFrame functions only.

Documents with equal text are one atomic group.  Groups are ordered by the hash of their text; the high bits of the
hash cut this order into cells of whole groups, by default 2**16 of them whatever the number of rows, so a cell is
far smaller than a shard and one row can hold all cell sizes.  The smallest capacity with which a greedy pass over
the cells needs no more than the wanted shards is found by binary search.  Cuts are then set as near to even parts
as this capacity allows: a cut may not come later than the greedy pass from the left, nor earlier than the greedy
pass from the right.

Law of the shards: ``bytes``.  A text's size is its UTF-8 bytes plus 8; a null text has size 8 and is its own group
apart from the empty one only in name (both hash alike).  Slots count the rows of a shard from 0 without gaps; a
group of equal texts may hold any share of the rows, so rows are numbered in parts (cell, salt of the id) and the
parts' starts are added.  Null ids and repeated rows get slots of their own; other columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import documents, text_of

SHARDS, CELL_BITS, SALTS, OVERHEAD = 24, 16, 64, 8


def sized(docs: DataFrame, cell_bits: int = CELL_BITS, salts: int = SALTS) -> DataFrame:
    """doc_id, size, text_crc32, the cell of the text and the salt of the row."""
    text = text_of(docs)
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("hash")).select(
        "*", F.shiftrightunsigned("hash", 64 - cell_bits).alias("cell"),
        F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt"))


def _needed(sizes: Column, capacity: Column) -> Column:
    """Shards a greedy pass fills when none may hold more than ``capacity``."""
    return F.aggregate(sizes, F.struct(F.lit(1).alias("n"), F.lit(0).cast("bigint").alias("used")),
                       lambda s, x: F.struct((s["n"] + F.when(s["used"] + x > capacity, 1).otherwise(0)).alias("n"),
                                             F.when(s["used"] + x > capacity, x).otherwise(s["used"] + x).alias("used")),
                       lambda s: s["n"])


def smallest_capacity(sizes: Column, shards: int) -> Column:
    """Smallest capacity with which ``shards`` contiguous parts hold all sizes, by binary search."""
    total = F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, x: a + x)
    low = F.greatest(F.array_max(sizes), F.ceil(total / shards).cast("bigint"))
    # an even part plus one group always suffices
    span = F.struct(low.alias("low"), (low + F.array_max(sizes)).alias("high"))
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.array_max(sizes) + 2)).cast("int") + 1)

    def halve(s: Column, _) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("bigint")
        fits = _needed(sizes, middle) <= shards
        return F.transform(F.array(F.struct(middle.alias("m"), fits.alias("f"))), lambda t: F.struct(
            F.when(t["f"], s["low"]).otherwise(F.least(t["m"] + 1, s["high"])).alias("low"),
            F.when(t["f"], t["m"]).otherwise(s["high"]).alias("high")))[0]
    return F.aggregate(steps, span, halve, lambda s: s["high"])


def cuts(cells: DataFrame, shards: int) -> DataFrame:
    """(cell, bytes) -> one row: the capacity and the first cells of all shards but the first."""
    zero = F.lit(0).cast("bigint")
    row = cells.groupBy().agg(F.array_sort(F.collect_list(F.struct("cell", "bytes"))).alias("c"))
    row = row.withColumn("sizes", F.transform("c", lambda x: x["bytes"]))
    row = row.withColumn("total", F.aggregate("sizes", zero, lambda a, x: a + x))
    row = row.withColumn("capacity", smallest_capacity(F.col("sizes"), shards))
    # back[k]: bytes that the last k shards can hold, by a greedy pass from the right
    row = row.withColumn("back", F.aggregate(
        F.reverse("sizes"), F.struct(F.array(zero).alias("done"), zero.alias("used"), zero.alias("sum")),
        lambda s, x: F.struct(
            F.when(s["used"] + x > F.col("capacity"), F.concat(s["done"], F.array(s["sum"]))).otherwise(s["done"]).alias("done"),
            F.when(s["used"] + x > F.col("capacity"), x).otherwise(s["used"] + x).alias("used"),
            (s["sum"] + x).alias("sum")),
        lambda s: F.concat(s["done"], F.array_repeat(s["sum"], shards + 1))))

    def walk(s: Column, x: Column) -> Column:
        even = F.col("total") * (s["shard"] + 1) / shards
        near = even - s["sum"] <= s["sum"] + x["bytes"] - even
        rest_fits = F.col("total") - s["sum"] <= F.element_at("back", F.lit(shards) - s["shard"])
        close = (s["shard"] < shards - 1) & (s["used"] > 0) & ((s["used"] + x["bytes"] > F.col("capacity")) | (near & rest_fits))
        return F.transform(F.array(close), lambda c: F.struct(
            (s["shard"] + F.when(c, 1).otherwise(0)).alias("shard"),
            F.when(c, x["bytes"]).otherwise(s["used"] + x["bytes"]).alias("used"),
            (s["sum"] + x["bytes"]).alias("sum"),
            F.when(c, F.concat(s["first"], F.array(x["cell"]))).otherwise(s["first"]).alias("first")))[0]
    begin = F.struct(F.lit(0).alias("shard"), zero.alias("used"), zero.alias("sum"), F.expr("cast(array() as array<bigint>)").alias("first"))
    return row.select("capacity", F.aggregate("c", begin, walk, lambda s: s["first"]).alias("first"))


def assign(docs: DataFrame, shards: int = SHARDS, cell_bits: int = CELL_BITS, salts: int = SALTS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row."""
    rows = sized(docs, cell_bits, salts)
    parts = rows.groupBy("cell", "salt").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    first = cuts(parts.groupBy("cell").agg(F.sum("bytes").cast("bigint").alias("bytes")), shards).select("first").scalar()
    placed = parts.withColumn("first", first).withColumn("shard", F.size(F.filter("first", lambda c: c <= F.col("cell"))))
    earlier = Window.partitionBy("shard").orderBy("cell", "salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.select("cell", "salt", "shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("cell", "salt").orderBy("doc_id", "hash")
    return rows.withColumn("k", F.row_number().over(inside) - 1).join(starts, ["cell", "salt"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("k")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


def op4_sharding(spark, folder):
    return assign(documents(spark, folder))
