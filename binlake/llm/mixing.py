"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

A source of weight ``w`` sends blocks of ``block`` documents.  Its b-th block (from 0) is released at slot
``floor(b / w)`` and due before slot ``ceil((b + 1) / w)``.  In each slot the released block with the earliest
deadline goes.  As the weights sum to one, every block meets its window, so after any number of slots t each source
has sent ``w t`` blocks within less than one.  Weights are whole shares of 10^15 and windows are computed in
decimals, so this holds for the weights asked for and not for rounded ones.  One row walks through the slots and
keeps what ranges of slots start from; the ranges are scheduled apart, and rows meet their block in a join.

The mix goes on until each source has sent all its documents once; sources that are done earlier start further
epochs, so documents of sources under their weight repeat.  With ``repeat=False`` they fall silent instead and every
document comes once.

Default weights are the counts of the sources to the power ``temper``.  A source of weight 0 sends nothing; one that
``weights`` doesn't name gets the ``period``-th part of the weights that are named.  A null source counts as the source ''.
Within a source, documents go in an order of hashes.  A source may hold any share of the rows: its rows are numbered
in parts (source, salt of the id) and the parts' starts are added.  Repeated rows are separate documents; null ids
and texts are kept; an empty table gives an empty mix; other columns are carried along.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import as_documents, documents, whole_rows

#: Documents of a block, slots of a range, parts of a source.  Weights are whole shares of WHOLE.
BLOCK, PERIOD, SALTS, TEMPER, WHOLE = 8, 1000, 1024, 0.7, 10 ** 15


def shares(counts: DataFrame, weights: dict[str, float] | None = None, temper: float = TEMPER, period: int = PERIOD) -> DataFrame:
    """(source, n) -> one row: sources in order, each with n and its whole weight q, and the period, the sum of weights."""
    if weights:
        if not all(0 <= v < float("inf") for v in weights.values()):
            raise ValueError("weights must be finite and not negative")
        table = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
        weight = F.try_element_at(table, F.col("source"))
    else:
        weight = F.pow("n", temper)
    rows = counts.withColumn("w", weight).groupBy().agg(
        F.sum("w").alias("known"), F.array_sort(F.collect_list(F.struct("source", "n", "w"))).alias("c"))
    rows = rows.withColumn("rest", F.when(F.col("known") > 0, F.col("known") / period).otherwise(1.0))
    rows = rows.withColumn("c", F.filter(F.transform("c", lambda x: F.struct(
        x["source"].alias("source"), x["n"].alias("n"), F.coalesce(x["w"], F.col("rest")).alias("w"))), lambda x: x["w"] > 0))
    rows = rows.withColumn("all", F.aggregate("c", F.lit(0.0), lambda a, x: a + x["w"])).filter(F.size("c") > 0)
    q = F.transform("c", lambda x: F.struct(x["source"].alias("source"), x["n"].alias("n"), F.greatest(
        F.lit(1).cast("bigint"), F.round(x["w"] / F.col("all") * WHOLE).cast("bigint")).alias("q")))
    return rows.select(q.alias("c")).withColumn("period", F.aggregate("c", F.lit(0).cast("bigint"), lambda a, x: a + x["q"]))


def _wide(x: Column) -> Column:
    return x.cast("decimal(19,0)")


def release(b: Column, q: Column, period: Column) -> Column:
    return F.call_function("div", _wide(b) * _wide(period), _wide(q))


def deadline(b: Column, q: Column, period: Column) -> Column:
    return F.call_function("div", _wide(b + 1) * _wide(period) + _wide(q) - 1, _wide(q))


def schedule(counts: DataFrame, weights: dict[str, float] | None = None, temper: float = TEMPER, period: int = PERIOD) -> DataFrame:
    """(source, n) -> (i, source, n, q, period): the weight of each source is q / period."""
    return shares(counts, weights, temper, period).select("period", F.posexplode("c").alias("i", "x")).select("i", "x.*", "period")


def _waiting(i: Column, b: Column, q: Column, last: Column) -> Column:
    """Block b of source i, in the order of the choice."""
    p = F.col("period")
    return F.struct(deadline(b, q, p).alias("due"), i.alias("i"), release(b, q, p).alias("from"), b.alias("b"), q.alias("q"), last.alias("last"))


def _step(r: Column, t: Column, then) -> Column:
    """``then(state r, waiting blocks after slot t, the block sent in it)``: of the released blocks the one with the earliest deadline goes."""
    sent = F.array_min(F.filter(r["s"], lambda x: x["from"] <= t))
    # an aggregate over one value computes it once and, unlike transform, does not copy the state
    return F.aggregate(F.array(sent), r, lambda r, x: then(r, F.concat(
        F.slice(r["s"], F.lit(1), x["i"]), F.array(_waiting(x["i"], x["b"] + 1, x["q"], x["last"])), F.slice(r["s"], x["i"] + 2, F.size(r["s"]))), x))


def blocks(row: DataFrame, block: int = BLOCK, size: int = PERIOD) -> DataFrame:
    """The row of ``shares`` -> (i, block, slot) of all slots until each source has sent its documents once.

    One row walks through the slots and keeps the waiting blocks at the start of each range of ``size`` slots and
    nothing else of it; the ranges are then scheduled apart from each other.
    """
    none, zero = F.expr("cast(array() as array<array<bigint>>)"), F.lit(0).cast("bigint")
    waiting = lambda b: F.transform("c", lambda x, i: _waiting(i, b(i), x["q"], F.floor((x["n"] - 1) / block)))
    slots = lambda k: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda j: k * size + j)
    end = F.array_max(F.transform("c", lambda x: deadline(F.floor((x["n"] - 1) / block), x["q"], F.col("period"))))
    walked = F.aggregate(
        F.sequence(zero, F.floor((end - 1) / size)), F.struct(waiting(lambda i: zero).alias("s"), zero.alias("length"), none.alias("starts")),
        lambda a, k: F.aggregate(
            slots(k), F.struct(a["s"].alias("s"), a["length"].alias("length")),
            lambda r, t: _step(r, t, lambda r, s, x: F.struct(s.alias("s"), F.when(x["b"] == x["last"], t + 1).otherwise(r["length"]).alias("length"))),
            lambda r: F.struct(r["s"].alias("s"), r["length"].alias("length"), F.concat(a["starts"], F.array(F.transform(a["s"], lambda x: x["b"]))).alias("starts"))),
        lambda a: F.struct(a["length"].alias("length"), a["starts"].alias("starts")))
    parts = int(row.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = row.withColumn("w", F.explode(F.array(walked))).select("c", "period", "w.length", F.posexplode("w.starts").alias("k", "sent")) \
        .filter(F.col("k") * size < F.col("length")).repartition(parts, "k")
    first = F.struct(waiting(lambda i: F.col("sent")[i]).alias("s"), F.expr("cast(array() as array<struct<i:int,block:bigint,slot:bigint>>)").alias("out"))
    out = F.aggregate(slots(F.col("k").cast("bigint")), first, lambda r, t: _step(r, t, lambda r, s, x: F.struct(
        s.alias("s"), F.concat(r["out"], F.array(F.struct(x["i"].alias("i"), x["b"].alias("block"), t.alias("slot")))).alias("out"))), lambda r: r["out"])
    return ranges.select("length", F.explode(out).alias("x")).filter("x.slot < length").select("x.*")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, temper: float = TEMPER,
        period: int = PERIOD, repeat: bool = True, salts: int = SALTS) -> DataFrame:
    """Rows of ``docs`` with epoch, block, release, deadline, slot and position in the mix (which replace columns of these names)."""
    out = _mix(whole_rows(docs, "doc_id", "source"), weights, block, temper, period, repeat, salts)
    return out.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns if c not in PLACE], *PLACE)


PLACE = ("epoch", "block", "release", "deadline", "slot", "position")


def _mix(docs: DataFrame, weights, block: int, temper: float, period: int, repeat: bool, salts: int) -> DataFrame:
    rows = docs.withColumns({"_source": F.coalesce(F.col("source").cast("string"), F.lit("")),
                             "_salt": F.pmod(F.xxhash64("doc_id"), F.lit(salts))})
    parts = rows.groupBy("_source", "_salt").agg(F.count("*").alias("_n"))
    counts = parts.groupBy(F.col("_source").alias("source")).agg(F.sum("_n").alias("n"))
    plan = schedule(counts, weights, temper, period)
    # the mix ends before this slot
    plan = plan.withColumn("end", F.max(deadline(F.floor((F.col("n") - 1) / block), F.col("q"), F.col("period"))).over(Window.partitionBy("period")))
    earlier = Window.partitionBy("_source").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("start", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n") \
        .join(plan.withColumnRenamed("source", "_source"), "_source").hint("shuffle_hash")
    inside = Window.partitionBy("_source", "_salt").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id")
    out = rows.withColumn("_k", F.row_number().over(inside) - 1).join(starts, ["_source", "_salt"])
    index = F.col("start") + F.col("_k")
    if repeat:
        # blocks released before slot ``end``, and with them the epochs of this row
        sent = F.call_function("div", _wide(F.col("end")) * _wide(F.col("q")), _wide(F.col("period"))) + 1
        out = out.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(
            F.lit(0).cast("bigint"), F.floor((sent * block - 1 - index) / F.col("n"))))))
    else:
        out = out.withColumn("epoch", F.lit(0).cast("bigint"))
    at = index + F.col("epoch") * F.col("n")
    out = out.withColumn("_at", at).withColumn("block", F.floor(F.col("_at") / block))
    out = out.join(blocks(shares(counts, weights, temper, period), block, period).hint("shuffle_hash"), ["i", "block"])
    return out.withColumns({
        "release": release(F.col("block"), F.col("q"), F.col("period")), "deadline": deadline(F.col("block"), F.col("q"), F.col("period")),
        "position": F.col("slot") * block + F.col("_at") % block})


def stage(docs: DataFrame) -> DataFrame:
    """The mix as rows of documents; every part of the output is in the order of the mix."""
    out = _mix(whole_rows(docs, "doc_id", "source"), None, BLOCK, TEMPER, PERIOD, True, SALTS)
    return as_documents(out.sortWithinPartitions("position"), docs)


def op6_mixing(spark, folder):
    return mix(documents(spark, folder).select("doc_id", "source"))
