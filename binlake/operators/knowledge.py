"""What is known at the addresses a function references."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import names as N

# Fixed values.
PER_TYPE, ADDRESSES, ENTRIES, LINES, CHARS = 15, 50, 20, 12, 2000
TYPE_ORDER = {"code": 0, "data": 1, "string": 2}


def type_rank(col):
    out = F
    for name, rank in TYPE_ORDER.items():
        out = out.when(col == name, rank)
    return out.otherwise(9)


def references(refs: DataFrame) -> DataFrame:
    """First reference per address and type, then the first 15 per function and type.

    Deduplication is a grouped minimum, so a function referenced a billion times combines
    before the shuffle; the rank filter keeps at most 15 rows per group and partition.
    """
    first = refs.groupBy("binary", "func_addr", "ref_type", "addr").agg(F.min("ord").alias("ord"))
    w = Window.partitionBy("binary", "func_addr", "ref_type").orderBy("ord", "addr")
    return first.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= PER_TYPE)


def lookup(addr_knowledge: DataFrame) -> DataFrame:
    """Knowledge rows that say anything at all."""
    return addr_knowledge.filter(N.has_content(*[F.col(c) for c in ("name", "comment", "type_str", "string_val")]))


def priority(name, comment, type_str, string_val):
    def full(c):
        return F.coalesce(c, F.lit("")) != ""
    return (F.when(full(string_val), 0).when(~N.is_noise(name), 1).when(full(type_str), 2)
            .when(full(comment), 3).otherwise(4))


def gather(refs: DataFrame, addr_knowledge: DataFrame) -> DataFrame:
    """Ranked knowledge entries per function, at most 20: strings, names, types, comments.

    An address referenced in several ways is listed once per way, always under its last type.
    """
    listed = references(refs).withColumn("type_pos", type_rank(F.col("ref_type")))
    same = Window.partitionBy("binary", "func_addr", "addr")
    listed = listed.withColumn("ref_type", F.max_by("ref_type", "type_pos").over(same))
    w = Window.partitionBy("binary", "func_addr").orderBy("type_pos", "pos", "addr")
    capped = listed.withColumn("slot", F.row_number().over(w)).filter(F.col("slot") <= ADDRESSES)
    known = capped.join(lookup(addr_knowledge), ["binary", "addr"])
    ranked = known.withColumn("priority", priority(*[F.col(c) for c in ("name", "comment", "type_str", "string_val")]))
    order = Window.partitionBy("binary", "func_addr").orderBy("priority", "slot")
    return (ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= ENTRIES)
            .select("binary", "func_addr", "addr", "ref_type", "name", "comment", "type_str", "string_val",
                    "priority", "rank"))


def line(name, comment, type_str, string_val):
    """One entry as text; null when it has nothing to show."""
    def full(c):
        return F.coalesce(c, F.lit("")) != ""
    quoted = F.concat(F.lit('"'), F.substring(N.escape_quotes(string_val), 1, 60), F.lit('"'))
    shown = (F.when(full(string_val), F.concat_ws(" ", quoted, F.nullif(name, F.lit(""))))
             .when(full(name), F.concat_ws(" ", name, F.when(
                 full(comment), F.concat(F.lit("// "), F.substring(comment, 1, 40)))))
             .when(full(comment), F.concat(F.lit("comment: "), F.substring(comment, 1, 60)))
             .when(full(type_str), F.concat(F.lit("("), type_str, F.lit(")"))))
    return F.when(F.length(shown) > 80, F.concat(F.substring(shown, 1, 77), F.lit("..."))).otherwise(shown)


def block(entries: DataFrame, shown: DataFrame | None = None) -> DataFrame:
    """Text block per function; names already ``shown`` (binary, func_addr, name) are only counted.

    Entries are at most 20 per function, so the ordered list is bounded.
    """
    rows = entries
    if shown is not None:
        mark = shown.select("binary", "func_addr", "name").distinct().withColumn("_shown", F.lit(True))
        rows = rows.join(mark, ["binary", "func_addr", "name"], "left")
    else:
        rows = rows.withColumn("_shown", F.lit(None).cast("boolean"))
    rows = (rows.withColumn("_skip", F.coalesce("_shown", F.lit(False)) & (F.coalesce("name", F.lit("")) != ""))
            .withColumn("_line", F.when(~F.col("_skip"), line(*[F.col(c) for c in (
                "name", "comment", "type_str", "string_val")]))))
    listed = rows.groupBy("binary", "func_addr").agg(
        F.array_sort(F.collect_list(F.struct("rank", "_skip", "_line"))).alias("e"))
    lines = F.slice(F.filter(F.transform("e", lambda x: x["_line"]), lambda x: x.isNotNull()), 1, LINES)
    last = F.coalesce(F.get(F.filter("e", lambda x: x["_line"].isNotNull()), F.lit(LINES - 1))["rank"],
                      F.lit(ENTRIES + 1))
    skipped = F.size(F.filter("e", lambda x: x["_skip"] & (x["rank"] < last)))
    tail = F.when(skipped > 0, F.array(F.concat(F.lit("(+"), skipped.cast("string"),
                                                F.lit(" already in callgraph context)")))
                  ).otherwise(F.array().cast("array<string>"))
    every = F.transform(F.concat(lines, tail), lambda x: F.concat(F.lit("  "), x))
    text = F.when(F.size(every) == 0, "").otherwise(
        F.concat(F.lit("Known references:\n"), F.array_join(every, "\n")))
    cut = F.when(F.length(text) > CHARS, F.concat(F.substring(text, 1, CHARS - 20),
                                                  F.lit("\n  ...(truncated)"))).otherwise(text)
    return listed.select("binary", F.col("func_addr").alias("addr"), cut.alias("knowledge"))



