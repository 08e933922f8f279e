"""Ranked n-hop neighbourhoods and the text block built from them."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import names as N, text as T

# Fixed values.
DEPTH, MAX_NEIGHBORS, OVERFETCH, BLOCK_CHARS = 2, 10, 3, 3000


def _adjacency(calls: DataFrame, functions: DataFrame, direction: str, keep: int) -> DataFrame:
    """Neighbour lists cut to the first ``keep`` named and ``keep`` unnamed entries by address.

    The cut loses nothing: a node is only expanded while fewer than ``cap`` results exist, so of the
    first ``2*cap + 1`` entries of a class at least ``cap`` are new, and no more than ``cap`` count.
    The row_number filter is applied before the shuffle too, so hubs shrink where they lie.
    """
    src, dst = ("callee_addr", "caller_addr") if direction == "callers" else ("caller_addr", "callee_addr")
    named = functions.select("binary", F.col("addr").alias("to"), "name",
                             N.is_named(F.col("name"), "context").alias("is_named"))
    near = (calls.select("binary", F.col(src).alias("addr"), F.col(dst).alias("to")).distinct()
            .join(named, ["binary", "to"], "left")
            .withColumn("is_named", F.coalesce("is_named", F.lit(False)))
            .withColumn("name", F.coalesce("name", F.lit(""))))
    w = Window.partitionBy("binary", "addr", "is_named").orderBy("to")
    return near.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= keep).drop("_r")


def neighbors(starts: DataFrame, calls: DataFrame, functions: DataFrame, direction: str,
              depth: int = DEPTH, max_neighbors: int = MAX_NEIGHBORS) -> DataFrame:
    """Best ``max_neighbors`` callers or callees of each start, named first, then nearest.

    Breadth-first through named functions only; a node is expanded while fewer than
    ``3 * max_neighbors`` results exist.  Neighbours of a node are visited by address.
    Output: binary, start, addr, name, relation, hops, is_named, rank.
    """
    cap = OVERFETCH * max_neighbors
    near = _adjacency(calls, functions, direction, 2 * cap + 1)
    per_start = ["binary", "start"]
    begin = starts.select("binary", "start").distinct()
    frontier = begin.withColumn("addr", F.col("start")).withColumn("via", F.lit(0).cast("bigint"))
    found = None
    for hop in range(1, depth + 1):
        cand = (frontier.join(near, ["binary", "addr"]).filter("to <> start")
                .groupBy("binary", "start", "to")
                .agg(F.min("via").alias("via"), F.first("name").alias("name"),
                     F.first("is_named").alias("is_named")))
        if found is None:
            grown = cand.withColumn("ord", F.row_number().over(Window.partitionBy(*per_start).orderBy("to")))
            found = grown.select(*per_start, F.col("to").alias("addr"), "name", "is_named",
                                 F.lit(hop).alias("hops"), F.col("ord").cast("bigint").alias("ord"))
        else:
            seen = found.select("binary", "start", F.col("addr").alias("to"))
            fresh = cand.join(seen, ["binary", "start", "to"], "left_anti")
            sizes = found.groupBy(*per_start).agg(F.count("*").alias("_have"))
            before = (Window.partitionBy(*per_start).orderBy("via")
                      .rowsBetween(Window.unboundedPreceding, -1))
            open_via = (fresh.groupBy(*per_start, "via").agg(F.count("*").alias("_n"))
                        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
                        .join(sizes, per_start).filter(F.col("_have") + F.col("_before") < cap)
                        .select(*per_start, "via", "_have"))
            grown = (fresh.join(open_via, [*per_start, "via"])
                     .withColumn("ord", F.col("_have") + F.row_number().over(
                         Window.partitionBy(*per_start).orderBy("via", "to"))))
            found = found.unionByName(grown.select(
                *per_start, F.col("to").alias("addr"), "name", "is_named", F.lit(hop).alias("hops"),
                F.col("ord").cast("bigint").alias("ord")))
        frontier = (found.filter((F.col("hops") == hop) & F.col("is_named"))
                    .select(*per_start, "addr", F.col("ord").alias("via")))
    rank = Window.partitionBy(*per_start).orderBy(F.desc("is_named"), "hops", "ord")
    return (found.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= max_neighbors)
            .select(*per_start, "addr",
                    F.when(F.col("name") == "", F.concat(F.lit("sub_"), F.lower(F.hex("addr"))))
                    .otherwise(F.col("name")).alias("name"),
                    F.lit(direction.rstrip("s")).alias("relation"), "hops", "is_named", "rank"))


def gather(functions: DataFrame, calls: DataFrame, starts: DataFrame | None = None,
           knowledge_block: DataFrame | None = None, depth: int = DEPTH,
           max_neighbors: int = MAX_NEIGHBORS) -> DataFrame:
    """One row per start: caller and callee lists (at most ``max_neighbors`` each), strings, constants.

    ``knowledge_block`` may bring (binary, addr, knowledge) texts.  Pseudocode is reduced to its few
    strings and numbers where it is scanned; it never enters a join.
    """
    if starts is None:
        starts = functions.select("binary", F.col("addr").alias("start"))
    lean = functions.select("binary", "addr", "name")
    out = starts.select("binary", "start").distinct()
    item = F.struct("rank", "addr", "name", "relation", "hops", "is_named")
    empty = F.array().cast("array<struct<rank:int,addr:bigint,name:string,relation:string,hops:int,"
                           "is_named:boolean>>")
    for direction in ("callers", "callees"):
        near = neighbors(starts, calls, lean, direction, depth, max_neighbors)
        listed = near.groupBy("binary", "start").agg(F.array_sort(F.collect_list(item)).alias(direction))
        out = (out.join(listed, ["binary", "start"], "left")
               .withColumn(direction, F.coalesce(direction, empty)))
    code = F.coalesce("pseudocode", F.lit(""))
    body = functions.select("binary", F.col("addr").alias("start"), T.strings(code, 8, 40).alias("strings"),
                            T.constants(code, 6).alias("constants"))
    out = out.join(body, ["binary", "start"], "left")
    if knowledge_block is not None:
        known = knowledge_block.select("binary", F.col("addr").alias("start"), "knowledge")
        out = out.join(known, ["binary", "start"], "left")
    return out


def _number(value):
    small = value.cast("string")
    return F.when(value > 255, F.concat(F.lit("0x"), F.hex(value.cast("bigint")))).otherwise(small)


def block(context: DataFrame) -> DataFrame:
    """Adds ``summary`` and ``block``: the compact text of a gathered context."""
    def side(col: str, named_head: str, unnamed_head: str):
        named = F.transform(F.filter(F.col(col), lambda n: n["is_named"]), lambda n: n["name"])
        unnamed = F.size(F.filter(F.col(col), lambda n: ~n["is_named"]))
        return (F.when(F.size(named) > 0, F.concat(F.lit(named_head), F.array_join(F.slice(named, 1, 6), ", "))),
                F.when(unnamed > 0, F.concat(F.lit(unnamed_head), unnamed.cast("string"),
                                             F.lit(" unnamed functions"))),
                F.when(unnamed > 0, F.concat(F.lit("+"), unnamed.cast("string"),
                                             F.lit(f" more unnamed {col}"))))
    a_named, a_unnamed, a_more = side("callers", "Called by: ", "Also called by: ")
    e_named, e_unnamed, e_more = side("callees", "Calls: ", "Also calls: ")
    quoted = F.transform(F.slice("strings", 1, 6), lambda s: F.concat(F.lit('"'), s, F.lit('"')))
    numbers = F.transform(F.slice("constants", 1, 4), _number)
    knowledge = F.nullif(F.col("knowledge"), F.lit("")) if "knowledge" in context.columns \
        else F.lit(None).cast("string")
    summary = F.concat_ws("; ", a_more, e_more)
    body = F.concat_ws(
        "\n", a_named, a_unnamed, e_named, e_unnamed,
        F.when(F.size("strings") > 0, F.concat(F.lit("References strings: "), F.array_join(quoted, ", "))),
        F.when(F.size("constants") > 0, F.concat(F.lit("Key constants: "), F.array_join(numbers, ", "))),
        knowledge, F.nullif(summary, F.lit("")))
    full = F.when(body == "", "").otherwise(F.concat(F.lit("Context:\n"), body))
    cut = F.when(F.length(full) > BLOCK_CHARS, F.concat(
        F.substring(full, 1, BLOCK_CHARS - 20), F.lit("\n…(truncated)"))).otherwise(full)
    return context.withColumn("summary", summary).withColumn("block", cut)


