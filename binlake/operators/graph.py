"""Function call graph: stats, search, neighbours, reachability, upserts, address resolution."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import addr as A, names as N
from ..plans import blocks, tables
from ..plans.ranges import range_join
from ..session import cut_lineage

LITE = ["binary", "addr", "name", "size"]


def stats(functions: DataFrame) -> DataFrame:
    return functions.groupBy("binary").agg(
        F.count("*").alias("total"), F.count_if(N.is_named(F.col("name"))).alias("named"))


def edge_degrees(calls: DataFrame) -> DataFrame:
    """Distinct callers and callees of every function that has any edge.

    Both directions come from one pass over the edges: each edge is one row per end, so the
    partial aggregation shrinks hub functions before the shuffle.
    """
    edges = calls.select("binary", "caller_addr", "callee_addr").distinct()
    ends = edges.select("binary", F.explode(F.array(
        F.struct(F.col("caller_addr").alias("addr"), F.lit(0).alias("i"), F.lit(1).alias("o")),
        F.struct(F.col("callee_addr").alias("addr"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy("binary", F.col("e.addr").alias("addr")).agg(
        F.sum("e.i").alias("callers"), F.sum("e.o").alias("callees"))


def with_degrees(rows: DataFrame, calls: DataFrame) -> DataFrame:
    """Any rows keyed by (binary, addr) with their call degrees, zero included."""
    return (rows.join(edge_degrees(calls), ["binary", "addr"], "left")
            .withColumn("callers", F.coalesce("callers", F.lit(0)))
            .withColumn("callees", F.coalesce("callees", F.lit(0))))


def degrees(functions: DataFrame, calls: DataFrame) -> DataFrame:
    return with_degrees(functions.select("binary", "addr"), calls)


def search(functions: DataFrame, needle: str, limit: int = 20, binary: str | None = None,
           ci: bool = False) -> DataFrame:
    """Name substring search, lowest addresses first.  ``ci`` is the trimmed, case-blind filter."""
    rows = functions.select(*LITE)
    if binary is not None:
        rows = rows.filter(F.col("binary") == binary)
    if ci:
        text = needle.strip().lower()
        return rows.filter(F.lower("name").contains(text)) if text else rows
    return rows.filter(F.col("name").contains(needle)).orderBy("binary", "addr").limit(limit)


def _hop(calls: DataFrame, functions: DataFrame, from_col: str, to_col: str) -> DataFrame:
    out = functions.select("binary", F.col("addr").alias(to_col), "name", "size")
    return (calls.join(out, ["binary", to_col], "left")
            .select("binary", F.col(from_col).alias("func_addr"), F.col(to_col).alias("addr"), "name", "size"))


def callees(calls: DataFrame, functions: DataFrame) -> DataFrame:
    return _hop(calls, functions, "caller_addr", "callee_addr")


def callers(calls: DataFrame, functions: DataFrame) -> DataFrame:
    return _hop(calls, functions, "callee_addr", "caller_addr")


def get_function(functions: DataFrame, calls: DataFrame, wanted: DataFrame) -> DataFrame:
    """Records of the wanted (binary, addr) rows, one row per neighbour (relation caller / callee).

    Neighbours stay rows instead of one array per function, so asking for a hub is safe; a function
    without neighbours has one row with a null relation.
    """
    want = wanted.select("binary", "addr").distinct()

    def side(rows: DataFrame, relation: str) -> DataFrame:
        return (rows.join(want.withColumnRenamed("addr", "func_addr"), ["binary", "func_addr"], "left_semi")
                .select("binary", F.lit(relation).alias("relation"), F.col("func_addr").alias("addr"),
                        F.col("addr").alias("other_addr"), F.col("name").alias("other_name"),
                        F.col("size").alias("other_size")))

    near = side(callers(calls, functions), "caller").unionByName(side(callees(calls, functions), "callee"))
    return (functions.join(want, ["binary", "addr"], "left_semi").join(near, ["binary", "addr"], "left"))


def _packed_starts(starts: DataFrame) -> DataFrame:
    """(binary, start, word, bit): the starts of each binary numbered in the order of their addresses, 64 to a word."""
    numbered = blocks.dense_index(starts.select("binary", "start").distinct(), ["binary"], "start", "_i", sparse=True)
    return numbered.select("binary", "start", F.expr("(_i - 1) div 64").alias("word"), ((F.col("_i") - 1) % 64).cast("int").alias("bit"))


def _reach_sets(packed: DataFrame, calls: DataFrame, depth: int, cut_every: int = 2) -> DataFrame:
    """(binary, addr, word, bits): for each function the set of starts that reach it in 1..depth calls.

    A search from all starts at once.  A round sends the words of the functions reached last along their edges and ORs what meets, so it makes at most one
    row per edge and word, however many starts there are; bits that a function had before are not sent again.
    """
    edges = calls.select("binary", F.col("caller_addr").alias("addr"), F.col("callee_addr").alias("to"))
    key, bits = ["binary", "addr", "word"], F.bit_or("bits").alias("bits")
    frontier = packed.groupBy("binary", F.col("start").alias("addr"), "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    reached = None
    for hop in range(1, depth + 1):
        step = frontier.join(edges, ["binary", "addr"]).groupBy("binary", F.col("to").alias("addr"), "word").agg(bits)
        if reached is not None and hop < depth:
            old = reached.withColumnRenamed("bits", "old")
            fresh = step.join(old, key, "left").select(*key, F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("old", F.lit(0).cast("bigint")))).alias("bits")).filter("bits <> 0")
        else:
            fresh = step
        cut = hop % cut_every == 0 and hop < depth
        frontier = cut_lineage(fresh) if cut else fresh
        reached = frontier if reached is None else reached.unionByName(frontier).groupBy(*key).agg(bits)
        if cut:
            reached = cut_lineage(reached)
            if frontier.isEmpty():
                break
    return reached


def trace_chain(starts: DataFrame, calls: DataFrame, depth: int = 2) -> DataFrame:
    """Functions reachable in 1..depth calls from each start, distinct; a start on a cycle reaches itself.

    ``starts`` has (binary, start).  The search works on sets of starts; pairs are made from its result alone.
    """
    packed = _packed_starts(starts)
    pairs = _reach_sets(packed, calls, depth).select("binary", "addr", "word", F.explode(F.expr(
        "filter(sequence(0, 63), b -> shiftright(bits, b) & 1L = 1L)")).alias("bit"))
    return pairs.join(packed, ["binary", "word", "bit"]).select("binary", "start", "addr")


def reach_counts(starts: DataFrame, calls: DataFrame, depth: int = 2) -> DataFrame:
    """(binary, start, reach): number of functions that each start reaches; no pair of start and function is made."""
    packed = _packed_starts(starts)
    per_bit = F.array(*[F.sum(F.shiftright("bits", b).bitwiseAND(F.lit(1).cast("bigint"))) for b in range(64)])
    counts = _reach_sets(packed, calls, depth).groupBy("binary", "word").agg(per_bit.alias("n"))
    return packed.join(counts, ["binary", "word"], "left").select("binary", "start", F.coalesce(F.get("n", F.col("bit")), F.lit(0)).alias("reach"))


FUNCTION_KEYS, FUNCTION_DEFAULTS = ["binary", "addr"], {"size": 0, "pseudocode": "", "disasm": ""}


def function_rows(incoming: DataFrame, version: str) -> DataFrame:
    """The row of the highest version per function, every field set."""
    rows = tables.latest(incoming, FUNCTION_KEYS, version)
    return rows.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in FUNCTION_DEFAULTS.items() if c in rows.columns})


def upsert_functions(current: DataFrame, incoming: DataFrame, version: str) -> DataFrame:
    """Overwrite function rows by (binary, addr) with the incoming row of the highest ``version``.

    Every field is set: a missing size becomes 0, missing pseudocode or disassembly becomes ''.
    """
    rows = tables.latest(incoming, FUNCTION_KEYS, version).drop(version)
    return tables.overwrite(current, rows, FUNCTION_KEYS, FUNCTION_DEFAULTS)


def upsert_calls(functions: DataFrame, calls: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct union of edges; ends not yet known become functions without a name."""
    cols = ["binary", "caller_addr", "callee_addr"]
    edges = calls.select(*cols).unionByName(new_edges.select(*cols)).distinct()
    ends = new_edges.select("binary", F.explode(F.array("caller_addr", "callee_addr")).alias("addr")).distinct()
    missing = ends.join(functions.select("binary", "addr"), ["binary", "addr"], "left_anti")
    return functions.unionByName(missing, allowMissingColumns=True), edges


def register(registry: DataFrame, incoming: DataFrame) -> DataFrame:
    """Registry rows by tag; a missing path keeps the stored one."""
    return tables.merge(registry, incoming, ["tag"])


def delete_binary(frames: dict[str, DataFrame], tag: str) -> dict[str, DataFrame]:
    """Frames (functions, calls, binaries) without the binary."""
    return {k: df.filter(F.col("tag" if k == "binaries" else "binary") != tag) for k, df in frames.items()}


def rename(functions: DataFrame, updates: DataFrame) -> DataFrame:
    """Apply (binary, addr, new_name, version) renames; rows without a match are left out silently."""
    last = updates.groupBy("binary", "addr").agg(F.max_by("new_name", "version").alias("new_name"))
    cols = functions.columns
    return (functions.join(last, ["binary", "addr"], "left")
            .withColumn("name", F.coalesce("new_name", "name")).select(*cols))


def list_binaries(registry: DataFrame, functions: DataFrame) -> DataFrame:
    cov = stats(functions).withColumnRenamed("binary", "tag")
    return (registry.join(cov, "tag", "left")
            .withColumn("total", F.coalesce("total", F.lit(0)))
            .withColumn("named", F.coalesce("named", F.lit(0))))


def resolve_xrefs(xrefs: DataFrame, functions: DataFrame, direction: str) -> DataFrame:
    """Functions that contain the two ends of raw references (binary, from_addr, to_addr).

    callees: distinct (function of from, function of to), itself excluded.
    callers: distinct (function of to, function of from), itself kept; the referenced address is kept.
    """
    spans = functions.select("binary", "start", "end")
    refs = xrefs.select("binary", "from_addr", "to_addr").distinct()
    src = (range_join(refs, spans, ["binary"], "from_addr").drop("end")
           .withColumnRenamed("start", "from_func"))
    if direction == "callers":
        return src.select("binary", F.col("to_addr").alias("addr"), "from_func").distinct()
    pairs = src.select("binary", "from_func", "to_addr").distinct()
    both = range_join(pairs, spans, ["binary"], "to_addr").withColumnRenamed("start", "to_func")
    return both.filter("from_func <> to_func").select("binary", "from_func", "to_func").distinct()


def vtable_slots(pointers: DataFrame, functions: DataFrame) -> DataFrame:
    """Pointer-table slots (binary, table_addr, slot, target) whose target lies inside a function."""
    hit = range_join(pointers.filter("target <> 0"), functions.select("binary", "start", "end", "name"),
                     ["binary"], "target")
    return hit.select("binary", "table_addr", "slot", "target", F.col("name").alias("target_name"))


def rtti_symbols(symbols: DataFrame) -> DataFrame:
    return symbols.filter(N.is_rtti(F.col("name")))


def invert_calls(rows: DataFrame) -> DataFrame:
    """(binary, ea, callees array) -> (binary, ea, caller), one row per caller.

    Kept tall: a hub with a third of all callers must not become one array.
    """
    pairs = rows.select("binary", F.col("ea").alias("caller"), F.explode("callees").alias("ea")).distinct()
    return rows.select("binary", "ea").join(pairs, ["binary", "ea"], "left")


def with_id(functions: DataFrame) -> DataFrame:
    return functions.withColumn("id", A.function_id(F.col("binary"), F.col("addr")))


def with_disasm(functions: DataFrame, text: str = "disasm_json") -> DataFrame:
    """Decode the JSON listing; text that is no list becomes an empty array."""
    parsed = F.from_json(text, "array<struct<address:string,text:string>>")
    return functions.withColumn("disasm", F.coalesce(
        parsed, F.array().cast("array<struct<address:string,text:string>>"))).drop(text)


def by_size(functions: DataFrame) -> Window:
    return Window.partitionBy("binary").orderBy(F.desc("size"), "addr")
