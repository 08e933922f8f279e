"""Comparison of execution traces and memory effects, eligibility and verification reports."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import addr as A, names as N, text as T
from ..plans import blocks, tables

# Fixed values.
KIND_RANK = {"write": 0, "call": 1, "return": 2}
EVENT_NAMES = {"write": "MemoryWriteEvent", "call": "CallEvent", "return": "ReturnEvent"}
PAIR = ["pair_id"]


def _pick(col: Column, table: dict) -> Column:
    out = F
    for key, value in table.items():
        out = out.when(col == key, F.lit(value))
    return out.otherwise(F.lit(None))


def events(trace: DataFrame, keys: list[str]) -> DataFrame:
    """Position of each event in its trace: by order, writes before calls before returns on ties.

    Order numbers are unique per kind, so (order, kind) is a unique integer step.
    """
    step = F.col("ord").cast("bigint") * 3 + _pick(F.col("kind"), KIND_RANK)
    return (blocks.dense_index(trace.withColumn("_step", step), keys, "_step")
            .withColumn("idx", F.col("idx") - 1).drop("_step"))


def trace_summary(trace: DataFrame, keys: list[str]) -> DataFrame:
    k = F.col("kind")
    return trace.groupBy(*keys).agg(
        F.count_if(k == "write").alias("memory_writes"), F.count_if(k == "call").alias("calls"),
        F.count_if(k == "return").alias("returns"), F.count("*").alias("total_events"))


def base_map(original: DataFrame, recompiled: DataFrame) -> DataFrame:
    """Most frequent write page per side of each pair (earliest page on ties), kept where they differ."""
    def main(trace: DataFrame, name: str) -> DataFrame:
        pages = (trace.filter("kind = 'write'").groupBy("pair_id", A.page(F.col("addr")).alias("page"))
                 .agg(F.count("*").alias("n"), F.min("ord").alias("first")))
        return pages.groupBy("pair_id").agg(
            F.max(F.struct("n", (-F.col("first")).alias("o"), "page"))["page"].alias(name))
    return (main(original, "orig_base").join(main(recompiled, "new_base"), "pair_id")
            .filter("orig_base <> new_base"))


def normalize(trace: DataFrame, mapping: DataFrame) -> DataFrame:
    """Move write addresses inside the mapped page to the page it maps to."""
    cols = trace.columns
    inside = ((F.col("kind") == "write") & (F.col("addr") >= F.col("orig_base"))
              & (F.col("addr") < F.col("orig_base") + A.PAGE))
    return (trace.join(mapping, "pair_id", "left")
            .withColumn("addr", F.when(inside, F.col("addr") - F.col("orig_base") + F.col("new_base"))
                        .otherwise(F.col("addr"))).select(*cols))


def _close(x: Column, y: Column, tolerance: float) -> Column:
    if tolerance <= 0:
        return x.eqNullSafe(y)
    bound = F.greatest(F.abs(x), F.abs(y), F.lit(1))
    return F.coalesce(F.abs(x - y) / bound <= tolerance, F.lit(False))


def _describe(side: str) -> Column:
    c = lambda n: F.col(f"{side}_{n}")
    return (F.when(c("kind") == "write", F.concat(
                F.lit("write "), c("size").cast("string"), F.lit("B to "), A.hexify(c("addr")), F.lit(" = "),
                c("value").cast("string")))
            .when(c("kind") == "call", F.concat(F.lit("call "), A.hexify(c("target"))))
            .otherwise(F.concat(F.lit("return "), c("value").cast("string"))))


def compare_traces(original: DataFrame, recompiled: DataFrame, tolerance: float = 0.0,
                   auto_normalize: bool = True) -> DataFrame:
    """First divergence of each pair of traces, positions counted from 0.

    The traces are joined position by position on (pair, position), so one huge trace spreads over
    the cluster like many small ones.
    """
    if auto_normalize:
        mapping = base_map(original, recompiled)
        original, recompiled = normalize(original, mapping), normalize(recompiled, mapping)
    fields = ["kind", "addr", "size", "value", "target"]
    def side(trace: DataFrame, name: str) -> DataFrame:
        return events(trace, PAIR).select("pair_id", "idx", *[F.col(f).alias(f"{name}_{f}") for f in fields])
    j = side(original, "o").join(side(recompiled, "r"), ["pair_id", "idx"], "full_outer")
    o, r = F.col("o_kind"), F.col("r_kind")
    same = (F.when(o.isNull() | r.isNull() | (o != r), False)
            .when(o == "write", _close(F.col("o_addr"), F.col("r_addr"), tolerance)
                  & _close(F.col("o_value"), F.col("r_value"), tolerance))
            .when(o == "call", F.col("o_target").eqNullSafe(F.col("r_target")))
            .otherwise(_close(F.col("o_value"), F.col("r_value"), tolerance)))
    expected = (F.when(o.isNull(), "no event").when(r.isNull(), _pick(o, EVENT_NAMES)).otherwise(_describe("o")))
    actual = (F.when(r.isNull(), "no event").when(o.isNull(), _pick(r, EVENT_NAMES)).otherwise(_describe("r")))
    rows = j.select("pair_id", "idx", same.alias("same"),
                    F.when(~same, F.struct("idx", expected.alias("e"), actual.alias("a"))).alias("bad"))
    out = rows.groupBy("pair_id").agg(F.min("bad").alias("bad"), F.max("idx").alias("last"))
    first = F.coalesce(F.col("bad.idx"), F.lit(-1))
    last = F.when(F.col("bad").isNull(), F.col("last")).otherwise(first - 1)
    return out.select(
        "pair_id", F.col("bad").isNull().alias("equivalent"), first.alias("first_divergent_event"),
        last.alias("last_matching_event"), F.coalesce("bad.e", F.lit("")).alias("expected"),
        F.coalesce("bad.a", F.lit("")).alias("actual"),
        F.when(F.col("bad").isNull(), "All events matched").otherwise(F.concat(
            F.lit("Matched "), (last + 1).cast("string"), F.lit(" events, diverged at event "),
            first.cast("string"))).alias("details"))


def write_pairs(original: DataFrame, recompiled: DataFrame) -> DataFrame:
    """Last value written per address on both sides, side by side; rows (pair_id, addr, ord, value)."""
    def final(t: DataFrame, name: str) -> DataFrame:
        return t.groupBy("pair_id", "addr").agg(F.max_by("value", "ord").alias(name))
    return final(original, "expected").join(final(recompiled, "actual"), ["pair_id", "addr"], "full_outer")


def divergent_writes(original: DataFrame, recompiled: DataFrame) -> DataFrame:
    return (write_pairs(original, recompiled).filter(~F.col("expected").eqNullSafe(F.col("actual")))
            .withColumn("address", A.hexify(F.col("addr"))))


def compare_writes(original: DataFrame, recompiled: DataFrame, returns: DataFrame,
                   tolerance: float = 0.0) -> DataFrame:
    """Memory-effect report per pair; ``returns`` has (pair_id, ret_original, ret_recompiled)."""
    rows = write_pairs(original, recompiled)
    same = F.col("expected").eqNullSafe(F.col("actual"))
    both = F.col("expected").isNotNull() & F.col("actual").isNotNull()
    near = same | ~both | _close(F.col("expected"), F.col("actual"), tolerance)
    agg = rows.groupBy("pair_id").agg(
        F.count_if(same).alias("matching_writes"), F.count_if(~same).alias("divergent_writes"),
        F.bool_and(near).alias("_near"))
    out = returns.join(agg, "pair_id", "left").withColumns({
        "matching_writes": F.coalesce("matching_writes", F.lit(0)),
        "divergent_writes": F.coalesce("divergent_writes", F.lit(0)),
        "_near": F.coalesce("_near", F.lit(True)),
        "return_match": F.col("ret_original").eqNullSafe(F.col("ret_recompiled"))})
    total = F.col("matching_writes") + F.col("divergent_writes")
    clean = F.col("divergent_writes") == 0
    tolerated = F.col("_near") if tolerance > 0 else F.lit(False)
    return out.select(
        "pair_id", (F.col("return_match") & (clean | tolerated)).alias("equivalent"), "return_match",
        "matching_writes", "divergent_writes",
        (F.col("matching_writes") / F.greatest(F.lit(1), total)).alias("write_match_ratio"))


def compare_runs(original: DataFrame, recompiled: DataFrame, returns: DataFrame,
                 tolerance: float = 0.1) -> DataFrame:
    """Return value and sorted final values of two runs, compared with tolerance.

    An address counts with the value written last (by ``ord``).
    Sorted values are not gathered: equal values fill a stretch of positions on either side, so the
    number of equal positions is the overlap of these stretches, summed over values.
    """
    def counted(t: DataFrame, name: str) -> DataFrame:
        last = t.groupBy("pair_id", "addr").agg(F.max_by("value", "ord").alias("value"))
        return last.groupBy("pair_id", "value").agg(F.count("*").alias(name))
    both = (counted(original, "no").join(counted(recompiled, "nr"), ["pair_id", "value"], "full_outer")
            .withColumns({"no": F.coalesce("no", F.lit(0)), "nr": F.coalesce("nr", F.lit(0))}))
    ends = blocks.running_sums(both, PAIR, "value", {"eo": F.col("no"), "er": F.col("nr")}, sparse=True)
    overlap = F.greatest(F.lit(0), F.least("eo", "er") - F.greatest(F.col("eo") - F.col("no"), F.col("er") - F.col("nr")))
    mem = ends.groupBy("pair_id").agg(F.sum(overlap).alias("hits"), F.sum("no").alias("writes_original"),
                                      F.sum("nr").alias("writes_recompiled"))
    j = returns.join(mem, "pair_id", "left").fillna(0, ["hits", "writes_original", "writes_recompiled"])
    n, m, hits = F.col("writes_original"), F.col("writes_recompiled"), F.col("hits")
    ret = (_close(F.col("ret_original"), F.col("ret_recompiled"), tolerance)
           | F.col("ret_original").eqNullSafe(F.col("ret_recompiled")))
    equal = (n == m) & (hits == n)
    mem_ok = equal if tolerance <= 0 else equal | (hits / F.greatest(F.lit(1), n) >= 1.0 - tolerance)
    ratio = F.when((n == 0) & (m == 0), 1.0).otherwise(hits / F.greatest(F.lit(1), n, m))
    fallback = (F.when(ret, 1.0).otherwise(0.0) + ratio) / 2 >= 1.0 - tolerance
    ok = (ret & mem_ok) if tolerance <= 0 else (ret & mem_ok) | fallback
    def word(c: Column) -> Column:
        return F.when(c, "match").otherwise("MISMATCH")
    details = F.concat(
        F.lit("return: "), F.col("ret_original").cast("string"), F.lit(" vs "), F.col("ret_recompiled").cast("string"),
        F.lit(" ("), word(ret), F.lit("), memory: "), n.cast("string"), F.lit(" vs "), m.cast("string"),
        F.lit(" ("), word(mem_ok), F.lit(")"))
    return j.select("pair_id", ok.alias("equivalent"), ret.alias("return_match"), mem_ok.alias("memory_match"),
                    F.when(ok, "equivalent").otherwise(details).alias("reason"), details.alias("details"))


def one_decimal(value: Column) -> Column:
    """Text with one decimal, exact ties to even."""
    return F.format_string("%.1f", F.bround(value.cast("double"), 1))


def sample(functions: DataFrame, n: int = 50) -> DataFrame:
    """Functions with pseudocode, shortest text first."""
    return (functions.filter(F.coalesce("pseudocode", F.lit("")) != "")
            .orderBy(F.length("pseudocode"), "binary", "addr").limit(n))


def eligibility_rate(functions: DataFrame, sample_size: int = 20) -> DataFrame:
    """Share of eligible functions among the smallest ``3 * sample_size`` of each binary."""
    w = Window.partitionBy("binary").orderBy("size", "addr")
    small = (functions.filter(F.col("pseudocode").isNotNull()).withColumn("_r", F.row_number().over(w))
             .filter(F.col("_r") <= 3 * sample_size))
    out = small.groupBy("binary").agg(F.count("*").alias("total_checked"),
                                      F.count_if(T.eligible(F.col("pseudocode"))).alias("oracle_eligible"))
    return out.withColumn("eligibility_rate", F.concat(one_decimal(
        100.0 * F.col("oracle_eligible") / F.greatest(F.lit(1), "total_checked")), F.lit("%")))


def report(attempts: DataFrame) -> DataFrame:
    """Counts and text report per binary from rows (binary, eligible, verified, compiled, elapsed_s).

    ``compile_fail`` keeps its customary name but counts what compiled without verifying.
    """
    e, v = F.col("eligible"), F.col("verified")
    out = attempts.groupBy("binary").agg(
        F.count("*").alias("total"), F.count_if(e).alias("oracle_eligible"), F.count_if(e & v).alias("verified"),
        F.count_if(e & ~v & F.col("compiled")).alias("compile_fail"), F.count_if(~e).alias("not_eligible"),
        F.sum("elapsed_s").alias("elapsed_s"))
    def share(n: str, d: str) -> Column:
        return one_decimal(100.0 * F.col(n) / F.greatest(F.lit(1), d))
    return out.withColumn("report", F.concat_ws(
        "\n", F.lit("=== Verified Decompilation Report ==="), F.concat(F.lit("Binary: "), F.col("binary")),
        F.concat(F.lit("Total functions: "), F.col("total").cast("string")), F.lit(""),
        F.concat(F.lit("Oracle-eligible: "), F.col("oracle_eligible").cast("string"), F.lit(" ("),
                 share("oracle_eligible", "total"), F.lit("%)")),
        F.concat(F.lit("Verified: "), F.col("verified").cast("string"), F.lit(" ("),
                 share("verified", "oracle_eligible"), F.lit("% of eligible)")),
        F.concat(F.lit("Compile fail: "), F.col("compile_fail").cast("string")),
        F.concat(F.lit("Not eligible: "), F.col("not_eligible").cast("string")), F.lit(""),
        F.concat(F.lit("Time: "), one_decimal(F.col("elapsed_s")), F.lit("s"))))


def cache_put(cache: DataFrame, incoming: DataFrame) -> DataFrame:
    """Replace cached sources by MD5 of the code bytes; rows (code_bytes, c_code, func_name, verified_at)."""
    rows = incoming.select(F.md5("code_bytes").alias("code_hash"), "c_code", "func_name", "verified_at")
    both = cache.select("code_hash", "c_code", "func_name", "verified_at").unionByName(rows)
    return tables.latest(both, ["code_hash"], "verified_at")


def cache_get(cache: DataFrame, functions: DataFrame) -> DataFrame:
    """Cached source per function, looked up by the MD5 of its bytes."""
    return (functions.withColumn("code_hash", F.md5("code_bytes"))
            .join(cache.select("code_hash", "c_code"), "code_hash", "left"))


def stubs(externals: DataFrame, symbols: DataFrame) -> DataFrame:
    """Stub declaration per distinct external symbol, with its size where the dictionary knows it."""
    j = externals.select("symbol").distinct().join(symbols.select("symbol", "size"), "symbol", "left")
    note = (F.when(F.col("size").isNull(), F.concat(F.lit("// Stub for "), F.col("symbol")))
            .when(F.col("size") > 0, F.concat(F.lit("// "), F.col("symbol"), F.lit(" (size: "),
                                              F.col("size").cast("string"), F.lit(" bytes)")))
            .otherwise(F.concat(F.lit("// "), F.col("symbol"))))
    clean = F.replace(F.col("symbol"), F.lit("::"), F.lit("_"))
    return j.select("symbol", F.concat(note, F.lit("\nlong long "), clean,
                                       F.lit("(long long* args) { return 0; }")).alias("stub"))


def safe_names(functions: DataFrame) -> DataFrame:
    return functions.withColumn("file", F.concat(N.safe_file_name(F.col("name")), F.lit(".c")))
