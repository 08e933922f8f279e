"""Call graph, context, knowledge and naming queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import addr as A, names as N
from ...operators import context, graph, knowledge, naming
from ...sources import export
from ...session import cut_lineage
from .. import tables
from ._register import Catalog

QUERIES = Catalog()
q = QUERIES.query

NAMED = "name IS NOT NULL AND NOT starts_with(name, 'sub_')"
CTX_NAMED = "coalesce(name, '') <> '' AND NOT starts_with(lower(name), 'sub_')"
DEGREES = """(SELECT f.binary, f.addr, coalesce(i.n, 0) AS callers, coalesce(o.n, 0) AS callees FROM functions f
    LEFT JOIN (SELECT binary, callee_addr AS addr, count(*) AS n FROM calls GROUP BY ALL) i USING (binary, addr)
    LEFT JOIN (SELECT binary, caller_addr AS addr, count(*) AS n FROM calls GROUP BY ALL) o USING (binary, addr))"""
REACH = """reach AS (SELECT DISTINCT * FROM (
    SELECT binary, caller_addr AS start, callee_addr AS addr FROM calls
    UNION ALL SELECT a.binary, a.caller_addr, b.callee_addr FROM calls a
        JOIN calls b ON a.binary = b.binary AND a.callee_addr = b.caller_addr))"""


@q("functions", f"SELECT binary, count(*) AS total, count(*) FILTER ({NAMED}) AS named FROM functions GROUP BY binary")
def graph_stats(t):
    return graph.stats(t.lean())


@q("functions calls", f"SELECT binary, addr, callers, callees FROM {DEGREES}")
def graph_degrees(t):
    return graph.degrees(t.lean(), t.calls())


@q("functions calls", f"""SELECT d.binary, d.addr, f.name, d.callers, d.callees, coalesce(r.n, 0) AS reach, {NAMED} AS is_named
    FROM {DEGREES} d JOIN functions f USING (binary, addr)
    LEFT JOIN (SELECT binary, start AS addr, count(*) AS n FROM reach GROUP BY ALL) r USING (binary, addr)""", REACH)
def function_overview(t):
    fns, calls = t.lean(), t.calls()
    starts = fns.select("binary", F.col("addr").alias("start"))
    reach = graph.reach_counts(starts, calls, 2).withColumnRenamed("start", "addr")
    return (graph.degrees(fns, calls).join(fns, ["binary", "addr"]).join(reach, ["binary", "addr"], "left")
            .select("binary", "addr", "name", "callers", "callees", F.coalesce("reach", F.lit(0)).alias("reach"),
                    N.is_named(F.col("name")).alias("is_named")))


@q("functions calls", "SELECT * FROM reach", REACH)
def graph_trace_chain(t):
    return graph.trace_chain(t.lean().select("binary", F.col("addr").alias("start")), t.calls(), 2)


@q("functions", """SELECT binary, addr, name, size FROM functions WHERE contains(name, 'ring')
    ORDER BY binary, addr LIMIT 20""")
def graph_search(t):
    return graph.search(t.lean(), "ring", 20)


@q("functions", "SELECT binary, addr, name, size FROM functions WHERE contains(lower(name), 'ring')")
def graph_search_ci(t):
    return graph.search(t.lean(), " RinG ", ci=True)


@q("functions calls", """SELECT c.binary, c.caller_addr AS func_addr, f.addr, f.name, f.size FROM calls c
    JOIN functions f ON f.binary = c.binary AND f.addr = c.callee_addr""")
def graph_callees(t):
    return graph.callees(t.calls(), t.lean())


@q("functions calls", """SELECT c.binary, c.callee_addr AS func_addr, f.addr, f.name, f.size FROM calls c
    JOIN functions f ON f.binary = c.binary AND f.addr = c.caller_addr""")
def graph_callers(t):
    return graph.callers(t.calls(), t.lean())


@q("functions calls", """SELECT f.binary, f.addr, f.name, f.size, f.pseudocode, n.relation, n.addr AS other_addr,
    n.name AS other_name, n.size AS other_size FROM functions f LEFT JOIN (
        SELECT c.binary, caller_addr AS func, 'callee' AS relation, g.addr, g.name, g.size FROM calls c
            JOIN functions g ON g.binary = c.binary AND g.addr = c.callee_addr
        UNION ALL SELECT c.binary, callee_addr, 'caller', g.addr, g.name, g.size FROM calls c
            JOIN functions g ON g.binary = c.binary AND g.addr = c.caller_addr) n
        ON n.binary = f.binary AND n.func = f.addr""")
def graph_get_function(t):
    return graph.get_function(t.functions(), t.calls(), t.lean())


@q("functions", """SELECT binary, addr, CASE WHEN addr % 5 = 0 THEN 'new_' || addr ELSE name END AS name,
        CASE WHEN addr % 5 <> 0 THEN size WHEN addr % 10 <> 0 THEN 1 ELSE 0 END AS size FROM functions
    UNION ALL SELECT binary, -addr - 1, 'added', 0 FROM functions WHERE addr % 100 = 0""")
def graph_upsert_functions(t):
    fns = t.lean()
    changed = fns.filter("addr % 5 = 0").select(
        "binary", "addr", F.concat(F.lit("new_"), F.col("addr").cast("string")).alias("name"),
        F.when(F.col("addr") % 10 != 0, F.lit(1).cast("bigint")).alias("size"), F.lit(2).alias("v"))
    stale = changed.withColumn("name", F.lit("stale")).withColumn("v", F.lit(1))
    added = fns.filter("addr % 100 = 0").select("binary", (-F.col("addr") - 1).alias("addr"), F.lit("added").alias("name"),
                                                F.lit(None).cast("bigint").alias("size"), F.lit(1).alias("v"))
    return graph.upsert_functions(fns, stale.unionByName(changed).unionByName(added), "v")


@q("functions calls", """SELECT binary, addr, name FROM functions
    UNION ALL SELECT DISTINCT binary, callee_addr + 1000000000, CAST(NULL AS VARCHAR) FROM calls WHERE caller_addr % 2 = 0""")
def graph_upsert_calls_functions(t):
    fns, calls = t.lean(), t.calls()
    new = calls.filter("caller_addr % 2 = 0").withColumn("callee_addr", F.col("callee_addr") + 1000000000)
    return graph.upsert_calls(fns.select("binary", "addr", "name"), calls, new)[0]


@q("functions calls", """SELECT binary, caller_addr, callee_addr FROM calls UNION SELECT binary, caller_addr, caller_addr
    FROM calls""")
def graph_upsert_calls_edges(t):
    calls = t.calls()
    return graph.upsert_calls(t.lean().select("binary", "addr"), calls, calls.withColumn("callee_addr", F.col("caller_addr")))[1]


@q("functions", "SELECT binary, addr, name, size FROM functions WHERE binary <> 'Brand#1'")
def graph_delete_binary(t):
    return graph.delete_binary({"functions": t.lean()}, "Brand#1")["functions"]


@q("functions", """SELECT DISTINCT binary AS tag, CASE WHEN binary IN ('Brand#1', 'Brand#2') THEN 'new.db' ELSE binary || '.db' END
    AS db_path, binary || '.bin' AS binary_path FROM functions""")
def graph_register(t):
    tag = t.read("part").select(F.col("p_brand").alias("tag")).distinct()
    old = tag.select("tag", F.concat("tag", F.lit(".db")).alias("db_path"), F.concat("tag", F.lit(".bin")).alias("binary_path"))
    new = tag.filter(F.col("tag").isin("Brand#1", "Brand#2")).select(
        "tag", F.lit("new.db").alias("db_path"), F.lit(None).cast("string").alias("binary_path"))
    return graph.register(old, new)


@q("functions", f"""SELECT binary AS tag, binary || '.db' AS db_path, count(*) AS total, count(*) FILTER ({NAMED}) AS named
    FROM functions GROUP BY binary""")
def graph_list_binaries(t):
    tag = t.read("part").select(F.col("p_brand").alias("tag")).distinct()
    return graph.list_binaries(tag.withColumn("db_path", F.concat("tag", F.lit(".db"))), t.lean())


@q("functions", """SELECT binary, addr, CASE WHEN addr % 4 = 0 THEN 'second' ELSE name END AS name, size FROM functions""")
def graph_rename(t):
    fns = t.lean()
    some = fns.filter("addr % 4 = 0").select("binary", "addr")
    gone = fns.select("binary", (-F.col("addr") - 1).alias("addr"))
    updates = (some.withColumns({"new_name": F.lit("first"), "version": F.lit(1)})
               .unionByName(some.withColumns({"new_name": F.lit("second"), "version": F.lit(2)}))
               .unionByName(gone.withColumns({"new_name": F.lit("nobody"), "version": F.lit(1)})))
    return graph.rename(fns, updates)


XREF = """SELECT DISTINCT x.binary, a.start AS from_func, b.start AS to_func FROM xrefs x
    JOIN spans a ON a.binary = x.binary AND from_addr >= a.start AND from_addr < a.fin
    JOIN spans b ON b.binary = x.binary AND to_addr >= b.start AND to_addr < b.fin WHERE a.start <> b.start"""


@q("spans xrefs", XREF)
def graph_resolve_callees(t):
    return graph.resolve_xrefs(t.xrefs(), t.spans(), "callees")


@q("spans xrefs", """SELECT DISTINCT x.binary, to_addr AS addr, a.start AS from_func FROM xrefs x
    JOIN spans a ON a.binary = x.binary AND from_addr >= a.start AND from_addr < a.fin""")
def graph_resolve_callers(t):
    return graph.resolve_xrefs(t.xrefs(), t.spans(), "callers")


@q("spans xrefs", """SELECT x.binary, x.from_addr AS slot, x.to_addr AS target, s.name AS target_name FROM xrefs x
    JOIN spans s ON s.binary = x.binary AND to_addr >= s.start AND to_addr < s.fin WHERE to_addr <> 0""")
def graph_vtable_slots(t):
    ptr = t.xrefs().select("binary", F.lit(0).alias("table_addr"), F.col("from_addr").alias("slot"), F.col("to_addr").alias("target"))
    return graph.vtable_slots(ptr, t.spans()).drop("table_addr")


@q("functions", """SELECT * FROM (SELECT addr, CASE addr % 4 WHEN 0 THEN '_ZTV' || addr WHEN 1 THEN 'my_VTable' WHEN 2 THEN 'x_rtti'
    ELSE '_ZTX' END AS name FROM functions) WHERE contains(name, '_ZTV') OR contains(lower(name), 'vtable') OR contains(lower(name), 'rtti')""")
def graph_rtti_symbols(t):
    n = (F.when(F.col("addr") % 4 == 0, F.concat(F.lit("_ZTV"), F.col("addr").cast("string")))
         .when(F.col("addr") % 4 == 1, "my_VTable").when(F.col("addr") % 4 == 2, "x_rtti").otherwise("_ZTX"))
    return graph.rtti_symbols(t.lean().select("addr", n.alias("name")))


@q("functions calls", """SELECT f.binary, f.addr AS ea, c.caller_addr AS caller FROM functions f LEFT JOIN calls c
    ON c.binary = f.binary AND c.callee_addr = f.addr""")
def graph_invert_calls(t):
    lists = (t.calls().groupBy("binary", F.col("caller_addr").alias("ea")).agg(F.collect_list("callee_addr").alias("callees")))
    rows = t.lean().select("binary", F.col("addr").alias("ea")).join(lists, ["binary", "ea"], "left").withColumn(
        "callees", F.coalesce("callees", F.array().cast("array<bigint>")))
    return graph.invert_calls(rows)


@q("functions", """SELECT addr, printf('%x', addr) AS d, CASE WHEN addr % 2 = 0 THEN addr ELSE addr END AS a, addr // 4096 * 4096 AS page,
    addr % 2 = 1 AS thumb, addr // 2 * 2 AS even, addr // 2 * 2 + 1 AS odd FROM functions""")
def addr_columns(t):
    a = F.col("addr")
    text = F.when(a % 2 == 0, A.hexify(a)).otherwise(a.cast("string"))
    return t.lean().select("addr", F.substring(A.hexify(a), 3, 20).alias("d"), A.parse(text).alias("a"), A.page(a).alias("page"),
                           A.is_thumb(a).alias("thumb"), A.strip_mode(a).alias("even"), A.thumb(a).alias("odd"))


PREDICATES = """SELECT binary, addr, {n} AS named, name <> '' AND NOT starts_with(name, 'sub_') AS strict,
    NOT starts_with(lower(name), 'sub_') AS ctx, NOT regexp_matches(name, '^(sub_|j_|nullsub_)') AS display,
    NOT regexp_matches(name, '^(sub_|j_)') AS merged, regexp_matches(lower(name), '^(sub_|dword_|off_|loc_|unk_|byte_)') AS noise,
    CASE WHEN size <= 0 THEN '' WHEN size < 512 THEN size || 'b' ELSE (size // 512) || 'h' END AS label FROM functions"""


@q("functions", PREDICATES.format(n=NAMED))
def name_predicates(t):
    n, s = F.col("name"), F.col("size")
    label = F.when(s <= 0, "").when(s < 512, N.size_label(s)).otherwise(
        F.concat(F.floor(s / 512).cast("string"), F.lit("h")))
    return t.lean().select("binary", "addr", N.is_named(n).alias("named"), N.is_named(n, "strict").alias("strict"),
                           N.is_named(n, "context").alias("ctx"), N.is_named(n, "display").alias("display"),
                           N.is_named(n, "merge").alias("merged"), N.is_noise(n).alias("noise"), label.alias("label"))


@q("", """SELECT s_suppkey, CASE WHEN v <= 0 THEN '' WHEN v < 1024 THEN v || 'b' ELSE (v // 1024) || 'kb' END AS label
    FROM (SELECT s_suppkey, s_suppkey * 97 - 100 AS v FROM supplier)""")
def size_labels(t):
    return t.read("supplier").select("s_suppkey", N.size_label(F.col("s_suppkey") * 97 - 100).alias("label"))


@q("functions", """SELECT binary, addr, CASE WHEN n2 <> '' AND NOT starts_with(name, 'sub_') THEN 'high' WHEN n2 <> '' THEN 'medium'
    ELSE 'low' END AS confidence FROM (SELECT *, CASE WHEN addr % 2 = 0 THEN 'x' ELSE '' END AS n2 FROM functions)""")
def name_confidence(t):
    return t.lean().select("binary", "addr", N.confidence(F.col("name"), F.when(F.col("addr") % 2 == 0, "x").otherwise("")).alias("confidence"))


@q("functions", """SELECT binary, addr, starts_with(lower(name), 'sub_') AND size >= 400 AS needs_naming FROM functions
    ORDER BY binary, addr LIMIT 500 OFFSET 10""")
def naming_targets(t):
    return naming.targets(t.lean(), skip=10, limit=500, min_size=400).select("binary", "addr", "needs_naming")


@q("functions", """SELECT binary, addr, md5('7:' || binary || ':' || addr) AS shuffle_key FROM functions""")
def naming_seeded_order(t):
    return naming.seeded_order(t.lean(), "7").select("binary", "addr", "shuffle_key")


MANGLED = "(SELECT *, CASE addr % 3 WHEN 0 THEN '_ZN' || (addr % 50) WHEN 1 THEN '?q' || (addr % 50) ELSE 'plain' END AS m FROM functions)"


@q("functions", f"""SELECT binary, addr, CASE WHEN m <> 'plain' AND addr % 50 < 40 THEN 'readable_' || m ELSE m END AS name,
    m <> 'plain' AND addr % 50 < 40 AS demangled FROM {MANGLED}""")
def naming_apply_dictionary(t):
    a = F.col("addr")
    k = (a % 50).cast("string")
    m = F.when(a % 3 == 0, F.concat(F.lit("_ZN"), k)).when(a % 3 == 1, F.concat(F.lit("?q"), k)).otherwise("plain")
    rows = t.lean().select("binary", "addr", m.alias("name"))
    words = rows.filter(N.mangled(F.col("name")) & (F.col("addr") % 50 < 40)).select(
        F.col("name").alias("mangled"), F.concat(F.lit("readable_"), "name").alias("readable")).distinct()
    return naming.apply_dictionary(rows, words)


@q("functions", """SELECT binary, count(*) AS total_functions, count(*) FILTER (named) AS named, count(*) FILTER (NOT named) AS unnamed,
    round_even(100.0 * count(*) FILTER (named) / count(*), 1) AS coverage_pct, count(*) FILTER (picked) AS sample_size,
    count(*) FILTER (picked AND named) AS sample_named, count(*) FILTER (picked AND NOT named) AS sample_unnamed
    FROM (SELECT *, (rn % greatest(1, n // 10)) = 0 AND rn // greatest(1, n // 10) < 10 AS picked FROM (
        SELECT binary, NOT starts_with(name, 'sub_') AS named, count(*) OVER (PARTITION BY binary) AS n,
        row_number() OVER (PARTITION BY binary ORDER BY size DESC, addr) - 1 AS rn FROM functions)) GROUP BY binary""")
def naming_baseline(t):
    return naming.baseline(t.lean(), 10)


PASSES = """(SELECT binary, addr, starts_with(name, 'sub_') AS needs, addr % 5 = 0 AS demangled,
    CASE WHEN addr % 2 = 0 THEN 'a' ELSE '' END AS p1, CASE addr % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE '' END AS p2 FROM functions)"""


@q("functions", f"""SELECT binary, count(*) AS total, count(*) FILTER (needs) AS attempted, count(*) FILTER (needs AND p1 <> '') AS named,
    count(*) FILTER (demangled) AS demangled, count(*) FILTER (needs AND p2 <> '' AND p2 <> p1) AS renamed_pass2
    FROM {PASSES} GROUP BY binary""")
def naming_pass_summary(t):
    a = F.col("addr")
    return naming.pass_summary(t.lean().select(
        "binary", F.col("name").startswith("sub_").alias("needs_naming"), (a % 5 == 0).alias("demangled"),
        F.when(a % 2 == 0, "a").otherwise("").alias("pass1_name"),
        F.when(a % 3 == 0, "a").when(a % 3 == 1, "b").otherwise("").alias("pass2_name")))


@q("functions", f"SELECT binary, addr, 2 AS pass, p1 AS old_name, p2 AS new_name FROM {PASSES} WHERE p2 <> '' AND p1 <> p2")
def naming_pass_diff(t):
    a = F.col("addr")
    one = t.lean().select("binary", "addr", F.lit(1).alias("pass"), F.when(a % 2 == 0, "a").otherwise("").alias("name"))
    two = t.lean().select("binary", "addr", F.lit(2).alias("pass"),
                          F.when(a % 3 == 0, "a").when(a % 3 == 1, "b").otherwise("").alias("name"))
    return naming.pass_diff(one.unionByName(two))


@q("functions", """SELECT binary, count(*) FILTER (starts_with(name, 'sub_')) AS count_before,
    count(*) FILTER (starts_with(name, 'sub_') AND addr % 2 = 0) AS count_after,
    count(*) FILTER (starts_with(name, 'sub_') AND addr % 2 = 1) AS renamed FROM functions GROUP BY binary""")
def naming_delta(t):
    before = t.lean()
    return naming.delta(before, before.withColumn("name", F.when(F.col("addr") % 2 == 1, "named").otherwise(F.col("name"))))


@q("functions", """SELECT binary, addr, name, size, pos FROM (SELECT *, CAST(row_number() OVER (PARTITION BY binary ORDER BY g,
    CASE WHEN g = 2 THEN -size ELSE 0 END, addr) AS INT) AS pos FROM (SELECT *, CASE WHEN addr % 40 = 0 THEN 0
    WHEN NOT starts_with(lower(name), 'sub_') THEN 1 ELSE 2 END AS g FROM functions)) WHERE pos <= 60""")
def naming_overview_sample(t):
    return naming.overview_sample(t.lean(), 60, t.lean().filter("addr % 40 = 0"))


# column names in the SQL are quoted word by word, so the word in the text is split
@q("functions", """SELECT binary, 'Here are up to ' || shown || ' functions from a bin' || 'ary (' || format('{:,}', total) || ' total functions):' || chr(10) || chr(10)
    || ctx || chr(10) || chr(10) || 'Based on these function names and sizes:' || chr(10) || '1. What does this bin' || 'ary likely do? (2-3 sentences)'
    || chr(10) || '2. What are its major subsystems or components?' || chr(10) || '3. Anything security-relevant, unusual, or interesting?'
    || chr(10) || chr(10) || 'Be concise and specific. If function names are mostly sub_*, say so and give your best guess from patterns you can see.' AS prompt FROM (
    SELECT binary, count(*) AS shown, any_value(total) AS total, string_agg('  ' || name || '  (' || size || ' bytes)', chr(10) ORDER BY pos) AS ctx
    FROM (SELECT *, count(*) OVER (PARTITION BY binary) AS total, row_number() OVER (PARTITION BY binary ORDER BY g,
        CASE WHEN g = 2 THEN -size ELSE 0 END, addr) AS pos FROM (SELECT *, CASE WHEN NOT starts_with(lower(name), 'sub_') THEN 1 ELSE 2 END AS g
        FROM functions)) WHERE pos <= 60 GROUP BY binary)""")
def naming_overview_prompt(t):
    return naming.overview_prompt(naming.overview_sample(t.lean(), 60), graph.stats(t.lean()))


# ranked neighbours: two levels; a via is expanded while fewer than 30 results exist
NEIGHBORS = """e AS (SELECT binary, {src} AS a, {dst} AS b FROM calls WHERE {src} <> {dst}),
h1 AS (SELECT e.binary, e.a AS start, e.b AS addr, row_number() OVER (PARTITION BY e.binary, e.a ORDER BY e.b) AS ord FROM e),
n1 AS (SELECT binary, start, count(*) AS n FROM h1 GROUP BY ALL),
c2 AS (SELECT h1.binary, h1.start, e.b AS addr, min(h1.ord) AS via FROM h1
    JOIN functions f ON f.binary = h1.binary AND f.addr = h1.addr AND """ + CTX_NAMED.replace("name", "f.name") + """
    JOIN e ON e.binary = h1.binary AND e.a = h1.addr WHERE e.b <> h1.start
    AND NOT EXISTS (SELECT 1 FROM h1 x WHERE x.binary = h1.binary AND x.start = h1.start AND x.addr = e.b) GROUP BY ALL),
v2 AS (SELECT binary, start, via, n + coalesce(sum(k) OVER (PARTITION BY binary, start ORDER BY via
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT c2.binary, c2.start, via, any_value(n) AS n, count(*) AS k
    FROM c2 JOIN n1 USING (binary, start) GROUP BY ALL)),
g AS (SELECT binary, start, addr, 1 AS hops, 0 AS via FROM h1 UNION ALL SELECT binary, start, addr, 2, via FROM c2
    JOIN v2 USING (binary, start, via) WHERE before < 30),
nb AS (SELECT * FROM (SELECT g.binary, g.start, g.addr, coalesce(nullif(f.name, ''), 'sub_' || printf('%x', g.addr)) AS name, g.hops,
    """ + CTX_NAMED.replace("name", "f.name") + """ AS is_named,
    CAST(row_number() OVER (PARTITION BY g.binary, g.start ORDER BY (""" + CTX_NAMED.replace("name", "f.name") + """) DESC, g.hops, g.via, g.addr) AS INT) AS rank
    FROM g LEFT JOIN functions f ON f.binary = g.binary AND f.addr = g.addr) WHERE rank <= 10)"""
OUT = "SELECT binary, start, addr, name, '{rel}' AS relation, hops, is_named, rank FROM nb"


def _starts(t):
    return t.lean().select("binary", F.col("addr").alias("start"))


@q("functions calls", OUT.format(rel="callee"), NEIGHBORS.format(src="caller_addr", dst="callee_addr"))
def context_callees(t):
    return context.neighbors(_starts(t), cut_lineage(t.calls()), t.lean(), "callees")


@q("functions calls", OUT.format(rel="caller"), NEIGHBORS.format(src="callee_addr", dst="caller_addr"))
def context_callers(t):
    return context.neighbors(_starts(t), cut_lineage(t.calls()), t.lean(), "callers")


@q()
def context_block(t):
    """Context text of every function (checked by brute force in the tests)."""
    k = knowledge.block(knowledge.gather(t.refs(), t.knowledge()))
    return context.block(context.gather(t.functions(), cut_lineage(t.calls()), knowledge_block=k)).select("binary", "start", "summary", "block")


KNOWN = """r1 AS (SELECT *, row_number() OVER (PARTITION BY binary, func_addr, ref_type ORDER BY ord, addr) AS pos FROM (
    SELECT binary, func_addr, ref_type, addr, min(ord) AS ord FROM refs GROUP BY ALL)),
r2 AS (SELECT *, CASE ref_type WHEN 'code' THEN 0 WHEN 'data' THEN 1 ELSE 2 END AS tp FROM r1 WHERE pos <= 15),
r3 AS (SELECT *, max(tp) OVER (PARTITION BY binary, func_addr, addr) AS lt,
    row_number() OVER (PARTITION BY binary, func_addr ORDER BY tp, pos, addr) AS slot FROM r2),
kn AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY binary, func_addr ORDER BY priority, slot) AS INT) AS rank FROM (
    SELECT r3.binary, r3.func_addr, r3.addr, (['code', 'data', 'string'])[lt + 1] AS ref_type, name, comment, type_str, string_val, slot,
    CASE WHEN string_val <> '' THEN 0 WHEN name <> '' AND NOT starts_with(name, 'off_') THEN 1 WHEN type_str <> '' THEN 2
        WHEN comment <> '' THEN 3 ELSE 4 END AS priority FROM r3 JOIN knowledge k ON k.binary = r3.binary AND k.addr = r3.addr
    WHERE slot <= 50 AND (name <> '' OR comment <> '' OR type_str <> '' OR string_val <> ''))) WHERE rank <= 20)"""


@q("refs knowledge", """SELECT binary, func_addr, addr, ref_type, name, comment, type_str, string_val, priority, rank FROM kn""", KNOWN)
def knowledge_gather(t):
    return knowledge.gather(t.refs(), t.knowledge())


@q("refs knowledge", """SELECT binary, func_addr AS addr, CASE WHEN body = '' THEN '' ELSE 'Known references:' || chr(10) || body END AS knowledge
    FROM (SELECT binary, func_addr, coalesce(string_agg('  ' || ln, chr(10) ORDER BY rank) FILTER (p <= 12), '') AS body FROM (
    SELECT *, row_number() OVER (PARTITION BY binary, func_addr ORDER BY rank) AS p FROM (SELECT *,
    CASE WHEN string_val <> '' THEN '"' || substr(replace(string_val, '"', chr(92) || '"'), 1, 60) || '"' || CASE WHEN name <> '' THEN ' ' || name ELSE '' END
        WHEN name <> '' THEN name || CASE WHEN comment <> '' THEN ' // ' || substr(comment, 1, 40) ELSE '' END
        WHEN comment <> '' THEN 'comment: ' || substr(comment, 1, 60) ELSE '(' || type_str || ')' END AS ln FROM kn)) GROUP BY ALL)""", KNOWN)
def knowledge_block(t):
    return knowledge.block(knowledge.gather(t.refs(), t.knowledge()))


@q("functions", """SELECT binary, addr, '0x' || printf('%x', addr) || ',' || name || ',' || size AS csv,
    '  set_name(0x' || printf('%x', addr) || ', "' || name || '", SN_NOWARN);' AS idc, '0x' || printf('%016x', addr) || ' ' || name AS symbols
    FROM functions WHERE NOT starts_with(lower(name), 'sub_')""")
def export_lines(t):
    fns = t.lean()
    keyed = [export.lines(fns.withColumn("addr", F.col("addr")), f, True).filter("part = 1").select("addr", F.col("line").alias(f))
             for f in ("csv", "idc", "symbols")]
    return fns.select("binary", "addr").join(keyed[0], "addr").join(keyed[1], "addr").join(keyed[2], "addr")


@q("functions", """SELECT binary, addr, name, size FROM functions WHERE addr % 2 = 0
    UNION ALL SELECT binary, addr, 'v3', size FROM functions WHERE addr % 2 = 1""")
def table_latest(t):
    fns = t.lean()
    old = fns.withColumn("v", F.lit(1))
    new = fns.filter("addr % 2 = 1").withColumns({"name": F.lit("v3"), "v": F.lit(3)})
    return tables.latest(old.unionByName(new), ["binary", "addr"], "v").drop("v")
