"""Trace and memory-effect comparison, eligibility, reports and the verified-source cache."""
from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import names as N
from ...operators import verify
from ._register import Catalog
from .text import BRANCHES, FORBIDDEN, LINES

QUERIES = Catalog()
q = QUERIES.query

RANK = "CASE kind WHEN 'write' THEN 0 WHEN 'call' THEN 1 ELSE 2 END"
BASES = """ob AS (SELECT pair_id, arg_max(page, [n, -f]) AS orig_base FROM (SELECT pair_id, addr // 4096 * 4096 AS page, count(*) AS n,
    min(ord) AS f FROM original WHERE kind = 'write' GROUP BY ALL) GROUP BY pair_id),
rb AS (SELECT pair_id, arg_max(page, [n, -f]) AS new_base FROM (SELECT pair_id, addr // 4096 * 4096 AS page, count(*) AS n,
    min(ord) AS f FROM recompiled WHERE kind = 'write' GROUP BY ALL) GROUP BY pair_id),
bm AS (SELECT pair_id, orig_base, new_base FROM ob JOIN rb USING (pair_id) WHERE orig_base <> new_base)"""


def ordered(name: str) -> str:
    return f"""(SELECT t.pair_id, kind, size, value, target, CASE WHEN kind = 'write' AND addr >= orig_base AND addr < orig_base + 4096
        THEN addr - orig_base + new_base ELSE addr END AS addr, row_number() OVER (PARTITION BY t.pair_id ORDER BY ord, {RANK}) - 1 AS idx
        FROM {name} t LEFT JOIN bm ON bm.pair_id = t.pair_id)"""


def shown(a: str) -> str:
    return f"""CASE {a}.kind WHEN 'write' THEN 'write ' || {a}.size || 'B to 0x' || printf('%x', {a}.addr) || ' = ' || {a}.value
        WHEN 'call' THEN 'call 0x' || printf('%x', {a}.target) ELSE 'return ' || {a}.value END"""


def event(a: str) -> str:
    return f"CASE {a}.kind WHEN 'write' THEN 'MemoryWriteEvent' WHEN 'call' THEN 'CallEvent' ELSE 'ReturnEvent' END"


def compared(close: str) -> str:
    return f"""{BASES}, al AS (SELECT coalesce(o.pair_id, r.pair_id) AS pair_id, coalesce(o.idx, r.idx) AS idx,
    CASE WHEN o.kind IS NULL OR r.kind IS NULL OR o.kind <> r.kind THEN false WHEN o.kind = 'call' THEN o.target = r.target
        WHEN o.kind = 'write' THEN {close.format(x='addr')} AND {close.format(x='value')} ELSE {close.format(x='value')} END AS same,
    CASE WHEN o.kind IS NULL THEN 'no event' WHEN r.kind IS NULL THEN {event('o')} ELSE {shown('o')} END AS e,
    CASE WHEN r.kind IS NULL THEN 'no event' WHEN o.kind IS NULL THEN {event('r')} ELSE {shown('r')} END AS a
    FROM {ordered('original')} o FULL JOIN {ordered('recompiled')} r ON o.pair_id = r.pair_id AND o.idx = r.idx)"""


COMPARE = """SELECT pair_id, first = -1 AS equivalent, first AS first_divergent_event, CASE WHEN first = -1 THEN last ELSE first - 1 END AS last_matching_event,
    expected, actual, CASE WHEN first = -1 THEN 'All events matched' ELSE 'Matched ' || first || ' events, diverged at event ' || first END AS details
    FROM (SELECT pair_id, coalesce(min(idx) FILTER (NOT same), -1) AS first, max(idx) AS last, coalesce(arg_min(e, idx) FILTER (NOT same), '') AS expected,
    coalesce(arg_min(a, idx) FILTER (NOT same), '') AS actual FROM al GROUP BY pair_id)"""


@q("original recompiled", COMPARE, compared("o.{x} = r.{x}"))
def verify_compare_traces(t):
    return verify.compare_traces(t.original(), t.recompiled())


@q("original recompiled", COMPARE, compared("abs(o.{x} - r.{x}) / greatest(abs(o.{x}), abs(r.{x}), 1) <= 0.1"))
def verify_compare_traces_tolerant(t):
    return verify.compare_traces(t.original(), t.recompiled(), tolerance=0.1)


@q("original recompiled", "SELECT * FROM bm", BASES)
def verify_base_map(t):
    return verify.base_map(t.original(), t.recompiled())


@q("original recompiled", """SELECT o.pair_id, o.ord, CASE WHEN kind = 'write' AND addr >= orig_base AND addr < orig_base + 4096
    THEN addr - orig_base + new_base ELSE addr END AS addr FROM original o LEFT JOIN bm USING (pair_id)""", BASES)
def verify_normalize(t):
    return verify.normalize(t.original(), verify.base_map(t.original(), t.recompiled())).select("pair_id", "ord", "addr")


@q("original", f"SELECT pair_id, ord, kind, row_number() OVER (PARTITION BY pair_id ORDER BY ord, {RANK}) - 1 AS idx FROM original")
def verify_events(t):
    return verify.events(t.original(), ["pair_id"]).select("pair_id", "ord", "kind", "idx")


@q("original", """SELECT pair_id, count(*) FILTER (kind = 'write') AS memory_writes, count(*) FILTER (kind = 'call') AS calls,
    count(*) FILTER (kind = 'return') AS returns, count(*) AS total_events FROM original GROUP BY pair_id""")
def verify_trace_summary(t):
    return verify.trace_summary(t.original(), ["pair_id"])


WRITES = """w AS (SELECT * FROM (SELECT pair_id, addr, arg_max(value, ord) AS expected FROM original WHERE kind = 'write' GROUP BY ALL)
    FULL JOIN (SELECT pair_id, addr - 65536 AS addr, arg_max(value, ord) AS actual FROM recompiled WHERE kind = 'write' GROUP BY ALL) USING (pair_id, addr))"""


def _writes(t):
    o = t.original().filter("kind = 'write'")
    r = t.recompiled().filter("kind = 'write'").withColumn("addr", F.col("addr") - 65536)
    return o, r


REPORT = """SELECT r.pair_id, ret_original IS NOT DISTINCT FROM ret_recompiled AND (coalesce(bad, 0) = 0 OR {near}) AS equivalent,
    ret_original IS NOT DISTINCT FROM ret_recompiled AS return_match, coalesce(ok, 0) AS matching_writes, coalesce(bad, 0) AS divergent_writes,
    coalesce(ok, 0) / greatest(1, coalesce(ok, 0) + coalesce(bad, 0)) AS write_match_ratio FROM returns r LEFT JOIN (
    SELECT pair_id, count(*) FILTER (expected IS NOT DISTINCT FROM actual) AS ok, count(*) FILTER (expected IS DISTINCT FROM actual) AS bad,
    bool_and(expected IS NULL OR actual IS NULL OR expected = actual OR abs(expected - actual) / greatest(abs(expected), abs(actual), 1) <= 0.1) AS near
    FROM w GROUP BY pair_id) USING (pair_id)"""


@q("original recompiled returns", REPORT.format(near="false"), WRITES)
def verify_compare_writes(t):
    return verify.compare_writes(*_writes(t), t.returns())


@q("original recompiled returns", REPORT.format(near="coalesce(near, true)"), WRITES)
def verify_compare_writes_tolerant(t):
    return verify.compare_writes(*_writes(t), t.returns(), tolerance=0.1)


@q("original recompiled", "SELECT pair_id, '0x' || printf('%x', addr) AS address, expected, actual FROM w WHERE expected IS DISTINCT FROM actual", WRITES)
def verify_divergent_writes(t):
    return verify.divergent_writes(*_writes(t)).select("pair_id", "address", "expected", "actual")


ZIP = """z AS (SELECT pair_id, count(*) FILTER (o.value = r.value) AS hits, count(o.value) AS n, count(r.value) AS m FROM
    (SELECT pair_id, value, row_number() OVER (PARTITION BY pair_id ORDER BY value) AS i FROM
        (SELECT pair_id, addr, arg_max(value, ord) AS value FROM original WHERE kind = 'write' GROUP BY pair_id, addr)) o FULL JOIN
    (SELECT pair_id, value, row_number() OVER (PARTITION BY pair_id ORDER BY value) AS i FROM
        (SELECT pair_id, addr, arg_max(value, ord) AS value FROM recompiled WHERE kind = 'write' GROUP BY pair_id, addr)) r USING (pair_id, i) GROUP BY pair_id),
y AS (SELECT pair_id, ret_original, ret_recompiled, coalesce(n, 0) AS n, coalesce(m, 0) AS m, coalesce(hits, 0) AS hits,
    coalesce(abs(ret_original - ret_recompiled) / greatest(abs(ret_original), abs(ret_recompiled), 1) <= 0.1, false) OR ret_original IS NOT DISTINCT FROM ret_recompiled AS ret
    FROM returns LEFT JOIN z USING (pair_id)),
x AS (SELECT *, (n = m AND hits = n) OR hits / greatest(1, n) >= 0.9 AS mem, CASE WHEN n = 0 AND m = 0 THEN 1 ELSE hits / greatest(1, n, m) END AS ratio FROM y),
v AS (SELECT *, (ret AND mem) OR (CASE WHEN ret THEN 1 ELSE 0 END + ratio) / 2 >= 0.9 AS ok, 'return: ' || ret_original || ' vs ' || ret_recompiled || ' ('
    || CASE WHEN ret THEN 'match' ELSE 'MISMATCH' END || '), memory: ' || n || ' vs ' || m || ' (' || CASE WHEN mem THEN 'match' ELSE 'MISMATCH' END || ')' AS details FROM x)"""


@q("original recompiled returns", """SELECT pair_id, ok AS equivalent, ret AS return_match, mem AS memory_match,
    CASE WHEN ok THEN 'equivalent' ELSE details END AS reason, details FROM v""", ZIP)
def verify_compare_runs(t):
    return verify.compare_runs(*_writes(t), t.returns())


CODE_FN = """(SELECT p_brand AS binary, p_partkey AS addr, CAST(p_size AS BIGINT) * 16 AS size, code FROM part LEFT JOIN code ON doc_id = p_partkey)"""


@q("functions", """SELECT binary, addr FROM functions WHERE coalesce(pseudocode, '') <> '' ORDER BY length(pseudocode), binary, addr LIMIT 50""")
def verify_sample(t):
    return verify.sample(t.functions(), 50).select("binary", "addr")


@q("code", f"""SELECT binary, count(*) AS total_checked, count(*) FILTER (e) AS oracle_eligible,
    printf('%.1f', 100.0 * count(*) FILTER (e) / greatest(1, count(*))) || '%' AS eligibility_rate FROM (SELECT binary,
    code <> '' AND NOT ({FORBIDDEN}) AND {BRANCHES} <= 10 AND {LINES} <= 50 AS e, row_number() OVER (PARTITION BY binary ORDER BY size, addr) AS r
    FROM {CODE_FN} WHERE code IS NOT NULL) WHERE r <= 30 GROUP BY binary""")
def verify_eligibility_rate(t):
    code = t.code().select(F.col("doc_id").alias("addr"), F.col("code").alias("pseudocode"))
    return verify.eligibility_rate(t.lean().join(code, "addr", "left"), 10)


@q("ev", """SELECT binary, total, oracle_eligible, verified, compile_fail, not_eligible, round(elapsed_s, 3) AS elapsed_s, '=== Verified Decompilation Report ===' || chr(10) || 'Binary: ' || binary || chr(10)
    || 'Total functions: ' || total || chr(10) || chr(10) || 'Oracle-eligible: ' || oracle_eligible || ' (' || printf('%.1f', 100.0 * oracle_eligible / greatest(1, total)) || '%)' || chr(10)
    || 'Verified: ' || verified || ' (' || printf('%.1f', 100.0 * verified / greatest(1, oracle_eligible)) || '% of eligible)' || chr(10) || 'Compile fail: ' || compile_fail || chr(10)
    || 'Not eligible: ' || not_eligible || chr(10) || chr(10) || 'Time: ' || printf('%.1f', elapsed_s) || 's' AS report FROM (
    SELECT 'bin' || (user_id % 10) AS binary, count(*) AS total, count(*) FILTER (e) AS oracle_eligible, count(*) FILTER (e AND v) AS verified,
    count(*) FILTER (e AND NOT v AND c) AS compile_fail, count(*) FILTER (NOT e) AS not_eligible, sum(k + 1 / 1024) AS elapsed_s
    FROM (SELECT *, event_type <> 'error' AS e, event_type = 'view' AS v, k % 2 = 0 AS c FROM ev) GROUP BY ALL)""")
def verify_report(t):
    e = F.col("event_type")
    rows = t.ev().select(F.concat(F.lit("bin"), (F.col("user_id") % 10).cast("string")).alias("binary"), (e != "error").alias("eligible"),
                         (e == "view").alias("verified"), (F.col("k") % 2 == 0).alias("compiled"), (F.col("k") + 1 / 1024).alias("elapsed_s"))
    return verify.report(rows).withColumn("elapsed_s", F.round("elapsed_s", 3))


@q("", """SELECT md5(text) AS code_hash, 'c' || arg_max(doc_id, doc_id) AS c_code FROM documents GROUP BY 1""")
def verify_cache_put(t):
    docs = t.read("documents").select(F.col("text").cast("binary").alias("code_bytes"), F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("c_code"),
                                      F.lit("f").alias("func_name"), F.col("doc_id").alias("verified_at"))
    old = docs.select(F.md5("code_bytes").alias("code_hash"), F.lit("old").alias("c_code"), "func_name", F.lit(-1).cast("bigint").alias("verified_at"))
    return verify.cache_put(old, docs).select("code_hash", "c_code")


@q("", """SELECT d.doc_id, c.doc_id AS cached FROM documents d LEFT JOIN (SELECT md5(text) AS h, min(doc_id) AS doc_id FROM documents
    WHERE doc_id % 2 = 0 GROUP BY 1) c ON c.h = md5(d.text)""")
def verify_cache_get(t):
    docs = t.read("documents")
    cache = docs.filter("doc_id % 2 = 0").groupBy(F.md5(F.col("text").cast("binary")).alias("code_hash")).agg(F.min("doc_id").alias("c_code"))
    return verify.cache_get(cache, docs.select("doc_id", F.col("text").cast("binary").alias("code_bytes"))).select(
        "doc_id", F.col("c_code").alias("cached"))


@q("", "SELECT p_partkey, replace(replace(p_name || '::x', '::', '_'), ' ', '_') || '.c' AS file FROM part")
def verify_file_names(t):
    return t.read("part").select("p_partkey", F.concat(N.safe_file_name(F.concat("p_name", F.lit("::x"))), F.lit(".c")).alias("file"))
