"""Instruction traces: flags, memory events, summaries, indicators, risk and patterns."""
from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import instructions as I
from ...operators import traces
from ._register import Catalog
from .runlogs import show, shown

QUERIES = Catalog()
q = QUERIES.query

BR, CA, RE, SY = (", ".join(f"'{m}'" for m in g) for g in (I.BRANCHES, I.CALLS, I.RETURNS, I.SYSCALLS))
SEM = "(VALUES " + ", ".join(f"('{m}', '{c}', {r}::DOUBLE)" for c, g in I.SEMANTICS.items() for m, r in g.items()) + ") s(mnemonic, category, risk)"
STACKY = "(contains(operands, 'rsp') OR contains(operands, 'rbp'))"
RISK = f"""rk AS (SELECT i.*, coalesce(category, 'unknown') AS category, coalesce(risk, 0.5) AS risk, coalesce(risk, 0) AS base,
    least(1, coalesce(risk, 0.5) * CASE WHEN {STACKY} THEN 1.5 ELSE 1 END * CASE WHEN i.mnemonic IN ('rep', 'movsb', 'stosb', 'movsd') THEN 2 ELSE 1 END
    * CASE WHEN i.mnemonic IN ('cmp', 'test', 'je', 'jne') THEN 0.3 ELSE 1 END) AS ctx FROM instr i LEFT JOIN {SEM} USING (mnemonic))"""


@q("mem", f"""SELECT i.trace_id, i.seq, mnemonic IN ({BR}) AS is_branch, mnemonic IN ({CA}) AS is_call, mnemonic IN ({RE}) AS is_return,
    mnemonic IN ({SY}) AS is_syscall, taken AS branch_taken, coalesce(ev, '') AS events, CASE WHEN rsp_a <> rsp_b THEN 'rsp ' ELSE '' END
    || CASE WHEN rsi_a <> rsi_b THEN 'rsi ' ELSE '' END || CASE WHEN rdi_a <> rdi_b THEN 'rdi ' ELSE '' END || 'rip' AS changed FROM instr i LEFT JOIN (
    SELECT trace_id, seq, string_agg(kind || ':' || addr || ':' || size || ':' || is_stack, ' ' ORDER BY is_stack DESC, addr DESC) AS ev FROM mem GROUP BY ALL) m
    ON m.trace_id = i.trace_id AND m.seq = i.seq""")
def traces_events(t):
    rows = traces.with_events(t.instr())
    ev = F.array_join(F.transform("memory_events", lambda e: F.concat_ws(":", e["event_type"], e["address"].cast("string"),
                                                                         e["size"].cast("string"), e["is_stack"].cast("string"))), " ")
    regs = ("rsp", "rsi", "rdi", "rip")
    return rows.select("trace_id", "seq", "is_branch", "is_call", "is_return", "is_syscall", "branch_taken", ev.alias("events"),
                       F.array_join(I.changed_registers(F.col("regs_before"), F.col("regs_after"), regs), " ").alias("changed"))


PER = """pe AS (SELECT trace_id, seq, count(*) AS n, count(*) FILTER (kind = 'read') AS r, count(*) FILTER (kind = 'write') AS w FROM mem GROUP BY ALL),
sm AS (SELECT i.trace_id, count(*) AS total_instructions, CAST(coalesce(sum(n) FILTER (r > 0), 0) AS BIGINT) AS total_memory_reads, CAST(coalesce(sum(n) FILTER (w > 0), 0) AS BIGINT) AS total_memory_writes,
    CAST(coalesce(sum(r), 0) AS BIGINT) AS exact_reads, CAST(coalesce(sum(w), 0) AS BIGINT) AS exact_writes,
    count(*) FILTER (mnemonic IN (""" + BR + """)) AS branch_count, count(*) FILTER (mnemonic IN (""" + SY + """)) AS syscall_count,
    max(2147483648::BIGINT - rsp_a) AS stack_depth, count(*) FILTER (mnemonic = 'call') AS c_call, count(*) FILTER (mnemonic = 'ret') AS c_ret, count(*) FILTER (mnemonic = 'jmp') AS c_jmp
    FROM instr i LEFT JOIN pe ON pe.trace_id = i.trace_id AND pe.seq = i.seq GROUP BY i.trace_id)"""


@q("mem", """SELECT trace_id, total_instructions, total_memory_reads, total_memory_writes, exact_reads, exact_writes, greatest(0, stack_depth) AS stack_depth_max,
    branch_count, syscall_count FROM sm""", PER)
def traces_summary(t):
    return traces.summary(traces.with_events(t.instr()))


@q("instr", "SELECT trace_id, mnemonic, count(*) AS n FROM instr GROUP BY ALL")
def traces_mnemonics(t):
    return traces.mnemonics(t.instr())


@q("mem", "SELECT trace_id, " + shown("""total_instructions / 10000, total_memory_reads / 1000, total_memory_writes / 1000, stack_depth / 10000, trace_id % 2,
    branch_count / 1000, syscall_count / 100, c_call / 10, c_ret / 10, c_jmp / 10""") + " AS stats FROM sm", PER)
def traces_stats_vector(t):
    v = traces.stats_vector(traces.summary(traces.with_events(t.instr())), traces.mnemonics(t.instr()), F.col("trace_id") % 2 == 1)
    return v.select("trace_id", show(F.col("stats")).alias("stats"))


INDICATORS = """ind AS (SELECT m.trace_id, m.seq, 'potential_stack_overflow' AS type, addr AS address, mnemonic || ' ' || operands AS instruction, 0.3::DOUBLE AS weight
    FROM mem m JOIN instr i ON i.trace_id = m.trace_id AND i.seq = m.seq WHERE mnemonic IN ('mov', 'push', 'stosb', 'stosw', 'stosd', 'stosq') AND is_stack AND kind = 'write' AND addr < 2147422208
    UNION ALL SELECT trace_id, seq, 'potential_format_string', address, mnemonic || ' ' || operands, 0.2 FROM instr WHERE mnemonic = 'call' AND contains(operands, 'printf')
    UNION ALL SELECT trace_id, seq, 'arithmetic_operation', NULL, mnemonic || ' ' || operands, 0 FROM instr WHERE mnemonic IN ('add', 'imul', 'mul') AND contains(operands, 'dword')
    UNION ALL SELECT trace_id, seq, 'potential_use_after_free', address, mnemonic || ' ' || operands, 0.25 FROM instr WHERE mnemonic IN ('call', 'jmp') AND contains(operands, 'free'))"""


@q("mem", "SELECT * FROM ind", INDICATORS)
def traces_indicators(t):
    return traces.indicators(traces.with_events(t.instr()))


@q("mem", "SELECT trace_id, round(least(1, sum(weight)), 6) AS risk_score, count(*) FILTER (weight > 0) AS indicators FROM ind GROUP BY trace_id", INDICATORS)
def traces_risk_scores(t):
    out = traces.risk_scores(traces.indicators(traces.with_events(t.instr())))
    return out.withColumn("risk_score", F.round("risk_score", 6))


@q("instr", "SELECT trace_id, seq, category, risk, round(ctx, 6) AS context_risk, " + shown(f"""base, {STACKY}::INT, contains(operands, '[')::INT, contains(mnemonic, 'call')::INT, contains(mnemonic, 'ret')::INT,
    (mnemonic IN ('jmp', 'je', 'jne', 'jg', 'jl'))::INT, (mnemonic IN ('syscall', 'int'))::INT, (mnemonic IN ('rep', 'movsb', 'stosb'))::INT, contains(operands, 'dword')::INT,
    contains(operands, 'qword')::INT""") + " AS features FROM rk", RISK)
def traces_risk(t):
    return traces.with_risk(t.instr()).select("trace_id", "seq", "category", "risk", F.round("context_risk", 6).alias("context_risk"),
                                              show(F.col("features")).alias("features"))


@q("instr", """SELECT address, round(least(1, risk / 10), 6) AS risk_score, CASE WHEN address % 32 = 0 THEN 0.5 ELSE 0 END::DOUBLE AS confidence, round(risk, 6) AS risk FROM (SELECT address, sum(ctx) AS risk FROM rk
    GROUP BY address) WHERE round(risk, 9) > 1""", RISK)
def traces_risk_areas(t):
    rows = t.instr()
    conf = rows.filter("address % 32 = 0").select(F.concat(F.lit("addr_"), F.col("address").cast("string")).alias("pattern"), F.lit(0.5).alias("confidence")).distinct()
    out = traces.risk_areas(rows, conf)
    return out.withColumn("risk_score", F.round("risk_score", 6)).withColumn("risk", F.round("risk", 6))


@q("instr", """SELECT DISTINCT trace_id, pattern, signature, severity FROM instr, (VALUES
    ('stack_buffer_overflow', 'rep movsb with large ECX and stack destination', 'critical', 'rep movsb', 'rsp|rbp'),
    ('stack_buffer_overflow', 'gets() call (no bounds checking)', 'critical', 'call', 'gets'),
    ('stack_buffer_overflow', 'strcpy() call (no bounds checking)', 'critical', 'call', 'strcpy'),
    ('use_after_free', 'use after free() call', 'high', 'call', 'free')) r(pattern, signature, severity, ms, word)
    WHERE list_contains(string_split(ms, ' '), mnemonic) AND regexp_matches(operands, word)""")
def traces_signatures(t):
    return traces.signatures(t.instr())


PATTERNS = INDICATORS + """, pt AS (SELECT pattern, count(*) AS n FROM (SELECT a || ',' || b || ',' || mnemonic AS pattern FROM (
    SELECT mnemonic, lag(mnemonic, 2) OVER w AS a, lag(mnemonic) OVER w AS b FROM instr WINDOW w AS (PARTITION BY trace_id ORDER BY seq)) WHERE a IS NOT NULL
    UNION ALL SELECT type || '_' || address FROM ind WHERE weight > 0) GROUP BY pattern)"""


def _patterns(t):
    rows = t.instr()
    return traces.patterns(rows, traces.indicators(traces.with_events(rows)))


@q("mem", "SELECT * FROM pt", PATTERNS)
def traces_patterns(t):
    return _patterns(t)


@q("mem", "SELECT pattern, n, round(1 - pow(0.9, 3), 6) AS confidence FROM pt", PATTERNS)
def traces_confidence(t):
    return traces.confidence(_patterns(t), 3).withColumn("confidence", F.round("confidence", 6))


@q("mem", """SELECT type, round(least(1, 0.1 * count(*)), 6) AS confidence FROM ind v WHERE weight > 0 AND trace_id % 2 = 1 AND EXISTS (
    SELECT 1 FROM ind o WHERE o.weight > 0 AND o.trace_id = v.trace_id - 1 AND o.type = v.type) GROUP BY type""", INDICATORS)
def traces_confirmed(t):
    found = traces.indicators(traces.with_events(t.instr()))
    pair = found.withColumn("run_id", F.floor(F.col("trace_id") / 2))
    out = traces.confirmed(pair.filter("trace_id % 2 = 0"), pair.filter("trace_id % 2 = 1"))
    return out.withColumn("confidence", F.round("confidence", 6))


@q("mem", """SELECT (SELECT count(DISTINCT trace_id) FROM instr) AS total_analyses, (SELECT count(DISTINCT pattern) FROM pt) AS known_patterns,
    round((SELECT avg(1 - pow(0.9, 3)) FROM pt), 6) AS avg_confidence""", PATTERNS)
def traces_pattern_stats(t):
    counts = _patterns(t)
    out = traces.pattern_stats(counts, traces.confidence(counts, 3), t.instr())
    return out.withColumn("avg_confidence", F.round("avg_confidence", 6))


@q("instr", """SELECT trace_id, seq, a AS address, CASE WHEN a >= 2147418112 AND a < 2147483647 THEN 'stack' WHEN a >= 1610612736 AND a < 1879048191 THEN 'heap'
    WHEN a >= 4194304 AND a < 6291456 THEN 'code' WHEN a >= 6291456 AND a < 7340032 THEN 'data' WHEN a >= 2130706432 AND a < 2147483647 THEN 'mmap' ELSE 'unknown' END AS region
    FROM (SELECT trace_id, seq, CASE seq % 4 WHEN 0 THEN address WHEN 1 THEN rsp_a WHEN 2 THEN rsi_a ELSE rdi_a END AS a FROM instr)""")
def traces_region(t):
    r = F.col("seq") % 4
    a = (F.when(r == 0, F.col("address")).when(r == 1, F.col("regs_after.rsp")).when(r == 2, F.col("regs_after.rsi")).otherwise(F.col("regs_after.rdi")))
    return traces.regions(t.instr().select("trace_id", "seq", a.alias("address")))
