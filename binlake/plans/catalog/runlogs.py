"""Fuzz, emulation, live-call and command logs, annotations and job logs."""
from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import commands as C, outcomes as O
from ...operators import annotate, jobs, learn, runs
from ._register import Catalog

QUERIES = Catalog()
q = QUERIES.query
KEYS = ["campaign"]


def show(col, digits=6):
    def text(x):
        plain = x.cast("double").cast("string")
        whole = F.when(plain == "0.0", "0." + "0" * digits).when(plain == "1.0", "1." + "0" * digits)  # most are, and formatting is slow
        return whole.otherwise(F.format_string(f"%.{digits}f", F.round(x.cast("double"), digits)))
    return F.array_join(F.transform(col, text), ",")


def shown(items: str) -> str:
    return f"array_to_string(list_transform([{items}], lambda x: printf('%.6f', round(CAST(x AS DOUBLE), 6))), ',')"


def flag(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 1 ELSE 0 END"


KIND = "CASE exit_code WHEN 139 THEN 'segv' WHEN 134 THEN 'abort' WHEN 136 THEN 'fpe' WHEN 135 THEN 'bus' ELSE CASE WHEN exit_code >= 128 THEN 'signal' ELSE '' END END"
FRESH = """fs AS (SELECT campaign, c, min(step) AS step FROM (SELECT campaign, step, unnest(cov_ids) AS c FROM {runs}) GROUP BY ALL),
cv AS (SELECT r.*, coalesce(n, 0) AS new_coverage, CAST(sum(coalesce(n, 0)) OVER (PARTITION BY r.campaign ORDER BY r.step) AS BIGINT) AS covered_so_far
    FROM {runs} r LEFT JOIN (SELECT campaign, step, count(*) AS n FROM fs GROUP BY ALL) f ON f.campaign = r.campaign AND f.step = r.step)"""


def _covered(t):
    return runs.coverage(t.fuzz_runs(), KEYS, O.crashed(F.col("exit_code")))


@q("", """SELECT code, CASE code WHEN 139 THEN 'segv' WHEN 134 THEN 'abort' WHEN 136 THEN 'fpe' WHEN 135 THEN 'bus'
    ELSE CASE WHEN code >= 128 THEN 'signal' ELSE '' END END AS kind, count(*) AS n FROM (SELECT o_orderkey % 160 AS code FROM orders) GROUP BY ALL""")
def runs_crash_kind(t):
    c = t.read("orders").select((F.col("o_orderkey") % 160).alias("code"))
    return c.groupBy("code", O.crash_kind(F.col("code")).alias("kind")).agg(F.count("*").alias("n"))


STATUS = "CASE WHEN crashed AND fault_addr < 65536 THEN 'needs_state' WHEN crashed THEN 'crash' WHEN returned THEN 'clean' ELSE 'inconclusive' END"


@q("emu_runs", f"""SELECT step, status, CASE status WHEN 'needs_state' THEN 'near-null access @+0x' || printf('%x', fault_addr) || '; needs live state'
    WHEN 'crash' THEN crash_kind || ' @ 0x' || printf('%x', fault_addr) || '; candidate bug' WHEN 'clean' THEN 'returned cleanly; ' || stubbed_calls || ' calls stubbed'
    ELSE 'hit instruction budget without returning' END AS note, CASE WHEN crashed THEN 139 WHEN timed_out THEN 124 ELSE 0 END AS exit_code
    FROM (SELECT *, {STATUS} AS status FROM emu_runs)""")
def runs_emu_status(t):
    s = O.emu_status(F.col("crashed"), F.col("fault_addr"), F.col("returned"))
    return t.emu_runs().withColumn("status", s).select(
        "step", "status", O.emu_note(F.col("status"), F.col("crash_kind"), F.col("fault_addr"), F.col("stubbed_calls")).alias("note"),
        O.emu_exit_code(F.col("crashed"), F.col("timed_out")).alias("exit_code"))


@q("", """SELECT doc_id, CASE WHEN contains(m, 'read') OR contains(m, 'write') THEN 'segfault' WHEN contains(m, 'stack') THEN 'stack_smash'
    WHEN contains(m, 'illegal') OR contains(m, 'invalid') THEN 'illegal_instruction' WHEN contains(m, 'overflow') THEN 'integer_overflow' ELSE 'unknown_crash' END AS class
    FROM (SELECT doc_id, lower(text || CASE doc_id % 4 WHEN 0 THEN ' Stack' WHEN 1 THEN ' INVALID' WHEN 2 THEN ' overflow' ELSE '' END) AS m FROM documents)""")
def runs_crash_class(t):
    d = F.col("doc_id") % 4
    m = F.concat("text", F.when(d == 0, " Stack").when(d == 1, " INVALID").when(d == 2, " overflow").otherwise(""))
    return t.spread("documents").select("doc_id", O.crash_class(m).alias("class"))


@q("fuzz_runs", "SELECT step, 'stdin|' || base64(encode(payload)) AS token, 'stdin' AS mode, hex(payload) AS back FROM fuzz_runs")
def runs_token(t):
    tok = t.fuzz_runs().select("step", O.token(F.col("mode"), F.col("payload")).alias("token"))
    return tok.select("*", O.token_mode(F.col("token")).alias("mode"), F.hex(O.token_payload(F.col("token"))).alias("back"))


SPEC = "(" + " + ".join(f"(length(p) - length(replace(p, '{s}', ''))) / 2" for s in O.FORMAT_SPECIFIERS) + ")"
FAMILY = f"CASE WHEN p = '' THEN 'empty' WHEN {SPEC} > 0 THEN 'format' WHEN length(p) >= 64 THEN 'long' WHEN p = repeat(left(p, 1), CAST(length(p) AS INT)) THEN 'repeat' ELSE 'text' END"


@q("fuzz_runs", f"SELECT step, {FAMILY} AS family FROM (SELECT step, payload AS p FROM fuzz_runs)")
def runs_input_family(t):
    return t.fuzz_runs().select("step", O.input_family(F.col("payload")).alias("family"))


def ratio(chars: str) -> str:
    return f"CASE WHEN n = 0 THEN 0 ELSE length(regexp_replace(p, '[^{chars}]', '', 'g')) / n END"


@q("", f"""SELECT doc_id, {shown(', '.join(['1', '0', 'least(n / 256, 1)', 'pr', 'dg', 'lt', 'hi', 'bl', 'least(run / 64, 1)', 'e / 8', 'least(sp / 4, 1)', 'rt', 'nl']))} AS features
    FROM (SELECT doc_id, length(hex(encode(text))) / 2 AS n, length(regexp_replace(text, '[^\\x20-\\x7E]', '', 'g')) AS c1, text FROM documents) d
    JOIN LATERAL (SELECT c1 / n AS pr, length(regexp_replace(text, '[^0-9]', '', 'g')) / n AS dg, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / n AS lt,
        length(regexp_replace(text, '[^ \\t\\n]', '', 'g')) / n AS bl, {SPEC.replace('(p', '(text')} AS sp,
        CASE WHEN left(text, 1) IN ('A', 'B', 'C', 'D') THEN 1 ELSE 0 END AS rt, CASE WHEN contains(text, chr(10)) THEN 1 ELSE 0 END AS nl) l ON true
    JOIN (SELECT doc_id, coalesce(sum(c) FILTER (b >= '80'), 0) / sum(c) AS hi, -sum(c / t * log2(c / t)) AS e FROM (SELECT *, sum(c) OVER (PARTITION BY doc_id) AS t FROM (SELECT doc_id, b, count(*) AS c
        FROM (SELECT doc_id, substr(h, CAST(2 * i + 1 AS INT), 2) AS b FROM (SELECT doc_id, hex(encode(text)) AS h, unnest(range(0, length(hex(encode(text))) // 2)) AS i FROM documents)) GROUP BY ALL)) GROUP BY doc_id) USING (doc_id)
    JOIN (SELECT doc_id, max(n) AS run FROM (SELECT doc_id, g, count(*) AS n FROM (SELECT doc_id, sum(x) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (
        SELECT doc_id, i, CASE WHEN b IS DISTINCT FROM lag(b) OVER (PARTITION BY doc_id ORDER BY i) THEN 1 ELSE 0 END AS x FROM (
        SELECT doc_id, i, substr(h, CAST(2 * i + 1 AS INT), 2) AS b FROM (SELECT doc_id, hex(encode(text)) AS h, unnest(range(0, length(hex(encode(text))) // 2)) AS i FROM documents)))) GROUP BY ALL) GROUP BY doc_id) USING (doc_id)""")
def runs_input_features(t):
    f = O.input_features(F.lit("stdin"), F.encode("text", "UTF-8"))
    names = ("is_stdin", "is_argv", "length", "printable", "digits", "letters", "high", "blank", "longest_run", "entropy", "specifiers", "routed", "has_newline")
    return t.spread("documents").select("doc_id", f.alias("f")).select("doc_id", show(F.array(*[F.col(f"f.{n}") for n in names])).alias("features"))


@q("fuzz_runs", """SELECT campaign, step, new_coverage, covered_so_far, new_coverage + CASE WHEN exit_code >= 128 THEN 3 ELSE 0 END::DOUBLE AS reward FROM cv""",
   FRESH.format(runs="fuzz_runs"))
def runs_coverage(t):
    return _covered(t).select("campaign", "step", "new_coverage", "covered_so_far", "reward")


@q("fuzz_runs", """SELECT campaign, step, hex(payload) AS payload, pos FROM (SELECT *, CAST(row_number() OVER (PARTITION BY campaign ORDER BY step) AS INT) AS pos FROM (
    SELECT campaign, payload, min(step) AS step FROM cv WHERE new_coverage > 0 AND payload NOT IN ('', 'A', 'BX', 'C%s', 'D8') GROUP BY ALL))""",
   FRESH.format(runs="fuzz_runs"))
def runs_corpus(t):
    return runs.corpus(_covered(t), KEYS).withColumn("payload", F.hex("payload"))


def _fuzz_crashes(t):
    return t.fuzz_runs().filter(O.crashed(F.col("exit_code"))).withColumn(
        "crash_key", runs.fuzz_crash_key(F.col("exit_code"), F.col("cov_ids")))


@q("fuzz_runs", f"""SELECT campaign, {KIND} || ':' || length(list_distinct(cov_ids)) AS crash_key, hex(arg_min(payload, step)) AS payload, min(step) AS first_step, count(*) AS hits
    FROM fuzz_runs WHERE exit_code >= 128 GROUP BY ALL""")
def runs_unique_crashes(t):
    return runs.unique_crashes(_fuzz_crashes(t), KEYS).withColumn("payload", F.hex("payload"))


@q("emu_runs", """SELECT binary, addr, crash_kind || '@0x' || printf('%x', fault_addr) AS crash_key, hex(arg_min(payload, step)) AS payload, min(step) AS first_step, count(*) AS hits
    FROM emu_runs WHERE crashed GROUP BY ALL""")
def runs_unique_emu_crashes(t):
    bad = t.emu_runs().filter("crashed").withColumn("crash_key", runs.emu_crash_key(F.col("crash_kind"), F.col("fault_addr")))
    return runs.unique_crashes(bad, ["binary", "addr"]).withColumn("payload", F.hex("payload"))


SUMMARY = f"""sm AS (SELECT campaign, count(*) AS inputs, (SELECT count(DISTINCT c) FROM (SELECT campaign AS k, unnest(cov_ids) AS c FROM fuzz_runs) x WHERE x.k = r.campaign) AS functions_covered,
    count(DISTINCT CASE WHEN exit_code >= 128 THEN {KIND} || ':' || length(list_distinct(cov_ids)) END) AS unique_crashes FROM fuzz_runs r GROUP BY campaign)"""


@q("fuzz_runs", "SELECT * FROM sm", SUMMARY)
def runs_summary(t):
    return runs.summary(t.fuzz_runs(), _fuzz_crashes(t), KEYS)


VERDICT = f"""vd AS (SELECT *, CASE WHEN n_crash > 0 THEN 'candidate_crash' WHEN n_needs_state > 0 THEN 'needs_state' WHEN n_clean > 0 THEN 'exercised_clean' ELSE 'inconclusive' END AS verdict FROM (
    SELECT binary, addr, count(*) AS rounds, max(blocks) AS blocks, max(stubbed_calls) AS stubbed_calls, count(*) FILTER (s = 'crash') AS n_crash,
    count(*) FILTER (s = 'needs_state') AS n_needs_state, count(*) FILTER (s = 'clean') AS n_clean, count(*) FILTER (s = 'inconclusive') AS n_inconclusive,
    count(DISTINCT CASE WHEN s = 'crash' THEN crash_kind || fault_addr END) AS unique_crashes, hex(arg_min(payload, step) FILTER (s = 'crash')) AS crash_input
    FROM (SELECT *, {STATUS} AS s FROM emu_runs) GROUP BY binary, addr))"""


@q("emu_runs", """SELECT binary, addr, verdict, blocks > 0 AS reachable, blocks, stubbed_calls, rounds, unique_crashes, n_crash, n_needs_state, n_clean,
    n_inconclusive, crash_input FROM vd""", VERDICT)
def runs_verdict(t):
    return runs.verdict(t.emu_runs())


@q("live_calls", """SELECT binary, step, 4194304 + rva AS addr, CASE WHEN rva % 32 = 0 THEN 'fn' || (4194304 + rva) END AS name FROM live_calls""")
def runs_live_to_function(t):
    calls = t.live_calls()
    bases = calls.select("binary").distinct().withColumn("image_base", F.lit(4194304).cast("bigint"))
    fns = calls.filter("rva % 32 = 0").select("binary", (F.col("rva") + 4194304).alias("addr")).distinct().withColumn(
        "name", F.concat(F.lit("fn"), F.col("addr").cast("string")))
    return runs.live_to_function(calls, fns, bases).select("binary", "step", "addr", "name")


@q("live_calls", """SELECT binary, rva, count(*) AS calls, coalesce(array_to_string(list_slice(list(arg ORDER BY step) FILTER (arg IS NOT NULL), 1, 5), ','), '') AS sample_args,
    array_to_string(list_slice(list(ret ORDER BY step), 1, 5), ',') AS returns FROM live_calls GROUP BY ALL""")
def runs_live_facts(t):
    return runs.live_facts(t.live_calls(), ["binary", "rva"], ["step"]).select(
        "binary", "rva", "calls", F.array_join("sample_args", ",").alias("sample_args"),
        F.array_join(F.transform("returns", lambda x: x.cast("string")), ",").alias("returns"))


@q("live_calls", "SELECT binary, rva, row_number() OVER (PARTITION BY binary, rva ORDER BY step) AS pos, arg FROM live_calls WHERE arg IS NOT NULL")
def runs_live_values(t):
    return runs.live_values(t.live_calls(), ["binary", "rva"], "step", "arg")


LIVE = """lf AS (SELECT campaign AS binary, addr AS rva, step, event_type = 'signup' AS detached, CASE WHEN event_type = 'error' THEN 'a' || (k % 3) END AS crash_addr,
    payload, step % 100 AS ret FROM fuzz_runs)"""


def _live_log(t):
    e = t.ev().select(F.col("event_id").alias("step"), "event_type")
    return t.fuzz_runs().join(e, "step").select(
        F.col("campaign").alias("binary"), F.col("addr").alias("rva"), "step", (F.col("event_type") == "signup").alias("detached"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("a"), (F.col("addr") % 3).cast("string"))).alias("crash_addr"), "payload",
        (F.col("step") % 100).alias("ret"))


@q("fuzz_runs", """SELECT binary, rva, count(*) FILTER (key IS NULL) AS calls, count(DISTINCT key) AS unique_crashes, count(*) FILTER (key IS NOT NULL) AS respawns,
    coalesce(array_to_string(list_slice(list(ret ORDER BY step) FILTER (key IS NULL), 1, 50), ','), '') AS returns
    FROM (SELECT *, CASE WHEN detached OR crash_addr IS NOT NULL THEN coalesce(crash_addr, 'detached') END AS key FROM lf) GROUP BY ALL""", LIVE)
def runs_live_fuzz_summary(t):
    return runs.live_fuzz_summary(_live_log(t), ["binary", "rva"]).withColumn(
        "returns", F.array_join(F.transform("returns", lambda x: x.cast("string")), ","))


@q("fuzz_runs", """SELECT binary, rva, row_number() OVER (PARTITION BY binary, rva ORDER BY step) AS pos, ret FROM lf WHERE NOT detached AND crash_addr IS NULL""", LIVE)
def runs_live_fuzz_returns(t):
    log = _live_log(t)
    return runs.live_values(log.filter(~F.col("detached") & F.col("crash_addr").isNull()), ["binary", "rva"], "step", "ret")


@q("fuzz_runs", """SELECT binary, rva, coalesce(crash_addr, 'detached') AS crash_key, hex(arg_min(payload, step)) AS payload, min(step) AS first_step, count(*) AS hits
    FROM lf WHERE detached OR crash_addr IS NOT NULL GROUP BY ALL""", LIVE)
def runs_live_fuzz_crashes(t):
    return runs.live_fuzz_crashes(_live_log(t), ["binary", "rva"]).withColumn("payload", F.hex("payload"))


@q("fuzz_runs", """SELECT step, CASE WHEN step % 10 = 0 THEN 0 ELSE exit_code END AS exit_code, CASE WHEN step % 10 = 0 THEN '' ELSE array_to_string(list_sort(cov_ids), ',') END AS cov,
    CASE WHEN step % 10 = 0 THEN '' ELSE stdout END AS stdout FROM fuzz_runs""")
def runs_parse_exec(t):
    rec = F.concat(F.lit("noise\n===RC:"), F.col("exit_code").cast("string"), F.lit("\n===COV\n"), F.array_join("cov_ids", "\n"), F.lit("\n"),
                   F.element_at("cov_ids", 1), F.lit("\n===OUT\n"), F.col("stdout"), F.lit("\n"))
    raw = t.fuzz_runs().select("step", F.when(F.col("step") % 10 == 0, F.replace(rec, F.lit("===OUT"), F.lit("==OUT"))).otherwise(rec).alias("record"))
    return runs.parse_exec(raw).select("step", "exit_code", F.array_join("cov_ids", ",").alias("cov"), "stdout")


@q("fuzz_runs", "SELECT step, " + shown(", ".join([
    "least(exit_code / 128, 1)", flag("exit_code = 0"), flag("exit_code >= 128"), flag("timed_out"), flag("exit_code = 139"), flag("exit_code = 134"),
    "least(2 / 8, 1)", "least(new_coverage / 4, 1)", "least(length(stdout) / 200, 1)", flag("stdout <> ''"), "least(covered_so_far / 8, 1)", "least(duration / 5, 1)",
    flag("contains(stdout, '%')"), "1", "0", "0", "0", "0", "0", "0"])) + " AS features FROM cv", FRESH.format(runs="fuzz_runs"))
def runs_fuzz_outcome_features(t):
    r = {c: F.col(c) for c in ("exit_code", "timed_out", "new_coverage", "stdout", "covered_so_far", "duration")}
    return _covered(t).select("step", show(O.fuzz_outcome_features({**r, "cov_count": F.size("cov_ids")})).alias("features"))


@q("emu_runs", "SELECT step, " + shown(", ".join([
    flag("crashed"), flag("returned"), flag("timed_out"), *[flag(f"crash_kind = '{k}'") for k in ("read_unmapped", "write_unmapped", "fetch_unmapped", "invalid_insn")],
    "least(blocks / 16, 1)", "least(new_coverage / 4, 1)", "least(covered_so_far / 32, 1)", flag("fault_addr <> 0"), flag("starts_with(crash_kind, 'write')"), "0", "1"]))
   + " AS features, coalesce(nullif(crash_kind, ''), CASE WHEN timed_out THEN 'timeout' ELSE 'ok' END) || '|' || least(blocks, 16) AS signature FROM cv", FRESH.format(runs="emu_runs"))
def runs_emu_outcome_features(t):
    cov = runs.coverage(t.emu_runs(), KEYS, F.col("crashed"))
    return cov.select("step", show(O.emu_outcome_features({c: F.col(c) for c in cov.columns})).alias("features"),
                      O.emu_signature(F.col("crash_kind"), F.col("timed_out"), F.col("blocks")).alias("signature"))


PROGRAM = "CASE event_type WHEN 'click' THEN 'ls' WHEN 'error' THEN 'grep' WHEN 'view' THEN 'cat' WHEN 'purchase' THEN 'gcc' ELSE 'frob' END"
CFAMILY = "CASE event_type WHEN 'click' THEN 'file' WHEN 'error' THEN 'text' WHEN 'view' THEN 'text' WHEN 'purchase' THEN 'compile' ELSE 'misc' END"


@q("commands", f"""SELECT step, {CFAMILY} || '|' || CASE WHEN exit_code = 0 THEN 'ok' WHEN exit_code >= 128 THEN 'crash' WHEN timed_out THEN 'timeout' ELSE 'rc' || exit_code END
    || '|' || CASE WHEN stdout = '' THEN 0 ELSE least(12, CAST(floor(log2(length(stdout))) AS INT) + 1) END || '|' || (stderr <> '') AS signature FROM commands""")
def learn_signature(t):
    rows = t.commands().withColumn("toks", C.tokens("command"))
    fam = C.family(C.primary_program(F.col("toks")))
    return rows.select("step", O.command_signature(fam, F.col("exit_code"), F.col("timed_out"), F.col("stdout"), F.col("stderr")).alias("signature"))


TOKS = "CASE event_type WHEN 'click' THEN 3 WHEN 'error' THEN 8 WHEN 'view' THEN 5 ELSE 3 END"
FAMS = ", ".join(flag(f"fam = '{f}'") for f in C.FAMILY_ORDER)
BITS = ", ".join(flag("fam IN (" + ", ".join(f"'{f}'" for f, b in C.INTENTS.items() if b[i]) + ")") for i in range(6))


@q("commands", f"""SELECT step, {PROGRAM} AS program, {shown(', '.join([FAMS, BITS, f'least({TOKS} / 8, 1)', 'least(length(command) / 80, 1)',
    "CASE event_type WHEN 'click' THEN 0.25 WHEN 'error' THEN 0.5 WHEN 'purchase' THEN 0.25 ELSE 0 END", flag("event_type = 'error'"), flag("event_type = 'view'"), '0', '0',
    "CASE event_type WHEN 'click' THEN 1.0/3 WHEN 'error' THEN 1.0/3 WHEN 'view' THEN 1.0/3 ELSE 0 END", "CASE event_type WHEN 'error' THEN 1.0/3 WHEN 'purchase' THEN 1.0/3 WHEN 'signup' THEN 1.0/3 ELSE 0 END",
    '0', '0', flag("event_type = 'signup'"), '0', flag("fam <> 'misc'"), flag("event_type = 'purchase'")]))} AS features FROM (SELECT *, {CFAMILY} AS fam FROM commands)""")
def learn_command_features(t):
    rows = t.commands().select("step", "command", C.tokens("command").alias("toks"))
    return rows.select("step", C.primary_program(F.col("toks")).alias("program"), show(C.features(F.col("command"), F.col("toks"))).alias("features"))


@q("commands", f"""SELECT step, {shown(', '.join(['least(exit_code / 128, 1)', flag('exit_code = 0'), flag('exit_code >= 128'), flag('timed_out'), 'least(length(stdout) / 500, 1)', 'least(length(stderr) / 500, 1)',
    "least((length(stdout) - length(replace(stdout, chr(10), ''))) / 50, 1)", flag("contains(low, 'error')"), flag("contains(low, 'not found') OR contains(low, 'no such')"),
    flag("regexp_matches(substr(stdout, 1, 200), '[0-9]')"), flag("regexp_matches(stdout, '[^ \\t\\n\\r]')"), flag("stderr <> ''"), 'least(duration / 8, 1)', flag('length(stdout) > 2000'), flag("exit_code = 0 AND NOT regexp_matches(stdout, '[^ \\t\\n\\r]')"), '1']))} AS features
    FROM (SELECT *, lower(stdout || ' ' || stderr) AS low FROM commands)""")
def runs_command_outcome_features(t):
    r = {c: F.col(c) for c in ("exit_code", "timed_out", "stdout", "stderr", "duration")}
    v = O.command_outcome_features({**r, "destructive": C.destructive(F.col("command"))})
    picked = [0, 1, 2, 3, 4, 5, 6, 8, 9, 12, 13, 14, 15, 21, 22, 23]
    return t.commands().select("step", v.alias("v")).select("step", show(F.array(*[F.col("v")[i] for i in picked])).alias("features"))


@q("commands", """SELECT campaign, command, step, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY campaign ORDER BY step) AS INT) AS rank FROM (
    SELECT campaign, command, min(step) AS step FROM commands WHERE exit_code = 0 GROUP BY ALL))""")
def learn_library(t):
    return learn.library(t.commands(), KEYS)


@q("commands", """SELECT campaign, path, seen.s AS step, CAST(row_number() OVER (PARTITION BY campaign ORDER BY seen) AS INT) AS rank FROM (
    SELECT campaign, path, min({'s': step, 'p': pos}) AS seen FROM (SELECT campaign, step, unnest(l) AS path, generate_subscripts(l, 1) AS pos
    FROM (SELECT campaign, step, regexp_extract_all(stdout, '/[A-Za-z0-9_./-]+') AS l FROM commands))
    WHERE path NOT IN ('~', '/tmp', '/etc/hostname', '/proc/cpuinfo') GROUP BY ALL)""")
def learn_harvested_paths(t):
    return learn.harvested_paths(t.commands(), KEYS).select("campaign", "path", "step", "rank")


# annotations -------------------------------------------------------------------------------------
def _status_facts(t):
    v = runs.verdict(t.emu_runs())
    return v, annotate.as_facts(v.select("binary", "addr", F.col("verdict").alias("status"), F.col("unique_crashes").alias("crashes"), "crash_input"), ["binary", "addr"])


FACTS = VERDICT + """, fa AS (SELECT binary, addr, 'status' AS key, verdict AS value FROM vd UNION ALL SELECT binary, addr, 'crashes', CAST(unique_crashes AS VARCHAR) FROM vd
    UNION ALL SELECT binary, addr, 'crash_input', crash_input FROM vd WHERE crash_input IS NOT NULL)"""


def _known(t):
    return t.emu_runs().select("binary", "addr").distinct().filter("addr % 2 = 0").withColumn("name", F.concat_ws("_", F.lit("n"), "addr"))


@q("emu_runs", """SELECT binary, addr, 'dyn_' || key AS key, value FROM fa WHERE addr % 2 = 0
    UNION ALL SELECT DISTINCT binary, addr, 'dyn_updated', '2024-01-02T03:04:05' FROM fa WHERE addr % 2 = 0""", FACTS)
def annotate_write(t):
    return annotate.write(_known(t), _status_facts(t)[1], now=F.lit("2024-01-02 03:04:05").cast("timestamp"))


@q("emu_runs", """SELECT binary, addr, 'dyn_note' AS key, 'x' AS value FROM vd WHERE addr % 4 = 0
    UNION ALL SELECT binary, addr, 'dyn_updated', '2024-01-02T03:04:05' FROM vd WHERE addr % 4 = 0""", VERDICT)
def annotate_write_by_name(t):
    facts = t.emu_runs().select("binary", "addr").distinct().filter("addr % 4 = 0 or addr % 4 = 1").select(
        "binary", F.concat_ws("_", F.lit("n"), "addr").alias("name"), F.lit("dyn_note").alias("key"), F.lit("x").alias("value"))
    return annotate.write(_known(t), facts, by="name", now=F.lit("2024-01-02 03:04:05").cast("timestamp"))


@q("emu_runs", "SELECT binary, count(*) AS matched FROM vd WHERE addr % 2 = 0 GROUP BY binary", VERDICT)
def annotate_matched(t):
    return annotate.matched(_known(t), _status_facts(t)[1])


@q("emu_runs", """SELECT binary, addr, 'dyn_' || key AS key, CASE WHEN key = 'status' AND addr % 3 = 0 THEN 'manual' ELSE value END AS value FROM fa""", FACTS)
def annotate_merge(t):
    rows = _status_facts(t)[1].withColumn("key", F.concat(F.lit("dyn_"), "key"))
    new = rows.filter("key = 'dyn_status' and addr % 3 = 0").withColumn("v", F.explode(F.array(F.lit(2), F.lit(1))))
    return annotate.merge(rows, new.withColumn("value", F.when(F.col("v") == 2, "manual").otherwise("stale")), "v")


@q("emu_runs", """SELECT binary, addr, 'dyn_' || key AS key, value FROM fa WHERE addr % 3 <> 0
    UNION ALL SELECT binary, addr, 'own_size', '1' FROM vd""", FACTS)
def annotate_clear(t):
    v, facts = _status_facts(t)
    rows = facts.withColumn("key", F.concat(F.lit("dyn_"), "key")).unionByName(
        v.select("binary", "addr", F.lit("own_size").alias("key"), F.lit("1").alias("value")))
    return annotate.clear(rows, v.filter("addr % 3 = 0").select("binary", "addr"))


def _wide(t):
    v, facts = _status_facts(t)
    ran = v.filter("addr % 5 = 0").select("binary", "addr", F.lit("live_ran").alias("key"), F.lit("true").alias("value"))
    rows = facts.unionByName(ran).withColumn("key", F.concat(F.lit("dyn_"), "key"))
    return annotate.wide(annotate.read(rows))


@q("emu_runs", "SELECT binary, addr, verdict AS status, unique_crashes AS crashes, addr % 5 = 0 AS live_ran, crash_input FROM vd", VERDICT)
def annotate_wide(t):
    return _wide(t)


@q("emu_runs", """SELECT binary, count(*) AS functions_analyzed, count(*) FILTER (addr % 5 = 0) AS live_traced, count(*) FILTER (verdict = 'candidate_crash') AS candidate_crash,
    count(*) FILTER (verdict = 'needs_state') AS needs_state, count(*) FILTER (verdict = 'exercised_clean') AS exercised_clean,
    count(*) FILTER (verdict = 'inconclusive') AS inconclusive FROM vd GROUP BY binary""", VERDICT)
def annotate_overview(t):
    return annotate.overview(_wide(t))


@q("emu_runs", """SELECT binary, rank, addr, unique_crashes AS crashes, verdict AS status FROM (SELECT *, CAST(row_number() OVER (PARTITION BY binary ORDER BY unique_crashes DESC, addr) AS INT) AS rank
    FROM vd WHERE unique_crashes > 0) WHERE rank <= 15""", VERDICT)
def annotate_top_crashes(t):
    return annotate.top_crashes(_wide(t))


@q("emu_runs", """SELECT binary, rank, addr, verdict AS status, unique_crashes AS crashes, crash_input FROM (SELECT *, CAST(row_number() OVER (PARTITION BY binary
    ORDER BY unique_crashes DESC, verdict, addr) AS INT) AS rank FROM vd WHERE verdict IN ('candidate_crash', 'needs_state')) WHERE rank <= 15""", VERDICT)
def annotate_risk(t):
    return annotate.risk(_wide(t))


@q("fuzz_runs", f"""SELECT campaign, true AS reachable, unique_crashes > 0 AS crashes, coalesce(kinds, '') AS crash_kinds, functions_covered, unique_crashes, sample_crash_input,
    CASE WHEN unique_crashes > 0 THEN 'crashes on fuzzed input' ELSE 'exercised, no crash found' END AS verdict FROM sm LEFT JOIN (
    SELECT campaign, array_to_string(list_sort(list_distinct(list({KIND}))), ',') AS kinds, hex(arg_min(payload, step)) AS sample_crash_input FROM fuzz_runs WHERE exit_code >= 128 GROUP BY 1) USING (campaign)""", SUMMARY)
def annotate_campaign_facts(t):
    bad = _fuzz_crashes(t)
    out = annotate.campaign_facts(runs.summary(t.fuzz_runs(), bad, KEYS), runs.unique_crashes(bad, KEYS), KEYS)
    return out.withColumn("crash_kinds", F.array_join("crash_kinds", ","))


# jobs ----------------------------------------------------------------------------------------------
def _log(t):
    k, i = F.col("k").cast("string"), F.col("event_id").cast("string")
    line = (F.when(F.col("event_type") == "view", F.concat(F.lit("saved db -> /out/"), i, F.lit(".i64")))
            .when(F.col("event_type") == "click", F.concat(F.lit("total wall: "), k, F.lit(".5s for 1,"), F.lpad(k, 3, "0"), F.lit(" funcs")))
            .when(F.col("event_type") == "error", F.concat(F.lit("["), k, F.lit("/100 shards] x"))).when(F.col("event_type") == "signup", "").otherwise("noise"))
    return t.ev().select(F.col("user_id").alias("job_id"), F.col("event_id").alias("line_no"), line.alias("line"))


@q("ev", """SELECT user_id AS job_id, arg_max('/out/' || event_id || '.i64', event_id) FILTER (event_type = 'view') AS saved_path,
    arg_max(k + 0.5::DOUBLE, event_id) FILTER (event_type = 'click') AS wall_s, arg_max(1000 + k, event_id) FILTER (event_type = 'click') AS funcs,
    CAST(arg_max(k, event_id) FILTER (event_type = 'error') AS INT) AS shards_done, CASE WHEN count(*) FILTER (event_type = 'error') > 0 THEN 100 END AS shards_total FROM ev GROUP BY user_id
    HAVING count(*) FILTER (event_type <> 'signup') > 0""")
def jobs_parse_log(t):
    return jobs.parse_log(_log(t))


@q("ev", """SELECT user_id AS job_id, event_id AS line_no FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM ev WHERE event_type <> 'signup') WHERE r <= 40""")
def jobs_tail(t):
    return jobs.tail(_log(t)).select("job_id", "line_no")


@q("ev", """SELECT user_id AS job_id, arg_max(event_type, event_id) AS status, 'b' || arg_max(k, event_id) AS binary, arg_max(k, event_id) || '%' AS progress FROM ev GROUP BY user_id""")
def jobs_status(t):
    k = F.col("k").cast("string")
    e = t.ev().select(F.col("user_id").alias("job_id"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("status"),
                      F.concat(F.lit("b"), k).alias("binary"), F.concat(k, F.lit("%")).alias("progress"))
    return jobs.status(e).drop("created")


@q("ev", """SELECT user_id, event_id, CAST(sum(ok) OVER w AS BIGINT) AS processed, CAST(sum(1 - ok) OVER w AS BIGINT) AS errors,
    round(coalesce(sum(ok * value) OVER w / nullif(sum(ok) OVER w, 0), 0), 9) AS avg_latency_ms FROM (SELECT *, CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS ok FROM ev)
    WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def jobs_latency(t):
    e = t.ev().select("user_id", "event_id", (F.col("event_type") != "error").alias("ok"), F.col("value").alias("latency_ms"))
    return jobs.latency(e, ["user_id"], "event_id").select("user_id", "event_id", "processed", "errors", F.round("avg_latency_ms", 9).alias("avg_latency_ms"))
