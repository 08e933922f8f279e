"""Pseudocode text, prompts and response parsing over whole documents, pages and conversations."""
from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import text as T
from ...operators import verify
from ._register import Catalog

QUERIES = Catalog()
q = QUERIES.query


def joined(col, sep="|"):
    return F.array_join(F.transform(col, lambda x: x.cast("string")), sep)


def firsts(source: str, key: str, items: str, keep: str) -> str:
    """SQL for 'distinct in first-seen order, joined' over a list expression."""
    return f"""SELECT {key}, coalesce(out, '') AS items FROM (SELECT DISTINCT {key} FROM {source}) LEFT JOIN (
        SELECT {key}, string_agg(s, '|' ORDER BY p) AS out FROM (
            SELECT {key}, s, min(p) AS p FROM (SELECT {key}, unnest(l) AS s, generate_subscripts(l, 1) AS p FROM (
                SELECT {key}, {items} AS l FROM {source})) WHERE {keep} GROUP BY {key}, s) GROUP BY {key}) USING ({key})"""


QUOTED = """regexp_extract_all({c}, '"([^"]{{1,200}})"', 1)"""
KEEP = r"""length(s) >= 2 AND NOT regexp_full_match(s, '["%# +\-0-9.*hlLzjt]*[diouxXeEfFgAcspn%]')"""


@q("", firsts("pages", "page_id", QUOTED.format(c="html"), KEEP))
def text_strings_pages(t):
    return t.spread("pages").select("page_id", joined(T.strings(F.col("html"))).alias("items"))


@q("code", firsts("code", "doc_id", QUOTED.format(c="code"), KEEP))
def text_strings_code(t):
    return t.code().select("doc_id", joined(T.strings(F.col("code"))).alias("items"))


@q("code", firsts("code", "doc_id", r"""list_transform(regexp_extract_all(code, '\b0x([0-9a-fA-F]{2,})\b', 1), lambda x: CAST(CAST('0x' || x AS BIGINT) AS VARCHAR))
    || list_transform(regexp_extract_all(code, '\b(-?[0-9]{4,})\b', 1), lambda x: CAST(CAST(x AS HUGEINT) AS VARCHAR))""",
    "s NOT IN ('0', '1', '-1', '2', '4', '8', '255', '65535', '4294967295', '18446744073709551615')"))
def text_constants(t):
    return t.code().select("doc_id", joined(T.constants(F.col("code"))).alias("items"))


COUNT = "CAST((length({c}) - length(replace({c}, '{w}', ''))) / {n} AS INT)"


def count(word: str, col: str = "code") -> str:
    return COUNT.format(c=col, w=word, n=len(word))


LINES = "(length(code) - length(replace(code, chr(10), '')) + 1)"
BRANCHES = f"({count('if')} + {count('else')} + {count('switch')})"
LOOPS = f"({count('for')} + {count('while')})"
FORBIDDEN = " OR ".join(f"contains(lower(code), '{w}')" for w in T.FORBIDDEN)
LEVEL = " ".join(f"WHEN {LINES} <= {a} AND {BRANCHES} <= {b} AND {LOOPS} <= {c} THEN '{n}'" for n, a, b, c in (
    ("trivial", 5, 0, 0), ("simple", 15, 2, 0), ("moderate", 30, 5, 1), ("complex", 50, 10, 3)))


@q("code", f"""SELECT doc_id, code <> '' AND NOT ({FORBIDDEN}) AND {BRANCHES} <= 10 AND {LINES} <= 50 AS eligible, level,
    CASE WHEN level IN ('trivial', 'simple') THEN 'easy' WHEN level = 'moderate' THEN 'medium' ELSE 'hard' END AS difficulty
    FROM (SELECT *, CASE {LEVEL} ELSE 'very_complex' END AS level FROM code)""")
def text_complexity(t):
    c = F.col("code")
    return t.code().withColumn("level", T.complexity(c)).select(
        "doc_id", T.eligible(c).alias("eligible"), "level", T.difficulty(F.col("level")).alias("difficulty"))


@q("", f"""SELECT doc_id, {LINES.replace('code', 'text')} AS lines, {BRANCHES.replace('code', 'text')} AS branches,
    {LOOPS.replace('code', 'text')} AS loops FROM documents""")
def text_counts(t):
    c = F.col("text")
    return t.spread("documents").select("doc_id", T.line_count(c).alias("lines"), T.branch_count(c).alias("branches"),
                                      T.loop_count(c).alias("loops"))


SKIP = ", ".join(f"'{w}'" for w in T.CALL_SKIP)


@q("code", rf"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(code, '\b([a-zA-Z_]\w*)\s*\(', 1),
    lambda n: n NOT IN ({SKIP}) AND regexp_matches(n, '^[A-Z]')))), '|') AS calls FROM code""")
def text_external_calls(t):
    return t.code().select("doc_id", joined(T.external_calls(F.col("code"))).alias("calls"))


SYM_SKIP = ", ".join(f"'{w}'" for w in T.SYMBOL_SKIP)
SYMBOLS = rf"""list_sort(list_distinct(list_filter(regexp_extract_all(code, '\b([a-zA-Z_]\w*(?:::[a-zA-Z_]\w*)*)\s*\(', 1),
    lambda n: n NOT IN ({SYM_SKIP}) AND (contains(n, '::') OR contains(n, '_') OR NOT regexp_matches(n, '^[a-z]')))
    || regexp_extract_all(code, '(?:\(|\s)([A-Z]\w*(?:::[A-Z]\w*)*)\s*\*', 1)))"""
TYPES = r"""list_sort(list_distinct(regexp_extract_all(code, 'typedef\s+\w+\s+(\w+)', 1)
    || regexp_extract_all(code, 'struct\s+(\w+)', 1) || regexp_extract_all(code, 'class\s+(\w+)', 1)))"""


@q("code", f"SELECT doc_id, array_to_string({SYMBOLS}, '|') AS symbols, array_to_string({TYPES}, '|') AS types FROM code")
def text_symbols(t):
    c = F.col("code")
    return t.code().select("doc_id", joined(T.symbols(c)).alias("symbols"), joined(T.declared_types(c)).alias("types"))


@q("code", f"""SELECT doc_id, array_to_string(list_transform(list_filter({SYMBOLS}, lambda s: NOT list_contains({TYPES}, s)
    AND s NOT IN ('ThisStruct', 'operator_new')), lambda s: '// Stub for ' || s || chr(10) || 'long long ' || replace(s, '::', '_')
    || '(long long* args) {{ return 0; }}'), chr(10)) AS stubs FROM code""")
def text_stubs(t):
    return t.code().select("doc_id", T.stubs(F.col("code")).alias("stubs"))


@q("code", f"""SELECT symbol, CASE WHEN size IS NULL THEN '// Stub for ' || symbol WHEN size > 0 THEN '// ' || symbol || ' (size: ' || size || ' bytes)'
    ELSE '// ' || symbol END || chr(10) || 'long long ' || replace(symbol, '::', '_') || '(long long* args) {{ return 0; }}' AS stub
    FROM (SELECT DISTINCT unnest({SYMBOLS}) AS symbol FROM code) LEFT JOIN (
        SELECT DISTINCT 'Foo' || (s_suppkey % 8) || '::Run' AS symbol, (s_suppkey % 8) * 16 AS size FROM supplier) USING (symbol)""")
def verify_stubs(t):
    known = t.read("supplier").select(
        F.concat(F.lit("Foo"), (F.col("s_suppkey") % 8).cast("string"), F.lit("::Run")).alias("symbol"),
        (F.col("s_suppkey") % 8 * 16).alias("size")).distinct()
    return verify.stubs(t.code().select(F.explode(T.symbols(F.col("code"))).alias("symbol")), known)


@q("", """SELECT doc_id, round(coalesce(-sum(p * log2(p)), 0), 6) AS entropy FROM documents LEFT JOIN (
    SELECT doc_id, n / sum(n) OVER (PARTITION BY doc_id) AS p FROM (SELECT doc_id, c, count(*) AS n FROM (
        SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents) GROUP BY ALL)) USING (doc_id) GROUP BY doc_id""")
def text_entropy(t):
    return t.spread("documents").select("doc_id", F.round(T.entropy(F.col("text")), 6).alias("entropy"))


@q("functions", """SELECT binary, addr, 'Calls: ' || name || chr(10) || 'Called by: none' || chr(10) || chr(10) || 'Assembly:' || chr(10)
    || array_to_string(list_transform(list_slice(string_split(pseudocode, ' '), 1, 80), lambda w, i:
        '  ' || lpad('0x' || printf('%x', i - 1), 16, ' ') || '  ' || w), chr(10)) || chr(10) || chr(10) || 'Name this function:' AS prompt,
    'Ctx' || chr(10) || chr(10) || 'Pseudocode:' || chr(10) || '```c' || chr(10) || substr(pseudocode, 1, 2000) || chr(10) || '```' || chr(10) || chr(10)
    || 'Proposed function name:' AS request FROM functions WHERE pseudocode IS NOT NULL""")
def text_prompts(t):
    words = F.transform(F.split("pseudocode", " "), lambda w, i: F.struct(
        F.concat(F.lit("0x"), F.lower(F.hex(i))).alias("address"), w.alias("text")))
    return t.functions().filter("pseudocode is not null").select(
        "binary", "addr", T.prompt(words, F.array("name"), F.array().cast("array<string>")).alias("prompt"),
        T.pseudocode_prompt(F.col("pseudocode"), F.lit("Ctx")).alias("request"))


@q("responses", r"""SELECT conv_id, turn, list_filter(list_transform(list_filter(list_transform(string_split_regex(response, '\r\n|\r|\n'),
    lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: starts_with(upper(x), 'NAME:')),
    lambda x: string_split_regex(regexp_replace(substr(x, 6), '^\s+', ''), '\s+')[1]), lambda x: regexp_full_match(x, '[A-Za-z_][A-Za-z0-9_]*'))[1] AS name,
    CASE WHEN contains(response, 'REASON:') THEN regexp_replace(substr(response, CAST(instr(response, 'REASON:') + 7 AS INT)), '^\s+|\s+$', '', 'g') ELSE '' END AS reason,
    substr(regexp_replace(string_split_regex(regexp_replace(regexp_replace(response, '(?s)<think>.*?</think>', '', 'g'), '^\s+|\s+$', '', 'g'),
        '\r\n|\r|\n')[1], '^\s+|\s+$', '', 'g'), 1, 80) AS first_line FROM responses""")
def text_parse_response(t):
    r = F.col("response")
    return t.responses().select("conv_id", "turn", T.response_name(r).alias("name"), T.response_reason(r).alias("reason"),
                                T.response_first_line(r).alias("first_line"))


@q("code", r"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(code,
    '\*\(\(\w+\s*\*?\)\s*\(this\s*\+\s*([0-9]+)\)', 1), lambda x: 131072 + CAST(x AS BIGINT))
    || list_transform(regexp_extract_all(code, '\*\(\(_DWORD\s*\*\)\s*\(this\s*\+\s*([0-9]+)\)', 1), lambda x: 131072 + 4 * CAST(x AS BIGINT)))), '|') AS fields,
    '_DWORD:' || (doc_id % 64) || '|T' || (doc_id % 3) || ':' || (doc_id % 32) AS layout FROM code""")
def text_struct_layout(t):
    c = F.col("code")
    lay = F.array_join(F.transform(T.struct_layout(c), lambda s: F.concat(
        s["type"], F.lit(":"), F.array_join(F.transform(s["offsets"], lambda o: o.cast("string")), ","))), "|")
    return t.code().select("doc_id", joined(T.field_addresses(c)).alias("fields"), lay.alias("layout"))


@q("ev", """SELECT event_id, array_to_string(list_filter([CASE WHEN k * 500 > 4096 THEN '0' END, CASE WHEN event_id > 4096 THEN '1' END],
    lambda x: x IS NOT NULL), '|') AS pointers FROM ev""")
def text_pointer_args(t):
    return t.ev().select("event_id", joined(T.pointer_args(F.array(F.col("k") * 500, F.col("event_id")))).alias("pointers"))
