"""Secret scans, with DataFrame functions only.

Base: assignments to secret names, access keys and hex runs by pattern.  Method: long tokens get an encoding from
their alphabet (hex, base32 and base36 of one case, base64) and go through a battery of randomness tests over its symbols: chi-squared
uniformity, runs about the middle of the alphabet, serial correlation.  The smallest of the three p-values, times
three, is the token's.  Ordinary names fail these tests, random keys pass.  Which tokens count as failed is decided
over all tokens of the document at a false-discovery rate (Benjamini and Hochberg), where p-values are weighted by
length, since a longer token that is not random shows it better.  Tokens that do not fail are added as ``random``.

Positions are code points, the end exclusive.  Null texts count as empty and have no spans.  Each row is judged
alone, so repeated rows, ties and other columns change nothing; a null id stays null.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import as_documents, documents, text_of, whole_rows

#: What each kind matches, and how long its kept part is at least.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
ASSIGN_MIN, ACCESS_MIN, TOKEN_MIN = 6, 20, 20
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "random")
#: Encodings in the order they are tried, smallest alphabet first: name, pattern of the whole token, alphabet.
ENCODINGS = (
    ("hex", r"^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    ("base32", r"^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base32 lower", r"^[a-z2-7]+$", "abcdefghijklmnopqrstuvwxyz234567"),
    ("base36 lower", r"^[a-z0-9]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base36 upper", r"^[A-Z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base64", r"^[A-Za-z0-9+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)
FDR = 0.05
SPAN = "array<struct<s:bigint,k:int,e:bigint>>"
MASK = "[SECRET]"


def _let(value: Column, fn) -> Column:
    """``fn(value)`` with the value computed once."""
    return F.transform(F.array(value), fn)[0]


def _hits(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Spans of all matches of ``pattern``; ``keep`` gives the strings of the matches to be judged and their filter."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(pattern), F.lit(keep[0] if keep else 0))
    parts = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("gap"), found.alias("hit"), judged.alias("part"))
    walked = F.aggregate(
        parts, F.struct(F.lit(0).cast("bigint").alias("at"), F.expr("cast(array() as array<struct<s:bigint,k:int,e:bigint,part:string>>)").alias("out")),
        lambda a, p: _let(a["at"] + F.length(p["gap"]), lambda s: F.struct(
            (s + F.length(p["hit"])).alias("at"),
            F.concat(a["out"], F.array(F.struct(s.alias("s"), F.lit(kind).alias("k"), (s + F.length(p["hit"])).alias("e"), p["part"].alias("part")))).alias("out"))),
        lambda a: a["out"])
    return F.filter(walked, keep[1]) if keep else walked


def _tail(z: Column) -> Column:
    """Two-sided normal tail, by a closed approximation."""
    z = F.abs(z)
    return F.exp(-0.717 * z - 0.416 * z * z)


def _p_value(symbols: Column, k: int) -> Column:
    """Three times the smallest p-value of the battery for symbols 0 to k - 1, at most 1."""
    n = F.size(symbols)
    total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + f(x))
    squares = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(0.0), lambda acc, s: acc + F.pow(F.size(F.filter(symbols, lambda x: x == s)), 2))
    df = k - 1.0
    chi = k * squares / n - n
    high = (F.pow(F.greatest(chi, F.lit(0.0)) / df, 1 / 3) - (1 - 2 / (9 * df))) / (2 / (9 * df)) ** 0.5
    p_chi = F.when(high <= 0, 1.0).otherwise(_tail(high) / 2)
    upper = F.size(F.filter(symbols, lambda x: x >= k // 2))
    expected = 2.0 * upper * (n - upper) / n + 1
    variance = (expected - 1) * (expected - 2) / (n - 1)
    runs = 1 + F.size(F.filter(F.sequence(F.lit(1), n - 1), lambda i: (symbols[i] >= k // 2) != (symbols[i - 1] >= k // 2)))
    p_runs = F.when(variance <= 0, 0.0).otherwise(_tail((runs - expected) / F.sqrt(variance)))
    mean = total(symbols, lambda x: x) / n
    spread = total(symbols, lambda x: (x - mean) * (x - mean))
    together = total(F.sequence(F.lit(1), n - 1), lambda i: (symbols[i] - mean) * (symbols[i - 1] - mean))
    p_serial = F.when(spread <= 0, 0.0).otherwise(_tail(together / spread * F.sqrt(n.cast("double"))))
    return F.least(F.lit(1.0), 3 * F.least(p_chi, p_runs, p_serial))


def _battery(token: Column, digit: bool = True) -> Column:
    """p-value of a token under its encoding; null where its alphabet shows none, as for words of one case."""
    bare = F.translate(F.rtrim(token, F.lit("=")), "-_", "+/")
    mixed = bare.rlike("[0-9]") & bare.rlike("[A-Za-z]")
    both = bare.rlike("[a-z]") & bare.rlike("[A-Z]")
    out = F.lit(None).cast("double")
    for name, pattern, alphabet in reversed(ENCODINGS):
        fits = bare.rlike(pattern) & (mixed if name != "base64" else mixed & both if digit else both)
        out = F.when(fits, _let(_symbols(F.lower(bare) if name == "hex" else bare, alphabet), _tests(len(alphabet)))).otherwise(out)
    return out


def _symbols(text: Column, alphabet: str) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.instr(F.lit(alphabet), F.substring(text, i, F.lit(1))) - 1)


def _tests(k: int):
    return lambda symbols: _p_value(symbols, k)


def _random(text: Column, rate: float, digit: bool = True) -> Column:
    """Spans of tokens that the battery does not tell from random ones."""
    tokens = F.transform(_hits(text, TOKEN, 3), lambda x: F.struct(x["s"], x["k"], x["e"], _battery(x["part"], digit).alias("p")))
    known = F.filter(tokens, lambda x: x["p"].isNotNull())

    def decide(c: Column) -> Column:
        m = F.size(c)
        mean = F.aggregate(c, F.lit(0.0), lambda a, x: a + (x["e"] - x["s"])) / m
        weighted = F.array_sort(F.transform(c, lambda x: x["p"] * mean / (x["e"] - x["s"])))
        passing = F.transform(weighted, lambda q, i: F.when(q <= rate * (i + 1) / m, q))
        return _let(F.coalesce(F.array_max(passing), F.lit(-1.0)), lambda limit: F.transform(
            F.filter(c, lambda x: x["p"] * mean / (x["e"] - x["s"]) > limit), lambda x: F.struct(x["s"], x["k"], x["e"])))
    return _let(known, decide)


def scanned(docs: DataFrame, text: str = "text", rate: float = FDR, digit: bool = True) -> DataFrame:
    """``docs`` with ``_spans``: (start, kind, end) of base and added spans, in order of start and kind.

    Without ``digit``, tokens of letters in both cases are tested too, which the SQL leaves out.
    """
    t = F.col("_t")
    none = F.expr(f"cast(array() as {SPAN})")
    short = lambda n: lambda x: F.length(x["part"]) >= n
    plain = lambda a: F.transform(a, lambda x: F.struct(x["s"], x["k"], x["e"]))
    df = docs.withColumn("_t", text_of(docs, text)).withColumns({
        "_assign": F.when((F.contains(t, F.lit("=")) | F.contains(t, F.lit(":"))) & t.rlike(ASSIGN),
                          plain(_hits(t, ASSIGN, 0, (2, short(ASSIGN_MIN))))).otherwise(none),
        "_access": F.when(F.contains(t, F.lit("AKIA")), plain(_hits(t, ACCESS, 1, (0, short(ACCESS_MIN))))).otherwise(none),
        "_hex": F.when(t.rlike(HEX), plain(_hits(t, HEX, 2))).otherwise(none),
        "_random": F.when(t.rlike(TOKEN), _random(t, rate, digit)).otherwise(none)})
    df = df.withColumn("_base", F.array_sort(F.concat("_assign", "_access", "_hex")))
    added = F.filter("_random", lambda r: ~F.exists("_base", lambda b: (b["s"] <= r["s"]) & (b["e"] >= r["e"])))
    return df.withColumn("_spans", F.array_sort(F.concat("_base", added)))


def as_text(spans: str) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kinds[x["k"]], x["s"], x["e"])), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with each run of touching or overlapping spans replaced by one mark."""
    walked = F.aggregate(spans, F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out")), lambda a, x: F.struct(
        F.greatest(a["at"], x["e"]).alias("at"),
        F.when((x["s"] > a["at"]) | (a["out"] == ""), F.concat(
            a["out"], F.substring(text, (a["at"] + 1).cast("int"), (x["s"] - a["at"]).cast("int")), F.lit(MASK))).otherwise(a["out"]).alias("out")))
    return _let(walked, lambda w: F.concat(w["out"], F.substring(text, (w["at"] + 1).cast("int"), F.length(text))))


def stage(docs: DataFrame) -> DataFrame:
    """Documents with their secrets masked."""
    found = scanned(whole_rows(docs, "text"), digit=False)
    text = F.when(F.size("_spans") > 0, masked(F.col("_t"), F.col("_spans"))).otherwise(F.col("text"))
    return as_documents(found, docs, text=text, n_chars=F.length(text).cast("bigint"))


def op9_secrets(spark, folder):
    return scanned(documents(spark, folder).select("doc_id", "text")).select(
        "doc_id", *[F.size(f"_{k}").cast("bigint").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(as_text("_base"), 256).alias("base_sha256"), as_text("_spans").alias("spans"))


def _sql_hits(kind: int, pattern: str, least: int, group: int = 0) -> str:
    p, size = pattern.replace("'", "''"), lambda part: f"coalesce(list_sum(list_transform({part}, lambda x: len(x))), 0)"
    return f"""SELECT doc_id, {kind} AS k, {size('g[1:i]')} + {size('h[1:i - 1]')} AS s, {size('g[1:i]')} + {size('h[1:i]')} AS e, h[i] AS hit
    FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS h, string_split_regex(t, '{p}') AS g,
        regexp_extract_all(t, '{p}', {group}) AS part FROM d WHERE regexp_matches(t, '{p}'))) WHERE len(part[i]) >= {least}"""


def _sql_case(value) -> str:
    return "CASE " + " ".join(f"WHEN enc = {k} THEN {value(x)}" for k, x in enumerate(ENCODINGS)) + " END"


_TAIL = "exp(-0.717 * abs({0}) - 0.416 * ({0}) * ({0}))"
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS ({_sql_hits(0, ASSIGN, ASSIGN_MIN, 2)} UNION ALL {_sql_hits(1, ACCESS, ACCESS_MIN)} UNION ALL {_sql_hits(2, HEX, 1)}),
t0 AS (SELECT doc_id, s, e, replace(replace(rtrim(hit, '='), '-', '+'), '_', '/') AS bare FROM ({_sql_hits(3, TOKEN, 1)})),
t1 AS (SELECT *, CASE {" ".join(f"WHEN regexp_matches(bare, '{pattern}')" + (" AND regexp_matches(bare, '[a-z]') AND regexp_matches(bare, '[A-Z]')" if name == "base64" else "") + f" THEN {k}" for k, (name, pattern, _) in enumerate(ENCODINGS))} END AS enc
    FROM t0 WHERE regexp_matches(bare, '[0-9]') AND regexp_matches(bare, '[A-Za-z]')),
t2 AS (SELECT *, len(bare) AS n, {_sql_case(lambda x: len(x[2]))} AS k, {_sql_case(lambda x: f"'{x[2]}'")} AS alphabet FROM t1 WHERE enc IS NOT NULL),
t3 AS (SELECT *, list_transform(string_split(CASE WHEN enc = 0 THEN lower(bare) ELSE bare END, ''), lambda c: instr(alphabet, c) - 1) AS v FROM t2),
t4 AS (SELECT *, k * list_sum(list_transform(range(k), lambda x: pow(len(list_filter(v, lambda y: y = x)), 2))) / n - n AS chi,
    len(list_filter(v, lambda x: x >= k // 2)) AS up, 1 + len(list_filter(range(2, n + 1), lambda i: (v[i] >= k // 2) <> (v[i - 1] >= k // 2))) AS runs,
    list_avg(v) AS mean FROM t3),
t5 AS (SELECT *, 2.0::DOUBLE * up * (n - up) / n + 1 AS mu, list_sum(list_transform(v, lambda x: (x - mean) * (x - mean))) AS spread,
    list_sum(list_transform(range(2, n + 1), lambda i: (v[i] - mean) * (v[i - 1] - mean))) AS together,
    (pow(greatest(chi, 0) / (k - 1), 1.0::DOUBLE / 3) - (1 - 2.0::DOUBLE / (9 * (k - 1)))) / sqrt(2.0::DOUBLE / (9 * (k - 1))) AS high FROM t4),
t6 AS (SELECT doc_id, s, e, least(1, 3 * least(CASE WHEN high <= 0 THEN 1 ELSE {_TAIL.format("high")} / 2 END,
    CASE WHEN (mu - 1) * (mu - 2) / (n - 1) <= 0 THEN 0 ELSE {_TAIL.format("(runs - mu) / sqrt((mu - 1) * (mu - 2) / (n - 1))")} END,
    CASE WHEN spread <= 0 THEN 0 ELSE {_TAIL.format("together / spread * sqrt(n)")} END)) AS p FROM t5),
t7 AS (SELECT *, p * avg(e - s) OVER (PARTITION BY doc_id) / (e - s) AS q, count(*) OVER (PARTITION BY doc_id) AS m FROM t6),
t8 AS (SELECT *, q <= {FDR} * row_number() OVER (PARTITION BY doc_id ORDER BY q) / m AS fails FROM t7),
r AS (SELECT doc_id, 3 AS k, s, e FROM (SELECT *, max(q) FILTER (fails) OVER (PARTITION BY doc_id) AS bar FROM t8) x WHERE q > coalesce(bar, -1)
    AND NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = x.doc_id AND b.s <= x.s AND b.e >= x.e)),
a AS (SELECT doc_id, k, s, e FROM b UNION ALL SELECT * FROM r),
o AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    string_agg(span, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(span, ',' ORDER BY s, k) AS spans
    FROM (SELECT *, ['assign', 'access', 'hex', 'random'][k + 1] || ':' || s || ':' || e AS span FROM a) GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN o USING (doc_id)"""
