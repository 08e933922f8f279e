"""Fingerprints, cosine search, matches and the identity table."""
from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import text as T, vectors as V
from ...operators import kb, match, similarity
from ...sources.tables import normalize_matches
from ._register import Catalog

QUERIES = Catalog()
q = QUERIES.query

LISTING = ("mov", "add", "sub", "ldr", "cmp", "jmp", "push", "fmul", "xyz", "xor")


def listing():
    """Instruction rows that stand for the words of the text, one per word."""
    names = F.array(*[F.lit(n) for n in LISTING])
    return F.transform(F.split("pseudocode", " "), lambda w: F.struct(
        F.lit("").alias("address"), F.concat(F.element_at(names, F.length(w) % 10 + 1), F.lit("  r0, r1")).alias("text")))


def fingerprinted(t):
    return similarity.fingerprints(t.functions().withColumn("disasm", listing()), t.calls())


# category of each of the ten mnemonics above
CATS = "[0, 1, 5, 6, 3, 4, 5, 6, NULL, 2]"
WORDS = "list_transform(regexp_extract_all(coalesce(pseudocode, ''), '[a-zA-Z_][A-Za-z0-9_]*'), lambda x: lower(x))"
KEYS = "[" + ", ".join(f"'{k.lower()}'" for k in V.KEYWORDS) + "]"


@q("functions", f"""SELECT binary, addr, array_to_string(list_transform(range(0, 7), lambda i: printf('%.6f', round(
        CASE WHEN length(c) = 0 THEN 0 ELSE length(list_filter(c, lambda x: x = i)) / length(c) END, 6))), ',') AS mnemonics,
    array_to_string(list_transform({KEYS}, lambda k: printf('%.6f', round(length(list_filter(w, lambda x: x = k)) / greatest(1, length(w)), 6))), ',') AS keywords,
    printf('%.6f', least(1, ln(1 + size) / ln(10001))) AS log_size FROM (SELECT *, {WORDS} AS w, list_filter(list_transform(
        CASE WHEN pseudocode IS NULL THEN [] ELSE string_split(pseudocode, ' ') END, lambda x: ({CATS})[length(x) % 10 + 1]), lambda x: x IS NOT NULL) AS c FROM functions)""")
def fingerprint_parts(t):
    fns = t.functions().withColumn("d", F.coalesce(listing(), F.array().cast("array<struct<address:string,text:string>>")))
    def show(col):
        return F.array_join(F.transform(col, lambda x: F.format_string("%.6f", F.round(x.cast("double"), 6))), ",")
    return fns.select("binary", "addr", show(V.mnemonic_histogram(F.col("d"))).alias("mnemonics"),
                      show(V.keyword_frequencies(F.coalesce("pseudocode", F.lit("")))).alias("keywords"),
                      F.format_string("%.6f", V.log_scale(F.col("size"))).alias("log_size"))


@q("code", """SELECT doc_id, array_to_string(list_transform(range(0, 8), lambda b: printf('%.6f', round(length(list_filter(l, lambda x: x = b)) / greatest(1, length(l)), 6))), ',') AS buckets
    FROM (SELECT doc_id, list_transform(regexp_extract_all(code, '"([^"]{1,200})"', 1), lambda s: CAST('0x' || right(md5(s), 1) AS INT) % 8) AS l FROM code)""")
def fingerprint_buckets(t):
    found = T.matches(F.col("code"), T.QUOTED, 1)
    return t.code().select("doc_id", F.array_join(F.transform(
        V.hash_buckets(found), lambda x: F.format_string("%.6f", F.round(x.cast("double"), 6))), ",").alias("buckets"))


@q()
def fingerprint_vectors(t):
    """The full 104-value vector of every function (dimension checked here, values in the tests)."""
    fp = fingerprinted(t)
    return fp.select("binary", "addr", F.size("vector").alias("dim"), F.round(V.dot(F.col("vector"), F.col("vector")), 6).alias("norm2"))


TOPK = """SELECT q_binary, q_addr, binary, addr, similarity, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY q_binary, q_addr
    ORDER BY similarity DESC, binary, addr) AS INT) AS rank FROM (SELECT q.binary AS q_binary, q.addr AS q_addr, v.binary, v.addr,
    round(list_cosine_similarity(q.vector, v.vector), 6) AS similarity FROM vectors q JOIN vectors v ON v.binary <> q.binary))
    WHERE similarity >= 0 AND rank <= {k}"""


@q("vectors", TOPK.format(k=5))
def similarity_topk(t):
    return similarity.topk(t.vectors(), t.vectors(), 5)


@q("vectors", "SELECT binary, count(*) AS queries, true AS enough FROM vectors WHERE addr % 50 = 0 GROUP BY binary")
def similarity_topk_approximate(t):
    """Approximate search for all rows; its recall is measured against the exact search for one query in fifty of each binary."""
    found = similarity.approximate_topk(t.vectors(), t.vectors(), 5)
    v = t.vectors()
    recall = similarity.search_recall(found, v, v, k=5)
    asked = v.filter(F.col("addr") % 50 == 0).groupBy("binary").agg(F.count("*").alias("queries"))
    return asked.join(F.broadcast(recall.select((F.col("recall") >= 0.9).alias("enough"))))


@q("vectors", """SELECT 'B1' AS binary, count(*) AS hits, round(sum(similarity), 4) AS total FROM (SELECT round(list_cosine_similarity(q.vector, v.vector), 6) AS similarity,
    row_number() OVER (PARTITION BY q.binary, q.addr ORDER BY round(list_cosine_similarity(q.vector, v.vector), 6) DESC, v.addr) AS rank
    FROM vectors q JOIN vectors v ON v.binary = 'B1' WHERE list_cosine_similarity(q.vector, v.vector) >= 0) WHERE rank <= 3""")
def similarity_within(t):
    return (similarity.within(t.vectors(), t.vectors(), "B1", 3).groupBy("binary")
            .agg(F.count("*").alias("hits"), F.round(F.sum("similarity"), 4).alias("total")))


BEST = f"best AS ({TOPK.format(k=1)})"


@q("vectors", """SELECT a.q_binary, a.q_addr, a.binary, a.addr, a.similarity FROM best a JOIN best b
    ON a.q_binary = b.binary AND a.q_addr = b.addr AND a.binary = b.q_binary AND a.addr = b.q_addr""", BEST)
def similarity_mutual_best(t):
    return similarity.mutual_best(t.vectors(), t.vectors())


@q("vectors", """SELECT count(*) AS total_pairs, count(*) FILTER (r = 1) AS correct_at_1, count(*) FILTER (r IS NOT NULL) AS correct_at_5,
    count(*) FILTER (r = 1) / greatest(1, count(*)) AS recall_at_1, count(*) FILTER (r IS NOT NULL) / greatest(1, count(*)) AS recall_at_5 FROM (
    SELECT p.*, (SELECT rank FROM top b WHERE b.q_binary = p.binary_b AND b.q_addr = p.addr_b AND b.binary = p.binary_a AND b.addr = p.addr_a) AS r
    FROM (SELECT a.q_binary AS binary_b, a.q_addr AS addr_b, a.binary AS binary_a, CASE WHEN a.q_addr % 3 = 0 THEN a.addr + 1 ELSE a.addr END AS addr_a
        FROM top a WHERE a.rank = 1 + a.q_addr % 2) p)""", f"top AS ({TOPK.format(k=5)})")
def similarity_recall(t):
    top = similarity.topk(t.vectors(), t.vectors(), 5)
    pairs = top.filter(F.col("rank") == 1 + F.col("q_addr") % 2).select(
        F.col("q_binary").alias("binary_b"), F.col("q_addr").alias("addr_b"), F.col("binary").alias("binary_a"),
        F.when(F.col("q_addr") % 3 == 0, F.col("addr") + 1).otherwise(F.col("addr")).alias("addr_a"))
    return similarity.recall(pairs, top)


@q("vectors", """SELECT count(*) AS total, count(DISTINCT binary) AS binaries, count(*) FILTER (addr % 2 = 0) AS verified FROM vectors""")
def similarity_stats(t):
    return similarity.stats(t.vectors().withColumn("verified", F.col("addr") % 2 == 0))


@q("kb_pairs", """SELECT count(*) AS total_pairs, count(*) FILTER (md5(a.text) = md5(b.text || CASE WHEN b.doc_id % 2 = 0 THEN 'x' ELSE '' END)) AS correct,
    count(*) FILTER (md5(a.text) = md5(b.text || CASE WHEN b.doc_id % 2 = 0 THEN 'x' ELSE '' END)) / greatest(1, count(*)) AS recall
    FROM kb_pairs k JOIN documents a ON a.source = k.binary_old AND a.doc_id = k.addr_old JOIN documents b ON b.source = k.binary_new AND b.doc_id = k.addr_new""")
def similarity_eval_hash(t):
    docs = t.read("documents")
    def hashed(text):
        return docs.select(F.col("source").alias("binary"), F.col("doc_id").alias("addr"), F.md5(text.cast("binary")).alias("hash"))
    changed = F.concat("text", F.when(F.col("doc_id") % 2 == 0, "x").otherwise(""))
    pairs = t.kb_pairs().select(F.col("binary_old").alias("binary_a"), F.col("addr_old").alias("addr_a"),
                                F.col("binary_new").alias("binary_b"), F.col("addr_new").alias("addr_b"))
    return similarity.eval_hash(pairs, hashed(F.col("text")), hashed(changed))


@q("vectors", """SELECT a.addr, round(list_cosine_similarity(a.vector, b.vector), 6) AS cosine, round(list_distance(a.vector, b.vector), 6) AS l2
    FROM vectors a JOIN vectors b ON b.addr = a.addr + 1""")
def vector_distances(t):
    v = t.vectors()
    nxt = v.select((F.col("addr") - 1).alias("addr"), F.col("vector").alias("other"))
    return v.join(nxt, "addr").select("addr", F.round(V.cosine(F.col("vector"), F.col("other")), 6).alias("cosine"),
                                      F.round(V.l2(F.col("vector"), F.col("other")), 6).alias("l2"))


GATE = "CASE WHEN ratio >= 0.95 THEN 'auto' WHEN ratio >= 0.8 THEN 'hint' ELSE 'discard' END"


@q("matches", f"""SELECT count(*) AS total_matched, count(*) FILTER (g = 'auto') AS auto_applied, count(*) FILTER (g = 'hint') AS hints,
    count(*) FILTER (g = 'discard') AS discarded FROM (SELECT {GATE} AS g FROM matches)""")
def match_gate(t):
    return match.gate(normalize_matches(t.matches()))


@q("matches", """SELECT address2 AS addr, '  set_name(0x' || printf('%x', address2) || ', "' || replace(name, '"', chr(92) || '"') || '", SN_NOWARN);' AS line
    FROM matches WHERE ratio >= 0.95""")
def match_port_lines(t):
    return match.port_lines(normalize_matches(t.matches()))


@q("matches", "SELECT address2 AS address_new, name AS name_old, round_even(ratio, 3) AS ratio, description FROM matches WHERE ratio >= 0.8 AND ratio < 0.95")
def match_hints(t):
    return match.hints(normalize_matches(t.matches()))


@q("matches", """SELECT 'old' AS binary_a, address AS addr_a, name AS name_a, 'new' AS binary_b, address2 AS addr_b, name2 AS name_b, ratio
    FROM matches WHERE ratio >= 0.95""")
def match_ground_truth(t):
    return match.ground_truth(normalize_matches(t.matches()))


@q("kb_pairs", """SELECT k.binary_old, k.addr_old, k.binary_new, k.addr_new, round(k.similarity, 6) AS similarity, w.source AS w_binary, w.doc_id AS w_addr
    FROM kb_pairs k JOIN documents w ON w.doc_id % 2 = 0 AND ((w.source = binary_old AND w.doc_id = addr_old) OR (w.source = binary_new AND w.doc_id = addr_new))""")
def kb_by_function(t):
    want = t.read("documents").filter("doc_id % 2 = 0").select(F.col("source").alias("binary"), F.col("doc_id").alias("addr"))
    return kb.by_function(t.kb_pairs(), want).drop("verified").withColumn("similarity", F.round("similarity", 6))


@q("kb_pairs", "SELECT binary_old, addr_old, binary_new, addr_new FROM kb_pairs WHERE binary_old = 'src1' OR binary_new = 'src1'")
def kb_by_binary(t):
    return kb.by_binary(t.kb_pairs(), "src1").select("binary_old", "addr_old", "binary_new", "addr_new")


@q("kb_pairs", """SELECT count(*) AS total_pairs, count(*) FILTER (verified) AS verified, count(DISTINCT binary_old) + count(DISTINCT binary_new) AS binaries,
    (SELECT count(DISTINCT b) FROM (SELECT binary_old AS b FROM kb_pairs UNION ALL SELECT binary_new FROM kb_pairs)) AS distinct_binaries FROM kb_pairs""")
def kb_stats(t):
    return kb.stats(t.kb_pairs())
