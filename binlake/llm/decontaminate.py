"""Benchmark decontamination with a broadcast hash set of normalised windows, with DataFrame functions only.

Texts are lower-cased (A-Z only) and cut into words.  Ten consecutive words of a benchmark item are a window; an item
of fewer words is one window.  The distinct windows form a hash set that is broadcast.  One scan of the training texts
hashes every window of the lengths that occur and probes the set; a hit is verified on the words themselves.  What
leaves the scan is one header per row and the verified hits, so texts are not shuffled and no window is hot.

*Bound.*  The set is broadcast only up to ``SET_BYTES`` of it; a larger one is split by hash, and each part is probed in
a scan of its own.  *Hot windows.*  Items that hold a window are kept as rows under a digest of the items, and the items of
a document are looked up once per distinct combination of digests, so a passage that a third of all documents or items
share costs one lookup.

``judged`` gives the words, hits and items of each row of ``docs``, ``clean`` the documents without the hit words
or without the hit documents.  Null and empty texts have no words and no hits; an empty benchmark hits nothing.
Long texts are judged whole, in one row.  A null id stays null; a null item id counts as the id ''.  Repeated rows are
judged each; rows of one id and different texts are different documents, items of one id are one item.  Other columns of
``docs`` are kept by ``clean`` under any name.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import as_documents, cut, documents, small_letters, text_of, whole_rows

WINDOW, SET_BYTES = 10, 32 << 20
#: Characters of words before lower-casing, and what lies between; what is not ASCII belongs to words.
RAW, BETWEEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def words_of(text: Column) -> Column:
    # splitting is linear in the text; extracting all matches copies the text for each
    return F.transform(F.array_remove(F.split(text, BETWEEN + "+"), ""), small_letters)


def _hash(hashes: Column, pos: Column, length: int) -> Column:
    """Hash of the ``length`` words from ``pos`` on, from their hashes."""
    return F.xxhash64(*[F.get(hashes, pos + k) for k in range(length)])


def _windows(df: DataFrame, lengths: list[int], first: Column, *keep: str) -> DataFrame:
    """``keep``, hashes, len, pos and h of each window of ``words`` of the given lengths, and a row with pos -1 where ``first`` says so.

    Places leave the array of words as one number each and are hashed as rows, inside generated code.
    """
    df = df.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w))).withColumn("n", F.size("words"))
    places = [F.when(F.col("n") >= n, F.sequence(F.lit(n), (F.col("n") - n) * 16 + n, F.lit(16))).otherwise(F.lit([]).cast("array<int>")) for n in lengths]
    # outer, so that no filter on the array's size is inferred, which would make it twice
    rows = df.select(*keep, "words", "hashes", F.explode_outer(F.concat(F.when(first, F.array(F.lit(-1))).otherwise(F.lit([]).cast("array<int>")), *places)).alias("code"))
    pos, size = F.when(F.col("code") < 0, -1).otherwise(F.shiftright("code", 4)), F.col("code").bitwiseAND(15)
    h = F.lit(None).cast("bigint")
    for n in lengths:
        h = F.when((F.col("code") >= 0) & (size == n), _hash(F.col("hashes"), F.shiftright("code", 4), n)).otherwise(h)
    return rows.select(*keep, "words", size.alias("len"), pos.alias("pos"), h.alias("h"))


def windows(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct (h, len, gram, item) of the benchmark's windows."""
    df = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), words_of(text_of(benchmark, text)).alias("words"))
    whole = _windows(df, list(range(1, WINDOW + 1)), F.lit(False), "item").filter((F.col("len") == WINDOW) | (F.col("len") == F.size("words")))
    return whole.select("h", "len", F.expr("slice(words, pos + 1, len)").alias("gram"), "item").distinct()


def _parts(grams: DataFrame, set_bytes: int) -> list[DataFrame]:
    """The hash set in parts that are small enough to broadcast."""
    size = grams.agg(F.sum(F.octet_length(F.array_join("gram", "")).cast("bigint") + 16 * F.col("len") + 64)).first()[0] or 0
    n = 1 + size // set_bytes
    return [grams.filter(F.pmod("h", F.lit(n)) == k) for k in range(n)]


def _covered(hits: Column) -> Column:
    """Number of words inside the (pos, len) hits."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    return F.aggregate(F.array_sort(hits), start, lambda a, x: F.struct(
        F.greatest(a["end"], x["pos"] + x["len"]).alias("end"),
        (a["n"] + F.greatest(F.lit(0), x["pos"] + x["len"] - F.greatest(a["end"], x["pos"]))).alias("n")), lambda a: a["n"])


def keyed(docs: DataFrame, doc_id: str, text: str) -> list[Column]:
    """128 bits of a row's id and text."""
    return [F.xxhash64(F.col(doc_id), F.col(text)).alias("k1"), F.xxhash64(F.lit(7), F.col(text), F.col(doc_id)).alias("k2")]


def hits(docs: DataFrame, grams: DataFrame, doc_id: str = "doc_id", text: str = "text", set_bytes: int = SET_BYTES) -> DataFrame:
    """One row per id, text and scan split: number of rows and words, verified (pos, len) hits, digests of their items."""
    lengths = sorted(r[0] for r in grams.select("len").distinct().collect())  # at most ten
    df = docs.select(F.col(doc_id).alias("doc_id"), F.spark_partition_id().alias("split"), *keyed(docs, doc_id, text), words_of(text_of(docs, text)).alias("words"))
    ids = ["doc_id", "split", "k1", "k2"]
    found = None
    for k, part in enumerate(_parts(grams, set_bytes)):
        rows = _windows(df, lengths, F.lit(k == 0), *ids)
        known = F.broadcast(part.select(F.col("h").alias("known"), F.col("len").alias("known_len"), "gram", "d1", "d2"))
        # the hash alone is the join's key; the words are compared for hits only
        rows = rows.join(known, F.col("h") == F.col("known"), "left").filter(
            "pos < 0 OR (known IS NOT NULL AND len = known_len AND slice(words, greatest(pos, 0) + 1, len) = gram)").select(
            *ids, F.when(F.col("pos") < 0, F.size("words")).alias("n_words"), "len", "pos", "d1", "d2")
        found = rows if found is None else found.unionByName(rows)
    hit = F.col("pos") >= 0
    return found.groupBy(*ids).agg(
        F.count("n_words").alias("copies"), F.max("n_words").cast("bigint").alias("n_words"),
        F.collect_set(F.when(hit, F.struct("pos", "len"))).alias("hits"),
        F.sort_array(F.collect_set(F.when(hit, F.struct("d1", "d2")))).alias("digests"))


def judged(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", set_bytes: int = SET_BYTES) -> DataFrame:
    """doc_id, k1, k2, copies, n_words, n_hit, n_items, items (sorted ids), hits of each row, repeated rows of a scan split as one."""
    pairs = cut(windows(benchmark))
    digest = [F.bit_xor(F.xxhash64("item")).alias("d1"), F.bit_xor(F.xxhash64(F.lit(7), F.col("item"))).alias("d2")]
    grams = cut(pairs.groupBy("h", "len", "gram").agg(*digest))
    found = cut(hits(docs, grams, doc_id, text, set_bytes))
    # items: once per digest, once per combination of digests
    first = grams.groupBy("d1", "d2").agg(F.min(F.struct("h", "len", "gram")).alias("g")).select("d1", "d2", "g.*")
    items = first.join(pairs, ["h", "len", "gram"]).select("d1", "d2", "item")
    dirty = found.filter(F.size("hits") > 0)
    listed = dirty.select("digests").distinct().select("digests", F.explode("digests").alias("d")).select("digests", "d.*").join(
        items, ["d1", "d2"]).groupBy("digests").agg(F.sort_array(F.collect_set("item")).alias("items"))
    dirty = dirty.join(listed, "digests").withColumn("n_hit", _covered(F.col("hits")).cast("bigint"))
    clean = found.filter(F.size("hits") == 0).withColumns({"items": F.lit([]).cast("array<string>"), "n_hit": F.lit(0).cast("bigint")})
    return clean.unionByName(dirty).select("doc_id", "k1", "k2", "copies", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), "items", "hits")


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", documents: bool = False,
          set_bytes: int = SET_BYTES) -> DataFrame:
    """``docs`` without the hit words and what follows each up to the next word, or with ``documents`` without the documents that are hit."""
    found = judged(docs, benchmark, doc_id, text, set_bytes).filter("n_hit > 0").groupBy("k1", "k2").agg(F.first("hits").alias("hits"))
    rows = whole_rows(docs, doc_id, text)
    rows = rows.select("_row", F.col(text).alias("_text"), *keyed(rows, doc_id, text))
    if documents:
        return as_documents(rows.join(found, ["k1", "k2"], "left_anti"), docs)
    rows = rows.join(found, ["k1", "k2"], "left")
    pieces = F.split(F.regexp_replace("_text", f"^{BETWEEN}+", ""), f"(?<={BETWEEN})(?={RAW})")
    places = F.flatten(F.transform("hits", lambda x: F.sequence(x["pos"], x["pos"] + x["len"] - 1)))
    rows = rows.withColumn("_pieces", F.when(F.col("hits").isNotNull(), pieces)).withColumn("_left", F.array_except(
        F.sequence(F.lit(0), F.size("_pieces") - 1), F.array_distinct(places)))
    kept = F.concat(F.regexp_extract("_text", f"^{BETWEEN}*", 0), F.array_join(F.transform("_left", lambda i: F.get("_pieces", i)), ""))
    new = F.when(F.col("hits").isNotNull(), kept).otherwise(F.col("_text"))
    size = {"n_chars": F.when(F.col("hits").isNotNull(), F.length(kept).cast("bigint")).otherwise(F.col("_row.n_chars"))} if "n_chars" in docs.columns else {}
    return as_documents(rows, docs, **{text: new}, **size)


def op13_decontaminate(spark, folder):
    rows = judged(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))
    return rows.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                       (F.col("n_hit") > 0).alias("contaminated"), F.explode(F.expr("sequence(1L, copies)")).alias("copy")).drop("copy")


CAPITALS, SMALL, WORD = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_words = lambda x: f"regexp_extract_all(translate(coalesce({x}, ''), '{CAPITALS}', '{SMALL}'), '{WORD}')"
SQL = rf"""
WITH i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_words('text')} AS ws FROM benchmark),
g AS (SELECT DISTINCT item, least(len(ws), {WINDOW}) AS n, array_to_string(ws[p + 1:p + {WINDOW}], ' ') AS g
      FROM (SELECT *, unnest(range(0, greatest(len(ws) - {WINDOW}, 0) + 1)) AS p FROM i WHERE len(ws) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, {_words('text')} AS ws FROM documents),
w AS (SELECT r, n, p, array_to_string(ws[p + 1:p + n], ' ') AS g
      FROM (SELECT r, ws, n, unnest(range(0, len(ws) - n + 1)) AS p FROM d, (SELECT DISTINCT n FROM g))),
h AS (SELECT r, n, p, item FROM w JOIN g USING (n, g)),
c AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT r, n, p FROM h)) GROUP BY r),
s AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN s USING (r)"""
