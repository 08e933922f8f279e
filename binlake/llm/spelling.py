"""Spelling variants by asymmetric q-chunks: words one edit apart, each linked to its most frequent near word.

Words are counted over all texts.  Of two words that differ by one inserted, deleted or replaced character, the shorter
one is cut into two disjoint chunks and the edit leaves one of them whole: the first at its place, the second shifted by
the difference in length.  The longer word gives its positional grams, of the lengths and at the places, within a shift of one, where
chunks of a word of its own length or one less can stand; chunks and grams meet in an equi-join.  A chunk
alone is a hot key (all words that start alike), so it is joined together with the half of the other chunk that the edit left
whole, which must hold too: cut anew, one of the two halves is untouched.  Joined pairs are verified by their edit distance.

``counted`` gives the words, ``near`` all pairs, ``variants`` the form and root of each word.  Counting adds up within each task before
words are shuffled, so a frequent word costs one row per task.  A form has at least twice its word's count, so a
chain of forms has no circle and ends within 63 steps; roots are found by doubling these steps.

Null and empty texts have no words; a null id counts as ''.  Ties in frequency go to the smaller word in code-point order.  Repeated
rows count each; other columns are not read; an empty table gives no rows.  Long texts and runs are taken whole.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, documents, small_letters, text_of

MIN_LENGTH, MIN_COUNT, RATIO, TYPO = 5, 3, 2, 97
#: All but letters; as a plain class, since a negated one is ten times as slow.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\xBF\x{100}-\x{10FFFF}]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """id and lower-cased run of each maximal run of letters that is long enough."""
    # outer, so that no filter on the array's size is inferred, which would split twice
    found = F.explode_outer(F.split(text_of(docs, text), BETWEEN))
    return docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), found.alias("run")).filter(
        F.length("run") >= min_length).withColumn("run", small_letters(F.col("run")))


def with_typos(words: DataFrame, every: int = TYPO) -> DataFrame:
    """One run in ``every`` loses a letter, by the checksum of id and run."""
    h = words.withColumn("h", F.crc32(F.concat_ws(":", "id", "run"))).withColumn("at", (F.col("h") % F.length("run")).cast("int"))
    lost = F.expr("concat(substring(run, 1, at), substring(run, at + 2))")
    return h.select(F.when(F.col("h") % every == 0, lost).otherwise(F.col("run")).alias("word"))


def counted(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n of each word that is long and frequent enough."""
    return words.filter(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def _cuts(length: Column) -> list[tuple[Column, Column]]:
    """The four halves of chunks, as (start, end): all but one of them make a key."""
    whole = length.cast("int")
    middle = F.floor(whole / 2).cast("int")
    first, third = F.floor(middle / 2).cast("int"), (middle + F.floor((whole - middle) / 2)).cast("int")
    return [(F.lit(0), first), (first, middle), (middle, third), (third, whole)]


def _keys(word: Column, length: Column, shift: int) -> Column:
    """Hash of a chunk at its place and a half of the other one, for each half that an edit may hit; ``length`` is the shorter word's."""
    return F.array(*[F.xxhash64(length, F.lit(k), word.substr(F.lit(1), start), word.substr(end + 1 + shift, F.length(word)))
                     for k, (start, end) in enumerate(_cuts(length))])


def near(words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b of each pair of words one edit apart, once per pair; b is the longer one, or the larger of equal length."""
    length = F.length("word")
    chunks = words.select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.explode(_keys(F.col("word"), length, 0)).alias("key"))
    grams = [words.select(F.col("word").alias("b"), F.col("n").alias("n_b"), F.explode(_keys(F.col("word"), length - shift, shift)).alias("key"))
             for shift in (0, 1)]
    fits = (F.col("a.key") == F.col("b.key")) & (F.length("b.b") - F.length("a.a")).isin(0, 1) & (
        (F.length("b.b") > F.length("a.a")) | (F.col("b.b") > F.col("a.a"))) & (F.levenshtein("a.a", "b.b", 1) == 1)
    return chunks.alias("a").join(grams[0].unionByName(grams[1]).alias("b"), fits).select("a", "n_a", "b", "n_b").distinct()


def roots(links: DataFrame) -> DataFrame:
    """word, root: where following ``links(word, form)`` ends."""
    at = cut(links.select("word", F.col("form").alias("root")))
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        step = cut(at.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")))
        if step.filter("moved").isEmpty():
            return step.select("word", "root")
        at = step.select("word", "root")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n, root of each row of ``words(word, n)``."""
    words = cut(words)
    pairs = cut(near(words))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    out = cut(words.join(best, "word", "left").withColumn("leads", F.coalesce(-F.col("best.m") >= ratio * F.col("n"), F.lit(False))).select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(F.col("leads"), F.col("best.other")).alias("form"),
        F.when(F.col("leads"), -F.col("best.m")).alias("form_n")))
    return out.join(roots(out.filter("form IS NOT NULL")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def op11_spelling(spark, folder):
    return variants(counted(with_typos(runs(documents(spark, folder))))).select("word", "form", "root", "n", "n_near", "form_n")


#: The checksum bit by bit: a step for each bit of each byte of UTF-8.
SQL = rf"""
WITH RECURSIVE r AS (
  SELECT k, run, count(*) AS c FROM (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS k,
           translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]{{{MIN_LENGTH},}}')), '{CAPITALS}', '{SMALL}') AS run FROM documents) GROUP BY k, run),
b AS (SELECT *, flatten(list_transform(string_split(k || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x), 0, 0, 0, 0, 0, 0, 0]
        ELSE [192 + (unicode(x) >> 6), 0, 0, 0, 0, 0, 0, 0, 128 + (unicode(x) & 63), 0, 0, 0, 0, 0, 0, 0] END)) AS bits FROM r),
h AS (SELECT run, c, xor(list_reduce(list_prepend(4294967295::BIGINT, bits::BIGINT[]),
        lambda s, x: xor(xor(s, x) >> 1, 3988292384::BIGINT * (xor(s, x) & 1))), 4294967295::BIGINT) AS h FROM b),
v AS (SELECT word, sum(c)::BIGINT AS n FROM (SELECT c, CASE WHEN h % {TYPO} = 0 THEN run[1:h % len(run)] || run[h % len(run) + 2:] ELSE run END AS word FROM h)
      WHERE len(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(c) >= {MIN_COUNT}),
x AS (SELECT word, n, i, word[1:i] || word[i + 2:] AS rest FROM (SELECT word, n, unnest(range(0, len(word))) AS i FROM v)),
p AS (SELECT a.word, b.word AS other, b.n AS m FROM x a JOIN x b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
      UNION SELECT x.word, v.word, v.n FROM x JOIN v ON x.rest = v.word
      UNION SELECT v.word, x.word, x.n FROM x JOIN v ON x.rest = v.word),
f AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM p GROUP BY word),
t AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {RATIO} * n THEN other END AS form, CASE WHEN m >= {RATIO} * n THEN m END AS form_n
      FROM v LEFT JOIN f USING (word)),
w AS (SELECT word, word AS at, form AS next FROM t UNION ALL SELECT w.word, t.word, t.form FROM w JOIN t ON w.next = t.word)
SELECT t.word, t.form, w.at AS root, t.n, t.n_near, t.form_n FROM t JOIN w ON t.word = w.word AND w.next IS NULL"""
