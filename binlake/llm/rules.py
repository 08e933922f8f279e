"""Quality rules line by line, with DataFrame functions only.

Base measures of a whole text: words, characters in words, symbols, repeated lines and words in repeated five-word
windows; a text fails the base with under 10 words or with over a fifth of its words in repeated windows.

Line rules: every line with a word is held against three rules.  *Punctuation*: it ends with terminal punctuation
(quotes and brackets may follow) or, if it breaks off, has a sentence that ends before, and marks such as ``#`` or ``!!`` do not stand after every few words.  *Navigation*: no
chain of menu separators that is dense for the line's length, no menu word alone.  *Boilerplate*: licence, consent,
copyright or sign-up phrases are less than a fortieth of the line, so one phrase fails a line of some 500 characters.
Lines that fail are removed; a document that loses more than ``max_loss`` of the characters of its lines is
rejected.

Null and empty texts have no words and are rejected.  Each row is judged alone, so repeated rows, ties and other
columns change nothing; a column named like a result is replaced by it; a null id stays null.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import SEPARATORS, as_documents, documents, text_of, whole_rows

MIN_WORDS, REPEAT_PERCENT, WINDOW, MAX_LOSS = 10, 20, 5, 0.5
#: A line fails if it has a separator for each MENU_SPAN characters, or if phrases are one part in PHRASE_SHARE of it.
MENU_SPAN, PHRASE_SHARE = 100, 40
#: Fixed values of the line rules, one pattern each, in a syntax that Java and RE2 share.
TERMINAL = r"[.!?…。！？][\x22'”’»)\]]*[\x20\x09-\x0D]*$"
SENTENCE_END = r"[.!?…。！？][\x22'”’»)\]]*\x20"
NOISE = r"[#*$%&|<>~^=_]{2,}|!!|\?\?"
MENU = r"[^|»>·•][|»>·•][^|»>·•]"
MENU_WORD = (r"(?i)^[\x20\x09-\x0D]*(home|menu|login|log in|sign in|sign up|register|search|next|previous|back to top|"
             r"share|read more|about us|contact us|sitemap|skip to content)[\x20\x09-\x0D.!>»]*$")
BOILERPLATE = (r"(?i)(all rights reserved|terms of (use|service)|privacy policy|cookie policy|we use cookies|accept (all )?cookies|"
               r"licensed under|subscribe to our|sign up for our|enable javascript|copyright ©|©\x20?[12][0-9]{3}|"
               r"permission is hereby granted|without warranty of any kind)")


def words_of(text: Column) -> Column:
    spaces = " \t\n\x0b\x0c\r"
    inner = F.btrim(text, F.lit(spaces))
    return F.when(inner == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(inner, f"[{SEPARATORS}]+"))


def _windows(words: Column) -> Column:
    """A hash of the words at each place and the four behind it."""
    last = F.size(words) - WINDOW
    return F.when(last < 0, F.expr("cast(array() as array<bigint>)")).otherwise(
        F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[words[i + k] for k in range(WINDOW)])))


def _covered(hashes: Column) -> Column:
    """Words that lie in a window found twice or more, from the hashes in the order of the text."""
    s = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = F.transform(F.array(s), lambda a: F.filter(a, lambda e, k: F.coalesce(F.get(a, k - 1)["h"] == e["h"], F.lit(False))
                                               | F.coalesce(F.get(a, k + 1)["h"] == e["h"], F.lit(False))))[0]
    places = F.array_sort(F.transform(twice, lambda e: e["i"]))
    return F.aggregate(places, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("bigint").alias("n")),
                       lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")),
                       lambda a: a["n"])


def line_fails(line: Column) -> Column:
    """Whether a line with a word fails one of the three rules."""
    n, bars = F.length(line), F.regexp_count(line, F.lit(MENU))
    phrases = n - F.length(F.regexp_replace(line, BOILERPLATE, ""))
    return ~(line.rlike(TERMINAL) | line.rlike(SENTENCE_END)) | (F.regexp_count(line, F.lit(NOISE)) * 40 > n) \
        | ((bars >= 3) & (bars * MENU_SPAN >= n)) | line.rlike(MENU_WORD) | (line.rlike(BOILERPLATE) & (phrases * PHRASE_SHARE >= n))


def judged(docs: DataFrame, text: str = "text", max_loss: float = MAX_LOSS) -> DataFrame:
    """``docs`` with the base measures, the cleaned text and the verdict."""
    df = docs.withColumn("_text", text_of(docs, text))
    df = df.withColumn("_words", words_of(F.col("_text")))
    df = df.withColumn("_hashes", _windows(F.col("_words"))).withColumn("_sorted", F.sort_array("_hashes"))
    twice = F.exists(F.transform("_sorted", lambda h, i: F.coalesce(h == F.get("_sorted", i - 1), F.lit(False))), lambda x: x)
    df = df.withColumns({
        "n_words": F.size("_words").cast("bigint"),
        "word_chars": F.length(F.array_join("_words", "")).cast("bigint"),
        "n_symbols": F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("bigint"),
        "n_repeat_words": F.when(twice, _covered(F.col("_hashes"))).otherwise(0).cast("bigint"),
        "_lines": F.filter(F.split("_text", "\n"), lambda x: x.rlike(f"[^{SEPARATORS}]"))})
    df = df.withColumn("_good", F.filter("_lines", lambda x: ~line_fails(x)))
    size = lambda lines: F.length(F.array_join(lines, ""))
    df = df.withColumns({
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")),
        "n_removed_lines": (F.size("_lines") - F.size("_good")).cast("bigint"),
        "lost": 1 - size("_good") / F.greatest(size("_lines"), F.lit(1)),
        "cleaned": F.array_join("_good", "\n")})
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("lost") <= max_loss)).drop(
        "_text", "_words", "_hashes", "_sorted", "_lines", "_good")


def stage(docs: DataFrame) -> DataFrame:
    """Documents that pass, without their failed lines."""
    # behind the explode, so that the optimizer doesn't copy the whole judgement into a filter below
    judgement = judged(whole_rows(docs, "text")).select(F.explode(F.array(F.struct(
        "_row", "text", "kept", "cleaned", F.col("n_removed_lines").alias("removed")))).alias("x")).filter("x.kept").select("x.*")
    text = F.when(F.col("removed") > 0, F.col("cleaned")).otherwise(F.col("text"))
    return as_documents(judgement, docs, text=text, n_chars=F.length(text).cast("bigint"))


def op5_quality_rules(spark, folder):
    return judged(documents(spark, folder).select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_lines")


_S = r"[^\x20\x09-\x0D]"
_q = lambda p: p.replace("'", "''")
SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{_S}+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_S}')) AS ls FROM d),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
        SELECT doc_id, unnest(range(i, i + 5)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1)
      GROUP BY doc_id),
b AS (SELECT doc_id, ls, len(ws) AS n_words, len(array_to_string(ws, '')) AS word_chars,
             len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
             list_filter(ls, lambda x: (regexp_matches(x, '{_q(TERMINAL)}') OR regexp_matches(x, '{_q(SENTENCE_END)}')) AND len(regexp_extract_all(x, '{_q(NOISE)}')) * 40 <= len(x)
                AND NOT (len(regexp_extract_all(x, '{_q(MENU)}')) >= 3 AND len(regexp_extract_all(x, '{_q(MENU)}')) * {MENU_SPAN} >= len(x))
                AND NOT regexp_matches(x, '{_q(MENU_WORD)}')
                AND NOT (regexp_matches(x, '{_q(BOILERPLATE)}') AND (len(x) - len(regexp_replace(x, '{_q(BOILERPLATE)}', '', 'g'))) * {PHRASE_SHARE} >= len(x))) AS good FROM w)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(n, 0) AS n_repeat_words,
       n_words < {MIN_WORDS} OR 100 * coalesce(n, 0) > {REPEAT_PERCENT} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * coalesce(n, 0) > {REPEAT_PERCENT} * n_words)
         AND 1 - len(array_to_string(good, '')) / greatest(len(array_to_string(ls, '')), 1) <= {MAX_LOSS} AS kept,
       len(ls) - len(good) AS n_removed_lines
FROM b LEFT JOIN r USING (doc_id)"""
