"""Spelling variants, hard negatives and benchmark decontamination against brute force."""
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from binlake.llm import decontaminate, negatives, spelling

DOCS = "doc_id bigint, text string, n_chars bigint, word string, n int, h string, item string, k1 string, hits string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, len(t or ""), "w", 1, "x", "i", "k", "y") for i, t in rows], DOCS).repartition(3)


# 11

def deletions(w):
    return {w[:k] + w[k + 1:] for k in range(len(w))}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return abs(len(a) - len(b)) == 1 and min(a, b, key=len) in deletions(max(a, b, key=len))


def vocabulary(rows):
    count = {}
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= 5:
                count[run] = count.get(run, 0) + 1
    return {w: n for w, n in count.items() if n >= 3}


def forms(count):
    out = {}
    for w, n in count.items():
        close = [x for x in count if one_edit(w, x)]
        best = min(close, key=lambda x: (-count[x], x.encode()), default=None)
        form = best if best is not None and count[best] >= 2 * n else None
        out[w] = (n, len(close), form, count[form] if form else None)
    roots = {}
    for w in out:
        at = w
        while out[at][2]:
            at = out[at][2]
        roots[w] = at
    return {w: (*v, roots[w]) for w, v in out.items()}


def table(df):
    got = [tuple(r[c] for c in ("word", "n", "n_near", "form", "form_n", "root")) for r in df.collect()]
    assert len({r[0] for r in got}) == len(got)
    return {r[0]: r[1:] for r in got}


def edited(r, w, letters):
    k = r.randrange(len(w) + 1)
    return r.choice([w[:k] + r.choice(letters) + w[k:], w[:k] + w[k + 1:], w[:k] + r.choice(letters) + w[k + 1:]])


def test_variants_by_brute_force(spark):
    r = random.Random(5)
    letters = "abéÿÀ"
    count = {}
    for _ in range(120):
        w = "".join(r.choice(letters) for _ in range(r.randrange(5, 14)))
        for _ in range(6):
            count[w] = r.choice([3, 3, 5, 9, 20, 45, 100])
            w = edited(r, w, letters)
            w = w if len(w) >= 5 else w + "abcde"
    got = table(spelling.variants(spark.createDataFrame(list(count.items()), "word string, n bigint").repartition(3)))
    assert got == forms(count)
    assert sum(v[2] is not None for v in got.values()) > 50 and any(v[4] not in (w, v[2]) for w, v in got.items())


def test_every_edit_is_met(spark):
    """All words one edit from a word, at every place, on either side."""
    base = "abcdefghi"
    for w in (base, base[:5], base[:6]):
        around = {w[:k] + "x" + w[k:] for k in range(len(w) + 1)} | {w[:k] + "x" + w[k + 1:] for k in range(len(w))} | deletions(w)
        words = spark.createDataFrame([(x, 3) for x in around] + [(w, 100)], "word string, n bigint")
        pairs = {(r.a, r.b) for r in spelling.near(words).collect()}
        assert {x for p in pairs if w in p for x in p} - {w} == around
        assert all(one_edit(*p) for p in pairs)


def test_words_of_odd_rows(spark):
    text = "Straße STRASSE Ünder under undeR x ab thing Thing things ÷×÷×÷ naïve-naïve"
    rows = [(k, text) for k in range(60)] + [(None, text), (7, None), (8, ""), (9, " .. "), (3, text), (3, text), (10, "a" * 20000), (11, "thing " * 9000)]
    got = table(spelling.variants(spelling.counted(spelling.with_typos(spelling.runs(docs(spark, rows))))))
    assert got == forms(vocabulary(rows))
    assert spelling.variants(spelling.counted(spelling.with_typos(spelling.runs(docs(spark, []))))).count() == 0


def test_crowded_beginnings_are_split(spark):
    """Many words that share their first half meet in small groups, not all with all."""
    r = random.Random(2)
    words = {"commonstem" + "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(10)): 3 for _ in range(3000)}
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    keys = df.select(F.explode(spelling._keys(F.col("word"), F.length("word"), 0)).alias("key")).groupBy("key").count()
    crowd = keys.filter("count > 40").agg(F.sum("count")).first()[0]
    assert crowd is None
    assert spelling.near(df).count() == sum(one_edit(a, b) for a in list(words)[:1] for b in words)


# 12

def brute(rows, anchor, positives=5, k=10, low=30, high=90):
    rows = {i: (label, [math.floor(256 * x) for x in v]) for i, label, v in rows}
    out = []
    for a in rows:
        if not anchor(a):
            continue
        la, va = rows[a]
        scored = sorted((-sum(x * y for x, y in zip(va, v)), i, label) for i, (label, v) in rows.items() if i != a and len(v) == len(va))
        mine = [(-s, i) for s, i, label in scored if label == la][:positives]
        for p, pid in mine:
            found = [(i, -s) for s, i, label in scored if label != la and low * p <= -100 * s <= high * p][:k]
            out += [(a, pid, n, i, p, s) for n, (i, s) in enumerate(found, 1)]
    return sorted(out)


def mined(df, anchor, **settings):
    cols = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(tuple(r[c] for c in cols) for r in negatives.mine(negatives.quantised(df), anchor, **settings).collect())


VECTORS = "vec_id bigint, label int, embedding array<double>, score string, slot string, q string, anchor string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "s", "t", "q", "a") for r in rows], VECTORS).repartition(5)


@pytest.mark.parametrize("scale", [1.0, 300.0, 3e5])
def test_mined_by_brute_force(spark, monkeypatch, scale):
    """In single, double and whole-number arithmetic; tiny tiles, chunks and buffers; ties and one label with most rows."""
    for name, value in (("ROWS", 16), ("ANCHORS", 3), ("HELD", 20)):
        monkeypatch.setattr(negatives, name, value)
    r = random.Random(int(scale))
    rows = [(k, r.choice([0, 0, 0, 1, 2]), [round(r.gauss(0.3, 0.5), 1) * scale for _ in range(6)]) for k in range(300)]
    rows += [(300 + k, k % 2, [0.5 * scale] * 6) for k in range(60)]
    got = mined(vectors(spark, rows), F.col("vec_id") % 20 == 0, chunk=7)
    assert got == brute(rows, lambda i: i % 20 == 0)
    assert len({x[:2] for x in got}) > 50 and max(x[2] for x in got) == 10


def test_rows_that_take_no_part(spark):
    r = random.Random(9)
    good = [(k, k % 3, [r.uniform(-1, 1) for _ in range(4)]) for k in range(60)]
    bad = [(None, 1, [1.0] * 4), (100, None, [1.0] * 4), (101, 1, None), (102, 1, [1.0, None, 1.0, 1.0]), (103, 1, [1.0, float("nan"), 1.0, 1.0]),
           (104, 1, [float("inf")] * 4), (105, 1, [1e9] * 4)]
    other = [(110, 1, [1.0] * 3), (120, 2, []), (130, 1, [1.0] * 3), (140, 1, [0.5] * 3), (150, 0, [0.5] * 3)]
    again = [good[5]] * 40
    got = mined(vectors(spark, good + bad + other + again), F.col("vec_id") % 10 == 0)
    assert got == brute(good + other, lambda i: i % 10 == 0)
    assert mined(vectors(spark, []), F.lit(True)) == []
    # of two rows with one id the smaller counts
    twice = vectors(spark, [*good, (7, 0, [0.0] * 4)])
    assert mined(twice, F.lit(True)) == brute([x for x in good if x[0] != 7] + [(7, 0, [0.0] * 4)], lambda i: True)


def test_one_vector_in_most_rows(spark):
    rows = [(k, k % 2, [0.5] * 4) for k in range(3000)] + [(5000, 0, [0.6] * 4), (5001, 1, [0.45] * 4)]
    assert mined(vectors(spark, rows), F.col("vec_id").isin(0, 5000)) == brute(rows, lambda i: i in (0, 5000))


# 13

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def judge(rows, bench):
    grams = {}
    for item, t in bench:
        w = WORD.findall((t or "").translate(LOWER))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            grams.setdefault(tuple(w[k:k + n]), set()).add("" if item is None else str(item))
    out = []
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        hit, items = set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                found = grams.get(tuple(w[k:k + n]))
                if found:
                    hit |= set(range(k, k + n))
                    items |= found
        digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(items), digest))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    some = lambda n: " ".join(r.choice(["Ab", "cé", "d1", "e", "F_f", "g-h", "漢", "i"]) + r.choice(["", ",", "..", " —"]) for _ in range(n))
    bench = [(k, some(r.randrange(10, 30))) for k in range(25)] + [(25, "One Short item"), (26, "x9"), (27, None), (28, ""), (29, " ,, "), (None, some(12))]
    bench += [(30, bench[0][1]), (30, bench[3][1]), (31, bench[0][1] + " tail tail")] + [(40 + k, bench[1][1]) for k in range(30)]
    rows = [(k, some(r.randrange(1, 60))) for k in range(40)]
    rows += [(50 + k, f"{some(7)} {r.choice(bench)[1] or ''} {some(3)}") for k in range(30)]
    rows += [(100 + k, f"the same. {bench[1][1]}") for k in range(30)] + [(100, f"the same. {bench[1][1]}")] * 4
    rows += [(1, None), (2, ""), (3, " .. "), (None, bench[0][1].upper()), (None, None), (4, "one, SHORT (item) X9 x99"), (4, "another text"), (5, some(9000))]
    return rows, bench


def found(df):
    rows = df.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("s"), F.explode(F.expr("sequence(1L, copies)")))
    return sorted((tuple(r)[:5] for r in rows.collect()), key=str)


@pytest.mark.parametrize("set_bytes", [1 << 25, 900])
def test_judged_by_brute_force(spark, texts, set_bytes):
    """The set in one part and in many."""
    rows, bench = texts
    b = spark.createDataFrame(bench, "item_id bigint, text string").repartition(2)
    got = found(decontaminate.judged(docs(spark, rows), b, set_bytes=set_bytes))
    assert got == judge(rows, bench)
    assert sum(x[2] > 0 for x in got) > 60 and sum(x[2] == 0 for x in got) > 20


def test_contaminated_parts_go(spark, texts):
    rows, bench = texts
    b = spark.createDataFrame(bench, "item_id bigint, text string")
    df = docs(spark, rows)
    cleaned = decontaminate.clean(df, b)
    assert cleaned.columns == df.columns and cleaned.count() == len(rows)
    got = cleaned.collect()
    assert all(r.n_chars == len(r.text or "") for r in got) and all((r.word, r.k1, r.hits) == ("w", "k", "y") for r in got)
    untouched = {(i, t) for (i, t), j in zip(rows, [judge([x], bench)[0] for x in rows]) if j[2] == 0}
    assert untouched <= {(r.doc_id, r.text) for r in got}
    one = {r.text for r in got if r.doc_id == 4}
    assert "another text" in one and "x99" in one
    kept = decontaminate.clean(df, b, documents=True)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(((i, t) for i, t in rows if (i, t) in untouched), key=str)


def test_empty_benchmark_and_documents(spark, texts):
    rows, bench = texts
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert {r.n_hit for r in decontaminate.judged(docs(spark, rows), none).collect()} == {0}
    assert decontaminate.judged(docs(spark, []), spark.createDataFrame(bench, none.schema)).count() == 0
    assert decontaminate.clean(docs(spark, rows), none).count() == len(rows)
