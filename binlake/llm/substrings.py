"""Substring deduplication by relative Lempel-Ziv parsing.

Every document is factored against all documents with smaller ids.  The index of these reference blocks has every
window of 13 words that lies in more than one document, with the smallest id it occurs in.  A factor starts at a
window found in a block with a smaller id and goes on while the following windows are found in the same block; at its
end the twelve windows that straddle the boundary are looked up again, as another block may continue there.  Factors
have 13 words or more and become duplicate spans.

The index is made in two steps, so that windows of one document only are never moved.  First each window is
represented by the least of its nine 5-word hashes: equal windows have equal representatives, and only one place in
five is one.  Then only windows whose representative occurs in two documents are indexed.  In both steps tasks keep one
posting per hash and batch, the smallest id (see ``postings``).

Texts are cut into words at ASCII spaces; null and empty texts have none.  Of equal windows in one document none is
smaller, so they stay.  Rows that repeat an id are parts of one document; rows without id are not compared and stay
whole.  Other columns are ignored.
"""
from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, functions as F

from .common import documents, mix, slices, text_of
from .postings import BATCH, PACKED, bucket_count, gather, grams, lowest, packed, places, rows_of, word_hashes

WINDOW, SEED = 13, 5


def _representatives(flat, starts):
    """The representative of every 13-word window, and the windows' places and owners."""
    import numpy as np
    at, owner = places(starts, WINDOW)
    g = grams(flat, SEED)
    if not len(at):
        return np.zeros(0, np.uint64), at, owner
    least = g[at]
    for j in range(1, WINDOW - SEED + 1):
        least = np.minimum(least, g[at + j])
    return least, at, owner


def _ids(batch, column="doc_id"):
    import numpy as np
    ids = batch.column(column)
    return np.asarray(ids.fill_null(-1)), ~np.asarray(ids.is_null())


def _postings(hashes, docs, buckets: int, marked):
    """Rows for the buckets: per hash the smallest id of the batch; ``marked`` gives what the others are sent as."""
    import numpy as np
    order, first, low = lowest(hashes, docs)
    h, d = hashes[order], docs[order]
    fresh = first.copy()
    fresh[1:] |= d[1:] != d[:-1]
    h, d, first, low = h[fresh], d[fresh], first[fresh], low[fresh]
    return marked(h, d, first, low, buckets)


def _seeds(h, d, first, low, buckets):
    """Smallest ids go to their bucket, marked if the batch has others; the others know enough and go back at once."""
    import numpy as np
    group = np.cumsum(first) - 1
    shared = np.bincount(group, minlength=first.sum()) > 1 if len(h) else np.zeros(0, bool)
    yield packed(h[first], d[first], shared.astype(np.int64), buckets)
    yield packed(h[~first], d[~first], np.full((~first).sum(), 2), buckets)


def _seeds_found(h, d, mark):
    """Documents whose representative occurs in another one too."""
    import numpy as np
    order, first, low = lowest(h, d)
    group = np.cumsum(first) - 1
    n = np.bincount(group, minlength=first.sum()) if len(h) else np.zeros(0, int)
    hit = (n[group] > 1) | (mark[order] > 0)
    return rows_of(d[order][hit], h[order][hit], names=["doc_id", "seeds"])


def _windows(h, d, first, low, buckets):
    import numpy as np
    yield packed(h[first], d[first], np.full(first.sum(), -1), buckets)
    # of the others the batch knows a smaller id; the bucket may know a still smaller one, but any will do
    yield packed(h[~first], d[~first], low[~first], buckets)


def _windows_found(h, d, mark):
    """Windows of a document that occur in one with a smaller id, and that document."""
    import numpy as np
    known = mark >= 0
    order, first, low = lowest(h[~known], d[~known])
    hh, dd = h[~known][order], d[~known][order]
    hit = dd > low
    return rows_of(np.concatenate([dd[hit], d[known]]), np.concatenate([hh[hit], h[known]]),
                   np.concatenate([low[hit], mark[known]]), names=["doc_id", "found", "block"])


def _look_up(rows: DataFrame, buckets: int, step, found, schema: str, lists: tuple[str, ...]) -> DataFrame:
    """One exchange with the buckets: rows -> (doc_id, lists of what was found)."""
    def run(batches):
        for b in slices(batches, "text", BATCH):
            hashes, docs = step(b)
            if len(hashes):
                yield from _postings(hashes, docs, buckets, _seeds if found is _seeds_found else _windows)
    back = gather(rows.mapInArrow(run, PACKED), found, schema)
    return back.groupBy("doc_id").agg(*[F.collect_list(x).alias(x) for x in lists])


def _seed_step(b):
    docs, known = _ids(b)
    flat, starts = word_hashes(b.column("text").to_pylist())
    least, _, owner = _representatives(flat, starts)
    keep = known[owner]
    return least[keep], docs[owner][keep]


def _list_members(b, column: str, hashes, owner):
    """Position in the row's list of each hash, or -1."""
    import numpy as np
    col = b.column(column)
    n = np.array([0 if not v.is_valid else len(v) for v in col], np.int64)
    values = np.asarray(col.flatten()).view(np.uint64)
    row = np.repeat(np.arange(len(n)), n)
    if not len(values) or not len(hashes):
        return np.full(len(hashes), -1)
    with np.errstate(over="ignore"):
        have = mix(values + mix(row.astype(np.uint64), 9))
        want = mix(hashes + mix(owner.astype(np.uint64), 9))
    order = np.argsort(have)
    k = np.minimum(np.searchsorted(have[order], want), len(have) - 1)
    return np.where(have[order][k] == want, order[k], -1)


def _window_step(b):
    docs, known = _ids(b)
    flat, starts = word_hashes(b.column("text").to_pylist())
    least, at, owner = _representatives(flat, starts)
    keep = known[owner] & (_list_members(b, "seeds", least, owner) >= 0)
    return grams(flat, WINDOW)[at[keep]], docs[owner][keep]


def factors(hit, block) -> list[tuple[int, int, int]]:
    """Greedy factors (begin, end, block) of a document from its windows found elsewhere, by place."""
    out, i, n = [], 0, len(hit)
    while i < n:
        if not hit[i]:
            i += 1
            continue
        j = i
        while j + 1 < n and hit[j + 1] and block[j + 1] == block[i]:
            j += 1
        out.append((i, j + WINDOW, int(block[i])))
        i = j + 1                                    # the straddling windows are looked up again
    return out


PARSED = "doc_id bigint, n_words bigint, kept string, spans array<struct<begin:bigint,end:bigint,block:bigint>>"


def _parse(batches):
    import numpy as np
    import pyarrow as pa
    for b in slices(batches, "text", BATCH):
        texts = b.column("text").to_pylist()
        flat, starts = word_hashes(texts)
        at, owner = places(starts, WINDOW)
        member = _list_members(b, "found", grams(flat, WINDOW)[at], owner)
        blocks = np.asarray(b.column("block").flatten())
        block = np.where(member >= 0, blocks[member], -1) if len(blocks) else np.full(len(at), -1)
        touched = set(owner[member >= 0].tolist())
        ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))])
        kept, spans = [], []
        for k, t in enumerate(texts):
            words, mine = t.encode().split(), []
            if k in touched:
                part = slice(ends[k], ends[k + 1])
                mine = factors(member[part] >= 0, block[part])
                cover = np.zeros(len(words) + 1, np.int64)
                for begin, end, _ in mine:
                    cover[begin] += 1
                    cover[end] -= 1
                words = [w for w, c in zip(words, np.cumsum(cover)) if not c]
            kept.append(b" ".join(words).decode())
            spans.append([{"begin": x, "end": y, "block": z} for x, y, z in mine])
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(np.diff(starts)), pa.array(kept, pa.string()),
             pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("block", pa.int64())])))],
            names=["doc_id", "n_words", "kept", "spans"])


def deduplicated(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_words, the kept words and the duplicate spans (in words) of every row."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of(docs, text).alias("text"))
    buckets = bucket_count(rows)
    seeds = _look_up(rows, buckets, _seed_step, _seeds_found, "doc_id bigint, seeds bigint", ("seeds",))
    some = F.expr("cast(array() as array<bigint>)")
    # both joins read one exchange of the texts
    first = rows.join(seeds, "doc_id", "left").select("doc_id", "text", F.coalesce("seeds", some).alias("seeds"))
    found = _look_up(first, buckets, _window_step, _windows_found, "doc_id bigint, found bigint, block bigint", ("found", "block"))
    second = rows.join(found, "doc_id", "left").select("doc_id", "text", F.coalesce("found", some).alias("found"), F.coalesce("block", some).alias("block"))
    return second.mapInArrow(_parse, PARSED)


def op10_substrings(spark, folder):
    return deduplicated(documents(spark, folder)).select(
        "doc_id", "n_words",
        F.aggregate("spans", F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("n")),
                    lambda a, x: F.struct(F.greatest(a["at"], x["end"]).alias("at"),
                                          (a["n"] + F.greatest(x["end"] - F.greatest(x["begin"], a["at"]), F.lit(0))).alias("n")),
                    lambda a: a["n"]).alias("n_removed"),
        F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
m AS (SELECT g, min(doc_id) AS low FROM g GROUP BY g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN m USING (g) WHERE low < doc_id),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM
        (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d) ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)"""
