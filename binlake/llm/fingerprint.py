"""Document fingerprints as invertible Bloom lookup sketches.

A text is cut into paragraphs: lines, and lines further at sentence and clause ends.  Each paragraph becomes a 64-bit
digest, numbered by its occurrence so that a repeated paragraph counts as often as it occurs.  A sketch is a small
table of cells (count, digest sum, check sum, length sum); every digest is added to one cell in each of three rows.
Two sketches of one size subtract cell by cell, common paragraphs vanish, and peeling cells of count one recovers
the digests and lengths of the paragraphs that differ.  Where peeling gets stuck, both sketches are built again four
times as wide.

Null texts count as empty; two empty texts are alike (1.0).  Repeated rows get equal results; equal ids are
ordered by text; null ids come first.  Other columns are ignored.
"""
from __future__ import annotations

import base64
import hashlib
import re

from pyspark.sql import DataFrame, functions as F

from .common import SLICE, documents, mix, slices

#: Cells in each of the three rows of the sketch that the fingerprint shows.
WIDTH = 4
#: A paragraph ends with its line, sentence or clause, and after 64 characters without any such end.
PARAGRAPH = re.compile(r"[^\n.!?,;:|]{1,64}[\n.!?,;:|]*\s*|[\n.!?,;:|]+\s*")
#: Rows aimed at in a bucket of neighbours, and most buckets (their bounds are held by the driver).
BUCKET_ROWS, MOST_BUCKETS = 500, 65_536


class Digests:
    """Paragraph digests of a list of texts, flat: digest, length, owner."""

    def __init__(self, texts: list[str]):
        import numpy as np
        from xxhash import xxh3_64_intdigest
        parts = [PARAGRAPH.findall(t) for t in texts]
        self.counts = np.fromiter(map(len, parts), np.int64, len(parts))
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        total = int(self.counts.sum())
        self.key = np.fromiter((xxh3_64_intdigest(p) for ps in parts for p in ps), np.uint64, total)
        self.length = np.fromiter((len(p) for ps in parts for p in ps), np.int64, total)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        owner = np.repeat(np.arange(len(parts)), self.counts)
        order = np.lexsort((self.key, owner))
        k, o = self.key[order], owner[order]
        fresh = np.ones(total, bool)
        fresh[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
        at = np.arange(total)
        occurrence = np.empty(total, np.int64)
        occurrence[order] = at - np.maximum.accumulate(np.where(fresh, at, 0))
        self.key = mix(self.key ^ mix(occurrence.astype(np.uint64), 5), 6)

    def of(self, rows):
        """Positions of the paragraphs of ``rows`` and the index into ``rows`` that owns each."""
        import numpy as np
        n = self.counts[rows]
        owner = np.repeat(np.arange(len(rows)), n)
        first = np.cumsum(n) - n
        return self.starts[rows][owner] + np.arange(n.sum()) - first[owner], owner


def cells(key, width: int):
    """The three cells of each digest in a sketch of three rows."""
    import numpy as np
    return [(mix(key, 11 + j) & np.uint64(width - 1)).astype(np.int64) + j * width for j in range(3)]


def sketch(d: Digests, rows, width: int):
    """(count, digest sum, check sum, length sum), each one line of cells per row."""
    import numpy as np
    at, owner = d.of(rows)
    key, length, m = d.key[at], d.length[at], 3 * width
    check = mix(key, 3)
    out = [np.zeros(len(rows) * m, t) for t in (np.int64, np.uint64, np.uint64, np.int64)]
    for c in cells(key, width):
        flat = owner * m + c
        for table, v in zip(out, (1, key, check, length)):
            np.add.at(table, flat, v)
    return [t.reshape(len(rows), m) for t in out]


def peel(diff, width: int):
    """Whether each row came out whole, and characters and paragraphs found only left and only right."""
    import numpy as np
    count, keys, checks, lengths = (t.ravel() for t in diff)
    n, m = diff[0].shape
    only = np.zeros((4, n), np.int64)
    active = np.arange(n)
    with np.errstate(over="ignore"):
        while len(active):
            where = (active[:, None] * m + np.arange(m)).ravel()
            where = where[np.abs(count[where]) == 1]
            sign = count[where]
            key = np.where(sign > 0, keys[where], -keys[where])
            pure = np.where(sign > 0, checks[where], -checks[where]) == mix(key, 3)
            where, sign, key = where[pure], sign[pure], key[pure]
            row = where // m
            order = np.lexsort((key, row))
            row, key, sign, length = row[order], key[order], sign[order], lengths[where[order]]
            fresh = np.ones(len(row), bool)
            fresh[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
            row, key, sign, length = row[fresh], key[fresh], sign[fresh], length[fresh]
            signed = np.where(sign > 0, key, -key)
            check = mix(key, 3)
            check = np.where(sign > 0, check, -check)
            for c in cells(key, width):
                flat = row * m + c
                np.subtract.at(count, flat, sign)
                np.subtract.at(keys, flat, signed)
                np.subtract.at(checks, flat, check)
                np.subtract.at(lengths, flat, length)
            for k, side in enumerate((sign > 0, sign < 0)):
                np.add.at(only[k], row[side], np.abs(length[side]))
                np.add.at(only[2 + k], row[side], 1)
            active = np.unique(row)
    whole = ~((diff[0] != 0).any(1) | (diff[1] != 0).any(1) | (diff[2] != 0).any(1))
    return whole, only


def differences(a: Digests, b: Digests, width: int = WIDTH):
    """For the pairs (a[i], b[i]): characters only left, only right, paragraphs only left, only right, final width."""
    import numpy as np
    n = len(a.counts)
    found, final, rows = np.zeros((4, n), np.int64), np.zeros(n, np.int64), np.arange(n)
    while len(rows):
        stuck = []
        step = max(1, (1 << 20) // (3 * width))
        for k in range(0, len(rows), step):
            part = rows[k:k + step]
            with np.errstate(over="ignore"):
                diff = [x - y for x, y in zip(sketch(a, part, width), sketch(b, part, width))]
            whole, only = peel(diff, width)
            found[:, part[whole]], final[part[whole]] = only[:, whole], width
            stuck.append(part[~whole])
        rows, width = np.concatenate(stuck), width * 4
    return found, final


def likeness(a: Digests, b: Digests, width: int = WIDTH):
    """Common share of the characters of both texts' paragraphs, 0 to 1, from what peeling recovers."""
    import numpy as np
    only, _ = differences(a, b, width)
    union = a.size + only[1]
    return np.where(union == 0, 1.0, (a.size - only[0]) / np.maximum(union, 1))


def as_text(d: Digests, width: int = WIDTH) -> list[str]:
    """Number of paragraphs and the cells of the narrowest sketch."""
    import numpy as np
    count, keys, checks, lengths = sketch(d, np.arange(len(d.counts)), width)
    packed = np.concatenate([count.astype("<u4").view(np.uint8), keys.astype("<u8").view(np.uint8),
                             (checks >> np.uint64(32)).astype("<u4").view(np.uint8),
                             lengths.astype("<u4").view(np.uint8)], axis=1)
    return [f"{n}:{base64.b64encode(p.tobytes()).decode()}" for n, p in zip(d.counts, packed)]


def fingerprints(docs: DataFrame, text: str = "text", width: int = WIDTH) -> DataFrame:
    """``docs`` with the fingerprint of its text column."""
    import pyarrow as pa
    df = docs.withColumn("_text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    schema = docs.select("*", F.lit("").alias("fingerprint")).schema

    def run(batches):
        for b in slices(batches, "_text"):
            marks = as_text(Digests(b.column("_text").to_pylist()), width)
            rest = b.drop_columns(["_text"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(marks, pa.string())],
                                             names=[*rest.schema.names, "fingerprint"])
    return df.mapInArrow(run, schema)


def _bounds(ids: DataFrame) -> tuple[list[int], int | None, bool]:
    """Existing ids that open a bucket each, the lowest id, and whether any id is null."""
    n, low, nulls = ids.agg(F.count("id"), F.min("id"), F.count_if(F.col("id").isNull())).first()
    parts = min(MOST_BUCKETS, max(1, n // BUCKET_ROWS))
    if parts < 2:
        return [], low, bool(nulls)
    at = F.percentile_approx("id", [k / parts for k in range(1, parts)], max(10_000, 4 * parts))
    return sorted({x for x in ids.agg(at).first()[0] if x != low}), low, bool(nulls)


def neighbours(docs: DataFrame) -> DataFrame:
    """(bucket, guest, id, text), each partition sorted: buckets of consecutive ids, with a guest row at the end.

    The guest is the first row of the next bucket (of the whole table after the last), so the row after each row
    stands behind it in its bucket.  Buckets are bounded by quantiles of the ids, not by values.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bounds, low, nulls = _bounds(docs.select(F.col("doc_id").cast("bigint").alias("id")))
    table = F.lit(bounds) if bounds else F.expr("cast(array() as array<bigint>)")
    steps = len(bounds).bit_length()
    # binary search: number of bounds that are not above the id
    search = F.aggregate(F.sequence(F.lit(1), F.lit(max(1, steps))),
                         F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi")),
                         lambda s, _: _narrow(s, table), lambda s: s["lo"])
    bucket = search if bounds else F.lit(0)
    rows = rows.withColumn("bucket", F.when(F.col("id").isNull(), 0).otherwise(bucket).cast("int"))
    opens = (F.col("bucket") > 0) & (F.try_element_at(table, F.col("bucket")) == F.col("id"))
    first = F.col("id").isNull() if nulls else F.col("id") == F.lit(low)
    here = F.struct("bucket", F.lit(0).alias("guest"))
    places = F.array(here, F.when(opens, F.struct((F.col("bucket") - 1).alias("bucket"), F.lit(1).alias("guest"))),
                     F.when(first, F.struct(F.lit(len(bounds)).alias("bucket"), F.lit(2).alias("guest"))))
    placed = rows.withColumn("place", F.explode(F.filter(places, lambda p: p.isNotNull()))).select("place.*", "id", "text")
    return placed.repartition("bucket").sortWithinPartitions("bucket", "guest", F.asc_nulls_first("id"), "text")


def _narrow(s, table):
    mid = F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int")
    fits = F.try_element_at(table, mid) <= F.col("id")
    done = s["lo"] >= s["hi"]
    return F.struct(F.when(~done & fits, mid).otherwise(s["lo"]).alias("lo"),
                    F.when(~done & ~fits, mid - 1).otherwise(s["hi"]).alias("hi"))


EDITED = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def edit(text: str, following: str) -> str:
    """The last half of the text, rounded down, replaced by as much of the start of the following one."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _compare(pairs: list[tuple], width: int):
    import pyarrow as pa
    ids, texts, follow = zip(*pairs)
    edited = [edit(t, f) for t, f in zip(texts, follow)]
    own, new, after = Digests(list(texts)), Digests(edited), Digests(list(follow))
    return pa.RecordBatch.from_arrays([
        pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
        pa.array(as_text(own, width)), pa.array(as_text(new, width)),
        pa.array(likeness(own, new, width)), pa.array(likeness(own, after, width))],
        names=[x.split()[0] for x in EDITED.split(", ")])


def versions(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Fingerprints of every text and of its edit with the following document, and how alike they are."""
    def run(batches):
        held, held_size, last, last_bucket = [], 0, None, None
        for b in slices(batches, "text"):
            for bucket, guest, i, text in zip(*(b.column(c).to_pylist() for c in ("bucket", "guest", "id", "text"))):
                if bucket == last_bucket and last is not None:
                    held.append((*last, text))
                    held_size += len(last[1])
                last, last_bucket = (None if guest else (i, text)), bucket
                if held_size > SLICE or len(held) > 4096:
                    yield _compare(held, width)
                    held, held_size = [], 0
        if held:
            yield _compare(held, width)
    return neighbours(docs).mapInArrow(run, EDITED)


def op1_fingerprints(spark, folder):
    return versions(documents(spark, folder))
