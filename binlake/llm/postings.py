"""Posting lists of hashed tokens, moved in blobs.

A task packs the postings of a batch of documents into one row per bucket of the hash space, so a shuffle moves a few
wide rows instead of one row per posting.  Before that it keeps one posting per hash and batch: what the others of
the batch need to know is known on the spot.  A token that half of all documents share so costs one posting per
batch.  The number of buckets grows with the input, and a bucket holds a bounded share of it.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from .common import give_back, mix

#: Characters of input for which one bucket is made, and bytes of text handled at once.
BUCKET_CHARS, BATCH = 4 << 20, 8 << 20
PACKED = "bucket bigint, hash array<bigint>, doc array<bigint>, mark array<bigint>"


def bucket_count(docs: DataFrame, text: str = "text") -> int:
    """Buckets in proportion to the characters of the input."""
    chars = docs.agg(F.sum(F.length(text).cast("bigint"))).first()[0] or 0
    return 1 + chars // BUCKET_CHARS


def word_hashes(texts: list[str], lower: bool = False):
    """Hashes of the words of all texts, and where each text's words start; words are split at ASCII spaces."""
    import numpy as np
    from xxhash import xxh3_64_intdigest
    words = [(t.encode().lower() if lower else t.encode()).split() for t in texts]
    n = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter((xxh3_64_intdigest(w) for ws in words for w in ws), np.uint64, int(n.sum()))
    return flat, np.concatenate([[0], np.cumsum(n)])


def grams(flat, k: int):
    """Hash of the k words from each place on; the last k - 1 places are missing."""
    import numpy as np
    n = max(0, len(flat) - k + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = out * np.uint64(0x9E3779B97F4A7C15) + mix(flat[j:j + n], j)
    return mix(out)


def places(starts, k: int):
    """Places where a window of k words lies inside one text, and the text of each."""
    import numpy as np
    n = np.maximum(np.diff(starts) - k + 1, 0)
    owner = np.repeat(np.arange(len(n)), n)
    return starts[:-1][owner] + np.arange(n.sum()) - (np.cumsum(n) - n)[owner], owner


def ragged(values, owner, n: int):
    """Arrow list array with the values of each owner; owners ascend."""
    import numpy as np
    import pyarrow as pa
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.ascontiguousarray(values).view(np.int64)))


def packed(hashes, docs, marks, buckets: int):
    """One row per bucket of the given postings."""
    import numpy as np
    import pyarrow as pa
    bucket = (mix(hashes, 77) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    found, at = np.unique(bucket[order], return_inverse=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(found), *(ragged(x[order], at, len(found)) for x in (hashes, docs, marks))], names=["bucket", "hash", "doc", "mark"])


def lowest(hashes, docs):
    """Sort by hash and document: order, which postings are the first of their hash, and the first's document for each."""
    import numpy as np
    order = np.lexsort((docs, hashes))
    h = hashes[order]
    first = np.ones(len(h), bool)
    first[1:] = h[1:] != h[:-1]
    return order, first, docs[order][np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))]


def gather(rows: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``fn(hash, doc, mark) -> RecordBatch`` over all postings of each bucket."""
    def run(table):
        import numpy as np
        import pyarrow as pa
        cols = [np.concatenate([np.asarray(c.flatten()) for c in table.column(x).chunks] or [np.zeros(0, np.int64)]) for x in ("hash", "doc", "mark")]
        out = pa.Table.from_batches([fn(cols[0].view(np.uint64), cols[1], cols[2])])
        del cols, table
        give_back()
        return out
    return rows.groupBy("bucket").applyInArrow(run, schema)


def rows_of(*values, names):
    """One row per place of the given arrays."""
    import numpy as np
    import pyarrow as pa
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(v).view(np.int64)) for v in values], names=names)
