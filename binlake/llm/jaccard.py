"""N-gram Jaccard join: documents linked where their sets of word shingles are alike.

Two sets with a similarity of ``t`` or more share at least ``l`` tokens among the first ``n - ceil(t n) + l`` tokens of each,
under any one order of all tokens.  Filters under several orders are intersected before any two sets are compared:

1. order of a hash: a document stays if at least ``l`` of its first tokens (``l`` a tenth of its tokens) occur among the
   first tokens of another set.  This takes the mass of documents out with a fifth of their tokens moved.
2. order of a second hash over what is left, with the same rule.
3. order of frequency among what is left, rarest first: a document stays if fewer than ``n - ceil(t n) + 1`` of its tokens are its
   own; its first tokens (``l = 1``) are its keys.

Documents are candidates of each other only if a chain of shared keys connects them, so pairs that pass all filters
are in one group.  Groups are compared block by block: each document goes to as many pairs of blocks as its group has
blocks, a task compares two blocks, and returns a spanning forest of the links it finds, never all pairs.
Documents with equal sets are one node from step 2 on.  Components come from label propagation with checkpoints.

Texts are lower-cased in A-Z and split at ASCII spaces.  A text with fewer words than a shingle is one shingle; a null
or wordless text has none and is linked with nothing.  Rows that repeat an id give one row; of different texts the one
with the most shingles stands.  A null id gets no component.  Other columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut, documents, mix, released, slices, text_of
from .postings import BATCH, PACKED, bucket_count, gather, grams, lowest, packed, places, ragged, word_hashes

WORDS, PERCENT = 4, 85
#: Tokens beyond the prefix that the first two filters ask for: one of so many.
SPARE = 10
#: Documents of a block when groups are compared, and tokens of a matrix at once.
BLOCK, COLUMNS = 512, 4096


def needed(n, percent: int = PERCENT):
    """Fewest tokens a set of n shares with any set as similar."""
    return -(-percent * n // 100)


def spare(n):
    import numpy as np
    return np.maximum(1, n // SPARE)


def shingles(texts: list[str], k: int = WORDS):
    """Distinct shingle hashes of all texts, ascending in each, and where each text's begin."""
    import numpy as np
    flat, starts = word_hashes(texts, lower=True)
    at, owner = places(starts, k)
    h = grams(flat, k)[at]
    n = np.diff(starts)
    short = np.flatnonzero((n > 0) & (n < k))
    whole = [grams(flat[starts[i]:starts[i + 1]], int(n[i]))[0] ^ np.uint64(n[i]) for i in short]
    h, owner = np.concatenate([h, np.array(whole, np.uint64)]), np.concatenate([owner, short])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[fresh], owner[fresh]
    return h, owner, np.bincount(owner, minlength=len(texts)).astype(np.int64)


def signatures(h, owner, n: int):
    """Two sums that equal sets share."""
    import numpy as np
    out = np.zeros((2, n), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(2):
            np.add.at(out[k], owner, mix(h, 31 + k))
    return out.view(np.int64)


def _first(h, owner, counts, salt: int, percent: int):
    """The first tokens of every set in the order of a hash."""
    import numpy as np
    rank = mix(h, salt)
    order = np.lexsort((rank, owner))
    start = np.cumsum(counts) - counts
    inside = np.arange(len(h)) - start[owner[order]]
    take = inside < (counts - needed(counts, percent) + spare(counts))[owner[order]]
    return h[order][take], owner[order][take]


def _counting(h, nodes, buckets: int):
    """Postings of one batch.  Tokens that two of its sets have are counted here; one posting tells the bucket of them."""
    import numpy as np
    order, first, _ = lowest(h, nodes)
    hh, dd = h[order], nodes[order]
    group = np.cumsum(first) - 1
    shared = np.bincount(group, minlength=first.sum()) > 1
    yield packed(hh[first], dd[first], shared.astype(np.int64), buckets)
    found, n = np.unique(dd[shared[group]], return_counts=True)
    yield packed(found.view(np.uint64), found, -n, buckets)         # counts known here: negative marks


def _counted(h, d, mark):
    """Per node the tokens that occur in another set too."""
    import numpy as np
    import pyarrow as pa
    known = mark < 0
    hh, dd, settled = h[~known], d[~known], mark[~known] > 0
    order, first, _ = lowest(hh, dd)
    group = np.cumsum(first) - 1
    n = np.bincount(group, minlength=first.sum()) if len(hh) else np.zeros(0, int)
    any_settled = np.zeros(len(n), bool)
    np.logical_or.at(any_settled, group, settled[order])
    hit = ((n > 1) | any_settled)[group] & ~settled[order]
    # one row per token, so that rows grow with the postings and not with nodes times buckets; Spark adds them up
    found = dd[order][hit]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([found, d[known]]).astype(np.int64)),
                                       pa.array(np.concatenate([np.ones(len(found), np.int64), -mark[known]]).astype(np.int64))], names=["node", "shared"])


def _ids(b):
    import numpy as np
    return np.asarray(b.column("doc_id").fill_null(-1))


def described(rows: DataFrame, k: int = WORDS) -> DataFrame:
    """One row per id: number of shingles and two sums that equal sets share."""
    def run(batches):
        import pyarrow as pa
        for b in slices(batches, "text", BATCH):
            h, owner, n = shingles(b.column("text").to_pylist(), k)
            s = signatures(h, owner, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, (n, *s))], names=["doc_id", "n", "s1", "s2"])
    df = rows.mapInArrow(released(run), "doc_id bigint, n bigint, s1 bigint, s2 bigint")
    return df.groupBy("doc_id").agg(F.max(F.struct("n", "s1", "s2")).alias("x")).select("doc_id", "x.*")


def _shared(postings: DataFrame) -> DataFrame:
    return gather(postings, _counted, "node bigint, shared bigint").groupBy("node").agg(F.sum("shared").alias("shared"))


def shared_of_texts(rows: DataFrame, buckets: int, k: int, percent: int, salt: int) -> DataFrame:
    """(node, shared): of the first tokens of each set, named by its first sum, those that another set has too."""
    def run(batches):
        import numpy as np
        for b in slices(batches, "text", BATCH):
            h, owner, n = shingles(b.column("text").to_pylist(), k)
            sums = signatures(h, owner, b.num_rows)[0]
            once = np.zeros(b.num_rows, bool)
            once[np.unique(sums, return_index=True)[1]] = True
            keep = (once & (n > 0))[owner]
            t, o = _first(h[keep], owner[keep], np.where(once, n, 0), salt, percent)
            if len(t):
                yield from _counting(t, sums[o], buckets)
    return _shared(rows.mapInArrow(released(run), PACKED))


def shared_of_sets(sets: DataFrame, buckets: int, percent: int, salt: int) -> DataFrame:
    """The same for rows (doc_id, tokens), named by their ids."""
    def run(batches):
        import numpy as np
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                n = np.asarray(b.column("tokens").value_lengths()).astype(np.int64)
                h = np.asarray(b.column("tokens").flatten()).view(np.uint64)
                t, o = _first(h, np.repeat(np.arange(len(n)), n), n, salt, percent)
                if len(t):
                    yield from _counting(t, _ids(b)[o], buckets)
    return _shared(sets.mapInArrow(released(run), PACKED))


def _enough(percent: int):
    """Whether the shared ones of a set's first tokens suffice for the smallest set that can be as similar."""
    least = F.ceil(F.lit(percent) * F.col("n") / 100)
    return F.col("shared") >= F.greatest(F.lit(1), F.floor(least / SPARE))


def split(rows: DataFrame, ids: DataFrame, bits: int = 24) -> tuple[DataFrame, DataFrame]:
    """Rows whose id may be among ``ids`` and rows whose id is not, by a bitmap of fixed size.

    The bitmap has ``2**bits`` bits in all (2 MB at 24) whatever the number of ids; where it fills up, fewer rows are
    told apart before the shuffle, and an exact join behind it still decides.
    """
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits))
    maps = ids.filter(F.col("doc_id").isNotNull()).select(spot.alias("x")).groupBy(F.shiftright("x", 15).alias("_part")).agg(
        F.bitmap_construct_agg((F.col("x") % 32768).cast("bigint")).alias("_map"))
    bit = F.col("_x") % 32768
    byte = F.conv(F.hex(F.substring("_map", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    told = rows.withColumn("_x", spot).withColumn("_part", F.shiftright("_x", 15)).join(F.broadcast(maps), "_part", "left") \
        .withColumn("_hit", F.coalesce(F.floor(byte / F.pow(F.lit(2), bit % 8)) % 2 == 1, F.lit(False)))
    return told.filter("_hit").select(*rows.columns), told.filter("not _hit").select(*rows.columns)


def sets_of(rows: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, tokens) of the nodes, whose sums say which of several texts is meant."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        for b in slices(batches, "text", BATCH):
            h, owner, n = shingles(b.column("text").to_pylist(), k)
            s = signatures(h, owner, b.num_rows)
            keep = (s[0] == np.asarray(b.column("s1"))) & (s[1] == np.asarray(b.column("s2")))
            tokens = ragged(h, owner, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), tokens], names=["doc_id", "n", "tokens"]).filter(pa.array(keep))
    maybe, _ = split(rows, nodes)
    return maybe.join(nodes.select("doc_id", "s1", "s2"), "doc_id").mapInArrow(released(run), "doc_id bigint, n bigint, tokens array<bigint>")


def keys_of(sets: DataFrame, percent: int) -> DataFrame:
    """(doc_id, token): first tokens in the order of frequency, of sets with few enough tokens of their own."""
    rows = sets.select("doc_id", "n", F.explode("tokens").alias("token"))
    often = rows.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    held = rows.join(often, "token").groupBy("doc_id", "n").agg(F.array_sort(F.collect_set(F.struct("df", "token"))).alias("s"))
    first = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1 - (F.col("n") - F.size("s"))
    return held.withColumn("_k", first.cast("int")).filter("_k > 0").select(
        "doc_id", F.explode(F.slice("s", F.lit(1), F.least("_k", F.size("s")))).alias("x")).select("doc_id", "x.token")


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (doc_id, root): every node of an edge with the smallest node it reaches.

    Large and small stars in turn: each node sends its larger neighbours, then its smaller ones, to the smallest.
    Hubs are joined, never collected, and every round is cut in the shared folder.
    """
    def both(e):
        return e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def star(e, large: bool):
        near = both(e) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        out = near.join(low, "a")
        if large:
            return out.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        return out.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))

    def tidy(e):
        return e.filter(F.col("a") != F.col("b")).distinct()
    e = cut(tidy(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))))
    state = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state, e = now, cut(tidy(star(tidy(star(e, True)), False)))
    return e.select(F.col("a").alias("doc_id"), F.col("b").alias("root")).union(
        e.select(F.col("b").alias("doc_id"), F.col("b").alias("root")).distinct())


def _links(percent: int):
    def run(key, table):
        import numpy as np
        import pyarrow as pa
        i, j = key[1].as_py(), key[2].as_py()
        ids, n, block = (np.asarray(table.column(c).combine_chunks()) for c in ("doc_id", "n", "block"))
        tokens = table.column("tokens").combine_chunks()
        flat, owner = np.asarray(tokens.flatten()), np.repeat(np.arange(len(n)), n)
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        _, token, often = np.unique(flat, return_inverse=True, return_counts=True)
        keep = often[token] > 1
        owner, token = owner[keep], np.unique(token[keep], return_inverse=True)[1]
        inter = np.zeros((len(left), len(right)), np.float32)
        place = np.full((2, len(n)), -1)
        place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
        order = np.argsort(token, kind="stable")
        owner, token = owner[order], token[order]
        for at in range(0, int(token[-1]) + 1 if len(token) else 0, COLUMNS):
            s = slice(*np.searchsorted(token, [at, at + COLUMNS]))
            sides = []
            for side, size in enumerate((len(left), len(right))):
                m, o = np.zeros((size, COLUMNS), np.float32), place[side][owner[s]]
                m[o[o >= 0], token[s][o >= 0] - at] = 1
                sides.append(m)
            inter += sides[0] @ sides[1].T
        union = n[left][:, None] + n[right][None, :] - inter
        x, y = np.nonzero(100 * inter >= percent * union)
        a, b = ids[left[x]], ids[right[y]]
        root: dict[int, int] = {}

        def find(v):
            while root.setdefault(v, v) != v:
                root[v] = v = root[root[v]]
            return v
        out = []
        for u, v in zip(a.tolist(), b.tolist()):
            p, q = find(u), find(v)
            if p != q:
                root[max(p, q)] = min(p, q)
                out.append((u, v))
        return pa.table({"a": pa.array([u for u, _ in out], pa.int64()), "b": pa.array([v for _, v in out], pa.int64())})
    return run


def compared(sets: DataFrame, groups: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """(a, b): links that connect all linked sets of each group, from comparisons of its blocks."""
    sizes = groups.groupBy("root").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    rows = sets.join(groups.join(sizes, "root"), "doc_id").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("root", F.least("block", "_j").alias("i"), F.greatest("block", "_j").alias("j"), "doc_id", "n", "block", "tokens")
    return rows.groupBy("root", "i", "j").applyInArrow(_links(percent), "a bigint, b bigint")


def linked(docs: DataFrame, text: str = "text", k: int = WORDS, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles and component_id of every id."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of(docs, text).alias("text"))
    buckets = bucket_count(rows)
    known = cut(described(rows, k))
    shared = shared_of_texts(rows, buckets, k, percent, 101)
    passing = known.join(shared, known["s1"] == shared["node"]).filter(_enough(percent))
    nodes = passing.groupBy("s1", "s2").agg(F.min("doc_id").alias("doc_id"))
    sets = cut(sets_of(rows, cut(nodes), k))
    second = sets.join(shared_of_sets(sets, buckets, percent, 102).withColumnRenamed("node", "doc_id"), "doc_id").filter(_enough(percent))
    keys = cut(keys_of(second.select("doc_id", "n", "tokens"), percent))
    leads = keys.groupBy("token").agg(F.min("doc_id").alias("lead"))
    groups = components(keys.join(leads, "token").select(F.col("doc_id").alias("a"), F.col("lead").alias("b")))
    roots = components(compared(sets, groups, percent, block))
    same = known.filter("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("first"))
    classes = same.join(roots, same["first"] == roots["doc_id"], "left").select("s1", "s2", F.coalesce("root", "first").alias("component_id"))
    return known.join(classes, ["s1", "s2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


#: Near duplicates in the pipeline: five words and a similarity of 0.8.
STAGE_WORDS, STAGE_PERCENT = 5, 80


def stage(docs: DataFrame) -> DataFrame:
    """Of each component of near duplicates the document with the smallest id; rows without id stay."""
    gone = linked(docs, k=STAGE_WORDS, percent=STAGE_PERCENT).filter("component_id <> doc_id").select("doc_id")
    gone = cut(gone)
    maybe, rest = split(docs, gone)
    return rest.union(maybe.join(gone, "doc_id", "left_anti").select(*docs.columns))


def op8_jaccard(spark, folder):
    return linked(documents(spark, folder))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY ALL"""
