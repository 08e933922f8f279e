"""Hard-negative mining by slot-decomposed selection.

Scores are integer inner products of quantised vectors.  An anchor's positives are its best rows of the same label.  A
positive with score p admits negatives (rows of another label) with ``low * p <= 100 * score <= high * p``; the windows of an anchor's
positives overlap.  Their upper limits, in descending order, split the scores into disjoint slots.  One scan keeps the best k
rows per anchor and slot (a combiner in each task, then a ranking per slot), and a window's answer is the merge of its own slot and
the ones below it, in descending order, down to the lower limit: the first k of them are among the best k of each slot.

The anchors are a stated query set and are held against all rows in blocks: up to ``CHUNK`` anchors are broadcast at a
time, each such chunk scans the rows twice (positives, negatives), and a task multiplies tiles of rows and anchors.  Vectors are never
shuffled pairwise, rows of one label or one repeated vector need not meet in a task, and a task holds k rows per anchor and slot.  Tiles are
multiplied in floating point only where the vectors' norms prove that no sum is rounded.

Rows with a null id, label or vector or with a null, non-finite or huge component (2^23 and more) take no part, nor do
vectors whose squared norm would pass 2^62.  Only vectors of one length meet.  Of rows that share an id the one with the smallest (label,
vector) counts, once.  Ties in score go to the smaller id.  A negative positive score has an empty window.  Other columns
are not read; an empty table gives no rows.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut

POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 5, 10, 30, 90, 256
#: Anchors that are broadcast at once; rows and anchors of a tile; candidates that are held before they are thinned out.
CHUNK, ROWS, ANCHORS, HELD = 1 << 15, 4096, 1024, 1 << 20
LEAST, MOST = -(1 << 62) - 1, 1 << 62


def quantised(df: DataFrame, vec_id: str = "vec_id", label: str | Column = "label", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, label, q, norm of the rows that take part, one row per id."""
    part = lambda x: F.when(F.isnan(x) | (F.abs(x) >= 2.0 ** 23), None).otherwise(F.floor(x * scale).cast("int"))
    q = F.transform(F.col(vector), lambda x: part(x.cast("double")))
    norm = F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    df = df.select(F.col(vec_id).cast("bigint").alias("vec_id"), (F.col(label) if isinstance(label, str) else label).cast("bigint").alias("label"), q.alias("q"))
    df = df.filter("vec_id IS NOT NULL AND label IS NOT NULL AND q IS NOT NULL AND NOT exists(q, x -> x IS NULL)")
    df = df.withColumn("norm", norm).filter(F.col("norm") < 2.0 ** 62)
    return df.groupBy("vec_id").agg(F.min(F.struct("label", "q", "norm")).alias("r")).select("vec_id", "r.*")


class Anchors:
    """A chunk of anchors: ids, labels, vectors and the score slots of each; slots descend, an absent one admits nothing."""

    def __init__(self, ids, labels, vectors, least, most, same: bool, k: int):
        self.ids, self.labels, self.vectors, self.least, self.most, self.same, self.k = ids, labels, vectors, least, most, same, k


class Best:
    """The best k rows per anchor and slot among all rows seen."""

    def __init__(self, anchors: Anchors):
        import numpy as np
        self.a, (n, self.slots) = anchors, anchors.least.shape
        # what a row must beat: a score, and among equal scores an id
        self.score, self.id = anchors.least - 1, np.full((n, self.slots), np.iinfo(np.int64).min)
        self.kept, self.held = [np.zeros(0, np.int64)] * 3, []

    def add(self, at: int, ids, own, scores) -> None:
        """Scores of rows (with ``ids``; ``own``: their labels) against the anchors from place ``at`` on."""
        import numpy as np
        n = scores.shape[1]
        tile = slice(at, at + n)
        bottom = self.score[tile].min(axis=1).astype(scores.dtype)
        mask = (scores >= bottom) & (scores <= self.a.most[tile].max(axis=1).astype(scores.dtype))
        mask &= (own[:, None] == self.a.labels[tile]) if self.a.same else (own[:, None] != self.a.labels[tile])
        r, c = np.nonzero(mask)
        s, i, c = scores[r, c].astype(np.int64), ids[r], c + at
        slot = (self.a.most[c] >= s[:, None]).sum(axis=1) - 1
        better = (s > self.score[c, slot]) | ((s == self.score[c, slot]) & (i < self.id[c, slot]))
        better &= i != self.a.ids[c]
        self.held.append([c[better] * self.slots + slot[better], s[better], i[better]])
        if sum(len(x[0]) for x in self.held) > HELD:
            self.thin()

    def thin(self) -> None:
        import numpy as np
        code, s, i = (np.concatenate([self.kept[k], *[x[k] for x in self.held]]) for k in range(3))
        order = np.lexsort((i, -s, code))
        code, s, i = code[order], s[order], i[order]
        start = np.searchsorted(code, code)
        rank = np.arange(len(code)) - start
        last = rank == self.a.k - 1
        self.score.flat[code[last]], self.id.flat[code[last]] = s[last], i[last]
        keep = rank < self.a.k
        self.kept, self.held = [code[keep], s[keep], i[keep]], []


def tiles(batches: Iterable, size: int) -> Iterator:
    """(ids, labels, vectors) of at most ``size`` rows, from Arrow batches."""
    import numpy as np
    for batch in batches:
        for k in range(0, batch.num_rows, size):
            b = batch.slice(k, size)
            flat = b.column("q").flatten().to_numpy(zero_copy_only=False)
            yield b.column("vec_id").to_numpy(), b.column("label").to_numpy(), np.ascontiguousarray(flat.reshape(b.num_rows, -1))


def scan(rows: DataFrame, anchors: Anchors, exact: str) -> DataFrame:
    """anchor, slot, score, id: the best k rows per anchor and slot over all ``rows``; ``exact`` is a type that rounds no sum."""
    shared = rows.sparkSession.sparkContext.broadcast(anchors)
    k = anchors.k

    def run(batches):
        import numpy as np
        import pyarrow as pa
        a = shared.value
        best, across = Best(a), a.vectors.astype(exact).T
        for ids, labels, vectors in tiles(batches, ROWS):
            vectors = vectors.astype(exact)
            for at in range(0, len(a.ids), ANCHORS):
                best.add(at, ids, labels, vectors @ across[:, at:at + ANCHORS])
        best.thin()
        code, s, i = best.kept
        for at in range(0, len(code), 1 << 16):
            part = slice(at, at + (1 << 16))
            anchor, slot = np.divmod(code[part], best.slots)
            yield pa.RecordBatch.from_arrays([pa.array(a.ids[anchor]), pa.array(slot.astype(np.int32)), pa.array(s[part]), pa.array(i[part])],
                                             names=["anchor", "slot", "score", "id"])

    found = rows.select("vec_id", "label", "q").mapInArrow(run, "anchor bigint, slot int, score bigint, id bigint")
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _limits(scores: list[list[int]], low: int, high: int):
    """Slots of anchors from their positives' scores: least and most score of each; a window's lower limit bounds the slots above it."""
    import numpy as np
    width = max([len(set(p)) for p in scores] + [1])
    least, most = np.full((len(scores), width), MOST), np.full((len(scores), width), LEAST)
    for k, found in enumerate(scores):
        windows = sorted({(high * p // 100, -(-low * p // 100)) for p in found if p >= 0}, reverse=True)
        tops = sorted({u for u, _ in windows}, reverse=True)
        for s, top in enumerate(tops):
            below = tops[s + 1] + 1 if s + 1 < len(tops) else LEAST + 1
            most[k, s], least[k, s] = top, max(below, min(lower for u, lower in windows if u >= top))
    return least, most


def mine(rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
         chunk: int = CHUNK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows of ``quantised`` that ``anchor`` selects."""
    import numpy as np
    rows = cut(rows.withColumn("anchor", F.coalesce(anchor, F.lit(False))).withColumn("dim", F.size("q")))
    out = None
    # bounded by the number of vector lengths
    for dim, n, among in sorted(tuple(r) for r in rows.filter("anchor").groupBy("dim").agg(F.count("*"), F.max("norm")).collect()):
        alike = rows.filter(F.col("dim") == dim)
        bound = (alike.agg(F.max("norm")).first()[0] * among) ** 0.5
        exact = "float32" if bound < 2 ** 24 else "float64" if bound < 2 ** 53 else "int64"
        parts = 1 + n // chunk
        for part in range(parts):
            chosen = alike.filter("anchor").filter(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == part).select("vec_id", "label", "q")
            table = chosen.toArrow().combine_chunks()  # one chunk of anchors
            if not table.num_rows:
                continue
            ids, labels = table["vec_id"].to_numpy(), table["label"].to_numpy()
            vectors = table["q"].combine_chunks().flatten().to_numpy().reshape(len(ids), dim)
            best = cut(scan(alike, Anchors(ids, labels, vectors, np.full((len(ids), 1), LEAST + 1), np.full((len(ids), 1), MOST), True, positives), exact))
            scores = {r.anchor: r.scores for r in best.groupBy("anchor").agg(F.collect_list("score").alias("scores")).toLocalIterator()}
            least, most = _limits([scores.get(i, []) for i in ids.tolist()], low, high)
            slots = scan(alike, Anchors(ids, labels, vectors, least, most, False, negatives), exact)
            merged = slots.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "id"))).alias("merged"))
            inside = F.filter("merged", lambda x: (-x["minus"]).between(F.col("lower"), F.col("upper")))
            # hundredths apart, so that no product overflows
            window = [F.expr(f"score div 100 * {low} + (score % 100 * {low} + 99) div 100").alias("lower"),
                      F.expr(f"score div 100 * {high} + score % 100 * {high} div 100").alias("upper")]
            got = best.filter("score >= 0").select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("p"), *window).join(merged, "anchor").select(
                F.col("anchor").alias("anchor_id"), "positive_id", F.col("p").alias("positive_score"), F.posexplode(F.slice(inside, 1, negatives)).alias("k", "x"))
            got = cut(got.select("anchor_id", "positive_id", (F.col("k") + 1).alias("rank"), F.col("x.id").alias("negative_id"), "positive_score",
                                 (-F.col("x.minus")).alias("negative_score")))
            out = got if out is None else out.unionByName(got)
    return out if out is not None else rows.sparkSession.createDataFrame(
        [], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")


def op12_hard_negatives(spark, folder):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(quantised(spark.read.parquet(f"{folder}/embeddings.parquet"), label=label), F.col("vec_id") % 100 == 0)


SQL = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_dot_product(a.q::DOUBLE[], b.q::DOUBLE[])::BIGINT AS s
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b AS p, s AS ps FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= {POSITIVES}),
n AS (SELECT p.a, p, ps, s.b AS n, s.s AS ns, row_number() OVER (PARTITION BY p.a, p ORDER BY s.s DESC, s.b) AS rank
      FROM p JOIN s ON p.a = s.a AND NOT same AND {LOW} * ps <= 100 * s.s AND 100 * s.s <= {HIGH} * ps)
SELECT a AS anchor_id, p AS positive_id, rank::INT AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE rank <= {NEGATIVES}"""
