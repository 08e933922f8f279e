"""Nearest vectors by cosine: an exact search over a tree of pivots, and an approximate one over random hyperplanes.

Both cut the index into cells, let each query visit some of them and score a visit as a small matrix product of a block of
index rows and a block of queries.  The exact search visits cells best bound first and stops a query once no cell left can beat the k-th
best that it has found; the approximate one visits the buckets of a few hyperplane codes and ranks what it meets exactly.

The exact search's cells travel in groups of neighbours: a query moves once for all the cells of a group that it visits in a round, and a
group once for a block of queries, so vectors move per group and block and not per visit.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import vectors as V
from ..session import cut_lineage

DIGITS = 6
#: Rounding of similarities and of angles.
SLACK = 1e-5
#: Pivots grow with the root of the index up to this number; they and one row of statistics each visit the driver.
MOST_PIVOTS = 1 << 17
#: Rows of a leaf on average, at least: smaller ones save less than they cost.
LEAF_ROWS = 1024
#: Cells of a query's first round of visits, and how many times more each further one has.
FIRST, FACTOR = 4, 16
#: Rows of a block of the exact search: an eighth of the index between these.  Copies of a vector that are more than the first are cut.
BLOCK_ROWS, MOST_BLOCK_ROWS = 2048, 1 << 16
#: Queries that are scored at once.
SLICE = 512
#: Similarities that round to the same differ by less.
TIED = 1.1 * 10 ** -DIGITS
RANKED = "q_binary string, q_addr bigint, binary string, addr bigint, similarity double"


def unit(block: pd.Series) -> np.ndarray:
    m = np.stack(list(block)).astype(np.float64, copy=False) if len(block) else np.zeros((0, 1))
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1))


class Tree:
    """Pivots of two levels: leaves below the nearest of their tops, with the shells that hold each one's rows."""

    def __init__(self, pivots: np.ndarray):
        count = max(1, math.isqrt(len(pivots)))
        self.tops, self.leaves = pivots[:count], pivots
        parent = _angles(self.leaves, self.tops).argmin(axis=1)
        self.below = [np.flatnonzero(parent == t) for t in range(count)]
        # nothing lies in a shell whose low end is above its high end
        self.low, self.high = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
        self.top_low, self.top_high = np.full(count, np.inf), np.full(count, -np.inf)
        self.group = np.zeros(len(pivots), np.int32)

    def place(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Leaf of each row, the angle to it and the angle to its top."""
        far = _angles(rows, self.tops)
        top = far.argmin(axis=1)
        leaf, angle = np.zeros(len(rows), int), np.zeros(len(rows))
        for t in np.unique(top):
            mine = np.flatnonzero(top == t)
            near = _angles(rows[mine], self.leaves[self.below[t]])
            leaf[mine], angle[mine] = self.below[t][near.argmin(axis=1)], near.min(axis=1)
        return leaf, angle, far[np.arange(len(rows)), top]

    def measured(self, stats: list) -> None:
        """Takes in (leaf, low, high, top_low, top_high) of the rows placed."""
        parent = {leaf: t for t, leaves in enumerate(self.below) for leaf in leaves}
        for leaf, low, high, top_low, top_high in stats:
            t = parent[leaf]
            self.low[leaf], self.high[leaf] = low, high
            self.top_low[t], self.top_high[t] = min(self.top_low[t], top_low), max(self.top_high[t], top_high)

    def grouped(self, sizes: dict[int, int], rows: int) -> None:
        """Deals the leaves, those of one top together, to groups of at most ``rows`` rows; a larger leaf is one group."""
        group = held = 0
        for leaf in (leaf for leaves in self.below for leaf in leaves):
            if held and held + sizes.get(leaf, 0) > rows:
                group, held = group + 1, 0
            self.group[leaf] = group
            held += sizes.get(leaf, 0)

    @staticmethod
    def _best(angle: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The greatest cosine that a row of each shell can have, by the triangle inequality of angles."""
        best = np.cos(np.clip(np.maximum(low - angle, angle - high), 0, np.pi))
        return np.where(low <= high, best, -np.inf)

    def bounds(self, queries: np.ndarray, bars: np.ndarray) -> np.ndarray:
        """Greatest cosine per query and leaf; -inf below the query's bar.  Leaves of a top that can't reach the bar are not looked at."""
        top = self._best(_angles(queries, self.tops), self.top_low, self.top_high)
        out = np.full((len(queries), len(self.leaves)), -np.inf)
        for t, leaves in enumerate(self.below):
            asked = np.flatnonzero(top[:, t] >= bars - SLACK)
            if len(asked) and len(leaves):
                best = np.minimum(self._best(_angles(queries[asked], self.leaves[leaves]), self.low[leaves], self.high[leaves]), top[asked, t][:, None])
                out[np.ix_(asked, leaves)] = np.where(best >= bars[asked][:, None] - SLACK, best, -np.inf)
        return out

    def next_visits(self, queries: np.ndarray, bars: np.ndarray, done: int, step: int) -> list[list[np.ndarray]]:
        """The leaves of rank ``done`` to ``done + step`` in the order of the bounds, as far as they reach the bar: for each group its number and then them."""
        out = []
        for at in range(0, len(queries), 256):
            bound = self.bounds(queries[at:at + 256], bars[at:at + 256])
            for row in bound:
                able = np.flatnonzero(row > -np.inf)
                due = able[np.argsort(-row[able], kind="stable")][done:done + step].astype(np.int32) if len(able) > done else able[:0]
                due = due[np.argsort(self.group[due], kind="stable")]
                groups, firsts = np.unique(self.group[due], return_index=True)
                out.append([np.concatenate([[g], leaves]).astype(np.int32) for g, leaves in zip(groups, np.split(due, firsts[1:]))])
        return out


def grown(index: DataFrame, count: int, block_rows: int, kind: str = "array<double>") -> tuple[Tree | None, DataFrame]:
    """The tree over the vectors that aren't zero, and these as ``kind`` with their leaf and its group.  Pivots are chosen by hash."""
    index = index.filter(V.dot(F.col("vector"), F.col("vector")) > 0)
    chosen = (index.orderBy(F.xxhash64("binary", "addr"), "binary", "addr").limit(count).select("vector").collect())
    if not chosen:
        return None, index.withColumns({"leaf": F.lit(0), "grp": F.lit(0)})
    tree = Tree(np.unique(unit(pd.Series([r[0] for r in chosen])), axis=0))

    @F.pandas_udf("struct<leaf:int,angle:double,top:double>")
    def place(vectors: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("leaf", "angle", "top"), tree.place(unit(vectors)))))

    placed = cut_lineage(index.withColumn("_p", place("vector")).select("binary", "addr", F.col("vector").cast(kind).alias("vector"), "_p.*"))
    stats = placed.groupBy("leaf").agg(F.min("angle"), F.max("angle"), F.min("top"), F.max("top"), F.count("*")).collect()
    tree.measured([tuple(r)[:5] for r in stats])
    tree.grouped({r[0]: r[5] for r in stats}, block_rows)

    @F.pandas_udf("int")
    def group(leaves: pd.Series) -> pd.Series:
        return pd.Series(tree.group[leaves.to_numpy()])

    return tree, placed.select("binary", "addr", "vector", "leaf", group("leaf").alias("grp"))


def narrow(*frames: DataFrame) -> str:
    """The type that holds all vectors without loss: floats move as half the bytes."""
    wide = F.exists("vector", lambda x: x.cast("float").cast("double") != x.cast("double"))
    return "array<float>" if all(f.filter(wide).isEmpty() for f in frames) else "array<double>"


def measured(index: DataFrame) -> tuple[int, int, int]:
    """Numbers of rows, of vectors of zeros and of the copies of the commonest vector."""
    zero = F.max(V.dot(F.col("vector"), F.col("vector")) == 0)
    copies = index.groupBy(F.xxhash64("vector").alias("h")).agg(F.count("*").alias("n"), zero.alias("zero"))
    return tuple(x or 0 for x in copies.agg(F.sum("n"), F.sum(F.when(F.col("zero"), F.col("n"))), F.max("n")).first())


def few_copies(index: DataFrame, k: int) -> DataFrame:
    """Of each vector the copies that can be among a query's k best: k of a binary, 2k in all.

    Copies tie, so the first ones by binary and address win, whichever one binary is left out.
    """
    own = Window.partitionBy("vector", "binary").orderBy("addr")
    every = Window.partitionBy("vector").orderBy("binary", "addr")
    return (index.withColumn("_r", F.row_number().over(own)).filter(F.col("_r") <= k)
            .withColumn("_r", F.row_number().over(every)).filter(F.col("_r") <= 2 * k).drop("_r"))


def _first_k(r: np.ndarray, h: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query r its k best rows h by similarity s, equal ones by row."""
    order = np.lexsort((h, -s, r))
    r, h, s = r[order], h[order], s[order]
    keep = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[keep], h[keep], s[keep]


def _hits(rows: np.ndarray, own: np.ndarray | None, queries: np.ndarray, theirs: np.ndarray | None, floor: np.ndarray, k: int):
    """(query, row, similarity) that reach the query's floor, few beyond its k best."""
    sims = queries @ rows.T
    if own is not None:
        sims[theirs[:, None] == own[None, :]] = -2.0
    low = floor - TIED
    found = sims >= low[:, None]
    if k < len(rows) and np.count_nonzero(found) > 4 * k * len(queries):
        kth = np.partition(sims, len(rows) - k, axis=1)[:, len(rows) - k]
        found = sims >= np.where(kth > low + TIED, kth - TIED, low)[:, None]
    r, h = np.nonzero(found)
    s = np.round(sims[r, h], DIGITS)
    keep = (s >= floor[r]) & (s > -2.0)
    return r[keep], h[keep], s[keep]


def best_of_part(a: pd.DataFrame, b: pd.DataFrame, k: int, least: float, exclude_same: bool) -> pd.DataFrame:
    """The k best rows of ``a`` for each query of ``b``.  Memory beyond the vectors is that of a slice of queries and one leaf."""
    cols = ["q_binary", "q_addr", "binary", "addr", "similarity"]
    if not len(a) or not len(b):
        return pd.DataFrame(columns=cols)
    a = a.sort_values(["binary", "addr"]).reset_index(drop=True)
    by_leaf = "leaf" in a.columns
    if by_leaf:  # queries that start in one leaf share most others
        b = b.iloc[np.argsort([c[1] for c in b["cells"]], kind="stable")].reset_index(drop=True)
    # rows of a leaf together, each leaf's by binary and address
    leaf = a["leaf"].to_numpy() if by_leaf else np.zeros(len(a), int)
    place = np.argsort(leaf, kind="stable")
    leaf, rows, queries = leaf[place], unit(a["vector"].iloc[place]), unit(b["vector"])
    own = theirs = None
    if exclude_same:
        codes = pd.factorize(np.concatenate([a["binary"].to_numpy()[place], b["q_binary"].to_numpy()]))[0]
        own, theirs = codes[:len(a)], codes[len(a):]
    floors = np.maximum(b["bar"].to_numpy() - SLACK, least)
    out = []
    for at in range(0, len(b), SLICE):
        n = min(SLICE, len(b) - at)
        cells = [c[1:] for c in b["cells"].iloc[at:at + n]] if by_leaf else [[0]] * n
        who, visited = np.repeat(np.arange(n), [len(c) for c in cells]), np.concatenate(cells)
        order = np.argsort(visited, kind="stable")
        who, visited = who[order], visited[order]
        floor, best = floors[at:at + n].copy(), [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
        held = 0
        for x in np.unique(visited):
            mine = slice(*np.searchsorted(leaf, [x, x + 1]))
            asked = who[slice(*np.searchsorted(visited, [x, x + 1]))]
            r, h, s = _hits(rows[mine], None if own is None else own[mine], queries[at + asked], None if own is None else theirs[at + asked], floor[asked], k)
            best.append((asked[r], place[mine][h], s))
            held += len(r)
            if held > 4 * k * n:
                best = [_first_k(*map(np.concatenate, zip(*best)), k)]
                r, _, s = best[0]
                held, full = len(r), np.bincount(r, minlength=n) == k
                worst = np.full(n, np.inf)
                np.minimum.at(worst, r, s)
                floor[full] = np.maximum(floor[full], worst[full])
        r, h, s = _first_k(*map(np.concatenate, zip(*best)), k)
        out.append((r + at, h, s))
    r, h, s = map(np.concatenate, zip(*out))
    return pd.DataFrame({
        "q_binary": b["q_binary"].to_numpy()[r], "q_addr": b["q_addr"].to_numpy()[r],
        "binary": a["binary"].to_numpy()[h], "addr": a["addr"].to_numpy()[h], "similarity": s + 0.0})


def scored(left: DataFrame, right: DataFrame, part: list[str], k: int, least: float, exclude_same: bool) -> DataFrame:
    """The k best rows of ``left`` per query of ``right`` in each part; a query with a ``bar`` needs rows that reach it.

    Rows with a ``leaf`` are scored only with the queries that name it among their ``cells``.
    """
    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return best_of_part(a, b, k, least, exclude_same)

    return left.groupBy(*part).cogroup(right.groupBy(*part)).applyInPandas(score, RANKED)


def ranked(rows: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("q_binary", "q_addr").orderBy(F.desc("similarity"), "binary", "addr")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def meeting(cells: DataFrame, visits: DataFrame, cell: list[str], block_rows: int) -> tuple[DataFrame, DataFrame, list[str], Column]:
    """Index rows and visiting queries in blocks of at most ``block_rows`` on average, each pair of blocks of a cell being one part.

    A cell that nobody visits isn't moved; of the rows' other columns ``leaf`` and ``cells`` come along.  Also returns the parts' columns and the number of copies that a cell's blocks take.
    """
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / block_rows)).cast("int")
    sizes = (cells.groupBy(*cell).agg(F.count("*").alias("_n")).join(visits.groupBy(*cell).agg(F.count("*").alias("_v")), cell)
             .select(*cell, "_n", "_v", blocks(F.col("_n")).alias("_subs"), blocks(F.col("_v")).alias("_qbs")))
    sizes = cut_lineage(sizes)
    def dealt(hashed, n):
        return F.pmod(F.xxhash64(*hashed), F.col(n).cast("bigint")).cast("int")
    left = (cells.join(sizes, cell).withColumn("sub", dealt(["binary", "addr"], "_subs"))
            .withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("_qbs") - 1))))
    right = (visits.join(sizes, cell).withColumn("qb", dealt(["q_binary", "q_addr"], "_qbs"))
             .withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("_subs") - 1))))
    copies = sizes.agg(F.sum(F.col("_n") * F.col("_qbs") + F.col("_v") * F.col("_subs"))).first()[0] or 0
    return (left.select(*cell, "sub", "qb", "binary", "addr", "vector", *[c for c in ("leaf",) if c in cells.columns]),
            right.select(*cell, "sub", "qb", "q_binary", "q_addr", "vector", "bar", *[c for c in ("cells",) if c in visits.columns]),
            [*cell, "sub", "qb"], copies)


def _visits(tree: Tree, done: int, step: int):
    @F.pandas_udf("array<array<int>>")
    def visits(vectors: pd.Series, bars: pd.Series) -> pd.Series:
        return pd.Series(tree.next_visits(unit(vectors), bars.to_numpy(), done, step))
    return visits


def exact(index: DataFrame, queries: DataFrame, k: int, least: float, exclude_same: bool, pivots: int | None, block_rows: int | None,
          counted: dict | None = None) -> DataFrame:
    """Exact k best per query.  Rounds of visits grow in width by a factor, which bounds the cells that a query visits beyond those it needs.

    ``counted``, if given, gets the number of vectors that were copied to a block, and of rounds.
    """
    index = index.select("binary", "addr", "vector")
    n, zeros, most = measured(index)
    if most > (block_rows or BLOCK_ROWS):
        index = few_copies(index, k)
    block_rows = block_rows or min(MOST_BLOCK_ROWS, max(BLOCK_ROWS, math.ceil(n / 8)))
    kind = narrow(index, queries)
    asked = queries.select(F.col("binary").alias("q_binary"), F.col("addr").alias("q_addr"), F.col("vector").alias("vector"))
    length = V.dot(F.col("vector"), F.col("vector"))
    none = [asked.filter(length == 0), asked.filter(length > 0).withColumn("vector", F.col("vector").cast(kind))]
    tree, cells = grown(index, pivots or 1 + min(MOST_PIVOTS, math.isqrt(n), n // LEAF_ROWS), block_rows, kind)
    # vectors of zeros have similarity 0 with all: the first rows win, as among copies
    own = Window.partitionBy("binary").orderBy("addr")
    def firsts(rows):
        first = rows.withColumn("_r", F.row_number().over(own)).filter(F.col("_r") <= k).orderBy("binary", "addr").limit(2 * k)
        return first.select("binary", "addr", F.lit(1).alias("one"))
    def with_zero(q, rows):
        met = q.select("q_binary", "q_addr", F.lit(1).alias("one")).join(F.broadcast(firsts(rows)), "one")  # at most 2k rows
        met = met.filter(F.col("q_binary") != F.col("binary")) if exclude_same else met
        return met.select("q_binary", "q_addr", "binary", "addr", F.lit(0.0).alias("similarity")).filter(F.col("similarity") >= least)
    best = asked.sparkSession.createDataFrame([], RANKED)
    if not none[0].isEmpty():
        best = best.unionByName(with_zero(none[0], index))
    if zeros:
        best = best.unionByName(with_zero(none[1], index.filter(length == 0)))
    best, active = ranked(best, k), none[1]
    done, step, copied, rounds = 0, FIRST, 0, 0
    while tree is not None and done < len(tree.leaves):
        full = best.filter(F.col("rank") == k).select("q_binary", "q_addr", F.col("similarity").alias("bar"))
        waiting = active.join(full, ["q_binary", "q_addr"], "left").withColumn("bar", F.greatest(F.coalesce("bar", F.lit(-1.0)), F.lit(float(least))))

        visits = _visits(tree, done, step)
        active = cut_lineage(waiting.withColumn("cells", visits("vector", "bar")).filter(F.size("cells") > 0))
        if active.isEmpty():
            break
        left, right, part, copies = meeting(cells, active.withColumn("cells", F.explode("cells")).withColumn("grp", F.col("cells")[0]), ["grp"], block_rows)
        found = scored(left, right, part, k, least, exclude_same)
        best = cut_lineage(ranked(best.drop("rank").unionByName(found), k).select("q_binary", "q_addr", "binary", "addr", "similarity", "rank"))
        active = active.select("q_binary", "q_addr", "vector")
        done, step, copied, rounds = done + step, FACTOR * step, copied + copies, rounds + 1
    if counted is not None:
        counted.update(copied=copied, rounds=rounds)
    return cut_lineage(best.select("q_binary", "q_addr", "binary", "addr", "similarity", "rank")) if rounds == 0 else best


def planes(dim: int, tables: int, bits: int, seed: int = 17) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((tables, bits, dim))


def approximate(index: DataFrame, queries: DataFrame, k: int, least: float, exclude_same: bool, tables: int, probes: int,
                bucket_rows: int, block_rows: int, seed: int = 17) -> DataFrame:
    """k best among the rows that share a bucket with the query: buckets are sign codes under random hyperplanes, in several tables.

    The number of bits grows with the log of the index, so a bucket holds ``bucket_rows`` rows on average.  A query also visits, per table, the
    ``probes`` buckets behind the hyperplanes that it lies closest to.  Large buckets are cut into blocks; none is capped.
    """
    index = index.select("binary", "addr", "vector")
    n, _, most = measured(index)
    if most > block_rows:
        index = few_copies(index, k)
    first = index.select(F.size("vector")).first()
    bits = max(1, min(24, math.ceil(math.log2(max(2, n / bucket_rows)))))
    normal = planes(first[0] if first else 1, tables, bits, seed)
    weight = 1 << np.arange(bits)

    @F.pandas_udf("array<int>")
    def codes(vectors: pd.Series) -> pd.Series:
        side = np.einsum("nd,tbd->ntb", unit(vectors), normal) > 0
        return pd.Series((side @ weight).tolist())

    @F.pandas_udf("array<array<int>>")
    def near_codes(vectors: pd.Series) -> pd.Series:
        far = np.einsum("nd,tbd->ntb", unit(vectors), normal)
        code = (far > 0) @ weight
        flips = np.argsort(np.abs(far), axis=2)[:, :, :min(probes, bits)]
        return pd.Series(np.concatenate([code[:, :, None], code[:, :, None] ^ weight[flips]], axis=2).tolist())

    cells = cut_lineage(index.select("*", F.posexplode(codes("vector")).alias("t", "code")))
    asked = queries.select(F.col("binary").alias("q_binary"), F.col("addr").alias("q_addr"), F.col("vector").alias("vector"), F.lit(-1.0).alias("bar"))
    visits = asked.select("*", F.posexplode(near_codes("vector")).alias("t", "near")).withColumn("code", F.explode("near")).drop("near")
    left, right, part, _ = meeting(cells, cut_lineage(visits), ["t", "code"], block_rows)
    found = scored(left, right, part, k, least, exclude_same).distinct()  # a row met in several tables has one similarity
    return cut_lineage(ranked(found, k))
