"""Quality scores from pairwise preferences (Bradley and Terry).

A document's score is linear in measures of its text.  It is learnt from preference pairs, a good document over a bad
one: the chance that the good one wins is the logistic function of the difference of their scores, so the loss is
logistic on differences of measures.  The threshold is the exact quantile of the scores of all labelled documents: as many lie
below it as are labelled bad.  Scores are shifted so that the threshold is ``CUT``.

Every labelled row that is not held out takes part.  Rows are dealt by a hash of the id to groups of about ``GROUP``; rows of
the rarer label go to as many groups as give each about ``RARE`` of them.  In a group each row of the commoner side meets
``MEETINGS`` of the other.  Newton steps sum over all pairs in tasks; sums and counts alone visit the driver.

Null texts count as empty and get the score of their measures; repeated rows get equal scores; a null id is
never held out and never labelled.  A repeated id is learnt once per label.  Without labels of both kinds all scores are 1.  Other columns are never read.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import cut_lineage
from .common import documents, map_arrow, text_of

FOLDS, CUT, RIDGE = 5, 0.3, 1e-3
GROUP, RARE, MEETINGS, BINS = 4096, 32, 8, 1024
MEASURES = ("capitals", "symbols", "marks", "bars", "digits", "breaks", "distinct", "same", "compressed", "word", "words", "few", "ended")


def measures(text: str) -> list[float]:
    """Measures of one text, each of about unit size."""
    import math
    import zlib
    raw = text.encode()
    n = max(len(raw), 1)
    words = text.split()
    m = max(len(words), 1)
    of = lambda cs: sum(raw.count(c) for c in cs)
    capitals = n - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    symbols = n - len(raw.translate(None, b"#*$%&<>^~=_@\\{}[]"))
    digits = n - len(raw.translate(None, b"0123456789"))
    same = sum(a == b for a, b in zip(words, words[1:])) / m
    packed = len(zlib.compress(raw, 1)) / n
    return [min(1.0, 4 * capitals / n), min(1.0, 10 * symbols / n), min(1.0, 20 * of((b"!!", b"??")) / n), min(1.0, 30 * of((b"|",)) / n),
            min(1.0, 10 * digits / n), min(1.0, 20 * of((b"\n",)) / n), len(set(words)) / m, same, min(packed, 0.6),
            min(2.0, len(text) / m / 6), math.log1p(len(words)) / 8, float(len(words) < 10), float(text.rstrip()[-1:] in tuple(".!?…\"'”»)"))]


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and the measures of every whole text."""
    def run(b):
        import numpy as np
        import pyarrow as pa
        x = np.array([measures(t) for t in b.column("_text").to_pylist()])
        return pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, x.T)], names=["doc_id", *MEASURES])
    df = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of(docs, text).alias("_text"))
    return map_arrow(df, "_text", run, "doc_id bigint, " + ", ".join(f"{m} double" for m in MEASURES))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(False))


@dataclass
class Model:
    weights: list[float]
    shift: float

    def linear(self) -> Column:
        """Weighted sum of the measures."""
        s = F.lit(0.0)
        for name, w in zip(MEASURES, self.weights):
            s = s + F.col(name) * w
        return s

    def score(self) -> Column:
        """Column of the score, from the measures."""
        return 1 / (1 + F.exp(self.shift - self.linear()) * ((1 - CUT) / CUT))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, quality and the measures of all rows that may be learnt from, one per id and label."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")) \
        .filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out()).distinct()
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter(F.col("doc_id").isNotNull() & ~held_out())
    # texts are reduced to measures before the join, so none is shuffled
    return measured(texts).join(known, "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct(*MEASURES)).alias("m")).select("doc_id", "quality", "m.*")


def groups(rows: DataFrame, counts: dict[int, int], size: int = GROUP) -> DataFrame:
    """Differences of measures of the pairs of each group, as bytes of doubles; every row is in at least one pair."""
    n = max(1, (counts[0] + counts[1]) // size)
    rare = min(counts, key=counts.get)
    copies = min(n, -(-RARE * n // counts[rare]))
    at = F.pmod(F.xxhash64("doc_id"), F.lit(n))
    to = F.when(F.col("quality") == rare, F.sequence(F.lit(0), F.lit(copies - 1))).otherwise(F.array(F.lit(0)))
    dealt = rows.withColumn("copy", F.explode(to)).withColumn("part", F.pmod(at + F.col("copy"), F.lit(n)))

    def pairs(group):
        import numpy as np
        import pandas as pd
        group = group.sort_values("doc_id")
        sides = [group[group["quality"] == q][list(MEASURES)].to_numpy() for q in (0, 1)]
        bad, good = sides
        if not len(bad) or not len(good):
            return pd.DataFrame({"part": [], "pairs": []})
        most, few = max(len(bad), len(good)), min(len(bad), len(good))
        i = np.tile(np.arange(most), min(MEETINGS, few))
        j = (i + np.repeat(np.arange(min(MEETINGS, few)), most) * max(1, few // MEETINGS)) % few
        d = good[j] - bad[i] if len(bad) == most else good[i] - bad[j]
        return pd.DataFrame({"part": group["part"].iloc[:1].to_numpy(), "pairs": [d.astype("<f8").tobytes()]})

    return dealt.groupBy("part").applyInPandas(pairs, "part bigint, pairs binary")


def _sums(pairs: DataFrame, w):
    """Number of pairs, gradient and curvature of the loss at ``w`` over all pairs; one row per task is gathered."""
    import numpy as np
    k = len(w)

    def run(batches):
        import pyarrow as pa
        total = np.zeros(1 + k + k * k)
        for batch in batches:
            for raw in batch.column("pairs"):
                d = np.frombuffer(raw.as_buffer(), "<f8").reshape(-1, k)
                p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))          # chance that the bad one wins
                total += np.concatenate([[len(d)], d.T @ p, ((d * (p * (1 - p))[:, None]).T @ d).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["sums"])

    total = np.sum([r["sums"] for r in pairs.select("pairs").mapInArrow(run, "sums array<double>").collect()], axis=0)
    return total[0], total[1:k + 1], total[k + 1:].reshape(k, k)


def fit(pairs: DataFrame) -> list[float]:
    """Weights by Newton steps on the logistic loss over all pairs."""
    import numpy as np
    w = np.zeros(len(MEASURES))
    for _ in range(30):
        n, slope, curve = _sums(pairs, w)
        step = np.linalg.solve(curve / n + RIDGE * np.eye(len(w)), slope / n - RIDGE * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def nth(values: DataFrame, n: int) -> float:
    """The value of rank ``n`` from 0 in the column ``x``, exactly: counts of ever narrower bins."""
    low, high = values.agg(F.min("x"), F.max("x")).first()
    while low < high:
        inside = values.filter((F.col("x") >= low) & (F.col("x") <= high))
        bin_of = F.least(F.lit(BINS - 1), F.floor((F.col("x") - low) / (high - low) * BINS))
        bins = inside.groupBy(bin_of.alias("b")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()
        for r in sorted(bins, key=lambda r: r["low"]):
            if n < r["n"]:
                low, high = r["low"], r["high"]
                break
            n -= r["n"]
    return low


def learn(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model from all labelled rows that are not held out."""
    rows = cut_lineage(labelled(docs, labels))
    counts = {r["quality"]: r["n"] for r in rows.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    model = Model(fit(cut_lineage(groups(rows, counts))), 0.0)
    scores = cut_lineage(rows.select(model.linear().alias("x")))
    model.shift = (nth(scores, counts[0] - 1) + nth(scores, counts[0])) / 2
    return model


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    score = model.score() if model else F.lit(1.0)
    return measured(docs).select("doc_id", held_out().alias("held_out"), score.alias("score")) \
        .withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def op3_ranking(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return scored(docs, learn(docs, spark.read.parquet(f"{folder}/labels.parquet")))
