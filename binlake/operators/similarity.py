"""Function fingerprints and exact cosine search."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T, vectors as V
from . import graph, pivots as P


def fingerprints(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """104-value vector per function from its listing, pseudocode, size and call degrees.

    Everything that reads text is reduced to numbers where the text is scanned; only these numbers
    are shuffled to meet the degrees.
    """
    body = F.coalesce("pseudocode", F.lit(""))
    listing = F.coalesce("disasm", F.array().cast("array<struct<address:string,text:string>>"))
    parts = functions.select(
        "binary", "addr", "name", V.mnemonic_histogram(listing).alias("_m"), V.log_scale(F.col("size")).alias("_s"),
        V.text_part(body, T.strings(body), T.constants(body)).alias("_t"))
    return graph.with_degrees(parts, calls).select("binary", "addr", "name", V.assemble(
        F.col("_m"), F.col("callers"), F.col("callees"), F.col("_s"), F.col("_t")).alias("vector"))


def stats(vectors: DataFrame) -> DataFrame:
    return vectors.agg(F.count("*").alias("total"), F.count_distinct("binary").alias("binaries"),
                       F.count_if("verified").alias("verified"))


def save(vectors: DataFrame, path: str) -> None:
    vectors.write.mode("append").partitionBy("binary").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def topk(index: DataFrame, queries: DataFrame, k: int = 10, min_similarity: float = 0.0,
         exclude_same: bool = True, pivots: int | None = None, block_rows: int | None = None, counted: dict | None = None) -> DataFrame:
    """Exact top-k by cosine (rounded to 6 digits, ties by binary and addr) for every query.

    ``index`` and ``queries`` have (binary, addr, vector).  A tree of pivots (by default as many as the root of the number of rows, fewer for small tables) cuts the
    index into cells; a query visits them best bound first until none left can beat its k-th best (``pivots.exact``).  No candidate is
    capped.  ``block_rows`` bounds the rows of a cell, and the queries, that meet in one task (by default an eighth of the index, 2,048 to 65,536).  ``counted`` gets the number of copied vectors and of rounds.
    """
    return P.exact(index, queries, k, min_similarity, exclude_same, pivots, block_rows, counted)


def approximate_topk(index: DataFrame, queries: DataFrame, k: int = 10, min_similarity: float = 0.0, exclude_same: bool = True,
                     tables: int = 8, probes: int = 3, bucket_rows: int = 256, block_rows: int = 2048) -> DataFrame:
    """Top-k among rows that share a bucket of random hyperplanes with the query, ranked exactly; ``search_recall`` measures it."""
    return P.approximate(index, queries, k, min_similarity, exclude_same, tables, probes, bucket_rows, block_rows)


def search_recall(ranked: DataFrame, index: DataFrame, queries: DataFrame, every: int = 50, **search) -> DataFrame:
    """found, wanted and recall of ``ranked`` against the exact search, over the queries whose address ``every`` divides."""
    asked = queries.filter(F.col("addr") % every == 0)
    best = topk(index, asked, **search).select("q_binary", "q_addr", "binary", "addr")
    got = ranked.select("q_binary", "q_addr", "binary", "addr", F.lit(True).alias("got"))
    return best.join(got, ["q_binary", "q_addr", "binary", "addr"], "left").agg(
        F.count("got").alias("found"), F.count("*").alias("wanted")).withColumn("recall", F.col("found") / F.greatest(F.lit(1), "wanted"))


def within(index: DataFrame, queries: DataFrame, binary: str, k: int = 10) -> DataFrame:
    """Top-k inside one binary."""
    return topk(index.filter(F.col("binary") == binary), queries, k, exclude_same=False)


def mutual_best(index: DataFrame, queries: DataFrame) -> DataFrame:
    """Pairs that are each other's best match, with the cosine as ratio.  Searches once where both sides are the same table."""
    ab = topk(index, queries, 1).select("q_binary", "q_addr", "binary", "addr", "similarity")
    back = ab if index.sameSemantics(queries) else topk(queries, index, 1)
    ba = back.select(F.col("binary").alias("q_binary"), F.col("addr").alias("q_addr"),
                                        F.col("q_binary").alias("binary"), F.col("q_addr").alias("addr"))
    return ab.join(ba, ["q_binary", "q_addr", "binary", "addr"], "left_semi")


def recall(pairs: DataFrame, ranked: DataFrame) -> DataFrame:
    """Recall@1 and @5 over pairs (binary_a, addr_a, binary_b, addr_b) whose B side was queried."""
    asked = ranked.select(F.col("q_binary").alias("binary_b"), F.col("q_addr").alias("addr_b")).distinct()
    hit = ranked.filter("rank <= 5").select(
        F.col("q_binary").alias("binary_b"), F.col("q_addr").alias("addr_b"),
        F.col("binary").alias("binary_a"), F.col("addr").alias("addr_a"), "rank")
    j = (pairs.join(asked, ["binary_b", "addr_b"], "left_semi")
         .join(hit, ["binary_a", "addr_a", "binary_b", "addr_b"], "left"))
    return j.agg(F.count("*").alias("total_pairs"), F.count_if(F.col("rank") == 1).alias("correct_at_1"),
                 F.count_if(F.col("rank").isNotNull()).alias("correct_at_5")).select(
        "*", (F.col("correct_at_1") / F.greatest(F.lit(1), "total_pairs")).alias("recall_at_1"),
        (F.col("correct_at_5") / F.greatest(F.lit(1), "total_pairs")).alias("recall_at_5"))


def eval_hash(pairs: DataFrame, hash_a: DataFrame, hash_b: DataFrame) -> DataFrame:
    """Exact byte-hash baseline over pairs present on both sides."""
    a = hash_a.select(F.col("binary").alias("binary_a"), F.col("addr").alias("addr_a"), F.col("hash").alias("ha"))
    b = hash_b.select(F.col("binary").alias("binary_b"), F.col("addr").alias("addr_b"), F.col("hash").alias("hb"))
    j = pairs.join(a, ["binary_a", "addr_a"]).join(b, ["binary_b", "addr_b"])
    return j.agg(F.count("*").alias("total_pairs"), F.count_if(F.col("ha") == F.col("hb")).alias("correct")).select(
        "*", (F.col("correct") / F.greatest(F.lit(1), "total_pairs")).alias("recall"))
