"""What sinks write and readers read back, through files in the shared folder."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ...operators import kb, learn, similarity, traces
from ...session import shared_folder
from ...sources import corpus, export, tables
from ._register import Catalog
from .corpus import _shard_results

QUERIES = Catalog()
q = QUERIES.query


def _folder(t) -> str:
    return f"{shared_folder(t.spark).rstrip('/')}/store-{uuid.uuid4().hex}"


@q("vectors", "SELECT binary, addr, len(vector) AS dim, round(list_sum(vector), 6) AS total FROM vectors")
def store_vectors(t):
    path = _folder(t)
    similarity.save(t.vectors(), path)
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)
    return similarity.load(t.spark, path).select("binary", "addr", F.size("vector").alias("dim"), F.round(total, 6).alias("total"))


@q("kb_pairs", "SELECT binary_old, addr_old, binary_new, addr_new, 2 AS times, 2 AS stamped FROM kb_pairs")
def store_kb(t):
    """Two appends; rows without a time get one."""
    path, pairs = _folder(t), t.kb_pairs().withColumn("ts", F.lit(None).cast("timestamp"))
    kb.append(pairs, path)
    kb.append(pairs.withColumn("ts", F.lit("2024-01-01").cast("timestamp")), path)
    return t.spark.read.parquet(path).groupBy("binary_old", "addr_old", "binary_new", "addr_new").agg(
        F.count("*").alias("times"), F.count("ts").alias("stamped"))


@q("ev", "SELECT user_id AS epoch, round(avg(event_id % 100), 4) AS loss, round(avg(k), 4) AS acc FROM ev GROUP BY user_id")
def store_history(t):
    """Metric points appended in two parts."""
    path = _folder(t)
    points = t.ev().select(F.col("user_id").alias("epoch"), (F.col("event_id") % 100).alias("loss"), F.col("k").alias("acc"), (F.col("event_id") % 2).alias("part"))
    for part in (0, 1):
        learn.append_history(points.filter(F.col("part") == part).drop("part"), path)
    means = learn.epoch_means(t.spark.read.parquet(path), ["loss", "acc"])
    return means.select("epoch", F.round("loss", 4).alias("loss"), F.round("acc", 4).alias("acc"))


@q("ev", "SELECT k AS pattern, count(*) AS n, CASE WHEN k % 2 = 0 THEN round(count(DISTINCT user_id) * 0.1, 6) END AS confidence FROM ev GROUP BY k")
def store_patterns(t):
    path, rows = _folder(t), t.ev().withColumnRenamed("k", "pattern")
    conf = rows.filter("pattern % 2 = 0").groupBy("pattern").agg(F.round(F.count_distinct("user_id") * 0.1, 6).alias("confidence"))
    traces.save_patterns(rows.groupBy("pattern").agg(F.count("*").alias("n")), conf, path)
    return traces.load_patterns(t.spark, path).select("pattern", "n", "confidence")


@q("functions", "SELECT binary, addr, name, size FROM functions WHERE size > 400")
def store_findings(t):
    path, rows = _folder(t), t.lean().filter("size > 400").select("binary", "addr", "name", "size")
    export.findings(rows, path)
    return t.spark.read.schema(rows.schema).json(path)


@q("functions", """SELECT binary, shard_start, shard_start + 3000 AS shard_end, addr * 2 + addr % 5 % 2 AS ea, CASE shard_start WHEN 0 THEN 'sub_' || addr ELSE name END AS name,
    size + shard_start // 500 AS size FROM functions, (SELECT unnest([0, 500]) AS shard_start)""")
def store_shards(t):
    """One JSON file per shard result, read back with their functions."""
    results = _shard_results(t)
    number = F.regexp_extract("binary", "([0-9]+)", 1)
    body = F.to_json(F.struct("shard_start", "shard_end", F.lit(1.5).alias("elapsed_s"), "funcs"))
    folder = t.stored(results.select(F.concat(F.lit("shard/"), number, F.lit("-"), "shard_start", F.lit(".json")).alias("path"), F.encode(body, "UTF-8").alias("content")))
    good, _ = tables.read_shards(t.spark, f"{folder}/shard")
    return good.select(F.concat(F.lit("Brand#"), F.regexp_extract("path", "([0-9]+)-[0-9]+.json$", 1)).alias("binary"), "shard_start", "shard_end",
                       F.explode("funcs").alias("f")).select("binary", "shard_start", "shard_end", "f.ea", "f.name", "f.size")


@q("blobs", "SELECT path, length(h) // 2 AS size, md5(unhex(h)) AS digest FROM blobs")
def store_seeds(t):
    """Every stored seed, none left out."""
    seeds = corpus.read_seeds(t.spark, f"{t.stored(t.blobs())}/bin", None, None)
    return seeds.select(F.regexp_extract("path", "(bin/[0-9]+)$", 1).alias("path"), F.length("payload").alias("size"), F.md5("payload").alias("digest"))
