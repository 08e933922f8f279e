"""Readers for shard results, match tables, dictionaries and logs."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import addr as A

SHARD = ("shard_start bigint, shard_end bigint, elapsed_s double, funcs array<struct<ea:bigint,name:string,"
         "size:bigint,callers:array<bigint>,thumb:boolean>>, _corrupt_record string")
RESULT = ("type string, line string, address string, name string, address2 string, name2 string, ratio double, "
          "nodes1 int, nodes2 int, description string")


def read_shards(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Shard results and, apart from them, the unreadable files (path and text)."""
    raw = (spark.read.schema(SHARD).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)
           .withColumn("path", F.col("_metadata.file_path")))
    bad = F.col("_corrupt_record").isNotNull() | F.col("shard_start").isNull()
    return raw.filter(~bad).drop("_corrupt_record"), raw.filter(bad).select("path", "_corrupt_record")


def normalize_matches(rows: DataFrame) -> DataFrame:
    """Diff results with BIGINT addresses and empty instead of missing texts."""
    texts = [c for c in ("type", "name", "name2", "description") if c in rows.columns]
    out = rows.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in texts})
    return out.withColumns({"address": A.parse_loose(F.col("address").cast("string")),
                            "address2": A.parse_loose(F.col("address2").cast("string")),
                            "ratio": F.coalesce(F.col("ratio").try_cast("double"), F.lit(0.0))})


def read_matches(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    reader = spark.read.format(fmt).options(**options)
    if fmt in ("csv", "json"):
        reader = reader.schema(RESULT)
    return normalize_matches(reader.load(path))


def read_symbols(spark: SparkSession, path: str) -> DataFrame:
    """JSON object symbol -> info, one row per symbol."""
    text = spark.read.text(path, wholetext=True)
    info = F.from_json("value", "map<string,struct<namespace:string,func_name:string,size:bigint>>")
    return text.select(F.explode(info).alias("symbol", "i")).select("symbol", "i.*")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(job_id, line_no, line) of analyser logs; the job is the file name.

    Line numbers need whole files; logs are small and each is one row.
    """
    files = spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1).alias("job_id"),
        F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))
    return files


def unchanged(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Files whose (path, modified) pair is not in the manifest of earlier exports."""
    return files.join(manifest.select("path", "modified"), ["path", "modified"], "left_anti")
