"""Keyed tables that are merged when they are read.

A batch is appended under a name of its own; running it again finds it committed, or writes its folder anew.  Readers take the row of the
highest version of each key from the newest base and the batches that it hasn't absorbed.  ``compact`` writes a new base beside all others, and ``vacuum``
removes what no reader needs.  A folder counts once its ``_SUCCESS`` marker is there, which is written last, so a
failure at any point leaves the table as it was.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

DONE = "_SUCCESS"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _committed(spark: SparkSession, path: str) -> list[str]:
    """Names of the finished folders below ``path``, in order."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
    return sorted(n for n in names if fs.exists(_fs(spark, f"{path}/{n}/{DONE}")[1]))


def append(batch: DataFrame, path: str, name: str) -> bool:
    """Adds a batch under its name; False if it is there already."""
    spark = batch.sparkSession
    if name in _committed(spark, f"{path}/batches"):
        return False
    batch.write.mode("overwrite").parquet(f"{path}/batches/{name}")
    return True


def delete(spark: SparkSession, path: str, name: str, key: str, value: str, until: int) -> bool:
    """Deletes the rows whose first key, the column ``key``, is ``value``, up to version ``until``, also those that still come late; False if ``name`` is there already."""
    if name in _committed(spark, f"{path}/deletes"):
        return False
    spark.createDataFrame([(value, until)], f"`{key}` string, `_until` bigint").coalesce(1).write.mode("overwrite").parquet(f"{path}/deletes/{name}")
    return True


def _parts(spark: SparkSession, path: str) -> tuple[str | None, list[str], list[str]]:
    """Newest base, batches that it has absorbed and batches since."""
    bases = _committed(spark, f"{path}/bases")
    base = bases[-1] if bases else None
    absorbed = [r[0] for r in spark.read.parquet(f"{path}/bases/{base}/absorbed").collect()] if base else []
    return base, absorbed, [b for b in _committed(spark, f"{path}/batches") if b not in set(absorbed)]


def current(spark: SparkSession, path: str, schema: StructType, keys: list[str], version: str) -> DataFrame:
    """The row of the highest version of each key; of equal versions the greatest row counts, in whatever order batches came."""
    base, _, batches = _parts(spark, path)
    folders = [f"{path}/bases/{base}/rows"] * (base is not None) + [f"{path}/batches/{b}" for b in batches]
    rows = spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)
    gone = _committed(spark, f"{path}/deletes")
    if gone:
        until = spark.read.schema(f"`{keys[0]}` string, `_until` bigint").parquet(*[f"{path}/deletes/{n}" for n in gone]).groupBy(keys[0]).agg(F.max("_until").alias("_until"))
        rows = rows.join(until, keys[0], "left").filter(F.col("_until").isNull() | (F.col(version) > F.col("_until"))).drop("_until")
    rest = [c for c in schema.names if c not in (*keys, version)]
    # combines before the shuffle
    return rows.groupBy(*keys).agg(F.max(F.struct(version, *rest)).alias("_row")).select(*keys, *[F.col(f"_row.{c}") for c in schema.names if c not in keys])


def compact(spark: SparkSession, path: str, schema: StructType, keys: list[str], version: str) -> str | None:
    """Writes a base of all that is committed now; None if nothing is new.  Batches that come meanwhile stay batches."""
    base, absorbed, batches = _parts(spark, path)
    if not batches:
        return None
    name = f"{int(base or 0) + 1:012d}"
    target = f"{path}/bases/{name}"
    current(spark, path, schema, keys, version).write.mode("overwrite").parquet(f"{target}/rows")
    spark.createDataFrame([(b,) for b in [*absorbed, *batches]], "name string").coalesce(1).write.mode("overwrite").parquet(f"{target}/absorbed")
    fs, p = _fs(spark, f"{target}/{DONE}")
    fs.create(p, True).close()
    return name


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Removes older bases and absorbed batches; only when nobody reads an older state any more.  Returns what went."""
    base, absorbed, _ = _parts(spark, path)
    if base is None:
        return []
    fs, root = _fs(spark, f"{path}/bases")
    old = [f"bases/{s.getPath().getName()}" for s in fs.listStatus(root) if s.getPath().getName() < base]
    gone = [n for n in [*old, *(f"batches/{b}" for b in absorbed)] if fs.exists(_fs(spark, f"{path}/{n}")[1])]
    for n in gone:
        fs.delete(_fs(spark, f"{path}/{n}")[1], True)
    return gone
