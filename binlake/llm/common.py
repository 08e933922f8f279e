"""Helpers shared by the document operators."""
from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import shared_folder

#: Words are runs of anything but these separators, in Java, Python and SQL syntax alike.
SEPARATORS = r"\x20\x09-\x0D"
SLICE = 4 << 20


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def cut(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder and read from there by all that follows."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def text_of(docs: DataFrame, text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def small_letters(word: Column) -> Column:
    """A-Z of a word as a-z, all else as it is; plain ASCII takes the fast way."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(
        F.translate(word, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def whole_rows(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of ``docs`` beside the whole row, so that no other column can clash with names made later."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *columns)


def as_documents(df: DataFrame, docs: DataFrame, **replaced: Column) -> DataFrame:
    """The columns of ``docs`` from whole rows, some with new values."""
    return df.select(*[(replaced[c] if c in replaced else F.col("_row").getField(c)).alias(c) for c in docs.columns])


def slices(batches: Iterable, column: str, limit: int = SLICE) -> Iterator:
    """Arrow batches cut so that ``column`` holds about ``limit`` bytes at most; a longer value stays alone."""
    import numpy as np
    import pyarrow.compute as pc
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at, base = 0, 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, end - at)
            base, at = int(ends[end - 1]), end


def give_back() -> None:
    """Returns what Arrow and the C library hold without using it: idle Python workers outlive their stage."""
    import ctypes

    import pyarrow as pa
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):   # other C libraries
        pass


def released(fn: Callable) -> Callable:
    """``fn`` over the batches of a task, with its memory given back at the end."""
    def run(batches):
        yield from fn(batches)
        give_back()
    return run


def map_arrow(df: DataFrame, column: str, fn: Callable, schema: str, limit: int = SLICE) -> DataFrame:
    """``fn(batch) -> RecordBatch`` over slices of bounded size."""
    def run(batches):
        for part in slices(batches, column, limit):
            yield fn(part)
    return df.mapInArrow(released(run), schema)


def mix(x, salt: int = 0):
    """A 64-bit finaliser on numpy arrays of unsigned integers."""
    import numpy as np
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
