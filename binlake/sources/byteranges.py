"""Files by byte range: rows (path, offset, length) that tasks list, deal out and read, and slices for rows that name ranges.

A header costs its own bytes, a file may be larger than any row can be, and bytes are read in the task that looks at them, so no file content is
ever shuffled.  Paths are local or of a store that ``pyarrow.fs`` opens (file, s3, gs, hdfs); all executors must reach them.

Many small files may be stored in packs: one behind the other in few large files, with an index of their names and places beside each.
``listed`` names such a member ``<pack>@<place>+<length>/<name>``, and whatever reads a path reads that much of the pack.
"""
from __future__ import annotations

import fnmatch
import functools
import itertools
import math
import os
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import cut_lineage

CHUNK, HEAD = 1 << 22, 64
#: Bytes and ranges that one task reads.
TASK_BYTES, TASK_RANGES = 1 << 26, 4096
#: Tasks of one step at most; above, tasks grow.
MOST_TASKS = 4096
#: Bytes and members after which a pack is closed.
PACK_BYTES, PACK_FILES = 1 << 26, 1 << 16
#: The path of a member: the pack, the place in it and the length; the last six digits of the place are within a block.
MEMBER = r"^(.+?/_pack-[0-9-]+[.]data)@([0-9]{12,})[+]([0-9]+)/"
BLOCK = r"^(.+?/_pack-[0-9-]+[.]data@[0-9]{6,})[0-9]{6}[+][0-9]+/"
SCHEMA = "path string, length bigint, off bigint, lead int, own int, data binary"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _entries(folder: str) -> Iterator[tuple[str, bool, int | None]]:
    """(path, whether a folder, length where the listing tells it) of what lies directly in a folder; local ones are streamed."""
    fs, root = opened(folder)
    if isinstance(fs, pafs.LocalFileSystem):
        with os.scandir(root) as found:
            for e in found:
                if e.is_dir() or e.is_file():
                    yield f"{folder.rstrip('/')}/{e.name}", e.is_dir(), None
        return
    prefix = folder[:len(folder) - len(root)] if folder.endswith(root) else ""
    for info in fs.get_file_info(pafs.FileSelector(root)):
        if info.type in (pafs.FileType.File, pafs.FileType.Directory):
            yield prefix + info.path, info.type == pafs.FileType.Directory, info.size


def _listing(glob: str):
    schema = pa.schema([("path", pa.string()), ("kind", pa.string()), ("length", pa.int64())])

    def kind(path: str, folder: bool) -> str | None:
        name = path.rpartition("/")[2]
        return "folder" if folder else "pack" if re.fullmatch("_pack-[0-9-]+[.]index", name) else "file" if _wanted(name, glob) else None

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                entries = ((name, k, length) for name, folder, length in _entries(path) if (k := kind(name, folder)))
                while held := list(itertools.islice(entries, 1 << 14)):
                    yield _batch(held, schema)
    return run


def _members(glob: str, recursive: bool):
    """(name, path, length) of the files in packs, by the indexes' paths."""
    schema = pa.schema([("name", pa.string()), ("path", pa.string()), ("length", pa.int64())])

    def run(batches):
        for batch in batches:
            for index in batch.column("path").to_pylist():
                fs, inside = opened(index)
                folder, pack = index.rpartition("/")[0], index.removesuffix("index") + "data"
                rows = zip(*(c.to_pylist() for c in pq.read_table(inside, filesystem=fs).select(["name", "at", "length"]).columns))
                entries = ((f"{folder}/{name}", f"{pack}@{at:012d}+{length}/{name}", length) for name, at, length in rows
                           if _wanted(name.rpartition("/")[2], glob) and (recursive or "/" not in name))
                while held := list(itertools.islice(entries, 1 << 14)):
                    yield _batch(held, schema)
    return run


def _wanted(name: str, glob: str) -> bool:
    return not name.startswith((".", "_")) and fnmatch.fnmatch(name, glob)


def _lengths(batches) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("path", pa.string()), ("length", pa.int64())])
    for batch in batches:
        known = zip(batch.column("path").to_pylist(), batch.column("length").to_pylist())
        rows = [(path, os.stat(opened(path)[1]).st_size if length is None else length) for path, length in known]
        yield _batch(rows, schema) if rows else schema.empty_table().to_batches()[0]


def listed(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """(path, length) of the non-empty files below ``path`` whose name matches; names that begin with a dot or a line are left out.

    Folders are listed by tasks, one level of the tree a round, and no name passes the driver.  A local folder's names are
    streamed and their lengths read by other tasks; of another store one task holds one folder's names.  Members of a pack are
    listed like files in the pack's folder, one for each name.
    """
    folders, rounds = spark.createDataFrame([(path,)], "path string"), []
    while True:
        found = cut_lineage(folders.mapInArrow(_listing(glob), "path string, kind string, length bigint"))
        rounds.append(found)
        folders = found.filter("kind = 'folder'").select("path")
        below = folders.count() if recursive else 0
        if not below:
            break
        folders = folders.repartition(min(below, MOST_TASKS), "path")
    found = functools.reduce(DataFrame.unionByName, rounds)
    names, packs = found.filter("kind = 'file'").select("path", "length"), found.filter("kind = 'pack'").select("path")
    tasks, packed = _tasks(names.count(), 0), packs.count()
    files = names.repartition(tasks, "path").mapInArrow(_lengths, "path string, length bigint").filter("length > 0")
    if packed:
        members = packs.repartition(min(packed, MOST_TASKS), "path").mapInArrow(_members(glob, recursive), "name string, path string, length bigint")
        named = members.filter("length > 0").unionByName(files.withColumn("name", F.col("path")))
        files = (named.repartition(min(MOST_TASKS, max(tasks, packed)), "name").groupBy("name")
                 .agg(F.max(F.struct("path", "length")).alias("_file")).select("_file.*"))
    return cut_lineage(files)


def _tasks(ranges: int, size: int) -> int:
    return min(MOST_TASKS, max(1, -(-ranges // TASK_RANGES), -(-size // TASK_BYTES)))


class _Files:
    """Reads files and members of packs; neighbours in one file share it open."""

    def __init__(self):
        self._name = self._file = None

    def read(self, path: str, off: int, n: int) -> bytes:
        """At most ``n`` bytes from an offset, none where it lies outside."""
        member = re.match(MEMBER, path)
        name = member[1] if member else path
        if name != self._name:
            self.close()
            fs, inside = opened(name)
            self._name, self._file = name, fs.open_input_file(inside)
        start, size = (int(member[2]), int(member[3])) if member else (0, self._file.size())
        return self._file.read_at(min(n, size - off), start + off) if 0 <= off < size and n > 0 else b""

    def close(self) -> None:
        if self._file is not None:
            self._file.close()
        self._name = self._file = None


def _batches(rows, schema: pa.Schema, limit: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1] or b"")
        if size > limit or len(held) >= 1024:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


def load(spark: SparkSession, path: str, glob: str = "*", chunk: int = CHUNK, head: int = 0, before: int = 0, after: int = 0) -> DataFrame:
    """Rows (path, length, off, lead, own, data) of the files below ``path``, empty ones left out.

    ``data`` starts ``lead`` bytes before offset ``off`` and holds ``own`` bytes from there and those behind that were asked for
    (``before``, ``after``).  ``chunk`` is the own bytes of a row; ``head`` asks for only that many first bytes of each file.
    """
    # a block of a pack is read by one task, in order; ranges of other files are dealt out one by one
    files = listed(spark, path, glob).withColumn("block", F.regexp_extract("path", BLOCK, 1))
    single = F.col("block") == ""
    starts = F.array(F.lit(0).cast("bigint")) if head else F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(chunk).cast("bigint"))
    own = F.least(F.lit(head), F.col("length")) if head else F.least(F.lit(chunk), F.col("length") - F.col("off"))
    ranges = files.select("path", "length", "block", F.explode(starts).alias("off")).withColumn("own", own.cast("bigint"))
    opens = (F.lit(1) if head else F.ceil(F.col("length") / chunk)) * F.when(single, 1).otherwise(TASK_RANGES / PACK_FILES)
    size = files.agg(F.sum(opens), F.sum(F.least(F.lit(head), F.col("length")) if head else F.col("length"))).first()
    dealt = F.when(single, F.col("path")).otherwise(F.col("block")), F.when(single, F.col("off")).otherwise(F.expr(f"off div {CHUNK}"))
    ranges = ranges.repartition(_tasks(*(math.ceil(x or 0) for x in size)), *dealt).sortWithinPartitions("path", "off")
    ranges = cut_lineage(ranges.select("path", "length", "off", "own"))
    schema = pa.schema([("path", pa.string()), ("length", pa.int64()), ("off", pa.int64()), ("lead", pa.int32()), ("own", pa.int32()), ("data", pa.binary())])

    def read(batches):
        files = _Files()
        for batch in batches:
            rows = ((*row, min(row[2], before)) for row in zip(*(c.to_pylist() for c in batch.columns)))
            yield from _batches(((p, length, off, lead, own, files.read(p, off - lead, lead + own + after)) for p, length, off, own, lead in rows), schema)
        files.close()

    return ranges.mapInArrow(read, SCHEMA)


def chunks(spark: SparkSession, path: str, base: Column | None = None, size: int = CHUNK, before: int = 0, after: int = 0, glob: str = "*") -> DataFrame:
    """Chunks as ``scan.chunks`` cuts them from contents; ``base`` is an expression of the path."""
    rows = load(spark, path, chunk=size, before=before, after=after, glob=glob)
    at = (F.lit(0) if base is None else base) + F.col("off")
    return rows.select("path", at.cast("bigint").alias("va"), "off", "lead", "own", "data")


def heads(spark: SparkSession, path: str, size: int = HEAD, glob: str = "*") -> DataFrame:
    """(path, length, content) with the first bytes of each file as its content."""
    return load(spark, path, head=size, glob=glob).select("path", "length", F.col("data").alias("content"))


def slices(rows: DataFrame, pieces: str = "pieces", data: str = "data") -> DataFrame:
    """``rows`` (with a path) without their ``pieces`` (off, n), and with the bytes of these, one behind the other.

    A piece beyond the end is cut; null pieces give null.  Rows stay where they are, and neighbours in one file share it open.
    """
    schema = rows.drop(pieces).schema.add(data, "binary")

    def run(batches):
        for batch in batches:
            files, got = _Files(), []
            for path, wanted in zip(batch.column("path").to_pylist(), batch.column(pieces).to_pylist()):
                got.append(None if path is None or wanted is None else b"".join(files.read(path, x["off"], x["n"]) for x in wanted))
            files.close()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in schema.names[:-1]), pa.array(got, pa.binary())], names=schema.names)

    return rows.select(*schema.names[:-1], pieces).mapInArrow(run, schema)


def piece(off: Column, n: Column) -> Column:
    return F.array(F.struct(off.cast("bigint").alias("off"), n.cast("bigint").alias("n")))


def store(blobs: DataFrame, folder: str) -> DataFrame:
    """Writes ``content`` of each row to ``path`` below the folder; one row (path, length) per file.  A repeated task writes the same files again."""
    def run(batches):
        for batch in batches:
            done = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                fs, inside = opened(f"{folder}/{path}")
                fs.create_dir(inside.rpartition("/")[0], recursive=True)
                with fs.open_output_stream(inside) as f:
                    f.write(content or b"")
                done.append((f"{folder}/{path}", len(content or b"")))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], names=["path", "length"])
    return blobs.select("path", "content").mapInArrow(run, "path string, length bigint")


class _Pack:
    """A pack that is being written; its index follows when it is closed, so that one that broke off isn't listed."""

    def __init__(self, folder: str, name: str, most: int):
        self._fs, root = opened(folder)
        self._most = most
        self._fs.create_dir(root, recursive=True)
        self._stem, self._rows, self._size = f"{root}/{name}", [], 0
        self._out = self._fs.open_output_stream(f"{self._stem}.data", buffer_size=1 << 20)

    def add(self, name: str, content: bytes) -> bool:
        """Whether the pack is full now."""
        self._out.write(content)
        self._rows.append((name, self._size, len(content)))
        self._size += len(content)
        return self._size >= PACK_BYTES or len(self._rows) >= self._most

    def close(self) -> None:
        self._out.close()
        index = _batch(self._rows, pa.schema([("name", pa.string()), ("at", pa.int64()), ("length", pa.int64())]))
        pq.write_table(pa.Table.from_batches([index]), f"{self._stem}.index", filesystem=self._fs)


def pack(blobs: DataFrame, folder: str, most: int = PACK_FILES) -> DataFrame:
    """Writes ``content`` of each row into packs of ``most`` files in a fresh folder, under the name ``path``; one row (path, length) per file.

    Packs are a task attempt's own: what a repeated task wrote twice is listed once, and so is a path that comes in several rows.
    """
    def run(batches):
        task, numbers, out = TaskContext.get(), itertools.count(), None
        for batch in batches:
            done = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                out = out or _Pack(folder, f"_pack-{task.partitionId()}-{task.taskAttemptId()}-{next(numbers)}", most)
                if out.add(f"{path}", content or b""):
                    out.close()
                    out = None
                done.append((f"{folder}/{path}", len(content or b"")))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], names=["path", "length"])
        if out:
            out.close()
    return blobs.select("path", "content").mapInArrow(run, "path string, length bigint")
