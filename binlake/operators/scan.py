"""Code-byte scans over a corpus: function starts, branch targets, strings, assets, shards."""
from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import addr as A, names as N
from ..plans import blocks

CHUNK = 1 << 20
ADDRESSES = T.ArrayType(T.LongType())
WORD_KINDS = ("prologue", "call_target", "block_head")

# Bytes that may precede a function start, and start sequences.
BOUNDARY = bytes([0xC3, 0xC2, 0xCC, 0x90, 0x00, 0xCB, 0xCF])
START_SEQUENCES = (b"\x48\x83\xec", b"\x55\x48\x89\xe5", b"\x48\x81\xec")

# AArch64 encodings (mask, value).
PROLOGUE = (0xFFC07FFF, 0xA9807BFD)
CALL = (0xFC000000, 0x94000000)
# mask, value, immediate shift, immediate width
JUMPS = ((0xFC000000, 0x14000000, 0, 26), (0xFF00001F, 0x54000000, 5, 19),
         (0x7E000000, 0x34000000, 5, 19), (0x7E000000, 0x36000000, 5, 14))

# Asset signatures in search order (name, magic, size limit).
ASSETS = (
    ("png", b"\x89PNG\r\n\x1a\n", 1 << 20), ("jpg", b"\xff\xd8\xff", 1 << 20), ("gif", b"GIF89a", 1 << 19),
    ("gif87", b"GIF87a", 1 << 19), ("riff", b"RIFF", 1 << 20), ("ogg", b"OggS", 1 << 20),
    ("zip", b"PK\x03\x04", 1 << 20), ("gzip", b"\x1f\x8b\x08", 1 << 20), ("bzip2", b"BZh", 1 << 20),
    ("ttf", b"\x00\x01\x00\x00", 1 << 19), ("otf", b"OTTO", 1 << 19), ("woff", b"wOFF", 1 << 19),
    ("bmp", b"BM", 1 << 19), ("elf", b"\x7fELF", 1 << 20), ("wasm", b"\x00asm", 1 << 20),
    ("pdf", b"%PDF-", 1 << 20), ("xml", b"<?xml", 1 << 18),
)
# End marker, search start and bytes kept from the marker on.
ASSET_ENDS = {"png": (b"IEND", 0, 8), "jpg": (b"\xff\xd9", 2, 2), "gif": (b"\x00\x3b", 0, 2),
              "gif87": (b"\x00\x3b", 0, 2)}
MIN_ASSET, MAX_ASSETS, MAX_BLOB, PREFIX = 32, 24, 400 << 20, 64


def chunks(blobs: DataFrame, size: int = CHUNK, before: int = 0, after: int = 0) -> DataFrame:
    """Cut (path, base, content) into rows (path, va, lead, data).

    ``va`` is the address of the first own byte, ``lead`` the number of look-behind bytes in front of
    it; ``own`` bytes follow and then up to ``after`` look-ahead bytes.
    """
    n = F.length("content")
    def piece(off: Column) -> Column:
        lead = F.least(off, F.lit(before))
        return F.struct(off.cast("bigint").alias("off"), lead.cast("int").alias("lead"),
                        F.least(F.lit(size), n - off).cast("int").alias("own"),
                        F.substring(F.col("content"), off - lead + 1, lead + size + after).alias("data"))
    offs = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    return (blobs.select("path", "base", F.explode(F.transform(offs, piece)).alias("c"))
            .select("path", (F.col("base") + F.col("c.off")).alias("va"), "c.off", "c.lead", "c.own", "c.data"))


def _find(data: bytes, needle: bytes) -> np.ndarray:
    """All (also overlapping) positions of a short needle."""
    arr = np.frombuffer(data, np.uint8)
    m = len(arr) - len(needle) + 1
    if m <= 0:
        return np.empty(0, np.int64)
    ok = np.ones(m, bool)
    for i, b in enumerate(needle):
        ok &= arr[i:i + m] == b
    return np.flatnonzero(ok)


@F.pandas_udf(ADDRESSES)
def _x86_hits(va: pd.Series, off: pd.Series, lead: pd.Series, own: pd.Series, data: pd.Series) -> pd.Series:
    edge = np.frombuffer(BOUNDARY, np.uint8)
    out = []
    for start, at, skip, n, raw in zip(va, off, lead, own, data):
        arr = np.frombuffer(raw, np.uint8)
        push = np.flatnonzero(arr == 0x55)
        push = push[push >= skip]
        prev_ok = np.isin(arr[np.maximum(push - 1, 0)], edge) & (push > 0)
        addr = start + push - skip
        hits = [push[prev_ok | (addr % 16 == 0) | ((at == 0) & (push == 0))]]
        hits += [_find(raw, s) for s in START_SEQUENCES]
        pos = np.unique(np.concatenate(hits)) - skip
        out.append((pos[(pos >= 0) & (pos < n)] + start).tolist())
    return pd.Series(out)


def x86_prologues(blobs: DataFrame, size: int = CHUNK) -> DataFrame:
    """x86-64 function starts (path, addr), independent of the chunk size."""
    return x86_starts(chunks(blobs, size, before=1, after=3))


def x86_starts(rows: DataFrame) -> DataFrame:
    """x86-64 function starts of chunks with 1 byte before and 3 behind."""
    hit = _x86_hits("va", "off", "lead", "own", "data")
    return rows.select("path", F.explode(hit).alias("addr")).distinct()


@F.pandas_udf(T.StructType([T.StructField(k, ADDRESSES) for k in WORD_KINDS]))
def _arm64_hits(va: pd.Series, data: pd.Series) -> pd.DataFrame:
    rows = []
    for start, raw in zip(va, data):
        words = np.frombuffer(raw[:len(raw) // 4 * 4], "<u4").astype(np.int64)
        here = start + 4 * np.arange(len(words), dtype=np.int64)
        def target(sel, shift, width):
            imm = (words[sel] >> shift) & ((1 << width) - 1)
            imm = imm - ((imm >> (width - 1)) << width)
            return here[sel] + 4 * imm
        pro = here[(words & PROLOGUE[0]) == PROLOGUE[1]]
        calls = target((words & CALL[0]) == CALL[1], 0, 26)
        heads = [pro]
        for mask, value, shift, width in JUMPS:
            sel = (words & mask) == value
            heads += [target(sel, shift, width), here[sel] + 4]
        rows.append((pro.tolist(), np.unique(calls).tolist(), np.unique(np.concatenate(heads)).tolist()))
    return pd.DataFrame(rows, columns=list(WORD_KINDS))


def arm64_words(blobs: DataFrame, size: int = CHUNK) -> DataFrame:
    """AArch64 prologues, call targets and block heads as rows (path, kind, addr)."""
    return arm64_hits(chunks(blobs, max(4, size // 4 * 4)))


def arm64_hits(rows: DataFrame) -> DataFrame:
    """AArch64 words of chunks of whole words."""
    rows = rows.select("path", _arm64_hits("va", "data").alias("h"))
    def tagged(kind: str) -> Column:
        return F.transform(F.col(f"h.{kind}"), lambda a: F.struct(F.lit(kind).alias("kind"), a.alias("addr")))
    tall = F.flatten(F.array(*[tagged(k) for k in WORD_KINDS]))
    return rows.select("path", F.explode(tall).alias("x")).select("path", "x.*").distinct()


def _runs(min_len: int):
    """Printable runs of a chunk that are long enough or touch its edge."""
    @F.pandas_udf(T.ArrayType(T.StructType().add("pos", T.LongType()).add("text", T.StringType())))
    def runs(data: pd.Series) -> pd.Series:
        short = re.compile(rb"^[\x20-\x7e]+|[\x20-\x7e]{%d,}|[\x20-\x7e]+\Z" % min_len)
        return data.map(lambda raw: [{"pos": m.start(), "text": m.group().decode("ascii")} for m in short.finditer(raw)])
    return runs


def strings(blobs: DataFrame, size: int = CHUNK, min_len: int = 5) -> DataFrame:
    """Printable runs of at least ``min_len`` characters with their address.

    Only runs that touch a chunk edge are stitched, at most two rows per chunk.
    """
    return strings_of(chunks(blobs, size), min_len)


def strings_of(rows: DataFrame, min_len: int = 5) -> DataFrame:
    """``strings`` of chunks without bytes around them."""
    found = (rows.select("path", "va", "own", F.explode(_runs(min_len)("data")).alias("r"))
             .select("path", (F.col("va") + F.col("r.pos")).alias("addr"), F.col("r.text").alias("text"),
                     ((F.col("r.pos") == 0) | (F.col("r.pos") + F.length("r.text") == F.col("own"))).alias("edge")))
    inner = found.filter(~F.col("edge") & (F.length("text") >= min_len)).select("path", "addr", "text")
    w = Window.partitionBy("path").orderBy("addr")
    cut = F.coalesce(F.lag(F.col("addr") + F.length("text")).over(w) != F.col("addr"), F.lit(True))
    grouped = (found.filter("edge").withColumn("_new", cut.cast("int"))
               .withColumn("_g", F.sum("_new").over(w)).groupBy("path", "_g")
               .agg(F.array_sort(F.collect_list(F.struct("addr", "text"))).alias("p")))
    joined = grouped.select("path", F.col("p")[0]["addr"].alias("addr"),
                            F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))
    return inner.unionByName(joined.filter(F.length("text") >= min_len))


def assets_in(raw: bytes, lead: int = 0, own: int | None = None) -> list[dict]:
    """Assets whose signature starts in the ``own`` bytes behind ``lead``, by signature order and offset."""
    out, stop_at = [], len(raw) if own is None else lead + own
    for i, (name, magic, limit) in enumerate(ASSETS):
        for m in re.finditer(re.escape(magic), raw):
            if not lead <= m.start() < stop_at:
                continue
            end = min(m.start() + limit, len(raw))
            if name in ASSET_ENDS:
                marker, skip, keep = ASSET_ENDS[name]
                stop = raw.find(marker, m.start() + skip, end)
                end = min(stop + keep, end) if stop >= 0 else end
            out.append({"sig": i, "name": name, "offset": m.start() - lead, "size": end - m.start(), "prefix": raw[m.start():min(end, m.start() + PREFIX)]})
    return out


@F.pandas_udf(T.ArrayType(T.StructType().add("sig", T.IntegerType()).add("name", T.StringType())
              .add("offset", T.LongType()).add("size", T.LongType()).add("prefix", T.BinaryType())))
def _assets(content: pd.Series) -> pd.Series:
    return pd.Series([assets_in(raw) for raw in content])


def carve(blobs: DataFrame, max_assets: int | None = MAX_ASSETS, min_len: int = MIN_ASSET, max_blob: int | None = MAX_BLOB) -> DataFrame:
    """Embedded assets of each blob, by signature order and offset, one per distinct 64-byte start; None lifts a limit."""
    if max_blob is not None:
        blobs = blobs.filter(F.length("content") <= max_blob)
    return _first_assets(blobs.select("path", F.explode(_assets("content")).alias("h")).select("path", "h.*"), max_assets, min_len)


def _first_assets(hits: DataFrame, max_assets: int | None, min_len: int) -> DataFrame:
    first = hits.filter(F.col("size") >= min_len).groupBy("path", "prefix").agg(F.min(F.struct("sig", "offset", "name", "size")).alias("h"))
    w = Window.partitionBy("path").orderBy("sig", "offset")
    out = first.select("path", "h.*").withColumn("pos", F.row_number().over(w))
    return out if max_assets is None else out.filter(F.col("pos") <= max_assets)


@F.pandas_udf(_assets.returnType)
def _chunk_assets(off: pd.Series, lead: pd.Series, own: pd.Series, data: pd.Series) -> pd.Series:
    return pd.Series([[{**h, "offset": h["offset"] + at} for h in assets_in(raw, skip, n)] for at, skip, n, raw in zip(off, lead, own, data)])


#: Bytes behind a chunk that ``carve_chunks`` needs: the largest asset.
ASSET_BYTES = max(limit for _, _, limit in ASSETS)


def carve_chunks(rows: DataFrame, max_assets: int | None = None, min_len: int = MIN_ASSET) -> DataFrame:
    """``carve`` for chunks with at least ``ASSET_BYTES`` behind them: files of any size, in bounded memory."""
    hits = rows.select("path", F.explode(_chunk_assets("off", "lead", "own", "data")).alias("h"))
    return _first_assets(hits.select("path", "h.*"), max_assets, min_len)


def carved_bytes(blobs: DataFrame, assets: DataFrame) -> DataFrame:
    return assets.join(blobs.select("path", "content"), "path").withColumn(
        "payload", F.substring(F.col("content"), (F.col("offset") + 1).cast("int"), F.col("size").cast("int"))
    ).drop("content")


def profile(blobs: DataFrame, head_bytes: int | None = None) -> DataFrame:
    """Size, first bytes and share of printable bytes, of the whole blob or of its first ``head_bytes``."""
    head = F.decode(F.col("content") if head_bytes is None else F.substring("content", 1, head_bytes), "ISO-8859-1")
    shown = F.length(F.regexp_replace(head, r"[^\x20-\x7E]", ""))
    return blobs.select("path", F.length("content").cast("bigint").alias("size"),
                        F.lower(F.hex(F.substring("content", 1, 16))).alias("first_bytes"),
                        (shown / F.nullif(F.length(head), F.lit(0))).alias("printable_ratio"))


def in_range(hits: DataFrame, start: int, end: int) -> DataFrame:
    return hits.filter(A.in_range(F.col("addr"), start, end))


def entry_points(*hits: DataFrame) -> DataFrame:
    """Distinct union of hit tables (path, addr)."""
    out = hits[0].select("path", "addr")
    for h in hits[1:]:
        out = out.unionByName(h.select("path", "addr"))
    return out.distinct()


def density_shards(hits: DataFrame, ranges: DataFrame, n: int) -> DataFrame:
    """Cut each code range (path, text_start, text_end) into n shards of equal hit counts.

    Only the n-1 boundary ranks of a path are gathered.  Paths without hits are cut evenly.
    """
    inside = hits.join(ranges, "path").filter(A.in_range(F.col("addr"), F.col("text_start"), F.col("text_end")))
    total = inside.groupBy("path").agg(F.count("*").alias("_n"))
    idx = blocks.dense_index(inside.select("path", "addr").distinct(), ["path"], "addr", "idx", sparse=True)
    per = F.greatest(F.lit(1), F.floor(F.col("_n") / n))
    want = F.transform(F.sequence(F.lit(1), F.lit(max(1, n - 1))),
                       lambda i: F.least(i * per, F.col("_n") - 1) + 1)
    ranks = total.select("path", F.posexplode(want).alias("i", "idx")).filter(F.lit(n > 1))
    cuts = (ranks.join(idx, ["path", "idx"]).groupBy("path")
            .agg(F.array_sort(F.collect_list(F.struct("i", F.col("addr").bitwiseAND(F.lit(-16)).alias("b")))).alias("cuts")))
    j = ranges.join(total, "path", "left").join(cuts, "path", "left")
    none = F.array().cast("array<struct<i:int,b:bigint>>")
    def push(acc: Column, c: Column) -> Column:
        prev = F.element_at(acc, -1)
        return F.concat(acc, F.array(F.when(c["b"] <= prev, prev + 16).otherwise(c["b"])))
    balanced = F.aggregate(F.coalesce("cuts", none), F.array(F.col("text_start").cast("bigint")), push)
    width = F.greatest(F.lit(1), F.floor((F.col("text_end") - F.col("text_start") + n - 1) / n))
    even = F.when(F.col("text_end") > F.col("text_start"), F.sequence(
        F.col("text_start").cast("bigint"), F.col("text_end").cast("bigint") - 1, width.cast("bigint")))
    starts = F.when(F.col("_n").isNull(), even).otherwise(balanced)
    cols = j.select("path", "text_end", F.posexplode(starts).alias("shard", "shard_start"), starts.alias("_s"))
    return cols.select("path", "shard", "shard_start", F.coalesce(
        F.get(F.col("_s"), F.col("shard") + 1), F.col("text_end").cast("bigint")).alias("shard_end"))


def assign_shards(points: DataFrame, shards: DataFrame) -> DataFrame:
    """Shard of each point; the (at most n) bounds of a path travel as one array."""
    bounds = shards.groupBy("path").agg(
        F.array_sort(F.collect_list(F.struct("shard_start", "shard_end", "shard"))).alias("_b"))
    hit = F.get(F.filter("_b", lambda b: A.in_range(F.col("addr"), b["shard_start"], b["shard_end"])), F.lit(0))
    return points.join(bounds, "path").withColumn("shard", hit["shard"]).drop("_b").filter("shard is not null")


def new_seeds(callees: DataFrame, visited: DataFrame, shards: DataFrame) -> DataFrame:
    """In-shard call targets (path, addr) no function start was found for yet."""
    return assign_shards(callees.select("path", "addr").distinct(), shards).join(
        visited.select("path", "addr"), ["path", "addr"], "left_anti")


def merge_shards(results: DataFrame) -> DataFrame:
    """One row per (binary, ea) from shard results (binary, shard_start, shard_end, funcs).

    Addresses lose their mode bit and must lie in their shard; a real name of the last shard wins,
    the size of the first shard stands.
    """
    f = results.select("binary", "shard_start", "shard_end", F.explode("funcs").alias("f")).select(
        "binary", "shard_start", "shard_end", A.strip_mode(F.col("f.ea")).alias("ea"), F.col("f.name").alias("name"),
        F.col("f.size").alias("size"), (F.coalesce("f.thumb", F.lit(False)) | A.is_thumb(F.col("f.ea"))).alias("thumb"))
    f = f.filter(A.in_range(F.col("ea"), F.col("shard_start"), F.col("shard_end")))
    real = F.when(N.is_named(F.col("name"), "merge"), F.col("name"))
    at = F.struct("shard_start", "shard_end")
    return f.withColumn("_real", real).groupBy("binary", "ea").agg(
        F.coalesce(F.max_by("_real", F.when(F.col("_real").isNotNull(), at)), F.max_by("name", at)).alias("name"),
        F.min_by("size", at).alias("size"), F.bool_or("thumb").alias("thumb"))


def shard_report(results: DataFrame) -> DataFrame:
    """Progress per binary from rows (binary, shard, funcs count, wall_s, error)."""
    done = F.col("error").isNull()
    out = results.groupBy("binary").agg(
        F.count("*").alias("shards"), F.count_if(done).alias("done"), F.count_if(~done).alias("failed"),
        F.sum(F.when(done, F.col("funcs")).otherwise(0)).alias("funcs"), F.max("wall_s").alias("elapsed_s"))
    share = F.col("done") / F.col("shards")
    return out.withColumns({
        "funcs_per_s": F.when(F.col("elapsed_s") > 0, F.col("funcs") / F.col("elapsed_s")).otherwise(0.0),
        "eta_s": F.when(F.col("done") > 0, F.col("elapsed_s") / share - F.col("elapsed_s")).otherwise(0.0)})


def resolve_seeds(supplied: DataFrame, carved: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target path: supplied seeds if any, else carved ones, else one row without payload."""
    ranked = (supplied.select("path", "payload", F.lit(0).alias("_p"), F.lit("seeds_dir").alias("source"))
              .unionByName(carved.select("path", "payload", F.lit(1).alias("_p"),
                                         F.lit("carved-from-binary").alias("source"))))
    best = ranked.groupBy("path").agg(F.min("_p").alias("_p"))
    kept = ranked.join(best, ["path", "_p"]).drop("_p")
    return targets.select("path").join(kept, "path", "left").withColumn(
        "source", F.coalesce("source", F.lit("none (proposer fallback)")))
