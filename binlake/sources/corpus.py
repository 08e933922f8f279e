"""Binary corpora: reading, format detection, architecture, sections, byte ranges."""
from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.addr import le_uint
from ..functions.binding import let
from ..plans.ranges import range_join
from . import byteranges

SEED_LIMIT, SEED_FILES = 1 << 20, 64

# Machine numbers.
PE_MACHINES = {0x8664: "x86_64", 0xAA64: "arm64", 0x14C: "x86", 0x1C0: "arm"}
ELF_MACHINES = {0x3E: "x86_64", 0xB7: "arm64", 0x28: "arm", 0x03: "x86"}
ELF_HINTS = {62: "x86_64", 183: "arm64", 40: "arm32"}

# Fixed value: where NSO images are loaded.
NSO_BASE = 0x7100000000

SECTION = "array<struct<name:string,va:bigint,raw_off:bigint,raw_size:bigint,vsize:bigint,is_code:boolean>>"


def read_corpus(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length, content) of every non-empty file below the path.

    Spark's file source yields no row for an empty file.
    """
    return (spark.read.format("binaryFile").option("pathGlobFilter", glob)
            .option("recursiveFileLookup", "true").load(path).select("path", "length", "content"))


def header_hex(start=0, size: int = 64) -> Column:
    """Hex text of ``size`` content bytes from a 0-based offset."""
    off = start if isinstance(start, Column) else F.lit(start)
    return F.hex(F.substring(F.col("content"), (off + 1).cast("int"), F.lit(size) if isinstance(size, int) else size))


def _starts(hex_prefix: str) -> Column:
    return F.substring(header_hex(), 1, len(hex_prefix)) == hex_prefix


def _pe_offset() -> Column:
    return le_uint(header_hex(), 0x3C, 4)


def is_pe() -> Column:
    return (F.length("content") >= 0x40) & _starts("4D5A") & (header_hex(_pe_offset(), 4) == "50450000")


def _elf_layout(head: Column) -> Column:
    """Place, entry size and number of entries of the section table, from the hex text of the header."""
    is64 = F.substring(head, 9, 2) == "02"
    def pick(wide: Column, narrow: Column) -> Column:
        return F.when(is64, wide).otherwise(narrow)
    return F.struct(
        is64.alias("is64"), pick(le_uint(head, 40, 8), le_uint(head, 32, 4)).alias("off"),
        pick(le_uint(head, 58, 2), le_uint(head, 46, 2)).cast("int").alias("entry"),
        pick(le_uint(head, 60, 2), le_uint(head, 48, 2)).cast("int").alias("count"))


def _elf_rows(at: Column, table: Column) -> Column:
    """Memory-mapped sections, from the bytes of the section table."""
    # one hex text per table entry, so a field only touches its own few bytes
    texts = F.transform(F.sequence(F.lit(0), at["count"] - 1), lambda i: F.struct(
        i.alias("i"), F.hex(F.substring(table, i * at["entry"] + 5, at["entry"] - 4)).alias("hex")))
    def row(e: Column) -> Column:
        def field(n: int) -> Column:  # type, flags, addr, offset, size
            wide = le_uint(e["hex"], 0 if n == 0 else 8 * n - 4, 4 if n == 0 else 8)
            return F.when(at["is64"], wide).otherwise(le_uint(e["hex"], 4 * n, 4))
        return F.struct(F.concat(F.lit("sec"), e["i"].cast("string")).alias("name"), *[
            field(n).alias(c) for n, c in enumerate(("type", "flags", "va", "off", "size"))])
    kept = F.filter(F.transform(texts, row), lambda s: s["flags"].bitwiseAND(F.lit(2)) != 0)
    return F.when(at["count"] > 0, F.transform(kept, lambda s: F.struct(
        s["name"].alias("name"), s["va"].alias("va"), F.when(s["type"] == 8, 0).otherwise(s["off"]).alias("raw_off"),
        F.when(s["type"] == 8, 0).otherwise(s["size"]).alias("raw_size"), s["size"].alias("vsize"),
        (s["flags"].bitwiseAND(F.lit(4)) != 0).alias("is_code"))))


def elf_sections() -> Column:
    """Memory-mapped ELF sections, 32- and 64-bit, read off the header bytes alone."""
    def rows(at: Column) -> Column:
        return let(F.substring(F.col("content"), (at["off"] + 1).cast("int"), at["entry"] * at["count"]), lambda table: _elf_rows(at, table))
    return let(header_hex(), lambda head: let(_elf_layout(head), rows))


def _pe_layout(pe: Column, h: Column) -> Column:
    """Place of the section table and number of its entries, from the hex text at the PE signature."""
    return F.struct((pe + 24 + le_uint(h, 20, 2)).alias("off"), F.lit(40).alias("entry"), le_uint(h, 6, 2).cast("int").alias("count"))


def _pe_rows(at: Column, table: Column) -> Column:
    texts = F.transform(F.sequence(F.lit(0), at["count"] - 1), lambda i: F.hex(F.substring(table, i * 40 + 1, F.lit(40))))
    def row(e: Column) -> Column:
        name = F.decode(F.unhex(F.regexp_replace(F.substring(e, 1, 16), "(00)+$", "")), "US-ASCII")
        return F.struct(name.alias("name"), le_uint(e, 12, 4).alias("va"), le_uint(e, 20, 4).alias("raw_off"),
                        le_uint(e, 16, 4).alias("raw_size"), le_uint(e, 8, 4).alias("vsize"),
                        (le_uint(e, 36, 4).bitwiseAND(F.lit(0x20)) != 0).alias("is_code"))
    return F.when(at["count"] > 0, F.transform(texts, row))


def pe_sections() -> Column:
    def rows(at: Column) -> Column:
        return let(F.substring(F.col("content"), (at["off"] + 1).cast("int"), at["entry"] * at["count"]), lambda table: _pe_rows(at, table))
    return let(_pe_offset(), lambda pe: let(header_hex(pe, 24), lambda h: let(_pe_layout(pe, h), rows)))


def nso_sections() -> Column:
    """Segments of an image whose three segments are stored as they are; null for a compressed one.  Offsets are places in the file."""
    def rows(h: Column) -> Column:
        def segment(name: str, at: int, code: bool) -> Column:
            size = le_uint(h, at + 8, 4)
            return F.struct(F.lit(name).alias("name"), le_uint(h, at + 4, 4).alias("va"), le_uint(h, at, 4).alias("raw_off"), size.alias("raw_size"),
                            size.alias("vsize"), F.lit(code).alias("is_code"))
        bss = F.struct(F.lit(".bss").alias("name"), (le_uint(h, 0x34, 4) + le_uint(h, 0x38, 4)).alias("va"), F.lit(0).cast("bigint").alias("raw_off"),
                       F.lit(0).cast("bigint").alias("raw_size"), le_uint(h, 0x3C, 4).alias("vsize"), F.lit(False).alias("is_code"))
        plain = le_uint(h, 0x0C, 4).bitwiseAND(F.lit(7)) == 0
        return F.when(plain & (F.length("content") >= 0x100), F.array(
            segment(".text", 0x10, True), segment(".rodata", 0x20, False), segment(".data", 0x30, False), bss))
    return let(header_hex(), rows)


def pe_image_base() -> Column:
    pe = _pe_offset()
    machine = le_uint(header_hex(pe, 8), 4, 2)
    wide, narrow = header_hex(pe + 48, 8), header_hex(pe + 52, 4)
    return F.when(machine.isin(0x8664, 0xAA64), le_uint(wide, 0, 8)).otherwise(le_uint(narrow, 0, 4))


def _none() -> Column:
    return F.lit(None).cast(SECTION)


# name -> (test, sections, image base); the first test that holds wins
_FORMATS: dict[str, tuple[Callable[[], Column], Callable[[], Column], Callable[[], Column]]] = {
    "NSO": (lambda: _starts("4E534F30"), nso_sections, lambda: F.lit(NSO_BASE)),
    "ELF": (lambda: _starts("7F454C46"), elf_sections, lambda: F.lit(0)),
    "PE": (is_pe, pe_sections, pe_image_base),
}


def register_format(name: str, sniff: Callable[[], Column], sections: Callable[[], Column] = _none,
                    image_base: Callable[[], Column] = lambda: F.lit(0), first: bool = False) -> None:
    """Add a format: Column expressions over ``content``.  ``first`` puts it ahead of the others."""
    entry = {name: (sniff, sections, image_base)}
    merged = {**entry, **_FORMATS} if first else {**_FORMATS, **entry}
    _FORMATS.clear()
    _FORMATS.update(merged)


def sniff(files: DataFrame) -> DataFrame:
    """Adds ``format``: the first registered test that holds, else generic."""
    out = F
    for name, (test, _, _) in _FORMATS.items():
        out = out.when(test(), name)
    return files.withColumn("format", out.otherwise("generic"))


def loose_kind() -> Column:
    """The second, display-oriented sniffer."""
    return (F.when(_starts("4D5A"), "PE (Windows)").when(_starts("7F454C46"), "ELF (Linux)")
            .when(_starts("FEEDFACE") | _starts("FEEDFACF"), "Mach-O (macOS)").when(_starts("2321"), "Script")
            .otherwise("Unknown"))


def _pick(value: Column, table: dict[int, str], default) -> Column:
    out = F
    for k, v in table.items():
        out = out.when(value == k, v)
    return out.otherwise(default)


def arch() -> Column:
    """Processor from the PE or ELF header; x86_64 where it says nothing known."""
    pe_machine = le_uint(header_hex(_pe_offset() + 4, 2), 0, 2)
    elf_machine = le_uint(header_hex(), 18, 2)
    return (F.when(_starts("4D5A"), _pick(pe_machine, PE_MACHINES, "x86_64"))
            .when(_starts("7F454C46"), _pick(elf_machine, ELF_MACHINES, "x86_64")).otherwise("x86_64"))


def arch_hint() -> Column:
    """Hint of the ELF handler (null for other formats and machines)."""
    return F.when(_starts("7F454C46"), _pick(le_uint(header_hex(), 18, 2), ELF_HINTS, F.lit(None))).when(
        _starts("4E534F30"), "arm64")


def sections(files: DataFrame) -> DataFrame:
    """One row per section of every recognised file: (path, image_base, name, va, raw_off, ...)."""
    table, base = F, F
    for name, (_, secs, image_base) in _FORMATS.items():
        table = table.when(F.col("format") == name, secs())
        base = base.when(F.col("format") == name, image_base().cast("bigint"))
    rows = sniff(files).select("path", base.otherwise(F.lit(0)).alias("image_base"),
                               F.explode(table.otherwise(_none())).alias("s"))
    return rows.select("path", "image_base", "s.*")


def described(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, length, format, kind, arch, hint, image_base, sections) of every non-empty file below a folder.

    Reads a header of each file, the section table of those that have one, and nothing else; no bytes are shuffled.  Formats
    that were registered are told by the header; their section tables need the content.
    """
    def at_pe(size: int) -> Column:
        return F.when(_starts("4D5A") & (F.col("length") >= 0x40), byteranges.piece(_pe_offset(), F.lit(size)))
    rows = byteranges.slices(byteranges.heads(spark, folder, 256, glob).withColumn("pieces", at_pe(64)), data="pe")
    h = F.hex("pe")
    real = F.coalesce(F.substring(h, 1, 8) == "50450000", F.lit(False))
    fmt = F
    for name, (test, _, _) in _FORMATS.items():
        fmt = fmt.when(real if name == "PE" else test(), name)
    rows = rows.withColumn("format", fmt.otherwise("generic")).withColumns({
        "elf_at": F.when(F.col("format") == "ELF", _elf_layout(header_hex())), "pe_at": F.when(F.col("format") == "PE", _pe_layout(_pe_offset(), h))})
    field = lambda name: F.coalesce(F.col(f"elf_at.{name}"), F.col(f"pe_at.{name}")).cast("bigint")
    rows = byteranges.slices(rows.withColumn("pieces", F.when(field("count") > 0, byteranges.piece(field("off"), field("entry") * field("count")))), data="table")
    machine = le_uint(h, 4, 2)
    base = F.when(machine.isin(0x8664, 0xAA64), le_uint(h, 48, 8)).otherwise(le_uint(h, 52, 4))
    secs, bases = F, F
    for name in _FORMATS:
        known = {"ELF": (_elf_rows(F.col("elf_at"), F.col("table")), F.lit(0)), "PE": (_pe_rows(F.col("pe_at"), F.col("table")), base)}
        found, at = known.get(name, (_FORMATS[name][1](), _FORMATS[name][2]()) if name == "NSO" else (_none(), F.lit(0)))
        secs, bases = secs.when(F.col("format") == name, found.cast(SECTION)), bases.when(F.col("format") == name, at.cast("bigint"))
    elf = le_uint(header_hex(), 18, 2)
    arch = (F.when(_starts("4D5A"), F.coalesce(_pick(machine, PE_MACHINES, "x86_64"), F.lit("x86_64")))
            .when(_starts("7F454C46"), _pick(elf, ELF_MACHINES, "x86_64")).otherwise("x86_64"))
    return rows.select("path", "length", "format", loose_kind().alias("kind"), arch.alias("arch"), arch_hint().alias("hint"),
                       bases.otherwise(F.lit(0)).alias("image_base"), secs.otherwise(_none()).alias("sections"))


def file_sections(files: DataFrame) -> DataFrame:
    """One row per section of ``described`` files, as ``sections`` gives them for contents."""
    return files.select("path", "image_base", F.explode("sections").alias("s")).select("path", "image_base", "s.*")


def read_file_ranges(secs: DataFrame, ranges: DataFrame) -> DataFrame:
    """``read_ranges`` for files: only places are joined and gathered, the bytes are read last and where they are needed."""
    parts = _mapped(secs, ranges).groupBy("path", "va_start", "va_end").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("va", "_off", "_n"))), lambda p: F.struct(
            p["_off"].cast("bigint").alias("off"), p["_n"].cast("bigint").alias("n"))).alias("pieces"))
    return byteranges.slices(parts, data="bytes")


def code_range(secs: DataFrame) -> DataFrame:
    """Address span of the code sections per file; files without code have null bounds."""
    start = F.when(F.col("is_code"), F.col("image_base") + F.col("va"))
    return secs.groupBy("path").agg(F.min(start).alias("text_start"), F.max(start + F.col("vsize")).alias("text_end"))


def _mapped(secs: DataFrame, ranges: DataFrame) -> DataFrame:
    """The part of each range that a section maps to raw data, as (_off, _n) in the file."""
    j = ranges.join(secs, "path")
    lo = F.greatest(F.col("va"), F.col("va_start") - F.col("image_base"))
    hi = F.least(F.col("va") + F.col("vsize"), F.col("va_end") - F.col("image_base"))
    return (j.withColumn("_lo", lo).withColumn("_n", F.least(hi - lo, F.col("raw_size") - (lo - F.col("va"))))
            .filter((F.col("_n") > 0) & (hi > lo)).withColumn("_off", F.col("raw_off") + F.col("_lo") - F.col("va")))


def read_ranges(files: DataFrame, secs: DataFrame, ranges: DataFrame) -> DataFrame:
    """Mapped bytes of address ranges (path, va_start, va_end), clipped to raw data, in va order.

    Sections per file are few, so files and sections meet by path; bytes join last.
    """
    parts = _mapped(secs, ranges).groupBy("path", "va_start", "va_end").agg(
        F.array_sort(F.collect_list(F.struct("va", "_off", "_n"))).alias("_p"))
    text = F.array_join(F.transform("_p", lambda p: F.hex(F.substring(
        F.col("content"), (p["_off"] + 1).cast("int"), p["_n"].cast("int")))), "")
    return (parts.join(files.select("path", "content"), "path")
            .select("path", "va_start", "va_end", F.unhex(text).alias("bytes")))


def section_of(points: DataFrame, secs: DataFrame, point: str = "addr") -> DataFrame:
    """Section that maps each address (path, addr)."""
    spans = secs.select("path", "name", (F.col("image_base") + F.col("va")).alias("start"),
                        (F.col("image_base") + F.col("va") + F.col("vsize")).alias("end"))
    return range_join(points, spans, ["path"], point)


def read_seeds(spark: SparkSession, path: str, limit: int | None = SEED_FILES, max_bytes: int | None = SEED_LIMIT) -> DataFrame:
    """Seed files of a folder, each non-empty; the first ``limit`` by name and of at most ``max_bytes``, where these are given (size filter runs on metadata)."""
    root = path if "://" in path or path.startswith("file:") else f"file:{os.path.abspath(path)}"
    files = byteranges.listed(spark, root, recursive=False)
    if max_bytes is not None:
        files = files.filter(F.col("length") <= max_bytes)
    files = files if limit is None else files.orderBy("path").limit(limit)
    return byteranges.slices(files.select("path", byteranges.piece(F.lit(0), F.col("length")).alias("pieces")), data="payload")
