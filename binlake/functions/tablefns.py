"""Table functions for SQL text: rows of a binary value, by lateral join.

``SELECT b.path, s.* FROM blobs b, LATERAL binary_strings(b.content, b.base, 5) s``
"""
from __future__ import annotations

import re
import struct
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="addr bigint, text string")
class BinaryStrings:
    """Printable runs of at least ``min_len`` characters, with ``base`` added to their places."""

    def eval(self, content: bytes, base: int, min_len: int) -> Iterator[tuple]:
        for m in re.finditer(rb"[\x20-\x7e]{%d,}" % max(1, min_len), content or b""):
            yield base + m.start(), m.group().decode("ascii")


@udtf(returnType="pos int, name string, offset bigint, size bigint")
class BinaryAssets:
    """Embedded assets of at least ``min_len`` bytes by signature order and offset, the first of each distinct start."""

    def eval(self, content: bytes, min_len: int) -> Iterator[tuple]:
        from ..operators.scan import assets_in
        seen = set()
        for h in assets_in(content or b""):
            if h["size"] >= min_len and h["prefix"] not in seen:
                seen.add(h["prefix"])
                yield len(seen), h["name"], h["offset"], h["size"]


@udtf(returnType="name string, va bigint, raw_off bigint, raw_size bigint, vsize bigint, is_code boolean")
class BinarySections:
    """Sections of an ELF or PE image or of an uncompressed NSO image; nothing for other or broken values."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        raw = content or b""
        try:
            read = self._elf if raw[:4] == b"\x7fELF" else self._pe if raw[:2] == b"MZ" else self._nso if raw[:4] == b"NSO0" else None
            rows = list(read(raw)) if read else []
        except struct.error:
            rows = []
        yield from rows

    @staticmethod
    def _elf(raw: bytes) -> Iterator[tuple]:
        wide = raw[4] == 2
        table, = struct.unpack_from("<Q" if wide else "<I", raw, 40 if wide else 32)
        entry, count = struct.unpack_from("<HH", raw, 58 if wide else 46)
        for k in range(count):
            kind, flags, va, off, size = struct.unpack_from("<IQQQQ" if wide else "<IIIII", raw, table + k * entry + 4)
            if flags & 2:
                yield f"sec{k}", va, 0 if kind == 8 else off, 0 if kind == 8 else size, size, bool(flags & 4)

    @staticmethod
    def _pe(raw: bytes) -> Iterator[tuple]:
        at, = struct.unpack_from("<I", raw, 0x3C)
        if raw[at:at + 4] != b"PE\0\0":
            return
        count, optional = struct.unpack_from("<H12xH", raw, at + 6)
        for k in range(count):
            name, vsize, va, size, off, flags = struct.unpack_from("<8sIIII12xI", raw, at + 24 + optional + 40 * k)
            yield name.rstrip(b"\0").decode("ascii", "replace"), va, off, size, vsize, bool(flags & 0x20)

    @staticmethod
    def _nso(raw: bytes) -> Iterator[tuple]:
        if struct.unpack_from("<I", raw, 0x0C)[0] & 7:
            return
        end = 0
        for k, name in enumerate((".text", ".rodata", ".data")):
            off, va, size = struct.unpack_from("<III", raw, 0x10 + 16 * k)
            end = va + size
            yield name, va, off, size, size, k == 0
        yield ".bss", end, 0, 0, struct.unpack_from("<I", raw, 0x3C)[0], False


#: Name in SQL -> table function.
TABLE_FUNCTIONS = {"binary_strings": BinaryStrings, "binary_assets": BinaryAssets, "binary_sections": BinarySections}


def register(spark: SparkSession) -> None:
    for name, fn in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, fn)
