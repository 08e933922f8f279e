"""Address columns: BIGINT holding the bit pattern of an unsigned 64-bit value."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

PAGE = 0x1000


def parse(col) -> Column:
    """Hex text with 0x, decimal text or a number -> BIGINT; anything else -> null."""
    text = F.trim(F.col(col).cast("string") if isinstance(col, str) else col.cast("string"))
    return (F.when(text.rlike("^0x[0-9a-fA-F]{1,16}$"),
                   F.conv(F.substring(text, 3, 16), 16, -10).cast("bigint"))
            .when(text.rlike("^-?[0-9]{1,18}$"), text.try_cast("bigint"))
            .when(text.rlike("^[0-9]{19,20}$"), _wrapped(text.try_cast("decimal(20,0)"))))


def _wrapped(value: Column) -> Column:
    """Bit pattern of an unsigned 64-bit decimal; null beyond 64 bits."""
    return F.when(value < F.lit("9223372036854775808").cast("decimal(20,0)"), value.try_cast("bigint")) \
        .when(value < F.lit("18446744073709551616").cast("decimal(20,0)"), (value - F.lit("18446744073709551616").cast("decimal(20,0)")).try_cast("bigint"))


def parse_loose(col: Column) -> Column:
    """Diff-result form: also accepts hex digits without the 0x prefix."""
    bare = F.when(col.rlike("^[0-9a-fA-F]{1,16}$") & col.rlike("[a-fA-F]"), F.concat(F.lit("0x"), col))
    return parse(F.coalesce(bare, col))


def hexify(col: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(col.cast("bigint"))))


def hex_padded(col: Column) -> Column:
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(col.cast("bigint"))), 16, "0"))


def function_id(binary: Column, addr: Column) -> Column:
    return F.concat(binary, F.lit(":"), hexify(addr))


def is_thumb(col: Column) -> Column:
    return col.bitwiseAND(F.lit(1)) == 1


def thumb(col: Column) -> Column:
    return col.bitwiseOR(F.lit(1).cast("bigint"))


def strip_mode(col: Column) -> Column:
    return col.bitwiseAND(F.lit(-2).cast("bigint"))


def page(col: Column) -> Column:
    return col.bitwiseAND(F.lit(-PAGE).cast("bigint"))


def in_range(col: Column, start, end) -> Column:
    """Half-open membership test."""
    return (col >= start) & (col < end)


def le_uint(hex_text: Column, byte_off, width: int) -> Column:
    """Little-endian unsigned integer out of the hex text of a header (BIGINT bit pattern)."""
    off = byte_off if isinstance(byte_off, Column) else F.lit(byte_off)
    parts = [F.substring(hex_text, (off + i) * 2 + 1, F.lit(2)) for i in range(width)]
    return F.conv(F.concat(*reversed(parts)), 16, -10).cast("bigint")


def hex_decimal(digits: Column) -> Column:
    """Exact DECIMAL(38,0) value of up to 30 hex digits; null beyond."""
    padded = F.lpad(digits, 30, "0")
    high = F.conv(F.substring(padded, 1, 15), 16, 10).cast("decimal(19,0)")
    low = F.conv(F.substring(padded, 16, 15), 16, 10).cast("decimal(19,0)")
    return F.when(F.length(digits) <= 30,
                  (high * F.lit(16 ** 15).cast("decimal(19,0)") + low).cast("decimal(38,0)"))
