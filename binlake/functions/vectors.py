"""Function fingerprints and vector arithmetic as higher-order expressions."""
from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from .binding import let

DIM = 104

# Mnemonics of the categories 0 to 6, as published; a mnemonic that comes again belongs to the later one.
MNEMONICS = {
    0: "mov ldr str ldp stp ldrb strb ldrh strh ldrsw movz movk adrp add lea movzx movsx cmov",
    1: "add sub mul div sdiv udiv mod srem urem neg inc dec imul idiv fadd fsub fmul fdiv",
    2: "and or xor not shl shr sar lsl lsr asr bic orn",
    3: "cmp tst teq test cmn",
    4: "b bl br blr ret jmp call je jne jz jnz jg jl jge jle cbz cbnz tbz tbnz",
    5: "push pop sub",
    6: "fmla fmul fadd fdiv fcvt scvtf ldr",
}
CATEGORY_OF = {word: category for category, words in MNEMONICS.items() for word in words.split()}

# The 78 pseudocode keywords, in vector order.
KEYWORDS = (
    "if else for while do switch case break continue return goto sizeof NULL nullptr true false "
    "malloc free realloc calloc memcpy memset memmove strlen strcmp strncmp strcpy strncpy sprintf "
    "snprintf printf fprintf vprintf vsnprintf new delete throw try catch class struct union enum "
    "typedef virtual override public private protected static extern const volatile int char void "
    "bool float double long short unsigned signed size_t uint8_t uint16_t uint32_t uint64_t int8_t "
    "int16_t int32_t int64_t FILE HANDLE HWND LPARAM WPARAM LRESULT").split()


def log_scale(value: Column, max_value: int = 10000) -> Column:
    return F.when(value > 0, F.least(F.lit(1.0), F.log1p(value.cast("double")) / math.log1p(max_value))
                  ).otherwise(F.lit(0.0))


def bucket8(text: Column) -> Column:
    """MD5 of the text modulo 8, read off its last hex digit."""
    return F.conv(F.right(F.md5(text.cast("binary")), F.lit(1)), 16, 10).cast("int") % 8


def _shares(labels: Column, keys) -> Column:
    """Share of each key among the labels."""
    return let(labels, lambda found: F.transform(
        F.array(*[F.lit(k) for k in keys]),
        lambda k: F.size(F.filter(found, lambda x: x == k)) / F.greatest(F.lit(1), F.size(found))))


def mnemonic_category(mnemonic: Column) -> Column:
    out = None
    for cat in MNEMONICS:
        test = mnemonic.isin(*[word for word, category in CATEGORY_OF.items() if category == cat])
        out = F.when(test, cat) if out is None else out.when(test, cat)
    return out


def mnemonic_histogram(disasm: Column) -> Column:
    first = F.transform(disasm, lambda d: F.lower(F.substring_index(
        F.substring_index(F.ltrim(d["text"]), " ", 1), "\t", 1)))
    cats = F.filter(F.transform(first, mnemonic_category), lambda c: c.isNotNull())
    return _shares(cats, range(7))


def keyword_frequencies(pseudocode: Column) -> Column:
    words = F.transform(F.coalesce(F.regexp_extract_all(pseudocode, F.lit("[a-zA-Z_][A-Za-z0-9_]*"), 0),
                                   F.array().cast("array<string>")), F.lower)
    low = [k.lower() for k in KEYWORDS]
    def shares(found: Column, total: Column) -> Column:
        return F.transform(F.array(*[F.lit(k) for k in low]),
                           lambda k: F.size(F.filter(found, lambda x: x == k)) / F.greatest(F.lit(1), total))
    return let(words, lambda w: let(F.size(w), lambda n: let(
        F.filter(w, lambda x: x.isin(*low)), lambda hits: shares(hits, n))))


def hash_buckets(texts: Column) -> Column:
    return _shares(F.transform(F.filter(texts, lambda s: s != ""), bucket8), range(8))


def text_part(pseudocode: Column, strings: Column, constants: Column) -> Column:
    """The 78 keyword, 8 string and 8 constant values."""
    return F.concat(keyword_frequencies(pseudocode), hash_buckets(strings),
                    hash_buckets(F.transform(constants, lambda c: c.cast("string"))))


def assemble(mnemonics: Column, callers: Column, callees: Column, log_size: Column, text: Column) -> Column:
    """The 104 values: 7 mnemonic, 2 degree, 1 size and 94 text values."""
    return F.concat(mnemonics, F.array(log_scale(callers), log_scale(callees), log_size), text)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0),
                              lambda s, x: s + x))
