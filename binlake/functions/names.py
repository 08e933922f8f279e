"""Predicates and labels on function names."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

# Placeholder prefixes that carry no signal.
NOISE_PREFIXES = ("sub_", "dword_", "off_", "loc_", "unk_", "byte_", "word_", "qword_",
                  "asc_", "flt_", "dbl_", "def_", "seg_")


def is_named(col: Column, mode: str = "graph") -> Column:
    """True for a real name.

    graph: not null and no ``sub_``; strict: also not empty; context: case-insensitive, not empty;
    display: also no ``j_``/``nullsub_``; merge: not empty, no ``sub_``/``j_``.
    """
    c = F.coalesce(col, F.lit(""))
    tests = {
        "graph": col.isNotNull() & ~c.startswith("sub_"),
        "strict": (c != "") & ~c.startswith("sub_"),
        "context": (c != "") & ~F.lower(c).startswith("sub_"),
        "display": ~c.rlike("^(sub_|j_|nullsub_)"),
        "merge": (c != "") & ~c.rlike("^(sub_|j_)"),
    }
    return tests[mode]


def is_noise(col: Column) -> Column:
    c = F.coalesce(col, F.lit(""))
    return (c == "") | F.lower(c).rlike("^(" + "|".join(NOISE_PREFIXES) + ")")


def mangled(col: Column) -> Column:
    return col.rlike(r"^(_Z|\?)")


def is_rtti(col: Column) -> Column:
    c = F.coalesce(col, F.lit(""))
    return c.rlike("_ZT[VIC]") | F.lower(c).rlike("vtable|rtti")


def needs_naming(name: Column, size: Column, min_size: int) -> Column:
    return F.lower(name).startswith("sub_") & (F.coalesce(size, F.lit(0)) >= min_size)


def confidence(old: Column, new: Column) -> Column:
    has = F.coalesce(new, F.lit("")) != ""
    return (F.when(has & ~old.startswith("sub_"), "high").when(has, "medium").otherwise("low"))


def size_label(size: Column) -> Column:
    return (F.when(size <= 0, "")
            .when(size < 1024, F.concat(size.cast("string"), F.lit("b")))
            .otherwise(F.concat((F.floor(size / 1024)).cast("bigint").cast("string"), F.lit("kb"))))


def safe_file_name(col: Column) -> Column:
    return F.replace(F.replace(col, F.lit("::"), F.lit("_")), F.lit(" "), F.lit("_"))


def escape_quotes(col: Column) -> Column:
    return F.replace(col, F.lit('"'), F.lit('\\"'))


def has_content(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols]).isNotNull()
