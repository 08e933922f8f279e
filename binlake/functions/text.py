"""Pseudocode and model-response text as Column expressions.

Word classes are ASCII on purpose: every engine that may cross-check a result then agrees.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from . import addr
from .binding import let

WORD = "[A-Za-z0-9_]"

# Fixed values of the extraction rules.
QUOTED = r'"([^"]{1,200})"'
FORMAT_ONLY = r'^["%# +\-0-9.*hlLzjt]*[diouxXeEfFgAcspn%]\z'
# both start with a plain character, so the look-behind only runs where one is found
HEX_LITERAL = rf"0(?<!{WORD}0)x([0-9a-fA-F]{{2,}})(?!{WORD})"
DEC_LITERAL = rf"-(?<={WORD}-)[0-9]{{4,}}(?!{WORD})|[0-9](?<!{WORD}[0-9])[0-9]{{3,}}(?!{WORD})"
COMMON_CONSTANTS = (0, 1, -1, 2, 4, 8, 0xFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFFFFFFFFFF)
CALL_SKIP = ("if", "else", "for", "while", "return", "sizeof", "switch", "case",
             "malloc", "free", "memcpy", "memset", "strlen", "strcmp")
SYMBOL_SKIP = ("if", "else", "for", "while", "return", "sizeof", "typeof", "switch", "case",
               "break", "continue", "goto", "do")
FORBIDDEN = ("syscall", "svc ", "swi ", "int 0x", "printf", "fprintf", "snprintf", "open(", "close(",
             "read(", "write(", "pthread", "mutex")


def matches(col: Column, pattern: str, group: int = 0) -> Column:
    return F.coalesce(F.regexp_extract_all(col, F.lit(pattern), group), F.array().cast("array<string>"))


def occurrences(col: Column, needle: str) -> Column:
    """Non-overlapping substring count."""
    return ((F.length(col) - F.length(F.replace(col, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def line_count(col: Column) -> Column:
    return occurrences(col, "\n") + 1


def strings(col: Column, max_strings: int | None = None, max_len: int | None = None) -> Column:
    """Distinct string literals in first-seen order, format-only ones dropped; cut only where a limit is given."""
    found = F.filter(matches(col, QUOTED, 1), lambda s: (F.length(s) >= 2) & ~s.rlike(FORMAT_ONLY))
    out = F.array_distinct(found)
    if max_strings is not None:
        out = F.slice(out, 1, max_strings)
    return out if max_len is None else F.transform(out, lambda s: F.substring(s, 1, max_len))


def constants(col: Column, max_constants: int | None = None) -> Column:
    """Distinctive numbers, hex literals first, as DECIMAL(38,0); cut only where a limit is given."""
    hexes = F.transform(matches(col, HEX_LITERAL, 1), addr.hex_decimal)
    decs = F.transform(matches(col, DEC_LITERAL), lambda s: s.try_cast("decimal(38,0)"))
    common = F.array(*[F.lit(str(v)).cast("decimal(38,0)") for v in COMMON_CONSTANTS])
    kept = F.filter(F.concat(hexes, decs), lambda v: v.isNotNull() & ~F.array_contains(common, v))
    out = F.array_distinct(kept)
    return out if max_constants is None else F.slice(out, 1, max_constants)


def eligible(col: Column) -> Column:
    """A function that may be checked in isolation: no hard externals, few branches, short."""
    c = F.coalesce(col, F.lit(""))
    low, bad = F.lower(c), F.lit(False)
    for word in FORBIDDEN:
        bad = bad | low.contains(word)
    return (c != "") & (line_count(c) <= 50) & (branch_count(c) <= 10) & ~bad


def branch_count(col: Column) -> Column:
    return occurrences(col, "if") + occurrences(col, "else") + occurrences(col, "switch")


def loop_count(col: Column) -> Column:
    return occurrences(col, "for") + occurrences(col, "while")


def complexity(col: Column) -> Column:
    lines, branches, loops = line_count(col), branch_count(col), loop_count(col)
    levels = (("trivial", 5, 0, 0), ("simple", 15, 2, 0), ("moderate", 30, 5, 1), ("complex", 50, 10, 3))
    out = F
    for label, max_lines, max_branches, max_loops in levels:
        out = out.when((lines <= max_lines) & (branches <= max_branches) & (loops <= max_loops), label)
    return out.otherwise("very_complex")


def difficulty(level: Column) -> Column:
    return (F.when(level.isin("trivial", "simple"), "easy").when(level == "moderate", "medium")
            .otherwise("hard"))


def external_calls(col: Column) -> Column:
    """Called names that look external: capitalised and not on the skip list (sorted, distinct)."""
    found = matches(col, rf"(?<!{WORD})([a-zA-Z_]{WORD}*+)\s*+\(", 1)
    return F.array_sort(F.array_distinct(
        F.filter(found, lambda n: ~n.isin(*CALL_SKIP) & n.rlike("^[A-Z]"))))


def symbols(col: Column) -> Column:
    """Qualified or compound call names and pointer types, sorted and distinct."""
    part = rf"[a-zA-Z_]{WORD}*+"  # possessive: a name is never given back character by character
    calls = F.filter(matches(col, rf"(?<!{WORD})({part}(?:::{part})*+)\s*+\(", 1),
                     lambda n: ~n.isin(*SYMBOL_SKIP)
                     & (n.contains("::") | n.contains("_") | ~n.rlike("^[a-z]")))
    types = matches(col, rf"[(\s]([A-Z]{WORD}*+(?:::[A-Z]{WORD}*+)*+)\s*+\*", 1)
    return F.array_sort(F.array_union(calls, types))


def declared_types(col: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(
        matches(col, rf"typedef\s+{WORD}+\s+({WORD}+)", 1),
        matches(col, rf"struct\s+({WORD}+)", 1),
        matches(col, rf"class\s+({WORD}+)", 1))))


def stub_lines(symbol: Column) -> Column:
    clean = F.replace(symbol, F.lit("::"), F.lit("_"))
    return F.concat(F.lit("// Stub for "), symbol, F.lit("\nlong long "), clean,
                    F.lit("(long long* args) { return 0; }"))


def stubs(col: Column) -> Column:
    """Stub declarations for every undefined symbol of a snippet, one text."""
    wanted = F.filter(F.array_except(symbols(col), declared_types(col)),
                      lambda s: ~s.isin("ThisStruct", "operator_new"))
    return F.array_join(F.transform(wanted, stub_lines), "\n")


def pointer_args(args: Column) -> Column:
    """Indexes of argument values that look like pointers."""
    idx = F.transform(args, lambda v, i: F.when((v > 0x1000) & (v < 0x7FFFFFFFFFFFFFFF), i))
    return F.filter(idx, lambda i: i.isNotNull())


@F.pandas_udf(T.DoubleType())
def _entropy(texts: pd.Series) -> pd.Series:
    def bits(s: str) -> float:
        if not s:
            return 0.0
        _, n = np.unique(np.frombuffer(s.encode("utf-32-le"), "<u4"), return_counts=True)
        p = n / n.sum()
        return float(-(p * np.log2(p)).sum()) + 0.0
    return texts.map(bits)


def entropy(col: Column) -> Column:
    """Shannon entropy in bits per character; 0 for empty text."""
    return _entropy(F.coalesce(col, F.lit("")))


def instruction_line(address: Column, text: Column) -> Column:
    pad = F.greatest(F.lit(16), F.length(address))
    return F.concat(F.lit("  "), F.lpad(address, pad, F.lit(" ")), F.lit("  "), text)


def _names_or_none(names: Column) -> Column:
    joined = F.array_join(F.slice(names, 1, 8), ", ")
    return F.when(joined == "", "none").otherwise(joined)


def prompt(disasm: Column, callees: Column, callers: Column) -> Column:
    """Naming request text from instruction rows and neighbour names."""
    rows = F.transform(F.slice(disasm, 1, 80), lambda d: instruction_line(d["address"], d["text"]))
    return F.concat(F.lit("Calls: "), _names_or_none(callees), F.lit("\nCalled by: "),
                    _names_or_none(callers), F.lit("\n\nAssembly:\n"), F.array_join(rows, "\n"),
                    F.lit("\n\nName this function:"))


def pseudocode_prompt(pseudocode: Column, context_block: Column) -> Column:
    code = F.concat(F.lit("Pseudocode:\n```c\n"), F.substring(pseudocode, 1, 2000), F.lit("\n```"))
    return F.concat(F.when(F.coalesce(context_block, F.lit("")) != "",
                           F.concat(context_block, F.lit("\n\n"))).otherwise(""),
                    code, F.lit("\n\nProposed function name:"))


def chat(system: Column, user: Column) -> Column:
    return F.concat(F.lit("<im>system</im>\n"), system, F.lit("</im>\n<im>user</im>\n"), user,
                    F.lit("</im>\n<im>assistant</im>\n"))


def strip(col: Column) -> Column:
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def strip_think(col: Column) -> Column:
    return strip(F.regexp_replace(col, r"(?s)<think>.*?</think>", ""))


def _lines(col: Column) -> Column:
    return F.transform(F.split(col, r"\r\n|\r|\n"), strip)


def response_name(col: Column) -> Column:
    """First NAME: line whose first token is an identifier; null when there is none."""
    heads = F.filter(_lines(col), lambda x: F.upper(x).startswith("NAME:"))
    tokens = F.transform(heads, lambda x: F.split(strip(F.substring(x, 6, 1_000_000_000)), r"\s+")[0])
    return F.get(F.filter(tokens, lambda t: t.rlike("^[A-Za-z_][A-Za-z0-9_]*$")), F.lit(0))


def response_reason(col: Column) -> Column:
    at = F.instr(col, "REASON:")
    return F.when(at > 0, strip(F.substring(col, at + 7, F.length(col)))).otherwise("")


def response_first_line(col: Column) -> Column:
    return F.substring(F.get(_lines(strip_think(col)), F.lit(0)), 1, 80)


def member_accesses(col: Column) -> Column:
    """``*((TYPE *)(base + N)``-style member reads as ``TYPE:N`` texts."""
    hit = rf"\*\(\(({WORD}+)\s*\*\)\s*\(({WORD}+)\s*\+\s*([0-9]+)\)"
    return F.zip_with(matches(col, hit, 1), matches(col, hit, 3), lambda t, o: F.concat(t, F.lit(":"), o))


def struct_layout(col: Column) -> Column:
    """Array of (type, sorted offsets) per accessed type."""
    pairs = F.transform(member_accesses(col), lambda p: F.struct(
        F.substring_index(p, ":", 1).alias("type"),
        F.substring_index(p, ":", -1).cast("bigint").alias("offset")))
    def grouped(found: Column) -> Column:
        return F.transform(F.array_distinct(F.transform(found, lambda p: p["type"])), lambda t: F.struct(
            t.alias("type"), F.array_sort(F.transform(F.filter(found, lambda p: p["type"] == t),
                                                      lambda p: p["offset"])).alias("offsets")))
    return let(pairs, grouped)


def field_addresses(col: Column, base: int = 0x20000) -> Column:
    """Addresses of ``this + N`` members; raw offset, plus the 8- and 4-byte scaled ones."""
    def at(kind: str, scale: int) -> Column:
        hit = rf"\*\(\(({kind})\)\s*\(this\s*\+\s*([0-9]+)\)"
        return F.transform(matches(col, hit, 2), lambda o: F.lit(base) + o.cast("bigint") * scale)
    any_type = at(rf"{WORD}+\s*\*?", 1)
    return F.array_sort(F.array_distinct(F.concat(any_type, at(r"_QWORD\s*\*", 8), at(r"_DWORD\s*\*", 4))))
