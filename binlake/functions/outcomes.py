"""Outcome labels, input features and behaviour signatures of recorded runs."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from . import addr, text

# Fixed values.
CRASH_EXIT_CODES = {139: "segv", 134: "abort", 136: "fpe", 135: "bus"}
NEAR_NULL = 0x10000
FORMAT_SPECIFIERS = ("%s", "%n", "%x", "%p")
BOUNDARY_LENGTHS = (15, 16, 17, 31, 32, 33, 63, 64, 65, 255, 256)


def flag(cond: Column) -> Column:
    return F.when(cond, 1.0).otherwise(0.0)


def unit(value: Column, scale: float) -> Column:
    return F.least(value.cast("double") / scale, F.lit(1.0))


def crashed(exit_code: Column) -> Column:
    return exit_code >= 128


def crash_kind(exit_code: Column) -> Column:
    out = F
    for code, kind in CRASH_EXIT_CODES.items():
        out = out.when(exit_code == code, kind)
    return out.when(crashed(exit_code), "signal").otherwise("")


def emu_status(did_crash: Column, fault_addr: Column, returned: Column) -> Column:
    return (F.when(did_crash & (fault_addr < NEAR_NULL), "needs_state").when(did_crash, "crash")
            .when(returned, "clean").otherwise("inconclusive"))


def emu_note(status: Column, kind: Column, fault_addr: Column, stubbed: Column) -> Column:
    where = addr.hexify(fault_addr)
    return (F.when(status == "needs_state", F.concat(F.lit("near-null access @+"), where,
                                                     F.lit("; needs live state")))
            .when(status == "crash", F.concat(kind, F.lit(" @ "), where, F.lit("; candidate bug")))
            .when(status == "clean", F.concat(F.lit("returned cleanly; "), stubbed.cast("string"),
                                              F.lit(" calls stubbed")))
            .otherwise("hit instruction budget without returning"))


def emu_exit_code(did_crash: Column, timed_out: Column) -> Column:
    return F.when(did_crash, 139).when(timed_out, 124).otherwise(0)


def crash_class(message: Column) -> Column:
    m = F.lower(message)
    return (F.when(m.contains("read") | m.contains("write"), "segfault")
            .when(m.contains("stack"), "stack_smash")
            .when(m.contains("illegal") | m.contains("invalid"), "illegal_instruction")
            .when(m.contains("overflow"), "integer_overflow").otherwise("unknown_crash"))


def token(mode: Column, payload: Column) -> Column:
    return F.concat(mode, F.lit("|"), F.replace(F.base64(payload), F.lit("\r\n"), F.lit("")))


def token_mode(tok: Column) -> Column:
    return F.substring_index(tok, "|", 1)


def token_payload(tok: Column) -> Column:
    return F.unbase64(F.substring(tok, F.instr(tok, "|") + 1, F.length(tok)))


def _latin(payload: Column) -> Column:
    """One character per byte."""
    return F.decode(payload, "ISO-8859-1")


def _byte_ratio(chars: Column, n: Column, char_class: str) -> Column:
    kept = F.length(F.regexp_replace(chars, f"[^{char_class}]", ""))
    return F.when(n > 0, kept / n).otherwise(F.lit(0.0))


def printable_ratio(payload: Column) -> Column:
    return _byte_ratio(_latin(payload), F.length(payload), r"\x20-\x7E")


def specifier_count(payload: Column) -> Column:
    return sum((text.occurrences(_latin(payload), s) for s in FORMAT_SPECIFIERS), F.lit(0))


def single_byte(payload: Column) -> Column:
    """Non-empty and made of one repeated byte."""
    chars = _latin(payload)
    return (F.length(payload) > 0) & (F.length(F.replace(chars, F.substring(chars, 1, 1), F.lit(""))) == 0)


# byte-statistics fields, in order
BYTE_STATS = ("printable", "digits", "letters", "nulls", "high", "blank", "longest_run", "entropy", "specifiers", "single_byte")


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in BYTE_STATS]))
def _byte_stats(payloads: pd.Series) -> pd.DataFrame:
    out = np.zeros((len(payloads), len(BYTE_STATS)))
    for i, raw in enumerate(payloads):
        arr = np.frombuffer(raw or b"", np.uint8)
        if not len(arr):
            continue
        share = np.bincount(arr, minlength=256) / len(arr)
        edges = np.flatnonzero(np.diff(arr))
        run = np.diff(np.concatenate(([-1], edges, [len(arr) - 1]))).max()
        p = share[share > 0]
        specifiers = sum(raw.count(s.encode()) for s in FORMAT_SPECIFIERS)
        out[i] = (share[32:127].sum(), share[48:58].sum(), share[65:91].sum() + share[97:123].sum(), share[0],
                  share[128:].sum(), share[[9, 10, 32]].sum(), min(run / 64.0, 1.0), -(p * np.log2(p)).sum() / 8.0,
                  min(specifiers / 4.0, 1.0), float(run == len(arr)))
    return pd.DataFrame(out, columns=list(BYTE_STATS))


def input_features(mode: Column, payload: Column) -> Column:
    """17 features of an input (a struct); ratios and lengths lie in [0, 1].

    Byte counts come from one Arrow pass per batch, the rest are plain expressions.
    """
    n, stats = F.length(payload), _byte_stats(payload)
    head = F.hex(F.substring(payload, 1, 1))
    return F.struct(
        flag(mode == "stdin").alias("is_stdin"), flag(mode == "argv").alias("is_argv"), unit(n, 256.0).alias("length"),
        *[stats[name].alias(name) for name in BYTE_STATS], flag(head.isin("41", "42", "43", "44")).alias("routed"),
        flag(n == 0).alias("is_empty"), flag(n.isin(*BOUNDARY_LENGTHS)).alias("boundary_length"),
        flag(F.contains(payload, F.lit(b"\n"))).alias("has_newline"))


def input_family(payload: Column) -> Column:
    return (F.when(F.length(payload) == 0, "empty")
            .when(specifier_count(payload) > 0, "format")
            .when(F.length(payload) >= 64, "long")
            .when(single_byte(payload), "repeat")
            .when(printable_ratio(payload) < 0.7, "binary")
            .otherwise("text"))


def fuzz_outcome_features(r: dict[str, Column], timeout: float = 5.0) -> Column:
    """20 long, 14 in use.  ``r`` maps exit_code, timed_out, cov_count, new_coverage, stdout,
    covered_so_far and duration to columns."""
    kind = crash_kind(r["exit_code"])
    used = [
        F.greatest(F.lit(-1.0), unit(r["exit_code"], 128.0)),
        flag(r["exit_code"] == 0), flag(crashed(r["exit_code"])), flag(r["timed_out"]),
        flag(kind == "segv"), flag(kind == "abort"),
        unit(r["cov_count"], 8.0), unit(r["new_coverage"], 4.0), unit(F.length(r["stdout"]), 200.0),
        flag(r["stdout"].rlike(r"\S")), unit(r["covered_so_far"], 8.0), unit(r["duration"], timeout),
        flag(r["stdout"].contains("%")), F.lit(1.0)]
    return F.array(*used, *[F.lit(0.0)] * 6)


def emu_outcome_features(r: dict[str, Column]) -> Column:
    """14 long, 13 in use."""
    kinds = [flag(r["crash_kind"] == k) for k in
             ("read_unmapped", "write_unmapped", "fetch_unmapped", "invalid_insn")]
    return F.array(
        flag(r["crashed"]), flag(r["returned"]), flag(r["timed_out"]), *kinds,
        unit(r["blocks"], 16.0), unit(r["new_coverage"], 4.0), unit(r["covered_so_far"], 32.0),
        flag(r["fault_addr"] != 0), flag(r["crash_kind"].startswith("write")), F.lit(0.0), F.lit(1.0))


def command_outcome_features(r: dict[str, Column]) -> Column:
    """24 values of a command run; ``r`` has exit_code, timed_out, stdout, stderr, duration, destructive."""
    out, err, code = r["stdout"], r["stderr"], r["exit_code"]
    low = F.lower(F.concat(out, F.lit(" "), err))
    blank = ~out.rlike(r"\S")
    return F.array(
        F.greatest(F.lit(-1.0), unit(code, 128.0)), flag(code == 0), flag(crashed(code)),
        flag(r["timed_out"]), unit(F.length(out), 500.0), unit(F.length(err), 500.0),
        unit(text.occurrences(out, "\n"), 50.0), text.entropy(F.substring(out, 1, 1000)) / 8.0,
        flag(low.contains("error")), flag(low.contains("not found") | low.contains("no such")),
        flag(low.contains("permission denied")), flag(low.contains("usage")),
        flag(F.substring(out, 1, 200).rlike("[0-9]")), flag(~blank), flag(err.rlike(r"\S")),
        unit(r["duration"], 8.0), flag(r["destructive"]), flag(code == -1), flag(code == 127),
        flag(code == 126), flag(text.strip(out).contains("\n")), flag(F.length(out) > 2000),
        flag((code == 0) & blank), F.lit(1.0))


def command_signature(family: Column, exit_code: Column, timed_out: Column, stdout: Column,
                      stderr: Column) -> Column:
    """What kind of thing happened: family, outcome, log2 output-size bucket, stderr flag."""
    outcome = (F.when(exit_code == 0, "ok").when(crashed(exit_code), "crash")
               .when(timed_out, "timeout").otherwise(F.concat(F.lit("rc"), exit_code.cast("string"))))
    bits = F.when(F.length(stdout) == 0, 0).otherwise(
        F.least(F.length(F.bin(F.length(stdout))), F.lit(12)))
    return F.concat_ws("|", family, outcome, bits.cast("string"), stderr.rlike(r"\S").cast("string"))


def fuzz_signature(exit_code: Column, cov_count: Column) -> Column:
    kind = F.nullif(crash_kind(exit_code), F.lit(""))
    return F.concat_ws("|", F.coalesce(kind, F.concat(F.lit("rc"), exit_code.cast("string"))),
                       cov_count.cast("string"))


def emu_signature(kind: Column, timed_out: Column, blocks: Column) -> Column:
    what = F.coalesce(F.nullif(kind, F.lit("")), F.when(timed_out, "timeout").otherwise("ok"))
    return F.concat_ws("|", what, F.least(blocks, F.lit(16)).cast("string"))
