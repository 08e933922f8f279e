"""Instruction-level flags, semantics, risk and memory events."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Mnemonic groups.
BRANCHES = ("je jne jg jge jl jle ja jae jb jbe jo jno js jns jp jnp loop loope loopne jmp jcxz "
            "jecxz jrcxz").split()
CALLS = ("call", "callq")
RETURNS = ("ret", "retq", "retn")
SYSCALLS = ("syscall", "int", "sysenter")
REGISTERS = ("rax rbx rcx rdx rsi rdi rbp rsp rip r8 r9 r10 r11 r12 r13 r14 r15 rflags xmm0 xmm1").split()

# Mnemonic -> category and base risk.
SEMANTICS = {
    "data_move": {"mov": 0.1, "push": 0.1, "pop": 0.1, "lea": 0.05, "xchg": 0.05, "cmov": 0.05},
    "arithmetic": {"add": 0.15, "sub": 0.15, "inc": 0.05, "dec": 0.05, "imul": 0.25, "mul": 0.25,
                   "idiv": 0.3, "div": 0.3, "neg": 0.1},
    "logic": {"and": 0.05, "or": 0.05, "xor": 0.05, "not": 0.05, "shl": 0.1, "shr": 0.1, "sar": 0.1,
              "rol": 0.05, "ror": 0.05},
    "compare": {"cmp": 0.0, "test": 0.0},
    "control_flow": {"jmp": 0.05, "je": 0.05, "jne": 0.05, "jg": 0.05, "jge": 0.05, "jl": 0.05,
                     "jle": 0.05, "ja": 0.05, "jb": 0.05, "call": 0.1, "ret": 0.15, "loop": 0.05},
    "string": {"rep": 0.2, "movsb": 0.2, "movsw": 0.2, "movsd": 0.2, "movsq": 0.2, "stosb": 0.15,
               "stosw": 0.15, "stosd": 0.15, "stosq": 0.15, "cmpsb": 0.05, "scasb": 0.05},
    "stack": {"enter": 0.05, "leave": 0.05},
    "system": {"syscall": 0.3, "int": 0.3, "sysenter": 0.3, "hlt": 0.0},
    "simd": {"movdqu": 0.2, "movdqa": 0.15, "paddd": 0.1},
}
UNKNOWN_RISK = 0.5

# Memory regions, first match wins (low inclusive, high exclusive).
REGIONS = (("stack", 0x7FFF0000, 0x7FFFFFFF), ("heap", 0x60000000, 0x6FFFFFFF),
           ("code", 0x00400000, 0x00600000), ("data", 0x00600000, 0x00700000),
           ("mmap", 0x7F000000, 0x7FFFFFFF))
STACK, HEAP = REGIONS[0], REGIONS[1]

# Signature rules (pattern, signature, severity, mnemonics, operand words).
SIGNATURES = (
    ("stack_buffer_overflow", "rep movsb with large ECX and stack destination", "critical",
     ("rep", "movsb"), ("rsp", "rbp")),
    ("stack_buffer_overflow", "gets() call (no bounds checking)", "critical", ("call",), ("gets",)),
    ("stack_buffer_overflow", "strcpy() call (no bounds checking)", "critical", ("call",), ("strcpy",)),
    ("use_after_free", "use after free() call", "high", ("call",), ("free",)),
)


def semantics_table(spark: SparkSession) -> DataFrame:
    """Fixed dimension of about 60 rows: mnemonic, category, risk."""
    rows = [(m, cat, risk) for cat, group in SEMANTICS.items() for m, risk in group.items()]
    return spark.createDataFrame(rows, "mnemonic string, category string, risk double")


def flags(mnemonic: Column) -> list[Column]:
    return [mnemonic.isin(*BRANCHES).alias("is_branch"), mnemonic.isin(*CALLS).alias("is_call"),
            mnemonic.isin(*RETURNS).alias("is_return"), mnemonic.isin(*SYSCALLS).alias("is_syscall")]


def branch_taken(rip_after: Column, address: Column, raw_len: Column) -> Column:
    return rip_after != address + raw_len


def inside(address: Column, region) -> Column:
    return (address >= region[1]) & (address < region[2])


def region(address: Column) -> Column:
    out = F
    for r in REGIONS:
        out = out.when(inside(address, r), r[0])
    return out.otherwise("unknown")


def on_stack(operands: Column) -> Column:
    return operands.contains("rsp") | operands.contains("rbp")


def context_risk(base: Column, mnemonic: Column, operands: Column) -> Column:
    """Base risk scaled for stack operands, string operations and comparisons, at most 1."""
    risk = F.coalesce(base, F.lit(UNKNOWN_RISK))
    risk = risk * F.when(on_stack(operands), 1.5).otherwise(1.0)
    risk = risk * F.when(mnemonic.isin("rep", "movsb", "stosb", "movsd"), 2.0).otherwise(1.0)
    risk = risk * F.when(mnemonic.isin("cmp", "test", "je", "jne"), 0.3).otherwise(1.0)
    return F.least(risk, F.lit(1.0))


def feature_row(base: Column, mnemonic: Column, operands: Column) -> Column:
    """Ten values: base risk (0 for unknown) and nine flags."""
    tests = [on_stack(operands), operands.contains("["), mnemonic.contains("call"), mnemonic.contains("ret"),
             mnemonic.isin("jmp", "je", "jne", "jg", "jl"), mnemonic.isin("syscall", "int"),
             mnemonic.isin("rep", "movsb", "stosb"), operands.contains("dword"), operands.contains("qword")]
    return F.array(F.coalesce(base, F.lit(0.0)), *[F.when(t, 1.0).otherwise(0.0) for t in tests])


def _event(address: Column, size: Column, kind: Column, is_stack: Column, is_heap: Column) -> Column:
    return F.struct(address.cast("bigint").alias("address"), size.cast("bigint").alias("size"),
                    kind.alias("event_type"), is_stack.alias("is_stack"), is_heap.alias("is_heap"))


def memory_events(before: Column, after: Column) -> Column:
    """Accesses implied by register changes: stack pointer moves and index registers."""
    move = after["rsp"] - before["rsp"]
    out = [F.when(move != 0, _event(after["rsp"], F.abs(move), F.when(move < 0, "write").otherwise("read"),
                                    F.lit(True), F.lit(False)))]
    for reg in ("rsi", "rdi"):
        old = before[reg]
        out.append(F.when((old != after[reg]) & (old != 0),
                          _event(old, F.lit(8), F.lit("read"), inside(old, STACK), inside(old, HEAP))))
    return F.filter(F.array(*out), lambda e: e.isNotNull())


def changed_registers(before: Column, after: Column, names=REGISTERS) -> Column:
    marks = [F.when(before[r] != after[r], F.lit(r)) for r in names]
    return F.filter(F.array(*marks), lambda r: r.isNotNull())
