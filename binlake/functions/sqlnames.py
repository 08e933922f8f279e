"""Operators under SQL names, for ``spark.sql`` users."""
from __future__ import annotations

from pyspark.sql import SparkSession

from . import commands, tablefns, text

# Fixed SQL bodies of small expressions.
DOT = "aggregate(zip_with({a}, {b}, (x, y) -> x * y), 0D, (s, x) -> s + x)"
BODIES = {
    "vector_dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": DOT.format(a="a", b="b"),
    "vector_cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE":
        "coalesce(try_divide(" + DOT.format(a="a", b="b") + ", sqrt(" + DOT.format(a="a", b="a") + ") * sqrt("
        + DOT.format(a="b", b="b") + ")), 0D)",
    "vector_l2(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE":
        "sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))",
    "addr_hex(a BIGINT) RETURNS STRING": "concat('0x', lower(hex(a)))",
    "is_named(n STRING) RETURNS BOOLEAN": "n IS NOT NULL AND NOT startswith(n, 'sub_')",
    "code_strings(c STRING) RETURNS ARRAY<STRING>":
        f"array_distinct(filter(regexp_extract_all(c, r'{text.QUOTED}', 1), "
        f"s -> length(s) >= 2 AND NOT rlike(s, r'{text.FORMAT_ONLY}')))",
}


def register(spark: SparkSession) -> list[str]:
    """Create the temporary functions of this session, table functions too; returns the names of the scalar ones."""
    for head, body in BODIES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udf.register("text_entropy", text._entropy)
    spark.udf.register("command_words", commands.tokens)
    tablefns.register(spark)
    return [h.split("(")[0] for h in BODIES] + ["text_entropy", "command_words"]
