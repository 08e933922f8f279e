"""Sinks: function lists, rename scripts, hints, verified sources, findings."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import addr as A, names as N
from ..operators import match

HEAD = ("// apply as a script", "#include <idc.idc>", "static main() {")


def lines(functions: DataFrame, fmt: str, named_only: bool = False) -> DataFrame:
    """Exported text lines keyed by (part, addr): 0 header, 1 body, 2 footer."""
    rows = functions.filter(N.is_named(F.col("name"), "context")) if named_only else functions
    at, name = F.col("addr"), F.col("name")
    body = {
        "csv": lambda: F.concat_ws(",", A.hexify(at), name, F.col("size").cast("string")),
        "idc": lambda: F.concat(F.lit("  set_name("), A.hexify(at), F.lit(', "'), N.escape_quotes(name),
                                F.lit('", SN_NOWARN);')),
        "symbols": lambda: F.concat_ws(" ", A.hex_padded(at), name),
        "json": lambda: F.to_json(F.struct(name, at.alias("start"), (at + F.col("size")).alias("end"), "size")),
    }
    if fmt not in body:
        raise ValueError(f"unknown format {fmt!r}: use json, csv, idc or symbols")
    frame = {"csv": (("address,name,size",), ()), "idc": (HEAD, ("}",))}.get(fmt, ((), ()))
    out = rows.select(F.lit(1).alias("part"), at.alias("addr"), body[fmt]().alias("line"))
    return _framed(out, *frame)


def _framed(body: DataFrame, head, foot) -> DataFrame:
    spark = body.sparkSession
    extra = [(0, i, t) for i, t in enumerate(head)] + [(2, i, t) for i, t in enumerate(foot)]
    if not extra:
        return body
    return body.unionByName(spark.createDataFrame(extra, "part int, addr bigint, line string"))


def write_lines(rows: DataFrame, path: str) -> None:
    """Text files in (part, addr) order: range-partitioned, so file order is line order."""
    (rows.repartitionByRange("part", "addr").sortWithinPartitions("part", "addr")
     .select("line").write.mode("overwrite").text(path))


def export(functions: DataFrame, path: str, fmt: str = "json", named_only: bool = False) -> None:
    write_lines(lines(functions, fmt, named_only), path)


def export_port(matches: DataFrame, script: str, hints: str) -> None:
    """Rename script of the automatic gate and JSON hints of the middle gate."""
    body = match.port_lines(matches).select(F.lit(1).alias("part"), "addr", "line")
    write_lines(_framed(body, HEAD, ("}",)), script)
    match.hints(matches).write.mode("overwrite").json(hints)


def export_verified(functions: DataFrame, path: str) -> None:
    """One source file per verified function (rows name, addr, c_code) and an index of them."""
    rows = functions.select(F.concat(N.safe_file_name(F.col("name")), F.lit(".c")).alias("file"), "name", "addr", "c_code")
    rows.select("file", F.col("c_code").alias("value")).write.mode("overwrite").partitionBy("file").text(f"{path}/src")
    (rows.select("name", A.hexify(F.col("addr")).alias("addr"), "file", F.lit(True).alias("verified"))
     .write.mode("overwrite").json(f"{path}/index"))


def findings(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


