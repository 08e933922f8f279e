"""Program-analysis relations derived from the star-schema, event and text tables.

Each relation exists twice: as a DataFrame (built by Spark from whole tables) and as an SQL common
table expression of the same content, used by the cross-check queries.
"""
from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import tablefns
from ..session import shared_folder, spread
from ..sources import byteranges


def le(value, width: int):
    """Hex text of a number, lowest byte first."""
    text = F.lpad(F.hex(value.cast("bigint")), width * 2, "0")
    return F.concat(*[F.substring(text, width * 2 - 2 * i - 1, 2) for i in range(width)])


def zeros(n: int):
    return F.lit("00" * n)


class Tables:
    """The input tables of one folder and the relations on top of them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        return spread(self.read(name))

    # static program tables -------------------------------------------------------------------
    def functions(self) -> DataFrame:
        docs = self.read("documents").select(F.col("doc_id").alias("p_partkey"), F.col("text").alias("pseudocode"))
        return self.spread("part").join(docs, "p_partkey", "left").select(
            F.col("p_brand").alias("binary"), F.col("p_partkey").alias("addr"),
            F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("sub_"), F.lower(F.hex("p_partkey"))))
            .otherwise(F.col("p_name")).alias("name"),
            (F.col("p_size").cast("bigint") * 16).alias("size"), "pseudocode")

    def lean(self) -> DataFrame:
        """Functions without the wide text column (and without its join)."""
        return self.read("part").select(
            F.col("p_brand").alias("binary"), F.col("p_partkey").alias("addr"),
            F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("sub_"), F.lower(F.hex("p_partkey"))))
            .otherwise(F.col("p_name")).alias("name"), (F.col("p_size").cast("bigint") * 16).alias("size"))

    def spans(self) -> DataFrame:
        return self.lean().withColumn("start", F.col("addr") * 4096).withColumn("end", F.col("start") + F.col("size"))

    def _line_pairs(self) -> DataFrame:
        brand = self.read("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("binary"))
        w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
        rows = self.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(brand, "l_partkey")
        nxt = F.lead(F.struct("l_partkey", "l_suppkey", "binary")).over(w)
        return rows.withColumn("n", nxt).filter("n is not null")

    def calls(self) -> DataFrame:
        p = self._line_pairs()
        return (p.filter((F.col("binary") == F.col("n.binary")) & (F.col("l_partkey") != F.col("n.l_partkey")))
                .select("binary", F.col("l_partkey").alias("caller_addr"), F.col("n.l_partkey").alias("callee_addr")).distinct())

    def xrefs(self) -> DataFrame:
        p = self._line_pairs()
        return p.select("binary", (F.col("l_partkey") * 4096 + F.col("l_suppkey") % 800).alias("from_addr"),
                        (F.col("n.l_partkey") * 4096 + F.col("n.l_suppkey") % 800).alias("to_addr"))

    def refs(self) -> DataFrame:
        brand = self.read("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("binary"))
        kind = F.when(F.col("l_returnflag") == "A", "code").when(F.col("l_returnflag") == "N", "data").otherwise("string")
        return self.read("lineitem").join(brand, "l_partkey").select(
            "binary", F.col("l_partkey").alias("func_addr"), kind.alias("ref_type"),
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"), F.col("l_suppkey").alias("addr"))

    def knowledge(self) -> DataFrame:
        s, n = F.col("s_suppkey"), F.col("s_name")
        used = self.refs().select("binary", "addr").distinct()
        facts = self.read("supplier").select(
            s.alias("addr"),
            F.when(s % 4 == 0, F.concat(F.lit("off_"), s.cast("string"))).when(s % 4 == 1, n).otherwise("").alias("name"),
            F.when(s % 3 == 0, F.concat(F.lit("note "), n)).otherwise("").alias("comment"),
            F.when(s % 5 == 0, "int *").otherwise("").alias("type_str"),
            F.when(s % 7 == 0, F.concat(F.lit('text "'), n, F.lit('"'))).otherwise("").alias("string_val"))
        return used.join(facts, "addr")

    def code(self) -> DataFrame:
        """Documents with a line of C-like code that varies with the document."""
        d = F.col("doc_id")
        def mod(n: int):
            return (d % n).cast("string")
        line = F.concat(
            F.lit("\nstruct S"), mod(7), F.lit("; x = *((_DWORD *)(this + "), mod(64), F.lit("); y = *((T"), mod(3),
            F.lit(" *)(v"), mod(5), F.lit(" + "), mod(32), F.lit("); Foo"), mod(11), F.lit("::Run(0x"),
            F.lower(F.hex(d * 977)), F.lit(", "), (d * 1009).cast("string"), F.lit("); Init(Widget *w); memcpy(a); do_it(b, \"lit "),
            mod(13), F.lit("\", \"%d\"); if (x) while (y) return z;"))
        return self.spread("documents").select("doc_id", F.concat("text", line).alias("code"))

    def responses(self) -> DataFrame:
        t, turn = F.col("text"), F.col("turn")
        text = (F.when(turn % 3 == 0, F.concat(F.lit("Sure.\n name: f_"), F.col("conv_id").cast("string"),
                                               F.lit(" x\nREASON: "), t))
                .when(turn % 3 == 1, F.concat(F.lit("<think>"), t, F.lit("</think> pick_"), turn.cast("string"),
                                              F.lit("\nNAME: 9bad")))
                .otherwise(t))
        return self.read("conversations").select("conv_id", "turn", text.alias("response"))

    # run logs ----------------------------------------------------------------------------------
    def ev(self) -> DataFrame:
        return self.read("events").select("event_id", "user_id", "event_type", "value", "ts",
                                          F.get_json_object("props", "$.k").cast("bigint").alias("k"))

    def fuzz_runs(self) -> DataFrame:
        k, e = F.col("k"), F.col("event_type")
        text = (F.when(k % 6 == 0, "").when(k % 6 == 1, F.concat(e, F.lit("%s")))
                .when(k % 6 == 2, F.repeat(F.lit("ab"), 40)).when(k % 6 == 3, F.expr("repeat('Z', cast(1 + k % 9 as int))"))
                .otherwise(F.concat(e, k.cast("string"))))
        code = (F.when(e == "error", F.when(k % 2 == 0, 139).otherwise(134)).when(e == "signup", 124)
                .when(e == "purchase", 2).otherwise(0))
        return self.ev().select(
            F.col("user_id").alias("campaign"), F.col("event_id").alias("step"),
            F.concat(F.lit("bin"), (F.col("user_id") % 10).cast("string")).alias("binary"), k.alias("addr"),
            F.lit("stdin").alias("mode"), F.encode(text, "UTF-8").alias("payload"), code.alias("exit_code"),
            F.when(code == 0, F.concat(F.lit("ok "), k.cast("string"), F.lit("%"))).otherwise("").alias("stdout"),
            F.array(F.concat(F.lit("f"), k.cast("string")), F.concat(F.lit("g"), F.floor(k / 7).cast("string"))).alias("cov_ids"),
            (e == "signup").alias("timed_out"), (F.col("value") / 100).alias("duration"))

    def emu_runs(self) -> DataFrame:
        k, e = F.col("k"), F.col("event_type")
        bad = e == "error"
        kind = (F.when(k % 4 == 0, "read_unmapped").when(k % 4 == 1, "write_unmapped").when(k % 4 == 2, "fetch_unmapped")
                .otherwise("invalid_insn"))
        return self.ev().select(
            F.col("user_id").alias("campaign"), F.col("event_id").alias("step"),
            F.concat(F.lit("bin"), (F.col("user_id") % 10).cast("string")).alias("binary"), k.alias("addr"),
            F.encode(F.concat_ws("-", e, k.cast("string")), "UTF-8").alias("payload"), bad.alias("crashed"),
            F.when(bad, kind).otherwise("").alias("crash_kind"),
            F.when(bad, F.floor(F.col("value") * 1000).cast("bigint")).otherwise(0).alias("fault_addr"),
            k.alias("blocks"), e.isin("click", "view").alias("returned"), (e == "purchase").alias("timed_out"),
            (k % 7).alias("stubbed_calls"), F.array(F.concat(F.lit("b"), k.cast("string"))).alias("cov_ids"))

    def live_calls(self) -> DataFrame:
        k = F.col("k")
        return self.ev().filter(F.col("event_type").isin("view", "click")).select(
            F.concat(F.lit("bin"), (F.col("user_id") % 10).cast("string")).alias("binary"), (k * 16).alias("rva"),
            F.when(k % 3 != 0, F.concat_ws("-", "event_type", F.col("user_id").cast("string"))).alias("arg"),
            (F.col("event_id") % 256).alias("ret"), F.col("event_id").alias("step"), "ts")

    def errors(self) -> DataFrame:
        return self.ev().select(F.col("user_id").alias("campaign"), F.col("event_id").alias("step"),
                                F.col("event_type").alias("family"), (F.col("value") / 500).alias("error"), "k")

    def commands(self) -> DataFrame:
        k, e = F.col("k").cast("string"), F.col("event_type")
        text = (F.when(e == "click", F.concat(F.lit("ls -la /tmp/"), k))
                .when(e == "error", F.concat(F.lit("sudo grep -n 'x y' /var/log/"), k, F.lit(" | head -5")))
                .when(e == "view", F.concat(F.lit("A=1 cat /proc/"), k, F.lit(" > out"))).when(
                    e == "purchase", F.concat(F.lit("/usr/bin/gcc --help "), k)).otherwise(F.concat(F.lit("frob "), k, F.lit(" &"))))
        docs = self.read("documents").select(F.col("doc_id").alias("event_id"), "text")
        code = F.when(e == "error", 139).when(e == "signup", 124).when(e == "purchase", 2).otherwise(0)
        path = F.when(F.col("k") % 5 == 0, F.concat(F.lit("/opt/x"), k, F.lit(" "))).otherwise("")
        return self.ev().join(docs, "event_id", "left").select(
            F.col("user_id").alias("campaign"), F.col("event_id").alias("step"), text.alias("command"),
            F.concat(path, F.coalesce("text", F.lit(""))).alias("stdout"),
            F.when(e == "error", F.concat(F.lit("Error: not found "), k)).otherwise("").alias("stderr"),
            code.alias("exit_code"), (F.col("value") / 50).alias("duration"), (e == "signup").alias("timed_out"))

    # traces ------------------------------------------------------------------------------------
    def _trace(self, recompiled: bool) -> DataFrame:
        k, e, i = F.col("k"), F.col("event_type"), F.col("event_id")
        kind = F.when(e.isin("click", "view"), "write").when(e.isin("purchase", "signup"), "call").otherwise("return")
        rows = self.ev().filter(i % 211 != 0) if recompiled else self.ev()
        at = F.lit(131072) + k * 8 + F.when(i % 61 == 0, 8).otherwise(0) if recompiled else F.lit(65536) + k * 8
        value = k + F.when(i % 37 == 0, 1).otherwise(0) if recompiled else k
        return rows.select(F.col("user_id").alias("pair_id"), kind.alias("kind"), i.alias("ord"), at.cast("bigint").alias("addr"),
                           F.lit(8).alias("size"), value.alias("value"), (k + 4096).alias("target"))

    def original(self) -> DataFrame:
        return self._trace(False)

    def recompiled(self) -> DataFrame:
        return self._trace(True)

    def returns(self) -> DataFrame:
        k = F.col("k")
        return self.ev().groupBy(F.col("user_id").alias("pair_id")).agg(
            F.max("k").alias("ret_original"), F.max(F.when(F.col("event_id") % 7 != 0, k)).alias("ret_recompiled"))

    def instr(self) -> DataFrame:
        names = ("mov push pop call add imul movsb rep cmp je jmp ret syscall stosb lea frob").split()
        ops = ("dword ptr [rsp+8], eax|strcpy|printf|rbp|eax, ebx|free|qword ptr [rax]|gets").split("|")
        p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
        w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
        rsp = F.lit(2147418112) + s * 8
        rsi = F.lit(1610612736) + p
        rdi = s % 3
        at = F.lit(4194304) + p % 500 * 16
        def regs(*cols):
            return F.struct(*[c.cast("bigint").alias(r) for r, c in zip(("rsp", "rsi", "rdi", "rip"), cols)])
        return self.read("lineitem").select(
            F.col("l_orderkey").alias("trace_id"), F.row_number().over(w).alias("seq"), at.cast("bigint").alias("address"),
            F.element_at(F.array(*[F.lit(x) for x in names]), (p % 16 + 1).cast("int")).alias("mnemonic"),
            F.element_at(F.array(*[F.lit(x) for x in ops]), (s % 8 + 1).cast("int")).alias("operands"), F.lit(4).alias("raw_len"),
            regs(rsp, rsi, rdi, at).alias("regs_before"),
            regs(rsp + (n - 4) * 8, rsi + n % 2, rdi + n % 3, at + 4 + p % 2 * 12).alias("regs_after"))

    # matching ------------------------------------------------------------------------------------
    def vectors(self) -> DataFrame:
        return self.read("embeddings").select(
            F.concat(F.lit("B"), F.col("label").cast("string")).alias("binary"), F.col("vec_id").alias("addr"),
            F.col("embedding").cast("array<double>").alias("vector"))

    def matches(self) -> DataFrame:
        c, o = F.col("o_custkey"), F.col("o_orderkey")
        text = F.when(o % 2 == 0, F.concat(F.lit("0x"), F.lower(F.hex(c)))).otherwise(c.cast("string"))
        return self.read("orders").select(
            F.col("o_orderpriority").alias("type"), text.alias("address"), F.concat(F.lit('fn"'), c.cast("string")).alias("name"),
            F.concat(F.lit("0x"), F.lower(F.hex(o))).alias("address2"), F.concat(F.lit("g"), o.cast("string")).alias("name2"),
            (o * 7919 % 1000 / 1000.0).alias("ratio"), F.lit(3).alias("nodes1"), F.lit(4).alias("nodes2"),
            F.col("o_orderstatus").alias("description"))

    def kb_pairs(self) -> DataFrame:
        docs = self.read("documents").select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("h"))
        first = docs.groupBy("h").agg(F.min(F.struct("doc_id", "source")).alias("f"))
        return docs.join(first, "h").filter(F.col("doc_id") != F.col("f.doc_id")).select(
            F.col("f.source").alias("binary_old"), F.col("f.doc_id").alias("addr_old"),
            F.col("source").alias("binary_new"), F.col("doc_id").alias("addr_new"),
            (1.0 / (1 + F.col("doc_id") - F.col("f.doc_id"))).alias("similarity"), (F.col("doc_id") % 2 == 0).alias("verified"))

    # bytes ---------------------------------------------------------------------------------------
    def blobs(self) -> DataFrame:
        """Pseudo-random code bytes with planted starts, text and a picture header per part."""
        p = F.col("p_partkey")
        noise = F.array_join(F.transform(F.sequence(F.lit(0), F.col("p_size") + 7), lambda i: F.md5(F.concat_ws(
            "-", p.cast("string"), i.cast("string")).cast("binary"))), "")
        text = F.concat(F.lit("c3554889e54883ec20cc55"), noise, F.lower(F.hex(F.col("p_name"))),
                        F.lit("0089504e470d0a1a0a"), F.md5(p.cast("string").cast("binary")), F.md5(F.col("p_name").cast("binary")),
                        F.lit("49454e44ae426082fd7bbfa9"))
        return self.spread("part").select(
            F.concat(F.lit("bin/"), p.cast("string")).alias("path"), (F.lit(4194304) + p * 65536).alias("base"),
            F.unhex(text).alias("content"))

    def stored(self, *blobs: DataFrame, packed: bool = False) -> str:
        """A fresh folder below the shared one with a file for each (path, content), many to a pack where asked for."""
        folder = f"{shared_folder(self.spark).rstrip('/')}/files-{uuid.uuid4().hex}"
        rows = blobs[0].select("path", "content")
        for more in blobs[1:]:
            rows = rows.unionByName(more.select("path", "content"))
        (byteranges.pack if packed else byteranges.store)(rows, folder).write.format("noop").mode("overwrite").save()
        return folder

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        """SQL over the frames, which it names in braces, with the registered table functions."""
        tablefns.register(self.spark)
        return self.spark.sql(text, **frames)

    def executables(self) -> DataFrame:
        """Minimal PE and NSO images, Mach-O heads and scripts, one of each per part."""
        p, size = F.col("p_partkey"), F.col("p_size").cast("bigint")
        four = lambda *values: F.element_at(F.array(*[F.lit(v).cast("bigint") for v in values]), (p % 4 + 1).cast("int"))
        name = F.rpad(F.hex(F.concat(F.lit(".t"), (p % 100).cast("string"))), 16, "0")
        base = F.when(p % 4 < 2, le(F.lit(0x140000000), 8)).otherwise(F.concat(zeros(4), le(F.lit(0x400000), 4)))
        exe = F.concat(
            F.lit("4d5a"), zeros(58), le(F.lit(128), 4), zeros(64), F.lit("50450000"), le(four(0x8664, 0xAA64, 0x14C, 0x1C0), 2), le(F.lit(1), 2), zeros(12),
            le(F.lit(240), 2), zeros(2), le(F.lit(0x20B), 2), zeros(22), base, zeros(208), name, le(size + 7, 4), le(p * 16 + 4096, 4), le(size, 4),
            le(F.lit(512), 4), zeros(12), le(four(0x20, 0x40, 0x20, 0x40), 4), zeros(80), F.expr("repeat('90', p_size)"))
        def segment(off, va, n):
            return F.concat(le(off, 4), le(va, 4), le(n, 4))
        nso = F.concat(
            F.lit("4e534f30"), zeros(12), segment(F.lit(256), F.lit(0), size), zeros(4), segment(size + 256, size, size - 1), zeros(4),
            segment(2 * size + 255, 2 * size, F.lit(1)), le(p % 50, 4), zeros(192), F.expr("repeat('1f2003d5', p_size)").substr(F.lit(1), (4 * size).cast("int")))
        kinds = {"exe": exe, "nso": nso, "mac": F.concat(F.lit("feedfacf"), F.hex("p_name")), "sh": F.concat(F.lit("2321"), F.hex("p_name"))}
        return self.spread("part").select(F.explode(F.array(*[F.struct(
            F.concat(F.lit(f"{k}/"), p.cast("string")).alias("path"), F.unhex(v).alias("content")) for k, v in kinds.items()])).alias("x")).select("x.*")

    def images(self) -> DataFrame:
        """Minimal 64-bit ELF files with one code and one zero-filled section per part."""
        p = F.col("p_partkey")
        machine = F.when(p % 3 == 0, 62).when(p % 3 == 1, 183).otherwise(40)
        head = F.concat(F.lit("7f454c460201"), zeros(12), le(machine, 2), zeros(20), le(F.lit(64), 8), zeros(10),
                        le(F.lit(64), 2), le(F.lit(2), 2), zeros(2))
        size = F.col("p_size").cast("bigint")
        def section(kind: int, flags: int, va, off, n):
            return F.concat(zeros(4), le(F.lit(kind), 4), le(F.lit(flags), 8), le(va, 8), le(off, 8), le(n, 8), zeros(24))
        body = F.expr("repeat('55', p_size)")
        text = F.concat(head, section(1, 6, F.lit(4096) + p * 16, F.lit(192), size),
                        section(8, 3, F.lit(1048576) + p, F.lit(0), size * 2), body)
        return self.spread("part").select(F.concat(F.lit("img/"), p.cast("string")).alias("path"), F.unhex(text).alias("content"))


# Common table expressions with the same content, and what each needs.
SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "functions": ((), """SELECT p_brand AS binary, p_partkey AS addr,
        CASE WHEN p_partkey % 3 = 0 THEN 'sub_' || printf('%x', p_partkey) ELSE p_name END AS name,
        CAST(p_size AS BIGINT) * 16 AS size, text AS pseudocode
        FROM part LEFT JOIN documents ON doc_id = p_partkey"""),
    "spans": (("functions",), "SELECT *, addr * 4096 AS start, addr * 4096 + size AS fin FROM functions"),
    "line_pairs": ((), """SELECT * FROM (SELECT p_brand AS binary, l_partkey, l_suppkey,
        lead(l_partkey) OVER w AS n_part, lead(l_suppkey) OVER w AS n_supp, lead(p_brand) OVER w AS n_binary
        FROM lineitem JOIN part ON p_partkey = l_partkey
        WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)) WHERE n_part IS NOT NULL"""),
    "calls": (("line_pairs",), """SELECT DISTINCT binary, l_partkey AS caller_addr, n_part AS callee_addr
        FROM line_pairs WHERE binary = n_binary AND l_partkey <> n_part"""),
    "xrefs": (("line_pairs",), """SELECT binary, l_partkey * 4096 + l_suppkey % 800 AS from_addr,
        n_part * 4096 + n_supp % 800 AS to_addr FROM line_pairs"""),
    "refs": ((), """SELECT p_brand AS binary, l_partkey AS func_addr,
        CASE l_returnflag WHEN 'A' THEN 'code' WHEN 'N' THEN 'data' ELSE 'string' END AS ref_type,
        l_orderkey * 8 + l_linenumber AS ord, l_suppkey AS addr FROM lineitem JOIN part ON p_partkey = l_partkey"""),
    "knowledge": (("refs",), """SELECT r.binary, s_suppkey AS addr,
        CASE s_suppkey % 4 WHEN 0 THEN 'off_' || s_suppkey WHEN 1 THEN s_name ELSE '' END AS name,
        CASE WHEN s_suppkey % 3 = 0 THEN 'note ' || s_name ELSE '' END AS comment,
        CASE WHEN s_suppkey % 5 = 0 THEN 'int *' ELSE '' END AS type_str,
        CASE WHEN s_suppkey % 7 = 0 THEN 'text "' || s_name || '"' ELSE '' END AS string_val
        FROM (SELECT DISTINCT binary, addr FROM refs) r JOIN supplier ON s_suppkey = r.addr"""),
    "code": ((), """SELECT doc_id, text || chr(10) || 'struct S' || (doc_id % 7) || '; x = *((_DWORD *)(this + ' || (doc_id % 64)
        || '); y = *((T' || (doc_id % 3) || ' *)(v' || (doc_id % 5) || ' + ' || (doc_id % 32) || '); Foo' || (doc_id % 11)
        || '::Run(0x' || printf('%x', doc_id * 977) || ', ' || (doc_id * 1009) || '); Init(Widget *w); memcpy(a); do_it(b, "lit '
        || (doc_id % 13) || '", "%d"); if (x) while (y) return z;' AS code FROM documents"""),
    "responses": ((), """SELECT conv_id, turn, CASE turn % 3
        WHEN 0 THEN 'Sure.' || chr(10) || ' name: f_' || conv_id || ' x' || chr(10) || 'REASON: ' || text
        WHEN 1 THEN '<think>' || text || '</think> pick_' || turn || chr(10) || 'NAME: 9bad' ELSE text END AS response
        FROM conversations"""),
    "ev": ((), """SELECT event_id, user_id, event_type, value, ts, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k
        FROM events"""),
    "fuzz_runs": (("ev",), """SELECT user_id AS campaign, event_id AS step, 'bin' || (user_id % 10) AS binary, k AS addr, k,
        event_type, CASE k % 6 WHEN 0 THEN '' WHEN 1 THEN event_type || '%s' WHEN 2 THEN repeat('ab', 40)
            WHEN 3 THEN repeat('Z', CAST(1 + k % 9 AS INT)) ELSE event_type || k END AS payload,
        CASE event_type WHEN 'error' THEN CASE WHEN k % 2 = 0 THEN 139 ELSE 134 END WHEN 'signup' THEN 124
            WHEN 'purchase' THEN 2 ELSE 0 END AS exit_code,
        CASE WHEN event_type IN ('click', 'view') THEN 'ok ' || k || '%' ELSE '' END AS stdout,
        ['f' || k, 'g' || (k // 7)] AS cov_ids, event_type = 'signup' AS timed_out, value / 100 AS duration FROM ev"""),
    "emu_runs": (("ev",), """SELECT user_id AS campaign, event_id AS step, 'bin' || (user_id % 10) AS binary, k AS addr,
        event_type || '-' || k AS payload, event_type = 'error' AS crashed,
        CASE WHEN event_type <> 'error' THEN '' WHEN k % 4 = 0 THEN 'read_unmapped' WHEN k % 4 = 1 THEN 'write_unmapped'
            WHEN k % 4 = 2 THEN 'fetch_unmapped' ELSE 'invalid_insn' END AS crash_kind,
        CASE WHEN event_type = 'error' THEN CAST(floor(value * 1000) AS BIGINT) ELSE 0 END AS fault_addr, k AS blocks,
        event_type IN ('click', 'view') AS returned, event_type = 'purchase' AS timed_out, k % 7 AS stubbed_calls,
        ['b' || k] AS cov_ids FROM ev"""),
    "live_calls": (("ev",), """SELECT 'bin' || (user_id % 10) AS binary, k * 16 AS rva,
        CASE WHEN k % 3 <> 0 THEN event_type || '-' || user_id END AS arg, event_id % 256 AS ret, event_id AS step, ts
        FROM ev WHERE event_type IN ('view', 'click')"""),
    "errors": (("ev",), """SELECT user_id AS campaign, event_id AS step, event_type AS family, value / 500 AS error, k
        FROM ev"""),
    "commands": (("ev",), """SELECT user_id AS campaign, event_id AS step, k, event_type,
        CASE event_type WHEN 'click' THEN 'ls -la /tmp/' || k
            WHEN 'error' THEN 'sudo grep -n ''x y'' /var/log/' || k || ' | head -5'
            WHEN 'view' THEN 'A=1 cat /proc/' || k || ' > out' WHEN 'purchase' THEN '/usr/bin/gcc --help ' || k
            ELSE 'frob ' || k || ' &' END AS command,
        CASE WHEN k % 5 = 0 THEN '/opt/x' || k || ' ' ELSE '' END || coalesce(text, '') AS stdout,
        CASE WHEN event_type = 'error' THEN 'Error: not found ' || k ELSE '' END AS stderr,
        CASE event_type WHEN 'error' THEN 139 WHEN 'signup' THEN 124 WHEN 'purchase' THEN 2 ELSE 0 END AS exit_code,
        value / 50 AS duration, event_type = 'signup' AS timed_out FROM ev LEFT JOIN documents ON doc_id = event_id"""),
    "original": (("ev",), """SELECT user_id AS pair_id, CASE WHEN event_type IN ('click', 'view') THEN 'write'
        WHEN event_type IN ('purchase', 'signup') THEN 'call' ELSE 'return' END AS kind, event_id AS ord,
        65536 + k * 8 AS addr, 8 AS size, k AS value, k + 4096 AS target FROM ev"""),
    "recompiled": (("ev",), """SELECT user_id AS pair_id, CASE WHEN event_type IN ('click', 'view') THEN 'write'
        WHEN event_type IN ('purchase', 'signup') THEN 'call' ELSE 'return' END AS kind, event_id AS ord,
        131072 + k * 8 + CASE WHEN event_id % 61 = 0 THEN 8 ELSE 0 END AS addr, 8 AS size,
        k + CASE WHEN event_id % 37 = 0 THEN 1 ELSE 0 END AS value, k + 4096 AS target FROM ev WHERE event_id % 211 <> 0"""),
    "returns": (("ev",), """SELECT user_id AS pair_id, max(k) AS ret_original,
        max(CASE WHEN event_id % 7 <> 0 THEN k END) AS ret_recompiled FROM ev GROUP BY user_id"""),
    "instr": ((), """SELECT l_orderkey AS trace_id,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq,
        4194304 + l_partkey % 500 * 16 AS address,
        (['mov','push','pop','call','add','imul','movsb','rep','cmp','je','jmp','ret','syscall','stosb','lea','frob'])
            [l_partkey % 16 + 1] AS mnemonic,
        (['dword ptr [rsp+8], eax','strcpy','printf','rbp','eax, ebx','free','qword ptr [rax]','gets'])[l_suppkey % 8 + 1] AS operands,
        2147418112 + l_suppkey * 8 AS rsp_b, 2147418112 + l_suppkey * 8 + (l_linenumber - 4) * 8 AS rsp_a,
        1610612736 + l_partkey AS rsi_b, 1610612736 + l_partkey + l_linenumber % 2 AS rsi_a,
        l_suppkey % 3 AS rdi_b, l_suppkey % 3 + l_linenumber % 3 AS rdi_a, l_partkey % 2 = 1 AS taken FROM lineitem"""),
    "mem": (("instr",), """SELECT trace_id, seq, rsp_a AS addr, abs(rsp_a - rsp_b) AS size,
            CASE WHEN rsp_a < rsp_b THEN 'write' ELSE 'read' END AS kind, true AS is_stack FROM instr WHERE rsp_a <> rsp_b
        UNION ALL SELECT trace_id, seq, rsi_b, 8, 'read', false FROM instr WHERE rsi_a <> rsi_b AND rsi_b <> 0
        UNION ALL SELECT trace_id, seq, rdi_b, 8, 'read', false FROM instr WHERE rdi_a <> rdi_b AND rdi_b <> 0"""),
    "vectors": ((), "SELECT 'B' || label AS binary, vec_id AS addr, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings"),
    "matches": ((), """SELECT o_orderpriority AS type, o_custkey AS address, 'fn"' || o_custkey AS name, o_orderkey AS address2,
        'g' || o_orderkey AS name2, (o_orderkey * 7919 % 1000) / 1000.0::DOUBLE AS ratio, o_orderstatus AS description FROM orders"""),
    "kb_pairs": ((), """SELECT f.source AS binary_old, f.doc_id AS addr_old, d.source AS binary_new, d.doc_id AS addr_new,
        1.0::DOUBLE / (1 + d.doc_id - f.doc_id) AS similarity, d.doc_id % 2 = 0 AS verified
        FROM documents d JOIN (SELECT md5(text) AS h, min(doc_id) AS first FROM documents GROUP BY 1) g ON md5(d.text) = g.h
        JOIN documents f ON f.doc_id = g.first WHERE d.doc_id <> g.first"""),
    "blobs": ((), """SELECT 'bin/' || p_partkey AS path, 4194304 + p_partkey * 65536 AS base,
        'c3554889e54883ec20cc55' || array_to_string([md5(p_partkey || '-' || i) for i in range(0, p_size + 8)], '')
        || lower(hex(p_name)) || '0089504e470d0a1a0a' || md5(p_partkey::VARCHAR) || md5(p_name) || '49454e44ae426082fd7bbfa9' AS h
        FROM part"""),
    "bytes": (("blobs",), """SELECT path, base, i AS pos, base + i AS addr, substr(h, CAST(2 * i + 1 AS INT), 2) AS b, h,
        CASE WHEN i > 0 THEN substr(h, CAST(2 * i - 1 AS INT), 2) END AS prev
        FROM (SELECT path, base, h, unnest(range(0, length(h) // 2)) AS i FROM blobs)"""),
    "words": (("blobs",), """SELECT path, base + 4 * i AS addr, CAST('0x' || substr(h, CAST(8 * i + 7 AS INT), 2)
            || substr(h, CAST(8 * i + 5 AS INT), 2) || substr(h, CAST(8 * i + 3 AS INT), 2)
            || substr(h, CAST(8 * i + 1 AS INT), 2) AS BIGINT) AS w
        FROM (SELECT path, base, h, unnest(range(0, length(h) // 8)) AS i FROM blobs)"""),
}


def sql(names: str, query: str, recursive: str = "") -> str:
    """Query text behind the common table expressions it names (space separated) and their needs."""
    order: list[str] = []
    def need(n: str) -> None:
        for d in SQL[n][0]:
            need(d)
        if n not in order:
            order.append(n)
    for n in names.split():
        need(n)
    parts = [f"{n} AS ({SQL[n][1]})" for n in order]
    ctes = ",\n".join(parts + ([recursive] if recursive else []))
    # the column name is a keyword to some parsers
    return re.sub(r'(?<!")\bbinary\b(?!")', '"binary"', f"WITH RECURSIVE {ctes}\n{query}")
