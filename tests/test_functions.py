"""Scalar rules on hand-made rows."""
import math

from pyspark.sql import functions as F

from binlake.functions import addr as A, commands as C, instructions as I, names as N, outcomes as O, text as T, vectors as V


def one(spark, ddl, row, *cols):
    return spark.createDataFrame([row], ddl).select(*cols).first()


def column(spark, ddl, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {ddl}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_names_and_sizes(spark):
    names = ["sub_140001000", "j_strcpy", "Player$$Update", "SUB_1", None, ""]
    x = F.col("x")
    assert column(spark, "string", names, N.is_named(x, "display")) == [False, False, True, True, True, True]
    assert column(spark, "string", names, N.is_named(x, "graph")) == [False, True, True, True, False, True]
    assert column(spark, "string", names, N.is_named(x, "context")) == [False, True, True, False, False, False]
    assert column(spark, "string", names, N.is_noise(x)) == [True, False, False, True, True, True]
    assert column(spark, "bigint", [0, 512, 2048], N.size_label(x)) == ["", "512b", "2kb"]


def test_addresses(spark):
    x = F.col("x")
    assert column(spark, "string", ["0x1F", "31", "0xffffffffffffffff", "zz", None], A.parse(x)) == [31, 31, -1, None, None]
    assert column(spark, "bigint", [255, -1], A.hexify(x)) == ["0xff", "0x" + "f" * 16]
    assert column(spark, "string", ["1f", "10"], A.parse_loose(x)) == [31, 10]
    assert int(column(spark, "string", ["f" * 30], A.hex_decimal(x))[0]) == int("f" * 30, 16)


def test_literals(spark):
    code = 'a("%s", "hello", "x", "hello"); b(0xDEADBEEF, 0xFF, 12345, a-4321, 7); "wide \\n text"; 0xFFFFFFFFFFFFFFFFF'
    r = one(spark, "c string", (code,), T.strings(F.col("c")).alias("s"), T.constants(F.col("c")).alias("k"))
    assert r.s == ["hello", "wide \\n text"]
    assert [int(v) for v in r.k] == [0xDEADBEEF, 0xFFFFFFFFFFFFFFFFF, 12345, -4321]


def test_responses_and_prompts(spark):
    texts = ["NAME: do_thing\nREASON: stuff", "no name here", "x\n name:  ok_1 more\nNAME: later", "<think>a\nb</think> first\nsecond"]
    x = F.col("x")
    assert column(spark, "string", texts, T.response_name(x)) == ["do_thing", None, "ok_1", None]
    assert column(spark, "string", texts, T.response_reason(x))[0] == "stuff"
    assert column(spark, "string", texts, T.response_first_line(x))[3] == "first"
    d = F.array(F.struct(F.lit("0x1").alias("address"), F.lit("mov eax, 1").alias("text")))
    p = one(spark, "a int", (1,), T.prompt(d, F.array(F.lit("callee")), F.array().cast("array<string>")))[0]
    assert "Calls: callee\nCalled by: none" in p and " " * 15 + "0x1  mov eax, 1" in p


def test_inputs(spark):
    data = [b"", b"C%n%x", b"A" * 80, b"ZZZZ", bytes([0, 1, 2, 200, 255]), b"hello"]
    x = F.col("x")
    assert column(spark, "binary", data, O.input_family(x)) == ["empty", "format", "long", "repeat", "binary", "text"]
    tok = O.token(F.lit("stdin"), x)
    assert column(spark, "binary", data, O.token_payload(tok)) == [bytearray(d) for d in data]
    f = column(spark, "binary", data, O.input_features(F.lit("argv"), x))
    assert len(f[0]) == 17 and f[0].is_empty == 1.0 and f[3].single_byte == 1.0 and f[1].specifiers == 0.5
    assert f[2].entropy == 0.0 and math.isclose(f[4].high, 0.4) and f[2].longest_run == 1.0


def test_crash_kinds(spark):
    assert column(spark, "int", [139, 134, 0, 136, 135, 140], O.crash_kind(F.col("x"))) == ["segv", "abort", "", "fpe", "bus", "signal"]


def test_commands(spark):
    cmds = ["sudo A=1 /usr/bin/grep -n 'a b' x", "echo 'broken", "", "rm -rf / && frob *"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cmds)], "i int, c string").withColumn("t", C.tokens("c"))
    rows = df.orderBy("i").select(C.primary_program(F.col("t")).alias("p"), C.features(F.col("c"), F.col("t")).alias("f")).collect()
    assert [r.p for r in rows] == ["grep", "echo", "", "rm"]
    assert all(len(r.f) == 32 for r in rows) and rows[3].f[29] == 1.0 and rows[3].f[27] == 1.0 and rows[3].f[23] == 1.0


def test_fingerprint_values(spark):
    code = 'if (x) return malloc(4096); else if (y) print("hello", "world");'
    dis = F.array(*[F.struct(F.lit("").alias("address"), F.lit(t).alias("text")) for t in ("mov a, b", "SUB a", "ret", "???", "ldr q0")])
    c = F.col("c")
    v = one(spark, "c string", (code,), V.assemble(V.mnemonic_histogram(dis), F.lit(3), F.lit(0), V.log_scale(F.lit(128)),
                                                   V.text_part(c, T.strings(c), T.constants(c))))[0]
    assert len(v) == V.DIM == 104
    assert v[:7] == [0.25, 0, 0, 0, 0.25, 0.25, 0.25]
    assert math.isclose(v[7], math.log1p(3) / math.log1p(10000)) and v[8] == 0.0
    import hashlib
    import re
    words = [w.lower() for w in re.findall(r"[a-zA-Z_]\w*", code)]
    assert all(math.isclose(a, words.count(k.lower()) / len(words)) for a, k in zip(v[10:88], V.KEYWORDS))
    want = [0.0] * 8
    for s in ("hello", "world"):
        want[int(hashlib.md5(s.encode()).hexdigest(), 16) % 8] += 0.5
    assert v[88:96] == want and sum(v[96:]) == 1.0


def test_complexity_and_symbols(spark):
    code = "int f(Foo *p) {\n  A::b(p);\n  if (x) g_h(1);\n}"
    c = F.col("c")
    r = one(spark, "c string", (code,), T.complexity(c).alias("l"), T.eligible(c).alias("e"), T.symbols(c).alias("s"),
            T.external_calls(F.lit("Foo(1); bar(2); Foo (3); _X(1)")).alias("x"))
    assert r.l == "simple" and r.e and r.s == ["A::b", "Foo", "g_h"] and r.x == ["Foo"]


def test_instruction_risk(spark):
    risk = I.context_risk(F.lit(None).cast("double"), F.lit("movsb"), F.lit("[rsp]"))
    assert one(spark, "a int", (1,), risk)[0] == 1.0


def test_sql_names(spark):
    from binlake.functions import sqlnames
    assert len(sqlnames.register(spark)) == 8
    r = spark.sql("""SELECT round(vector_cosine(array(1D, 0D), array(1D, 1D)), 6) c, vector_cosine(array(0D), array(1D)) z, vector_l2(array(0D, 3D), array(4D, 0D)) d,
        addr_hex(255) h, is_named('sub_1') n, code_strings('f("%d", "abc", "abc")') s, text_entropy('abab') e, command_words("a 'b c'") w""").first()
    assert (r.c, r.z, r.d, r.h, r.n, r.s, r.e, r.w) == (0.707107, 0.0, 5.0, "0xff", False, ["abc"], 1.0, ["a", "b c"])
