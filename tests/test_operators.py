"""Operators against brute force, under tiny blocks and hot keys."""
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from binlake.operators import annotate, context, graph, learn, match, runs, scan, similarity
from binlake.plans import blocks
from binlake.sources import corpus, export, tables as readers
from binlake.streaming import stateful, stream


def test_blocked_windows_match_plain_ones(spark):
    """One key holds most rows; blocks of 7 rows must give the plain window's results."""
    rnd = random.Random(1)
    rows = [("hot" if i % 10 else f"k{i}", i * 3, rnd.random()) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, step bigint, v double")
    idx = blocks.dense_index(df, ["k"], "step", block=7)
    w = Window.partitionBy("k").orderBy("step")
    both = idx.withColumn("want", F.row_number().over(w))
    assert both.filter("idx <> want").count() == 0 and both.count() == 400
    halo = blocks.with_lookback(idx, ["k"], "idx", 5, block=7)
    near = halo.withColumn("s", F.sum("v").over(blocks.trailing(["k"], "idx", -5))).filter("_own")
    want = {(r.k, r.step): r.s for r in df.withColumn("s", F.sum("v").over(w.rowsBetween(-5, 0))).collect()}
    got = {(r.k, r.step): r.s for r in near.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_clamped_scan_is_block_independent(spark):
    rnd = random.Random(2)
    rows = [("hot", i, rnd.choice([0.0, 0.5, 0.99]), rnd.random() - 0.4, -0.2, 0.6) for i in range(1, 101)]
    df = spark.createDataFrame(rows, "k string, idx bigint, a double, b double, lo double, hi double")
    t, want = 0.1, []
    for _, _, a, b, lo, hi in rows:
        t = min(max(a * t + b, lo), hi)
        want.append(t)
    got = [r.after for r in blocks.clamped_scan(df, ["k"], "idx", 0.1, block=9).orderBy("idx").collect()]
    assert np.allclose(got, want, atol=1e-12)


def bfs(edges, names, start, cap, best, depth):
    """Breadth-first search with the over-fetch stop, neighbours by address."""
    seen, queue, out = {start}, [(start, 0)], []
    while queue and len(out) < cap:
        at, hop = queue.pop(0)
        if hop >= depth:
            continue
        for n in sorted(edges.get(at, ())):
            if n in seen:
                continue
            seen.add(n)
            named = bool(names.get(n)) and not names[n].lower().startswith("sub_")
            out.append((n, hop + 1, named))
            if named:
                queue.append((n, hop + 1))
    return sorted(out, key=lambda x: (not x[2], x[1]))[:best]


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_neighbors_match_search(spark, depth):
    rnd = random.Random(depth)
    n = 60
    names = {i: rnd.choice([f"sub_{i:x}", f"fn{i}", None, "SUB_x"]) for i in range(n)}
    pairs = {(rnd.randrange(n), rnd.randrange(n)) for _ in range(260)} | {(0, i) for i in range(50)} | {(i, 0) for i in range(5, 9)}
    fns = spark.createDataFrame([("b", i, names[i]) for i in range(n)], "binary string, addr bigint, name string")
    calls = spark.createDataFrame([("b", a, b) for a, b in pairs], "binary string, caller_addr bigint, callee_addr bigint")
    starts = fns.select("binary", F.col("addr").alias("start"))
    edges = {}
    for a, b in pairs:
        edges.setdefault(a, set()).add(b)
    rows = context.neighbors(starts, calls, fns, "callees", depth, 4).collect()
    for s in range(n):
        got = [(r.addr, r.hops, r.is_named) for r in sorted((r for r in rows if r.start == s), key=lambda r: r.rank)]
        assert got == bfs(edges, names, s, 12, 4, depth), s


def test_trace_chain_depths(spark):
    edges = [(i, i + 1) for i in range(8)] + [(8, 0)]
    calls = spark.createDataFrame([("b", a, b) for a, b in edges], "binary string, caller_addr bigint, callee_addr bigint")
    start = spark.createDataFrame([("b", 0)], "binary string, start bigint")
    for depth in (1, 3, 9, 12):
        got = sorted(r.addr for r in graph.trace_chain(start, calls, depth).collect())
        assert got == sorted((i % 9) for i in range(1, min(depth, 9) + 1))


def test_reach_of_many_starts(spark):
    """All functions as starts, around a hub that all call: as brute force finds, in few rows per hop."""
    import random
    r = random.Random(8)
    n = 300
    calls = {(k, 0) for k in range(1, n)} | {(0, k) for k in range(1, 40)} | {(r.randrange(n), r.randrange(n)) for _ in range(200)} | {(5, 5)}
    df = spark.createDataFrame([("b", a, c) for a, c in calls] + [("other", 1, 2)], "binary string, caller_addr bigint, callee_addr bigint")
    starts = spark.createDataFrame([("b", k) for k in range(n)] * 2 + [("other", 1), ("other", 2)], "binary string, start bigint")
    for depth in (1, 2, 3, 5):
        want = set()
        for s in range(n):
            front = {s}
            for _ in range(depth):
                front = {c for a, c in calls if a in front}
                want |= {("b", s, c) for c in front}
        got = [tuple(x) for x in graph.trace_chain(starts, df, depth).filter("binary = 'b'").collect()]
        assert len(got) == len(set(got)) and set(got) == want
        counts = {(x.binary, x.start): x.reach for x in graph.reach_counts(starts, df, depth).collect()}
        assert counts.pop(("other", 1)) == 1 and counts.pop(("other", 2)) == 0
        assert counts == {("b", s): sum(x[1] == s for x in want) for s in range(n)}
        rows = graph._reach_sets(graph._packed_starts(starts), df, depth).count()
        assert rows <= (len({c for _, c in calls}) + 1) * (n // 64 + 1)


def test_range_join_of_any_lengths(spark):
    """One giant interval, a million-fold smaller ones inside it, overlaps, negative addresses and empty intervals."""
    from binlake.plans.ranges import range_join
    r = random.Random(6)
    spans = [("a", -2**40, 2**60, -1), ("a", 10, 10, -2), ("a", 20, 5, -3), ("b", 0, 1, -4)]
    spans += [("a", 4096 * k, 4096 * k + r.choice([1, 2, 3, 64, 4095, 4096, 9000]), k) for k in range(400)]
    points = [("a", r.choice([r.randrange(400 * 4096), 4096 * r.randrange(400), -5, 2**59, 2**60, -2**41])) for _ in range(500)] + [("b", 0), ("b", 1), ("c", 0)]
    got = range_join(spark.createDataFrame(points, "binary string, p bigint").withColumn("n", F.monotonically_increasing_id()),
                     spark.createDataFrame(spans, "binary string, start bigint, end bigint, id int"), ["binary"], "p")
    want = sorted((b, p, i) for b, p in points for c, s, e, i in spans if b == c and s <= p < e)
    assert sorted((x.binary, x.p, x.id) for x in got.collect()) == want
    listed = spark.createDataFrame(spans, "binary string, start bigint, end bigint, id int")
    plan = range_join(spark.createDataFrame(points, "binary string, p bigint"), listed, ["binary"], "p")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_blocks_of_sparse_steps(spark):
    """A key with most rows and random 64-bit steps: sums as brute force, no block with more than a few shares of the rows."""
    r = random.Random(4)
    rows = [("hot" if k % 3 else f"k{k % 40}", r.randrange(-2**62, 2**62), r.randrange(10)) for k in range(4000)]
    df = spark.createDataFrame(rows, "key string, step bigint, x bigint")
    placed = blocks.with_ranged_block(df, ["key"], "step", 40)
    assert placed.groupBy("_blk").count().agg(F.max("count")).first()[0] < 400
    sums, want = {}, set()
    for key, step, x in sorted(rows):
        sums[key] = sums.get(key, 0) + x
        want.add((key, step, sums[key]))
    got = blocks.running_sums(df, ["key"], "step", {"s": F.col("x")}, sparse=True)
    assert {(x.key, x.step, x.s) for x in got.collect()} == want and got.count() == len(rows)


@pytest.mark.parametrize("block", [3, 7, 256])
def test_clamped_scan(spark, block):
    """A hot key and small ones through several levels of blocks, without Python in the plan."""
    r = random.Random(block)
    rows = [(key, i + 1, r.choice([0.0, 0.5, 0.9, 1.0]), r.uniform(-1, 1), *sorted([r.uniform(-2, 1), r.uniform(0, 2)]), f"p{i}")
            for key, n in (("hot", 150), ("one", 1), ("few", 9)) for i in range(n)]
    df = spark.createDataFrame(rows, "key string, idx bigint, a double, b double, lo double, hi double, note string").repartition(3)
    out = blocks.clamped_scan(df, ["key"], "idx", 0.25, block)
    assert out.columns == ["key", "idx", "note", "before", "after"]
    got = {(x.key, x.idx): x for x in out.collect()}
    assert len(got) == len(rows)
    t = 0.25
    for key, i, a, b, lo, hi, note in rows:
        t = 0.25 if i == 1 else t
        assert got[key, i].note == note and got[key, i].before == pytest.approx(t, abs=1e-12)
        t = min(max(a * t + b, lo), hi)
        assert got[key, i].after == pytest.approx(t, abs=1e-12)
    plan = out._jdf.queryExecution().toString()
    assert "Arrow" not in plan and "Python" not in plan and "Pandas" not in plan


def test_files_by_ranges(spark, tmp_path):
    """Files in chunks of any size, headers, slices and section tables; contents never pass an exchange."""
    from binlake.sources import byteranges
    e64, code = elf()
    nso = b"NSO0" + bytes(12) + le(256, 4) + le(0, 4) + le(8, 4) + bytes(4) + le(264, 4) + le(16, 4) + le(4, 4) + bytes(4) + le(268, 4) + le(32, 4) + le(2, 4) + le(5, 4)
    nso += bytes(256 - len(nso)) + bytes(range(14))
    packed = nso[:12] + b"\1" + nso[13:]
    noise = random.Random(1).randbytes(5000) + b"hello printable world" * 30
    png = b"xx\x89PNG\r\n\x1a\n" + bytes(60) + b"IEND\xaeB`\x82tail"
    files = {"e64": e64, "sub/pe.exe": pe(), "nso": nso, "packed": packed, "mz": b"MZ" + bytes(100), "noise": noise, "png": png, "empty": b""}
    blobs = spark.createDataFrame(list(files.items()), "path string, content binary").withColumn("base", F.lit(4096).cast("bigint"))
    assert byteranges.store(blobs, str(tmp_path)).count() == len(files)
    known = corpus.described(spark, str(tmp_path))
    name = F.substring("path", len(str(tmp_path)) + 2, 100)
    assert {r.n: (r.format, r.length) for r in known.select(name.alias("n"), "format", "length").collect()} == {
        k: (f, len(files[k])) for k, f in (("e64", "ELF"), ("sub/pe.exe", "PE"), ("nso", "NSO"), ("packed", "NSO"), ("mz", "generic"), ("noise", "generic"), ("png", "generic"))}
    secs = corpus.file_sections(known)
    assert sorted(map(tuple, secs.withColumn("path", name).collect())) == sorted(map(tuple, corpus.sections(blobs).collect()))
    assert [(r.name, r.va, r.raw_off, r.raw_size, r.vsize, r.is_code) for r in secs.filter(name == "nso").collect()] == [
        (".text", 0, 256, 8, 8, True), (".rodata", 16, 264, 4, 4, False), (".data", 32, 268, 2, 2, False), (".bss", 34, 0, 0, 5, False)]
    want = spark.createDataFrame([(f"{tmp_path}/e64", 0x1004, 0x5000), (f"{tmp_path}/sub/pe.exe", 0x140001010, 0x140001020)], "path string, va_start bigint, va_end bigint")
    read = corpus.read_file_ranges(secs, want)
    assert {bytes(r.bytes) for r in read.collect()} == {code[4:], bytes(range(16, 32))}
    for size in (16, 1000, 1 << 20):
        cut = lambda **around: byteranges.chunks(spark, str(tmp_path), F.lit(4096), size, **around).withColumn("path", name)  # noqa: E731, B023
        pairs = [(scan.x86_starts(cut(before=1, after=3)), scan.x86_prologues(blobs)), (scan.strings_of(cut()), scan.strings(blobs)),
                 (scan.carve_chunks(cut(after=scan.ASSET_BYTES)).drop("prefix"), scan.carve(blobs, None, max_blob=None).drop("prefix"))]
        for got, want in pairs:
            assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect())) and got.count() > 0
    pieces = spark.createDataFrame([(f"{tmp_path}/png", [(2, 4), (0, 2), (70, 500), (9999, 5)]), (f"{tmp_path}/png", None)], "path string, pieces array<struct<off:bigint,n:bigint>>")
    assert [r.data and bytes(r.data) for r in byteranges.slices(pieces).collect()] == [png[2:6] + png[:2] + png[70:], None]
    for df in (known, secs, byteranges.slices(pieces)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_packed_files(spark, tmp_path, monkeypatch):
    """Members of packs are listed, described, cut and sliced like files; a pack that broke off, repeated names and nested packs."""
    from binlake.sources import byteranges
    monkeypatch.setattr(byteranges, "CHUNK", 8)
    e64, _ = elf()
    files = {"img/1": e64, "exe/2.exe": pe(), "noise": random.Random(1).randbytes(3000), "sh/3": b"#!x", ".hidden": b"h", "empty": b"", "x/_y": b"y"}
    blobs = spark.createDataFrame([*files.items(), *files.items(), (None, b"MZ no name")], "path string, content binary").repartition(3)
    root = tmp_path / "packs"
    for folder, rows in ((f"file:{root}", blobs), (str(root / "below"), spark.createDataFrame([("img/1", e64[:40])], blobs.schema))):
        assert byteranges.pack(rows, folder, 3).count() == rows.count()
    assert len(list(root.glob("_pack-*.index"))) > 4
    (root / "_pack-9-9-9.data").write_bytes(b"broke off")
    (root / "plain").write_bytes(b"MZ plain")
    files |= {"None": b"MZ no name", "below/img/1": e64[:40], "plain": b"MZ plain"}
    name = F.regexp_replace(F.regexp_replace("path", f"^{root}/", ""), "_pack-.*?[.]data@[0-9]+[+][0-9]+/", "")
    seen = {k: v for k, v in files.items() if v and k.rpartition("/")[2][0] not in "._"}
    def listing(**only):
        return sorted((r.n, r.length) for r in byteranges.listed(spark, str(root), **only).select(name.alias("n"), "length").collect())
    assert listing() == sorted((k, len(v)) for k, v in seen.items())
    assert listing(glob="*.exe") == [("exe/2.exe", len(pe()))]
    assert listing(recursive=False) == [("None", 10), ("noise", 3000), ("plain", 8)]
    plain = tmp_path / "plain"
    byteranges.store(spark.createDataFrame([*seen.items()], blobs.schema), str(plain)).count()
    def told(folder):
        known = corpus.described(spark, str(folder))
        return sorted(map(str, known.withColumn("path", F.regexp_replace(name, f"^{plain}/", "")).collect()))
    assert told(root) == told(plain)
    pieces = {k: (bytes(r[1]), r[0]) for k, r in ((r.n, (r.path, r.data)) for r in byteranges.load(spark, str(root), chunk=1 << 20).select(name.alias("n"), "path", "data").collect())}
    assert {k: v for k, (v, _) in pieces.items()} == seen
    cut = byteranges.load(spark, str(root), chunk=7, before=2, after=3).withColumn("n", name)
    assert all(bytes(r.data) == seen[r.n][r.off - r.lead:r.off + r.own + 3] and r.lead == min(2, r.off) for r in cut.collect())
    assert cut.groupBy("n").agg(F.sum("own").alias("own")).filter("n = 'noise'").first().own == 3000
    wanted = spark.createDataFrame([(pieces["noise"][1], [(2990, 50), (0, 2), (3000, 1)])], "path string, pieces array<struct<off:bigint,n:bigint>>")
    assert [bytes(r.data) for r in byteranges.slices(wanted).collect()] == [files["noise"][2990:] + files["noise"][:2]]


@pytest.mark.parametrize("query, count, kinds, per", [("files_sniff", 1500, 5, ("format", "kind")), ("files_sections", 2100, 7, ("name",))])
def test_stored_files_are_few(spark, tmp_path, monkeypatch, query, count, kinds, per):
    """Many small files take few of the file system's own: it has a fixed number of them."""
    from binlake.plans.catalog import registry
    from binlake.plans.relations import Tables
    made, stored = [], Tables.stored
    monkeypatch.setattr(Tables, "stored", lambda *a, **b: made.append(stored(*a, **b)) or made[-1])
    part = spark.range(100, 30100, 100).selectExpr("id AS p_partkey", "concat('part ', id) AS p_name", "'b' AS p_brand", "'t' AS p_type", "CAST(id / 100 % 49 + 2 AS INT) AS p_size", "1.0D AS p_retailprice")
    part.write.parquet(str(tmp_path / "part.parquet"))
    rows = registry()[query][0](spark, str(tmp_path)).collect()
    assert len(rows) == len({(r.path, *(r[c] for c in per)) for r in rows}) == count and len({tuple(r[c] for c in per) for r in rows}) == kinds
    assert len(list(Path(made[0].removeprefix("file:")).rglob("*"))) < 100


def test_files_are_listed_by_tasks(spark, tmp_path):
    """No scan that plans files or ranges on the driver; nested and hidden files, globs, a folder's own files alone."""
    from binlake.sources import byteranges
    for name, data in (("a.bin", b"12345"), ("x/b.bin", b"678"), ("x/y/c.txt", b"9"), ("x/.hidden", b"h"), ("_meta", b"m"), ("x/empty", b"")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    def names(df):
        return sorted((r.path[len(str(tmp_path)) + 1:], r.length) for r in df.collect())
    assert names(byteranges.listed(spark, str(tmp_path))) == [("a.bin", 5), ("x/b.bin", 3), ("x/y/c.txt", 1)]
    assert names(byteranges.listed(spark, str(tmp_path), "*.bin")) == [("a.bin", 5), ("x/b.bin", 3)]
    assert names(byteranges.listed(spark, str(tmp_path), recursive=False)) == [("a.bin", 5)]
    cut = byteranges.load(spark, str(tmp_path), chunk=2, before=1)
    assert sorted((r.off, r.lead, r.own, bytes(r.data)) for r in cut.collect() if r.length == 5) == [(0, 0, 2, b"12"), (2, 1, 2, b"234"), (4, 1, 1, b"45")]
    seeds = corpus.read_seeds(spark, str(tmp_path / "x"), None, None)
    assert [(r.path, bytes(r.payload)) for r in seeds.collect()] == [(f"file:{tmp_path}/x/b.bin", b"678")]
    for df in (cut, corpus.described(spark, str(tmp_path)), seeds):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BatchScan" not in plan and "FileScan" not in plan


def test_table_functions(spark):
    from binlake.functions import tablefns
    tablefns.register(spark)
    rows = [("e64", elf()[0]), ("e32", elf(40, False)[0]), ("pe", pe()), ("broken", b"\x7fELF\x02"), ("mz", b"MZ"), ("none", None), ("text", b"ab\0long enough\1")]
    df = spark.createDataFrame(rows, "path string, content binary")
    got = spark.sql("SELECT d.path, s.* FROM {d} d, LATERAL binary_sections(d.content) s", d=df)
    assert sorted(map(tuple, got.collect())) == sorted((r.path, r.name, r.va, r.raw_off, r.raw_size, r.vsize, r.is_code) for r in corpus.sections(df.filter("path IN ('e64', 'e32', 'pe')")).collect())
    text = spark.sql("SELECT s.addr, s.text FROM {d} d, LATERAL binary_strings(d.content, 100, 5) s WHERE d.path = 'text'", d=df).collect()
    assert [tuple(r) for r in text] == [(103, "long enough")]
    asset = spark.createDataFrame([(b"BM" + bytes(80),)], "content binary")
    assert spark.sql("SELECT a.name, a.offset, a.size FROM {d} d, LATERAL binary_assets(d.content, 32) a", d=asset).collect() == [("bmp", 0, 82)]


def test_context_block_text(spark):
    fns = spark.createDataFrame([("b", 1, "main", 'log("ready"); x = 4660; y = 0x1F4;'), ("b", 2, "helper", None), ("b", 3, "sub_3", None)],
                                "binary string, addr bigint, name string, pseudocode string")
    calls = spark.createDataFrame([("b", 1, 2), ("b", 1, 3)], "binary string, caller_addr bigint, callee_addr bigint")
    known = spark.createDataFrame([("b", 1, "Known references:\n  k")], "binary string, addr bigint, knowledge string")
    out = {r.start: r.block for r in context.block(context.gather(fns, calls, knowledge_block=known)).collect()}
    assert out[1] == ('Context:\nCalls: helper\nAlso calls: 1 unnamed functions\nReferences strings: "ready"\n'
                      "Key constants: 0x1F4, 0x1234\nKnown references:\n  k\n+1 more unnamed callees")
    assert out[2] == "Context:\nCalled by: main"


@pytest.mark.parametrize("block_rows,pivots", [(7, 5), (2048, 64)])
def test_topk_matches_brute_force(spark, block_rows, pivots):
    """Clustered vectors (so cells are skipped), one binary with most rows, zero vectors, ties."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    rows = []
    for i in range(150):
        v = centres[i % 6] + rng.normal(scale=0.05, size=8) if i % 29 else np.zeros(8)
        rows.append(("big" if i % 3 else f"b{i % 4}", i, [float(x) for x in (rows[-1][2] if i % 17 == 1 else v)]))
    df = spark.createDataFrame(rows, "binary string, addr bigint, vector array<double>")
    got = {}
    for r in similarity.topk(df, df, 4, pivots=pivots, block_rows=block_rows).collect():
        got.setdefault((r.q_binary, r.q_addr), []).append((r.rank, r.binary, r.addr, r.similarity))
    for qb, qa, qv in rows:
        want = []
        for b, a, v in rows:
            if b != qb:
                n = np.linalg.norm(qv) * np.linalg.norm(v)
                want.append((-round(float(np.dot(qv, v) / n) if n else 0.0, 6) + 0.0, b, a))
        want = [(b, a, -s) for s, b, a in sorted(want) if -s >= 0][:4]
        have = [(b, a, s) for _, b, a, s in sorted(got.get((qb, qa), []))]
        assert [x[:2] for x in have] == [x[:2] for x in want] and np.allclose([x[2] for x in have], [x[2] for x in want])


def _clusters(spark, n, dim=6, seed=1):
    """About the root of n clusters, as many rows in each, and one vector that a third of the rows share."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(int(n ** 0.5), dim))
    rows = [(f"b{i % 7}", i, [float(x) for x in (centres[0] if i % 3 == 0 else centres[i % len(centres)] + rng.normal(scale=0.01, size=dim))]) for i in range(n)]
    return spark.createDataFrame(rows, "binary string, addr bigint, vector array<double>")


def test_topk_copies_grow_slower_than_pairs(spark):
    """Vectors moved to blocks: far from n * n, and growing with a power well below two."""
    moved = []
    for n in (600, 2400):
        df, counted = _clusters(spark, n), {}
        assert similarity.topk(df, df, 3, pivots=int(n ** 0.5), counted=counted, block_rows=32).count() == 3 * n
        moved.append(counted["copied"])
        assert counted["rounds"] <= 8
    assert moved[1] < 2400 * 2400 / 40 and moved[1] < moved[0] * 4 ** 1.6


def test_approximate_topk(spark):
    df = _clusters(spark, 1500)
    found = similarity.approximate_topk(df, df, 5, bucket_rows=64, block_rows=100)
    assert found.groupBy("q_addr").agg(F.count("*").alias("n"), F.max("rank").alias("r")).filter("n <> r OR n > 5").isEmpty()
    row = similarity.search_recall(found, df, df, every=10, k=5).first()
    assert row.wanted == 750 and row.recall >= 0.9
    few = similarity.search_recall(similarity.approximate_topk(df, df, 5, tables=1, probes=0, bucket_rows=8), df, df, every=10, k=5).first()
    assert few.recall < row.recall and few.found == round(few.recall * few.wanted)


def _series(spark, values):
    return spark.createDataFrame([("f", i, float(v)) for i, v in enumerate(values)], "family string, step bigint, error double")


@pytest.mark.parametrize("values,label", [
    ([0.30 + 0.001 * (i % 2) for i in range(40)], "underfit"), ([0.02 if i % 2 else 0.60 for i in range(40)], "noisy"),
    ([0.5 - 0.01 * i for i in range(40)], "learning"), ([0.005] * 40, "mastered"), ([0.3] * 39, "exploring")])
def test_competence_labels(spark, values, label):
    df = _series(spark, values)
    state = learn.label(learn.competence(df, ["family"], window=40))
    assert state.first().label == label
    last = learn.competence_history(df, ["family"], window=40).orderBy(F.desc("step")).first()
    assert abs(last.mean_error - state.first().mean_error) < 1e-12 and last.noisy == state.first().noisy


def test_surprise_threshold(spark):
    df = _series(spark, [0.4] + [0.01] * 200)
    rows = learn.surprise(df, ["family"]).orderBy("step").collect()
    assert rows[0].surprising and not rows[-1].surprising and rows[-1].threshold_after < 0.1
    assert rows[48].threshold_after == 0.1 and rows[49].threshold_after != 0.1


def test_stall_reports(spark):
    noisy = learn.competence(_series(spark, [0.02 if i % 2 else 0.60 for i in range(40)]), ["family"], window=40).withColumn("c", F.lit(1))
    assert learn.policy(noisy, ["c"], window=40).first().stall_report.endswith("unlearnable noise ['f']")
    stuck = learn.competence(_series(spark, [0.3] * 40), ["family"], window=40).withColumn("c", F.lit(1))
    r = learn.policy(stuck, ["c"], window=40).first()
    assert r.grow_for == "f" and r.stall_report is None
    assert learn.policy(stuck, ["c"], window=40, since_growth=5).first().grow_for is None


def test_exec_records(spark):
    good = "===RC:139\n===COV\n0x111\n0x222\n0x111\n===OUT\nboom\n"
    df = spark.createDataFrame([(good,), ("nothing",)], "record string")
    a, b = runs.parse_exec(df).collect()
    assert (a.exit_code, a.cov_ids, a.stdout) == (139, ["0x111", "0x222"], "boom") and (b.exit_code, b.cov_ids, b.stdout) == (0, [], "")


def test_annotations(spark):
    fns = spark.createDataFrame([("b", 1, "main")], "binary string, addr bigint, name string")
    facts = spark.createDataFrame([("b", "main", "reachable", "true"), ("b", "main", "dyn_x", "5"), ("b", "gone", "x", "1")],
                                  "binary string, name string, key string, value string")
    rows = {r.key: r.value for r in annotate.write(fns, facts, by="name").collect()}
    assert set(rows) == {"dyn_reachable", "dyn_x", "dyn_updated"}
    with pytest.raises(ValueError):
        annotate.write(fns, facts, by="id")


def le(v, n):
    return int(v).to_bytes(n, "little")


def elf(machine=62, bits64=True):
    code = bytes(range(32))
    if bits64:
        head = b"\x7fELF\x02\x01" + bytes(10) + le(2, 2) + le(machine, 2) + bytes(20) + le(64, 8) + bytes(10) + le(64, 2) + le(3, 2) + bytes(2)
        sec = lambda t, f, a, o, s: bytes(4) + le(t, 4) + le(f, 8) + le(a, 8) + le(o, 8) + le(s, 8) + bytes(24)
        off = 64 + 3 * 64
    else:
        head = b"\x7fELF\x01\x01" + bytes(10) + le(2, 2) + le(machine, 2) + bytes(12) + le(52, 4) + bytes(10) + le(40, 2) + le(3, 2) + bytes(2)
        sec = lambda t, f, a, o, s: bytes(4) + le(t, 4) + le(f, 4) + le(a, 4) + le(o, 4) + le(s, 4) + bytes(16)
        off = 52 + 3 * 40
    return head + sec(0, 0, 0, 0, 0) + sec(1, 6, 0x1000, off, 32) + sec(8, 3, 0x2000, 0, 0x40) + code, code


def pe():
    b = bytearray(4096)
    b[:2], b[0x3C:0x40], b[0x100:0x104] = b"MZ", le(0x100, 4), b"PE\0\0"
    b[0x104:0x106], b[0x106:0x108], b[0x114:0x116] = le(0x8664, 2), le(1, 2), le(240, 2)
    b[0x118:0x11A], b[0x130:0x138] = le(0x20B, 2), le(0x140000000, 8)
    s = 0x118 + 240
    b[s:s + 5] = b".text"
    b[s + 8:s + 24] = le(0x1000, 4) + le(0x1000, 4) + le(0x200, 4) + le(0x400, 4)
    b[s + 36:s + 40] = le(0x20, 4)
    b[0x400:0x600] = bytes(range(256)) * 2
    return bytes(b)


def test_formats(spark):
    e64, code = elf()
    e32, _ = elf(40, False)
    files = {"e64": e64, "e32": e32, "pe": pe(), "nso": b"NSO0" + bytes(60), "bin": b"\x01\x02", "mz": b"MZ" + bytes(100)}
    df = spark.createDataFrame(list(files.items()), "path string, content binary")
    fmt = {r.path: (r.format, r.arch) for r in corpus.sniff(df).select("path", "format", corpus.arch().alias("arch")).collect()}
    assert {k: v[0] for k, v in fmt.items()} == {"e64": "ELF", "e32": "ELF", "pe": "PE", "nso": "NSO", "bin": "generic", "mz": "generic"}
    assert fmt["e64"][1] == "x86_64" and fmt["e32"][1] == "arm"
    secs = corpus.sections(df)
    got = sorted((r.path, r.name, r.va, r.raw_size, r.vsize, r.is_code) for r in secs.collect())
    assert got == [("e32", "sec1", 0x1000, 32, 32, True), ("e32", "sec2", 0x2000, 0, 0x40, False), ("e64", "sec1", 0x1000, 32, 32, True),
                   ("e64", "sec2", 0x2000, 0, 0x40, False), ("pe", ".text", 0x1000, 0x200, 0x1000, True)]
    rng = {r.path: (r.text_start, r.text_end) for r in corpus.code_range(secs).collect()}
    assert rng["pe"] == (0x140001000, 0x140002000)
    want = spark.createDataFrame([("e64", 0x1004, 0x5000), ("pe", 0x140001010, 0x140001020)], "path string, va_start bigint, va_end bigint")
    raw = {r.path: bytes(r.bytes) for r in corpus.read_ranges(df, secs, want).collect()}
    assert raw == {"e64": code[4:], "pe": bytes(range(16, 32))}


def test_registered_format(spark):
    from pyspark.sql import functions as fn
    saved = dict(corpus._FORMATS)
    try:
        corpus.register_format("WASM", lambda: fn.substring("content", 1, 4) == fn.lit(b"\0asm"), first=True)
        df = spark.createDataFrame([("w", b"\0asm1234")], "path string, content binary")
        assert corpus.sniff(df).first().format == "WASM"
    finally:
        corpus._FORMATS.clear()
        corpus._FORMATS.update(saved)


def test_scans_do_not_depend_on_chunks(spark):
    rnd = random.Random(5)
    data = bytes(rnd.choice(b"\x55\x48\x83\xec\x89\xe5\x81\xc3\xcc\x90AbC d\x00") for _ in range(3000)) + b"tail text"
    df = spark.createDataFrame([("p", 0x1000, data), ("q", 0x1001, data[1:] + b"\0"), ("r", 8, b"U"), ("s", 0, b"")], "path string, base bigint, content binary")
    seqs = (b"\x48\x83\xec", b"\x55\x48\x89\xe5", b"\x48\x81\xec")
    def starts(raw, base):
        return {base + i for i in range(len(raw)) if any(raw.startswith(s, i) for s in seqs) or (
            raw[i] == 0x55 and (i == 0 or raw[i - 1] in scan.BOUNDARY or (base + i) % 16 == 0))}
    import re
    for size in (64, 100, 4096):
        got = {}
        for r in scan.x86_prologues(df, size).collect():
            got.setdefault(r.path, set()).add(r.addr)
        assert got["p"] == starts(data, 0x1000) and got["r"] == {8}
        text = {(r.path, r.addr): r.text for r in scan.strings(df, size).collect()}
        want = {("p", 0x1000 + m.start()): m.group().decode() for m in re.finditer(rb"[\x20-\x7e]{5,}", data)}
        assert {k: v for k, v in text.items() if k[0] == "p"} == want
    a = {tuple(r) for r in scan.arm64_words(df, 64).collect()}
    assert a == {tuple(r) for r in scan.arm64_words(df, 1 << 20).collect()}


def test_carving(spark):
    png = b"\x89PNG\r\n\x1a\n" + bytes(range(40)) + b"IEND" + b"crc!"
    jpg = b"\xff\xd8\xff" + bytes(50) + b"\xff\xd9"
    data = b"junk" + png + b"pad" + jpg + png + b"BM" + b"x" * 10
    df = spark.createDataFrame([("p", 0, data)], "path string, base bigint, content binary")
    got = scan.carved_bytes(df, scan.carve(df)).orderBy("pos").collect()
    assert [(r.name, bytes(r.payload)) for r in got] == [("png", png), ("jpg", jpg)]
    many = b"".join(b"BM" + i.to_bytes(2, "big") + b"y" * 70 for i in range(30))
    df = spark.createDataFrame([("p", 0, many)], "path string, base bigint, content binary")
    assert [r.offset for r in scan.carve(df).orderBy("pos").collect()] == [i * 74 for i in range(24)]


def test_carve_query_without_limits(spark):
    from binlake.plans.catalog import corpus as queries
    raw = b"".join(b"\x89PNG\r\n\x1a\n" + bytes([i]) * 60 for i in range(30))
    tables = type("Tables", (), {"blobs": lambda self: spark.createDataFrame([("p", bytearray(raw))], "path string, content binary")})()
    assert queries.scan_carve_png(tables).count() == 30 and scan.carve(tables.blobs(), None, max_blob=len(raw) - 1).count() == 0


def test_shard_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"shard_start": 0, "shard_end": 100, "elapsed_s": 1.0, "funcs": [{"ea": 17, "name": "sub_11", "size": 4}]}')
    (tmp_path / "b.json").write_text("{broken")
    good, bad = readers.read_shards(spark, str(tmp_path))
    assert good.count() == 1 and bad.count() == 1
    row = scan.merge_shards(good.withColumn("binary", F.lit("b"))).first()
    assert (row.ea, row.name, row.size, row.thumb) == (16, "sub_11", 4, True)
    (tmp_path / "sym.json").write_text('{"A::b": {"namespace": "A", "func_name": "b", "size": 8}}')
    assert readers.read_symbols(spark, str(tmp_path / "sym.json")).first().size == 8


def test_exports(spark, tmp_path):
    fns = spark.createDataFrame([("b", 4096, 'ma"in', 16), ("b", 8192, "sub_2000", 8)], "binary string, addr bigint, name string, size bigint")
    export.export(fns, str(tmp_path / "idc"), "idc", named_only=True)
    text = "".join(p.read_text() for p in sorted((tmp_path / "idc").glob("part-*.txt")))
    assert text.splitlines()[-2:] == ['  set_name(0x1000, "ma\\"in", SN_NOWARN);', "}"]
    export.export(fns, str(tmp_path / "sym"), "symbols")
    text = "".join(p.read_text() for p in sorted((tmp_path / "sym").glob("part-*.txt")))
    assert text.splitlines() == ['0x0000000000001000 ma"in', "0x0000000000002000 sub_2000"]
    with pytest.raises(ValueError):
        export.lines(fns, "xml")
    m = spark.createDataFrame([(1, "old", 2, "new", 0.97, "d"), (3, "h", 4, "i", 0.85, "d")],
                              "address bigint, name string, address2 bigint, name2 string, ratio double, description string")
    export.export_port(m, str(tmp_path / "port"), str(tmp_path / "hints"))
    assert spark.read.json(str(tmp_path / "hints")).first().address_new == 4
    assert match.gate(m).first().auto_applied == 1
    done = spark.createDataFrame([("A::f x", 1, "int f;")], "name string, addr bigint, c_code string")
    export.export_verified(done, str(tmp_path / "src"))
    assert (tmp_path / "src" / "src" / "file=A_f_x.c").is_dir()


ROWS = "binary string, addr bigint, name string, size bigint, v int"


def _functions(spark, path):
    return sorted(tuple(r)[:4] for r in stream.upserted(spark, path, spark.createDataFrame([], ROWS).schema, "v").collect())


def test_stream_upsert_merges_on_read(spark, tmp_path):
    path, src = str(tmp_path / "t"), str(tmp_path / "in")
    batches = [[("a", 1, "x", 5, 1), ("b", 1, "y", 6, 1)], [("a", 1, "x2", None, 2), ("a", 1, "stale", 9, 1), ("a", 2, "z", 7, 1)],
               [("a", 2, "z", 7, 1), ("c", 9, "n", 1, 3), ("c", 9, "m", 1, 2)]]
    for rows in batches:
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(src)
    ups = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(src)
    stream.run_available(stream.upsert(ups, path, str(tmp_path / "ck"), "v"))
    want = [("a", 1, "x2", 0), ("a", 2, "z", 7), ("b", 1, "y", 6), ("c", 9, "n", 1)]
    assert _functions(spark, path) == want
    # the same batches through the same stream again, as after a loss of its progress
    import shutil
    shutil.rmtree(tmp_path / "ck")
    stream.run_available(stream.upsert(ups, path, str(tmp_path / "ck"), "v"))
    assert _functions(spark, path) == want and len(list((tmp_path / "t" / "batches").iterdir())) == 3


def test_versioned_table_survives_failures(spark, tmp_path):
    from binlake.plans import versioned
    path, schema, keys = str(tmp_path / "t"), spark.createDataFrame([], ROWS).schema, ["binary", "addr"]
    def put(name, *rows):
        return versioned.append(spark.createDataFrame(rows, ROWS), path, name)
    assert _functions(spark, path) == []
    assert put("1", ("a", 1, "x", 5, 1), ("b", 1, "y", 6, 1))
    assert not put("1", ("a", 1, "other", 5, 9))
    # a batch whose writer was lost before its marker isn't seen, and is written anew
    put("2", ("a", 1, "half", 5, 5))
    (tmp_path / "t" / "batches" / "2" / "_SUCCESS").unlink()
    assert _functions(spark, path) == [("a", 1, "x", 5), ("b", 1, "y", 6)]
    assert put("2", ("a", 1, "x2", 5, 2))
    want = [("a", 1, "x2", 5), ("b", 1, "y", 6)]
    assert _functions(spark, path) == want
    # a compaction lost between its rows and its marker changes nothing, and the next one succeeds
    name = versioned.compact(spark, path, schema, keys, "v")
    (tmp_path / "t" / "bases" / name / "_SUCCESS").unlink()
    assert versioned.vacuum(spark, path) == [] and _functions(spark, path) == want
    assert versioned.compact(spark, path, schema, keys, "v") == name
    put("3", ("a", 1, "late", 5, 1), ("c", 1, "z", 1, 1))
    assert _functions(spark, path) == [*want, ("c", 1, "z", 1)]
    assert sorted(versioned.vacuum(spark, path)) == ["batches/1", "batches/2"] and _functions(spark, path) == [*want, ("c", 1, "z", 1)]
    assert versioned.compact(spark, path, schema, keys, "v") > name and versioned.compact(spark, path, schema, keys, "v") is None
    # a deletion holds for what comes late, not for newer rows
    assert versioned.delete(spark, path, "d", "binary", "a", 3) and not versioned.delete(spark, path, "d", "binary", "a", 9)
    put("4", ("a", 2, "late", 5, 3), ("a", 3, "new", 5, 4))
    assert _functions(spark, path) == [("a", 3, "new", 5), ("b", 1, "y", 6), ("c", 1, "z", 1)]


def test_progress_of_streams(spark, tmp_path):
    from binlake.streaming import progress
    src = str(tmp_path / "in")
    for k in range(3):
        spark.createDataFrame([(k, x) for x in range(10)], "k int, x int").coalesce(1).write.mode("append").parquet(src)
    def run(name, df):
        rows = df.writeStream.outputMode("update").format("noop").queryName(name).option("checkpointLocation", str(tmp_path / name))
        stream.run_available(rows)
    seen = progress.Progress({"kept", "broken"}).watch(spark)
    read = spark.readStream.schema("k int, x int").option("maxFilesPerTrigger", 1).parquet(src)
    run("kept", read.groupBy("k").count())
    run("other", read.groupBy("k").count())
    with pytest.raises(Exception, match="by zero|DIVIDE"):
        run("broken", read.select(F.expr("1 / (k - 1)")))
    progress.settled(spark)
    seen.stop(spark)
    got = {r.query: r for r in progress.per_job(seen.table(spark)).collect()}
    assert got.keys() == {"kept", "broken"} and got["broken"].outcome == "failed"
    assert (got["kept"].input_rows, got["kept"].state_rows, got["kept"].outcome) == (30, 3, "ended") and got["kept"].batches >= 3


def test_stream_surprise_across_batches(spark, tmp_path):
    """Three micro-batches must give what the batch operator gives at once."""
    rows = [("f", i, ((i * 37) % 11) / 20.0) for i in range(150)]
    for n in range(3):
        (spark.createDataFrame(rows[n * 50:(n + 1) * 50], "family string, step bigint, error double").coalesce(1)
         .write.mode("append").parquet(str(tmp_path / "in")))
    src = (spark.readStream.schema("family string, step bigint, error double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    out = stateful.surprise(src, ["family"])
    writer = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck"))
    stream.run_available(writer)
    got = {r.step: r.threshold_after for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.step: r.threshold_after for r in learn.surprise(spark.createDataFrame(rows, "family string, step bigint, error double"), ["family"]).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_progress_and_persistence(spark, tmp_path):
    from binlake.operators import jobs, kb, traces
    rows, seen = jobs.observed(spark.range(7).toDF("n"), "p", total=F.sum("n"))
    rows.write.parquet(str(tmp_path / "r"))
    assert seen.get == {"total": 21}
    pairs = spark.createDataFrame([("a", 1, "b", 2, None)], "binary_old string, addr_old bigint, binary_new string, addr_new bigint, ts timestamp")
    kb.append(pairs, str(tmp_path / "kb"))
    kb.append(pairs, str(tmp_path / "kb"))
    assert spark.read.parquet(str(tmp_path / "kb")).filter("ts is not null").count() == 2
    vec = spark.createDataFrame([("a", 1, [1.0])], "binary string, addr bigint, vector array<double>")
    similarity.save(vec, str(tmp_path / "v"))
    assert similarity.load(spark, str(tmp_path / "v")).count() == 1
    counts = spark.createDataFrame([("x", 2)], "pattern string, n bigint")
    traces.save_patterns(counts, traces.confidence(counts, 2), str(tmp_path / "p"))
    assert abs(traces.load_patterns(spark, str(tmp_path / "p")).first().confidence - 0.19) < 1e-12
    learn.append_history(spark.createDataFrame([(1, 0.5)], "step bigint, train_err double"), str(tmp_path / "h"))
    (tmp_path / "seeds").mkdir()
    for name, data in (("b", b"22"), ("a", b"1"), ("empty", b"")):
        (tmp_path / "seeds" / name).write_bytes(data)
    assert [bytes(r.payload) for r in corpus.read_seeds(spark, str(tmp_path / "seeds")).collect()] == [b"1", b"22"]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "j1.txt").write_text("start\nsaved db -> /out/x.i64\n[2/4 shards]\ntotal wall: 2.5s for 1,234 funcs\n")
    got = jobs.parse_log(readers.read_log(spark, str(tmp_path / "log"))).first()
    assert (got.job_id, got.saved_path, got.wall_s, got.funcs, got.shards_done) == ("j1", "/out/x.i64", 2.5, 1234, 2)
    # the file source has no rows for empty files (stated in read_corpus)
    assert corpus.read_corpus(spark, str(tmp_path / "seeds")).count() == 2


def test_topk_moves_a_query_once_per_group_of_cells(spark):
    """Vectors that no bound prunes: each moves with every block of the other side, not with every cell; floats are found to fit half the bytes."""
    from binlake.operators import pivots
    rng = np.random.default_rng(8)
    rows = [(f"b{i % 3}", i, [float(np.float32(x)) for x in rng.normal(size=24)]) for i in range(900)]
    df, counted = spark.createDataFrame(rows, "binary string, addr bigint, vector array<double>"), {}
    assert similarity.topk(df, df, 2, pivots=60, counted=counted, block_rows=300).count() == 1800
    assert counted["copied"] < 900 * 2 * 5 * counted["rounds"]  # 4 groups or so; each query visits most of the 60 cells
    assert pivots.narrow(df) == "array<float>"
    assert pivots.narrow(df, df.limit(1).withColumn("vector", F.array(F.lit(0.1)))) == "array<double>"


def test_mutual_best_searches_a_table_once(spark, monkeypatch):
    asked = []
    search = similarity.topk
    monkeypatch.setattr(similarity, "topk", lambda *a, **b: asked.append(1) or search(*a, **b))
    rows = [("a", 1, [1.0, 0.0]), ("b", 2, [1.0, 0.1]), ("b", 3, [0.0, 1.0]), ("a", 4, [0.5, 1.0])]
    df = spark.createDataFrame(rows, "binary string, addr bigint, vector array<double>")
    pairs = {(r.q_addr, r.addr) for r in similarity.mutual_best(df, df).collect()}
    assert pairs == {(1, 2), (2, 1), (3, 4), (4, 3)} and len(asked) == 1
    other = df.filter("addr < 3")
    assert {(r.q_addr, r.addr) for r in similarity.mutual_best(df, other).collect()} == {(1, 2), (2, 1)} and len(asked) == 3


def test_scoring_a_part_takes_slices():
    """A part's similarities are never held whole, and equal ones go by binary and address."""
    import tracemalloc

    import pandas as pd
    from binlake.operators import pivots
    n = 5000
    vectors = list(np.random.default_rng(4).normal(size=(n, 4)))
    a = pd.DataFrame({"binary": "b", "addr": range(n), "vector": vectors, "leaf": [i % 5 for i in range(n)]})
    b = pd.DataFrame({"q_binary": "q", "q_addr": range(n), "vector": vectors, "bar": -1.0, "cells": [np.array([0, 0, 1, 2, 3, 4])] * n})
    tracemalloc.start()
    got = pivots.best_of_part(a, b, 1, 0.0, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got["q_addr"] == got["addr"]).all() and len(got) == n
    assert peak < n * n * 8 / 4


def test_plain_words_equal_the_shells():
    import shlex

    from binlake.functions import commands
    r = random.Random(2)
    for _ in range(3000):
        text = "".join(r.choice(" \t\r\nab=-#|;&$'\"\\\x0b\x85é") for _ in range(r.randrange(9)))
        try:
            want = shlex.split(text)
        except ValueError:
            want = text.split()
        assert commands._split(text) == want


def test_command_features_name_the_program_once(spark):
    """The expression over the words is evaluated once and not once per family and value."""
    from binlake.functions import commands
    df = spark.createDataFrame([("sudo /bin/ls -l 'a b' > x",)], "c string").withColumn("t", commands.tokens("c"))
    out = df.select(commands.features(F.col("c"), F.col("t")).alias("f"))
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.count("sudo") <= 2 and len(out.first().f) == 32


def test_range_join_lists_a_point_few_times_and_broadcasts_nothing(spark):
    """Lengths of six powers of two share two widths, and the intervals' listing, whose size isn't known, is not broadcast."""
    from binlake.plans.ranges import range_join
    spans = spark.range(3000).selectExpr("'b' AS binary", "id * 4096 AS start", "id * 4096 + 16 * (1 + id % 50) AS end", "id")
    points = spark.range(3000).selectExpr("'b' AS binary", "id * 4096 + id % 800 AS p")
    got = range_join(points, spans, ["binary"], "p")
    assert got.count() == sum(i % 800 < 16 * (1 + i % 50) for i in range(3000))
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_streamed_novelty_makes_one_frame_per_group(monkeypatch):
    """A group that comes in one frame is neither joined nor sorted as a frame; steps in any order, frames and states count on."""
    import pandas as pd
    from binlake.streaming import stateful

    class Rows:
        dtypes = [("campaign", "bigint"), ("signature", "string"), ("step", "bigint")]
        groupBy = lambda self, *keys: self
        applyInPandasWithState = lambda self, count, *rest: count  # noqa: E731, N815

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    count, state = stateful.novelty(Rows(), ["campaign"]), State()
    frame = lambda *steps: pd.DataFrame({"campaign": 7, "signature": "a", "step": steps})
    with monkeypatch.context() as m:
        m.setattr(stateful.pd, "concat", None)
        first, = count((7, "a"), iter([frame(5, 3, 4)]), state)
    assert list(first.columns) == ["campaign", "signature", "step", "times_seen", "is_new", "reward"]
    assert first.values.tolist() == [[7, "a", 3, 1, True, 1.0], [7, "a", 4, 2, False, 1 / 2 ** 0.5], [7, "a", 5, 3, False, 1 / 3 ** 0.5]]
    more, = count((7, "a"), iter([frame(9), frame(8)]), state)
    assert more["step"].tolist() == [8, 9] and more["times_seen"].tolist() == [4, 5] and state.get == (5,)
    nulls, = count((7, "b"), iter([frame(None, 2.0)]), State())
    assert nulls["step"].iloc[0] == 2 and np.isnan(nulls["step"].iloc[1])
