"""Binary corpora: headers, sections, byte scans, shards and assets."""
from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import scan
from ...sources import byteranges, corpus
from ._register import Catalog

QUERIES = Catalog()
q = QUERIES.query
WORKERS = 4


@q("", "SELECT 'img/' || p_partkey AS path, 'ELF' AS format, 'ELF (Linux)' AS kind, CASE p_partkey % 3 WHEN 0 THEN 'x86_64' WHEN 1 THEN 'arm64' ELSE 'arm' END AS arch, "
       "CASE p_partkey % 3 WHEN 0 THEN 'x86_64' WHEN 1 THEN 'arm64' ELSE 'arm32' END AS hint FROM part")
def corpus_sniff(t):
    return corpus.sniff(t.images()).select("path", "format", corpus.loose_kind().alias("kind"), corpus.arch().alias("arch"), corpus.arch_hint().alias("hint"))


@q("", """SELECT 'bin/' || p_partkey AS path, 'generic' AS format, 'Unknown' AS kind FROM part""")
def corpus_sniff_generic(t):
    return corpus.sniff(t.blobs()).select("path", "format", corpus.loose_kind().alias("kind"))


SECTIONS = """se AS (SELECT 'img/' || p_partkey AS path, 0 AS image_base, 'sec0' AS name, 4096 + p_partkey * 16 AS va, 192 AS raw_off, p_size AS raw_size, p_size AS vsize, true AS is_code, p_partkey FROM part
    UNION ALL SELECT 'img/' || p_partkey, 0, 'sec1', 1048576 + p_partkey, 0, 0, p_size * 2, false, p_partkey FROM part)"""


@q("", "SELECT * EXCLUDE (p_partkey) FROM se", SECTIONS)
def corpus_sections(t):
    return corpus.sections(t.images())


@q("", "SELECT path, min(va) FILTER (is_code) AS text_start, max(va + vsize) FILTER (is_code) AS text_end FROM se GROUP BY path", SECTIONS)
def corpus_code_range(t):
    return corpus.code_range(corpus.sections(t.images()))


@q("", """SELECT 'img/' || p_partkey AS path, va_start, repeat('55', greatest(0, p_size - 3)) AS bytes FROM (SELECT *, 4099 + p_partkey * 16 AS va_start FROM part) WHERE p_size > 3""")
def corpus_read_ranges(t):
    p = F.substring("path", 5, 20).cast("bigint")
    files = t.images()
    ranges = files.select("path", (p * 16 + 4099).alias("va_start"), (p * 16 + 2000000).alias("va_end"))
    return corpus.read_ranges(files, corpus.sections(files), ranges).select("path", "va_start", F.hex("bytes").alias("bytes"))


@q("", "SELECT 'img/' || p_partkey AS path, 4097 + p_partkey * 16 AS addr, 'sec0' AS name FROM part WHERE p_size > 1")
def corpus_section_of(t):
    files = t.images()
    pts = files.select("path", (F.substring("path", 5, 20).cast("bigint") * 16 + 4097).alias("addr"))
    return corpus.section_of(pts, corpus.sections(files)).select("path", "addr", "name")


def _name(kind: str):
    """The name that a file of ``kind`` was stored under, from its whole path."""
    return F.regexp_extract("path", f"({kind}/[0-9]+)$", 1)


@q("", """SELECT 'img/' || p_partkey AS path, 'ELF' AS format, 'ELF (Linux)' AS kind, CASE p_partkey % 3 WHEN 0 THEN 'x86_64' WHEN 1 THEN 'arm64' ELSE 'arm' END AS arch,
       CASE p_partkey % 3 WHEN 0 THEN 'x86_64' WHEN 1 THEN 'arm64' ELSE 'arm32' END AS hint, 192 + p_size AS length FROM part
    UNION ALL SELECT 'exe/' || p_partkey, 'PE', 'PE (Windows)', CASE p_partkey % 4 WHEN 0 THEN 'x86_64' WHEN 1 THEN 'arm64' WHEN 2 THEN 'x86' ELSE 'arm' END, NULL, 512 + p_size FROM part
    UNION ALL SELECT 'nso/' || p_partkey, 'NSO', 'Unknown', 'x86_64', 'arm64', 256 + 2 * p_size FROM part
    UNION ALL SELECT 'mac/' || p_partkey, 'generic', 'Mach-O (macOS)', 'x86_64', NULL, 4 + length(encode(p_name)) FROM part
    UNION ALL SELECT 'sh/' || p_partkey, 'generic', 'Script', 'x86_64', NULL, 2 + length(encode(p_name)) FROM part""".replace("length(encode(p_name))", "strlen(p_name)"))
def files_sniff(t):
    """Five kinds of files, stored in packs and then told by their headers."""
    names = corpus.described(t.spark, t.stored(t.images().select("path", "content"), t.executables(), packed=True))
    return names.select(F.regexp_extract("path", "([a-z]+/[0-9]+)$", 1).alias("path"), "format", "kind", "arch", "hint", "length")


FILE_SECTIONS = f"""se AS (SELECT 'img/' || p_partkey AS path, 0 AS image_base, 'sec0' AS name, 4096 + p_partkey * 16 AS va, 192 AS raw_off, p_size AS raw_size, p_size AS vsize, true AS is_code FROM part
    UNION ALL SELECT 'img/' || p_partkey, 0, 'sec1', 1048576 + p_partkey, 0, 0, p_size * 2, false FROM part
    UNION ALL SELECT 'exe/' || p_partkey, CASE WHEN p_partkey % 4 < 2 THEN 5368709120 ELSE 4194304 END, '.t' || p_partkey % 100, 4096 + p_partkey * 16, 512, p_size, p_size + 7, p_partkey % 2 = 0 FROM part
    UNION ALL SELECT 'nso/' || p_partkey, {corpus.NSO_BASE}, unnest(['.text', '.rodata', '.data', '.bss']), unnest([0, p_size, 2 * p_size, 2 * p_size + 1]), unnest([256, 256 + p_size, 256 + 2 * p_size - 1, 0]),
        unnest([p_size, p_size - 1, 1, 0]), unnest([p_size, p_size - 1, 1, p_partkey % 50]), unnest([true, false, false, false]) FROM part)"""


@q("", "SELECT * FROM se", FILE_SECTIONS)
def files_sections(t):
    """Section tables of files stored in packs."""
    found = corpus.file_sections(corpus.described(t.spark, t.stored(t.images().select("path", "content"), t.executables(), packed=True)))
    return found.withColumn("path", F.regexp_extract("path", "([a-z]+/[0-9]+)$", 1))


@q("", """SELECT 'img/' || p_partkey AS path, va_start, repeat('55', greatest(0, p_size - 3)) AS bytes FROM (SELECT *, 4099 + p_partkey * 16 AS va_start FROM part) WHERE p_size > 3""")
def files_read_ranges(t):
    files = corpus.described(t.spark, t.stored(t.images().select("path", "content")))
    p = F.regexp_extract("path", "([0-9]+)$", 1).cast("bigint")
    ranges = files.select("path", (p * 16 + 4099).alias("va_start"), (p * 16 + 2000000).alias("va_end"))
    return corpus.read_file_ranges(corpus.file_sections(files), ranges).select(_name("img").alias("path"), "va_start", F.hex("bytes").alias("bytes"))


def _blob_chunks(t, **around):
    base = 4194304 + F.regexp_extract("path", "([0-9]+)$", 1).cast("bigint") * 65536
    return byteranges.chunks(t.spark, t.stored(t.blobs()), base, 4096, **around)


X86 = """px AS (SELECT DISTINCT path, addr FROM bytes WHERE (b = '55' AND (prev IS NULL OR prev IN ('c3', 'c2', 'cc', '90', '00', 'cb', 'cf') OR addr % 16 = 0))
    OR substr(h, CAST(2 * pos + 1 AS INT), 6) IN ('4883ec', '4881ec') OR substr(h, CAST(2 * pos + 1 AS INT), 8) = '554889e5')"""


@q("bytes", "SELECT path, addr FROM px", X86)
def scan_x86_prologues(t):
    return scan.x86_prologues(t.blobs())


@q("bytes", "SELECT path, addr FROM px", X86)
def files_x86_prologues(t):
    return scan.x86_starts(_blob_chunks(t, before=1, after=3)).withColumn("path", _name("bin"))


def jump(shift: int, width: int) -> str:
    imm = f"((w >> {shift}) & {(1 << width) - 1})"
    return f"addr + 4 * ({imm} - CASE WHEN {imm} >= {1 << (width - 1)} THEN {1 << width} ELSE 0 END)"


HEADS = " UNION ALL ".join(f"SELECT path, 'block_head' AS kind, {a} AS addr FROM words WHERE (w & {m}) = {v}"
                           for m, v, s, n in scan.JUMPS for a in (jump(s, n), "addr + 4"))
ARM = f"""aw AS (SELECT DISTINCT path, kind, addr FROM (SELECT path, 'prologue' AS kind, addr FROM words WHERE (w & {scan.PROLOGUE[0]}) = {scan.PROLOGUE[1]}
    UNION ALL SELECT path, 'block_head', addr FROM words WHERE (w & {scan.PROLOGUE[0]}) = {scan.PROLOGUE[1]}
    UNION ALL SELECT path, 'call_target', {jump(0, 26)} FROM words WHERE (w & {scan.CALL[0]}) = {scan.CALL[1]} UNION ALL {HEADS}))"""


@q("words", "SELECT * FROM aw", ARM)
def scan_arm64_words(t):
    return scan.arm64_words(t.blobs())


@q("words", "SELECT * FROM aw", ARM)
def files_arm64_words(t):
    return scan.arm64_hits(_blob_chunks(t)).withColumn("path", _name("bin"))


@q("bytes words", "SELECT path, addr FROM px UNION SELECT path, addr FROM aw WHERE kind <> 'block_head'", X86 + ", " + ARM)
def scan_entry_points(t):
    return scan.entry_points(scan.x86_prologues(t.blobs()), scan.arm64_words(t.blobs()).filter("kind <> 'block_head'"))


RUNS = """ru AS (SELECT path, min(addr) AS addr, string_agg(chr(CAST('0x' || b AS INT)), '' ORDER BY addr) AS text FROM (
    SELECT *, pos - row_number() OVER (PARTITION BY path ORDER BY pos) AS g FROM bytes WHERE b >= '20' AND b < '7f') GROUP BY path, g)"""


@q("bytes", "SELECT * FROM ru WHERE length(text) >= 5", RUNS)
def scan_strings(t):
    return scan.strings(t.blobs())


@q("bytes", "SELECT * FROM ru WHERE length(text) >= 5", RUNS)
def files_strings(t):
    return scan.strings_of(_blob_chunks(t)).withColumn("path", _name("bin"))


@q("bytes", "SELECT * FROM ru WHERE length(text) >= 5", RUNS)
def sql_strings(t):
    """The table function in a lateral join."""
    return t.sql("SELECT b.path, s.addr, s.text FROM {blobs} b, LATERAL binary_strings(b.content, b.base, 5) s", blobs=t.blobs())


@q("", "SELECT * EXCLUDE (image_base) FROM se", FILE_SECTIONS)
def sql_sections(t):
    images = t.images().select("path", "content").unionByName(t.executables())
    return t.sql("SELECT b.path, s.* FROM {images} b, LATERAL binary_sections(b.content) s", images=images)


@q("blobs", """SELECT path, 'png' AS name, i AS offset, length(h) // 2 - i - 4 AS size FROM (SELECT path, h, (position('89504e470d0a1a0a' IN h) - 1) // 2 AS i FROM blobs)""")
def sql_assets_png(t):
    return t.sql("SELECT b.path, a.name, a.offset, a.size FROM {blobs} b, LATERAL binary_assets(b.content, 32) a WHERE a.name = 'png'", blobs=t.blobs())


@q("", """SELECT page_id, length(encode(html)) AS size, lower(left(hex(encode(html)), 32)) AS first_bytes, round(length(regexp_replace(a, '[^\\x20-\\x7E]', '', 'g')) / (length(hex(encode(html))) // 2), 6) AS printable_ratio
    FROM (SELECT *, array_to_string([CASE WHEN substr(hx, CAST(2 * i + 1 AS INT), 2) BETWEEN '20' AND '7E' THEN 'a' ELSE chr(1) END for i in range(0, length(hx) // 2)], '') AS a
    FROM (SELECT *, hex(encode(html)) AS hx FROM pages))""".replace("length(encode(html)) AS size", "length(hex(encode(html))) // 2 AS size"))
def scan_profile(t):
    b = t.read("pages").select(F.col("page_id").alias("path"), F.encode("html", "UTF-8").alias("content"))
    return scan.profile(b).withColumnRenamed("path", "page_id").withColumn("printable_ratio", F.round("printable_ratio", 6))


@q("blobs", """SELECT path, 'png' AS name, i AS offset, length(h) // 2 - i - 4 AS size FROM (SELECT path, h, (position('89504e470d0a1a0a' IN h) - 1) // 2 AS i FROM blobs)""")
def scan_carve_png(t):
    return scan.carve(t.blobs(), None, max_blob=None).filter("name = 'png'").select("path", "name", "offset", "size")


SIGNATURES = ", ".join(
    f"({i}, '{name}', '{magic.hex()}', {limit}, " + ("'{}', {}, {})".format(scan.ASSET_ENDS[name][0].hex(), *scan.ASSET_ENDS[name][1:]) if name in scan.ASSET_ENDS else "NULL, 0, 0)")
    for i, (name, magic, limit) in enumerate(scan.ASSETS))
CARVE = f"""ca AS (SELECT path, h, pos AS o, sig, name, least(pos + lim, length(h) // 2) AS fin, mk, skip, keep
        FROM bytes JOIN (VALUES {SIGNATURES}) g(sig, name, m, lim, mk, skip, keep) ON substr(h, CAST(2 * pos + 1 AS INT), length(m)) = m),
ce AS (SELECT c.path, c.o, c.sig, min(b.pos) AS stop FROM ca c JOIN bytes b ON b.path = c.path AND b.pos >= c.o + c.skip AND b.pos + length(c.mk) // 2 <= c.fin
        AND substr(b.h, CAST(2 * b.pos + 1 AS INT), length(c.mk)) = c.mk GROUP BY ALL),
cs AS (SELECT ca.*, coalesce(least(stop + keep, fin), fin) - o AS size FROM ca LEFT JOIN ce USING (path, o, sig)),
cf AS (SELECT * FROM cs WHERE size >= {scan.MIN_ASSET} QUALIFY row_number() OVER (PARTITION BY path, substr(h, CAST(2 * o + 1 AS INT), CAST(2 * least(size, {scan.PREFIX}) AS INT)) ORDER BY sig, o) = 1)"""


@q("bytes", """SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY sig, o) AS INT) AS pos, name, o AS offset, size,
    md5(unhex(substr(h, CAST(2 * o + 1 AS INT), CAST(2 * size AS INT)))) AS digest FROM cf""", CARVE)
def scan_carve(t):
    """All assets of every blob with their bytes' digest."""
    b = t.blobs()
    return scan.carved_bytes(b, scan.carve(b, None, max_blob=None)).select("path", "pos", "name", "offset", "size", F.md5("payload").alias("digest"))


@q("blobs", """SELECT path, 'png' AS name, i AS offset, length(h) // 2 - i - 4 AS size, md5(unhex(substr(h, CAST(2 * i + 1 AS INT), CAST(length(h) - 2 * i - 8 AS INT)))) AS digest
    FROM (SELECT path, h, (position('89504e470d0a1a0a' IN h) - 1) // 2 AS i FROM blobs)""")
def files_carve_png(t):
    found = scan.carve_chunks(_blob_chunks(t, after=scan.ASSET_BYTES)).filter("name = 'png'")
    read = byteranges.slices(found.withColumn("pieces", byteranges.piece(F.col("offset"), F.col("size"))))
    return read.select(_name("bin").alias("path"), "name", "offset", "size", F.md5("data").alias("digest"))


@q("bytes", """SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY sig, o) AS INT) AS pos, name, o AS offset, size,
    md5(unhex(substr(h, CAST(2 * o + 1 AS INT), CAST(2 * size AS INT)))) AS digest FROM cf""", CARVE)
def files_carve(t):
    """All assets of stored files, found in chunks and read by their ranges."""
    found = scan.carve_chunks(_blob_chunks(t, after=scan.ASSET_BYTES))
    read = byteranges.slices(found.withColumn("pieces", byteranges.piece(F.col("offset"), F.col("size"))))
    return read.select(_name("bin").alias("path"), "pos", "name", "offset", "size", F.md5("data").alias("digest"))


def _hits(t):
    """Function starts of one image per brand: addresses 64 apart, with uneven gaps."""
    return t.lean().select(F.col("binary").alias("path"), (F.col("addr") * 64 + F.col("size") % 7).alias("addr"))


def _ranges(t):
    return _hits(t).select("path").distinct().unionByName(_hits(t).select(F.concat(F.lit("empty "), "path").alias("path")).distinct()).select(
        "path", F.lit(0).cast("bigint").alias("text_start"), F.lit(100_000_007).cast("bigint").alias("text_end"))


# boundaries lie far more than 16 bytes apart here, so no push forward is needed
SHARDS = f"""hi AS (SELECT binary AS path, addr * 64 + size % 7 AS addr FROM functions),
rk AS (SELECT path, addr, row_number() OVER (PARTITION BY path ORDER BY addr) - 1 AS r, count(*) OVER (PARTITION BY path) AS n FROM hi),
cu AS (SELECT path, i, (addr // 16) * 16 AS b FROM rk JOIN (SELECT unnest(range(1, {WORKERS})) AS i) g ON r = least(i * greatest(1, n // {WORKERS}), n - 1)
    UNION ALL SELECT DISTINCT path, 0, 0 FROM hi UNION ALL SELECT DISTINCT 'empty ' || path, i, i * ((100000007 + {WORKERS} - 1) // {WORKERS}) FROM hi, (SELECT unnest(range(0, {WORKERS})) AS i)),
sh AS (SELECT path, CAST(i AS INT) AS shard, b AS shard_start, lead(b, 1, 100000007) OVER (PARTITION BY path ORDER BY i) AS shard_end FROM cu)"""


@q("functions", "SELECT * FROM sh", SHARDS)
def scan_density_shards(t):
    return scan.density_shards(_hits(t), _ranges(t), WORKERS)


@q("functions", "SELECT h.path, h.addr, s.shard FROM hi h JOIN sh s ON s.path = h.path AND h.addr >= s.shard_start AND h.addr < s.shard_end", SHARDS)
def scan_assign_shards(t):
    return scan.assign_shards(_hits(t), scan.density_shards(_hits(t), _ranges(t), WORKERS))


@q("functions", """SELECT h.path, h.addr + 1 AS addr, s.shard FROM hi h JOIN sh s ON s.path = h.path AND h.addr + 1 >= s.shard_start AND h.addr + 1 < s.shard_end
    WHERE NOT EXISTS (SELECT 1 FROM hi x WHERE x.path = h.path AND x.addr = h.addr + 1)""", SHARDS)
def scan_new_seeds(t):
    callees = _hits(t).withColumn("addr", F.col("addr") + 1).unionByName(_hits(t))
    return scan.new_seeds(callees, _hits(t), scan.density_shards(_hits(t), _ranges(t), WORKERS))


@q("functions", "SELECT binary AS path, addr FROM functions WHERE addr >= 100 AND addr < 500")
def scan_in_range(t):
    return scan.in_range(t.lean().select(F.col("binary").alias("path"), "addr"), 100, 500)


def _shard_results(t):
    """Two overlapping shard results per brand; function lists stay per shard and brand."""
    f = t.lean().select("binary", F.explode(F.array(F.lit(0), F.lit(1))).alias("shard"), "addr", "name", "size")
    ea = F.col("addr") * 2 + F.col("addr") % 5 % 2
    fn = F.struct(ea.alias("ea"), F.when(F.col("shard") == 0, F.concat(F.lit("sub_"), F.col("addr").cast("string"))).otherwise(F.col("name")).alias("name"),
                  (F.col("size") + F.col("shard")).alias("size"), F.lit(None).cast("boolean").alias("thumb"))
    return f.groupBy("binary", (F.col("shard") * 500).cast("bigint").alias("shard_start"), (F.col("shard") * 500 + 3000).cast("bigint").alias("shard_end")).agg(
        F.collect_list(fn).alias("funcs"))


@q("functions", """SELECT binary, addr * 2 AS ea, CASE WHEN two AND NOT starts_with(name, 'sub_') THEN name WHEN two THEN name ELSE 'sub_' || addr END AS name,
    CASE WHEN one THEN size ELSE size + 1 END AS size, addr % 5 % 2 = 1 AS thumb FROM (SELECT *, addr * 2 < 3000 AS one, addr * 2 >= 500 AND addr * 2 < 3500 AS two FROM functions) WHERE one OR two""")
def scan_merge_shards(t):
    return scan.merge_shards(_shard_results(t))


@q("ev", """SELECT binary, shards, done, shards - done AS failed, funcs, round(elapsed_s, 6) AS elapsed_s, round(funcs / elapsed_s, 4) AS funcs_per_s, round(elapsed_s / (done / shards) - elapsed_s, 4) AS eta_s FROM (
    SELECT 'bin' || (user_id % 10) AS binary, count(*) AS shards, count(*) FILTER (event_type <> 'error') AS done, CAST(coalesce(sum(k) FILTER (event_type <> 'error'), 0) AS BIGINT) AS funcs, max(value) AS elapsed_s FROM ev GROUP BY ALL)""")
def scan_shard_report(t):
    rows = t.ev().select(F.concat(F.lit("bin"), (F.col("user_id") % 10).cast("string")).alias("binary"), F.col("k").alias("funcs"), F.col("value").alias("wall_s"),
                         F.when(F.col("event_type") == "error", "broken").alias("error"))
    return scan.shard_report(rows).withColumns({c: F.round(c, d) for c, d in (("elapsed_s", 6), ("funcs_per_s", 4), ("eta_s", 4))})


@q("", """SELECT path, payload, source FROM (SELECT 't' || p_partkey AS path, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN p_brand END AS payload,
    CASE p_partkey % 3 WHEN 0 THEN 'seeds_dir' WHEN 1 THEN 'carved-from-binary' ELSE 'none (proposer fallback)' END AS source FROM part)""")
def scan_resolve_seeds(t):
    p = t.read("part").select(F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("path"), "p_partkey", "p_name", "p_brand")
    return scan.resolve_seeds(p.filter("p_partkey % 3 = 0").select("path", F.col("p_name").alias("payload")),
                              p.filter("p_partkey % 3 < 2").select("path", F.col("p_brand").alias("payload")), p.select("path"))
