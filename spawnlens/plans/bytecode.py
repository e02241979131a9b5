"""Queries of code analysis, over each distinct code of the contracts view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import evm
from ..operators import bytecode as B
from ..operators import kernel
from ..sources import views
from ..sources.views import sql
from ..streaming.jobs import keep

KEY = B.KEY


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.codes_once(views.contracts(spark, sf_dir), ["block_number"], keep)


def _rows(spark, sf_dir):
    return B.with_blocks(B.instruction_rows(B.dealt(_codes(spark, sf_dir))))


def _blocks(spark, sf_dir):
    return B.block_rows(_rows(spark, sf_dir))


def _text(col: str):
    return F.array_join(F.col(col).cast("array<string>"), ",").alias(col)


def opcode_histogram(spark, sf_dir):
    rows = _codes(spark, sf_dir).select(F.explode(evm.instructions(F.col("code"))).alias("t"))
    return rows.groupBy(F.substring("t", 1, 2).alias("op")).agg(F.count("*").alias("n")).select("op", evm.opcode_name(F.col("op")).alias("opcode"), evm.operand_size(F.col("op")).cast("bigint").alias("operand_size"), "n")


def disassemble(spark, sf_dir):
    return B.instruction_rows(B.dealt(_codes(spark, sf_dir))).select(KEY, "i", F.col("pc"), "op", "operand")


def basic_blocks(spark, sf_dir):
    return _blocks(spark, sf_dir).select(KEY, "start_pc", "end_pc", "n_instructions", "contains_create", "contains_create2")


def cfg_edges(spark, sf_dir):
    return B.edge_summary(_blocks(spark, sf_dir))


def reachable_blocks(spark, sf_dir):
    return B.reachability(_blocks(spark, sf_dir)).select(KEY, "start_pc", "reachable")


def factory_blocks(spark, sf_dir):
    return B.reachability(_blocks(spark, sf_dir)).where("reachable and (contains_create or contains_create2)").select(KEY, "start_pc", "contains_create", "contains_create2")


def verified_creates(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return B.verified(rows, B.reachability(B.block_rows(rows)))


def raw_create_positions(spark, sf_dir):
    c = F.col("code")
    return _codes(spark, sf_dir).select(KEY, F.array_join(evm.byte_positions(c, "f0").cast("array<string>"), ",").alias("creates"), F.array_join(evm.byte_positions(c, "f5").cast("array<string>"), ",").alias("create2s"))


def false_positive_positions(spark, sf_dir):
    found = kernel.verdicts(_codes(spark, sf_dir))
    c = F.col("code")
    rest = F.array_sort(F.concat(F.array_except(evm.byte_positions(c, "f0"), "create_positions"), F.array_except(evm.byte_positions(c, "f5"), "create2_positions")))
    return found.select(KEY, F.array_join(rest.cast("array<string>"), ",").alias("positions"))


def _verdict(found: DataFrame, *more: str) -> DataFrame:
    return found.select(KEY, "is_factory", "factory_type", _text("create_positions"), _text("create2_positions"), F.size("false_positive_positions").cast("bigint").alias("false_positives"), "total_instructions", "total_basic_blocks", "reachable_blocks", *more)


def detect_baseline(spark, sf_dir):
    return _verdict(kernel.verdicts(_codes(spark, sf_dir)))


def detect_enhanced(spark, sf_dir):
    return _verdict(kernel.verdicts(_codes(spark, sf_dir), enhanced=True), "factory_blocks", "deep_factory_blocks", F.round("confidence_score", 6).alias("confidence_score"))


def confidence_score(spark, sf_dir):
    return kernel.verdicts(_codes(spark, sf_dir), enhanced=True).where("confidence_score is not null").select(KEY, F.round("confidence_score", 6).alias("confidence_score"))


def static_jump_targets(spark, sf_dir):
    return B.static_targets(_rows(spark, sf_dir)).select(KEY, "jump_pc", "target_pc")


def enhanced_edges(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    blocks = keep(B.block_rows(rows))  # read three times, made once
    return B.enhanced_edges(blocks, B.static_targets(rows, blocks))


def block_depth(spark, sf_dir):
    return kernel.block_rows(_codes(spark, sf_dir), KEY).withColumn("deep", F.col("depth") >= kernel.DEEP)


def create_context(spark, sf_dir):
    return B.creation_context(_rows(spark, sf_dir))


def strip_0x(spark, sf_dir):
    return _codes(spark, sf_dir).select(KEY, evm.strip_0x(F.col("code")).alias("stripped"))


def bytecode_hash(spark, sf_dir):
    return views.contracts(spark, sf_dir).select("address", evm.bytecode_hash(F.col("code")).alias(KEY))


def naive_create_bytes(spark, sf_dir):
    return _codes(spark, sf_dir).select(KEY, evm.naive_count(F.col("code"), "f0").alias("f0"), evm.naive_count(F.col("code"), "f5").alias("f5"))


QUERIES = {f.__name__: f for f in (opcode_histogram, disassemble, basic_blocks, cfg_edges, reachable_blocks, factory_blocks, verified_creates, raw_create_positions, false_positive_positions, detect_baseline, detect_enhanced, confidence_score, static_jump_targets, enhanced_edges, block_depth, create_context, strip_0x, bytecode_hash, naive_create_bytes)}


def _in(xs: list[str]) -> str:
    return "(" + ", ".join(f"'{x}'" for x in xs) + ")"


_STRIP = "CASE WHEN code LIKE '0x%' THEN substr(code, 3) ELSE code END"
_NAMES = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in evm.OPCODES.items()) + "}"
CTES = f"""
codes AS (SELECT DISTINCT code, sha256(code) AS bytecode_hash FROM v_contracts WHERE code IS NOT NULL),
pairs AS (SELECT *, regexp_extract_all(lower({_STRIP}), '..') AS bytes FROM codes),
tok AS (SELECT bytecode_hash, unnest(ts) AS t, CAST(generate_subscripts(ts, 1) - 1 AS INTEGER) AS i FROM (SELECT bytecode_hash, regexp_extract_all(lower({_STRIP}), '{evm.INSTRUCTION}') AS ts FROM codes)),
ins AS (SELECT bytecode_hash, i, substr(t, 1, 2) AS op, substr(t, 3) AS operand, CAST(sum(length(t) // 2) OVER w - length(t) // 2 AS INTEGER) AS pc, count(*) OVER (PARTITION BY bytecode_hash) AS n, lag(substr(t, 1, 2)) OVER w AS prev FROM tok WINDOW w AS (PARTITION BY bytecode_hash ORDER BY i)),
numbered AS (SELECT *, CAST(sum(CASE WHEN i = 0 OR op = '5b' OR (prev IN {_in(evm.ENDS_BLOCK)} AND pc < n) THEN 1 ELSE 0 END) OVER (PARTITION BY bytecode_hash ORDER BY i) - 1 AS INTEGER) AS blk FROM ins),
rws AS (SELECT *, sum(CASE WHEN op IN {_in(evm.STOPS)} THEN 1 ELSE 0 END) OVER (PARTITION BY bytecode_hash, blk ORDER BY i) AS stops FROM numbered),
grouped AS (SELECT bytecode_hash, blk, min(pc) AS start_pc, max(pc) AS last_pc, count(*) AS n_instructions, min_by(op, i) AS first_op, max_by(op, i) AS last_op, bool_or(op = 'f0') AS contains_create, bool_or(op = 'f5') AS contains_create2 FROM rws GROUP BY bytecode_hash, blk),
blocks AS (SELECT *, lead(start_pc) OVER w AS next_pc, coalesce(lead(start_pc) OVER w - 1, last_pc) AS end_pc, sum(CASE WHEN first_op = '5b' THEN 1 ELSE 0 END) OVER (PARTITION BY bytecode_hash) AS n_jumpdests, lead(first_op) OVER w AS next_op, count(*) OVER (PARTITION BY bytecode_hash) AS n_blocks FROM grouped WINDOW w AS (PARTITION BY bytecode_hash ORDER BY blk)),
isl AS (SELECT *, coalesce(sum(CASE WHEN last_op IN {_in(evm.BREAKS)} THEN 1 ELSE 0 END) OVER (PARTITION BY bytecode_hash ORDER BY blk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM blocks),
jmp AS (SELECT *, bool_or(island = 0 AND last_op IN ('56', '57')) OVER (PARTITION BY bytecode_hash) AS any_jump FROM isl),
reach AS (SELECT *, bool_or(blk = 0 OR (first_op = '5b' AND any_jump)) OVER (PARTITION BY bytecode_hash, island ORDER BY blk) AS reachable FROM jmp),
ver AS (SELECT r.bytecode_hash, r.pc, r.op FROM rws r JOIN reach b USING (bytecode_hash, blk) WHERE r.op IN ('f0', 'f5') AND r.stops = 0 AND b.reachable),
raw AS (SELECT bytecode_hash, list_filter(list_transform(bytes, lambda b, k: CASE WHEN b = 'f0' THEN k - 1 END), lambda x: x IS NOT NULL) AS f0, list_filter(list_transform(bytes, lambda b, k: CASE WHEN b = 'f5' THEN k - 1 END), lambda x: x IS NOT NULL) AS f5 FROM pairs),
recent AS (SELECT *, list(CASE WHEN op BETWEEN '60' AND '7f' AND operand <> '' THEN operand END) OVER (PARTITION BY bytecode_hash ORDER BY i ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS pushed FROM rws),
cand AS (SELECT DISTINCT bytecode_hash, blk, pc AS jump_pc, ltrim(unnest(pushed), '0') AS h FROM recent WHERE op IN ('56', '57')),
tgt AS (SELECT DISTINCT c.bytecode_hash, c.blk, c.jump_pc, d.pc AS target_pc FROM cand c JOIN rws d ON d.bytecode_hash = c.bytecode_hash AND d.op = '5b' AND c.h IS NOT NULL AND lower(hex(d.pc)) = CASE WHEN c.h = '' THEN '0' ELSE c.h END),
edg AS (SELECT bytecode_hash, start_pc, 'fall' AS kind, next_pc AS dst_pc FROM blocks WHERE last_op NOT IN {_in(evm.BREAKS)} AND next_pc IS NOT NULL
  UNION ALL SELECT b.bytecode_hash, b.start_pc, CASE WHEN t.target_pc IS NULL THEN 'all' ELSE 'static' END, t.target_pc FROM blocks b LEFT JOIN tgt t ON t.bytecode_hash = b.bytecode_hash AND t.jump_pc = b.last_pc WHERE b.last_op IN ('56', '57')),
step AS (SELECT e.bytecode_hash, e.start_pc, e.dst_pc FROM edg e WHERE kind <> 'all'),
size AS (SELECT bytecode_hash, count(*) AS n FROM blocks GROUP BY bytecode_hash),
bfs AS (SELECT bytecode_hash, 0 AS start_pc, 0 AS d FROM size UNION SELECT f.bytecode_hash, s.dst_pc, f.d + 1 FROM bfs f JOIN step s USING (bytecode_hash, start_pc) JOIN size z USING (bytecode_hash) WHERE f.d + 1 < z.n),
d0 AS (SELECT bytecode_hash, start_pc, min(d) AS d FROM bfs GROUP BY ALL),
bfs2 AS (SELECT bytecode_hash, start_pc, 0 AS d FROM blocks WHERE first_op = '5b' UNION SELECT f.bytecode_hash, s.dst_pc, f.d + 1 FROM bfs2 f JOIN step s USING (bytecode_hash, start_pc) JOIN size z USING (bytecode_hash) WHERE f.d + 1 < z.n),
d1 AS (SELECT bytecode_hash, start_pc, min(d) AS d FROM bfs2 GROUP BY ALL),
free AS (SELECT bytecode_hash, min(d) AS d FROM d0 JOIN edg USING (bytecode_hash, start_pc) WHERE kind = 'all' GROUP BY ALL),
dep AS (SELECT bytecode_hash, start_pc, CAST(min(d) AS INTEGER) AS depth FROM (SELECT * FROM d0 UNION ALL SELECT d1.bytecode_hash, d1.start_pc, d1.d + free.d + 1 FROM d1 JOIN free USING (bytecode_hash)) GROUP BY ALL),
ctx AS (SELECT bytecode_hash, pc, op, blk, stops, NOT (coalesce(lead(op) OVER w IN ('fd', 'fe'), false) OR list_contains(list(op) OVER (w ROWS BETWEEN 10 PRECEDING AND 4 FOLLOWING), 'ff') OR (count(*) OVER (PARTITION BY bytecode_hash, blk) < 3 AND list_contains(list(op) OVER (w ROWS BETWEEN 10 PRECEDING AND 4 FOLLOWING), 'fd'))) AS kept FROM rws WINDOW w AS (PARTITION BY bytecode_hash, blk ORDER BY i)),
ever AS (SELECT c.bytecode_hash, c.pc, c.op, c.blk, p.depth FROM ctx c JOIN blocks b USING (bytecode_hash, blk) JOIN dep p ON p.bytecode_hash = b.bytecode_hash AND p.start_pc = b.start_pc WHERE c.stops = 0 AND (c.op = 'f5' OR (c.op = 'f0' AND c.kept)))
"""


def _verdict_sql(source: str, reached: str) -> str:
    return f"""v AS (SELECT bytecode_hash, list_sort(list(pc) FILTER (op = 'f0')) AS c, list_sort(list(pc) FILTER (op = 'f5')) AS c2 FROM {source} GROUP BY bytecode_hash),
cnt AS (SELECT bytecode_hash, count(*) AS n FROM ins GROUP BY ALL), rc AS ({reached}),
whole AS (SELECT k.bytecode_hash, coalesce(v.c, []) AS c, coalesce(v.c2, []) AS c2, raw.f0, raw.f5, cnt.n, size.n AS nb, rc.n AS nr,
  len(list_filter(raw.f0, lambda x: NOT list_contains(coalesce(v.c, []), x))) + len(list_filter(raw.f5, lambda x: NOT list_contains(coalesce(v.c2, []), x))) AS fp
  FROM codes k JOIN raw USING (bytecode_hash) LEFT JOIN v USING (bytecode_hash) LEFT JOIN cnt USING (bytecode_hash) LEFT JOIN size USING (bytecode_hash) LEFT JOIN rc USING (bytecode_hash))"""


_TYPE = "CASE WHEN len(c) > 0 AND len(c2) > 0 THEN 'BOTH_CREATE_CREATE2' WHEN len(c) > 0 THEN 'CREATE_ONLY' WHEN len(c2) > 0 THEN 'CREATE2_ONLY' ELSE 'NONE' END"
_COLUMNS = f"array_to_string(c, ',') AS create_positions, array_to_string(c2, ',') AS create2_positions, CASE WHEN n IS NULL THEN 0 ELSE fp END AS false_positives, CAST(n AS INTEGER) AS total_instructions, CAST(nb AS INTEGER) AS total_basic_blocks, CAST(nr AS INTEGER) AS reachable_blocks, {_TYPE} AS factory_type"
_BASE = _verdict_sql("ver", "SELECT bytecode_hash, count(*) AS n FROM reach WHERE reachable GROUP BY ALL")
_ENH = _verdict_sql("ever", "SELECT bytecode_hash, count(*) AS n FROM dep GROUP BY ALL") + """,
fb AS (SELECT bytecode_hash, count(DISTINCT blk) AS blocks, count(DISTINCT blk) FILTER (depth >= 5) AS deep FROM ever GROUP BY ALL),
scored AS (SELECT w.*, CASE WHEN n IS NULL THEN NULL ELSE coalesce(fb.blocks, 0) END AS blocks, CASE WHEN n IS NULL THEN NULL ELSE coalesce(fb.deep, 0) END AS deep,
  CASE WHEN n IS NULL THEN NULL WHEN len(c) + len(c2) = 0 THEN 0.0 ELSE least(1.0, greatest(0.0, CASE WHEN len(c) > 0 THEN 0.4 ELSE 0 END + CASE WHEN len(c2) > 0 THEN 0.5 ELSE 0 END + CASE WHEN fb.blocks > 1 THEN 0.2 ELSE 0.15 END + CASE WHEN fb.deep > 0 THEN 0.1 ELSE 0 END
    - 0.15::DOUBLE * fp / (len(f0) + len(f5)) - CASE WHEN nr < 5 THEN 0.1 ELSE 0 END)) END AS score FROM whole w LEFT JOIN fb USING (bytecode_hash))"""


def _sql(text: str) -> str:
    text = text.strip()
    return sql(f"WITH RECURSIVE {CTES.strip()} {text}" if not text.startswith(",") else f"WITH RECURSIVE {CTES.strip()}{text}", "contracts")


ORACLE_SQL = {
    "opcode_histogram": _sql(f"SELECT op, coalesce(({_NAMES})[op], 'UNKNOWN_' || op) AS opcode, CAST(CASE WHEN op BETWEEN '60' AND '7f' THEN CAST('0x' || op AS INTEGER) - 95 ELSE 0 END AS BIGINT) AS operand_size, count(*) AS n FROM ins GROUP BY op"),
    "disassemble": _sql("SELECT bytecode_hash, i, pc, op, operand FROM ins"),
    "basic_blocks": _sql("SELECT bytecode_hash, start_pc, end_pc, n_instructions, contains_create, contains_create2 FROM blocks"),
    "cfg_edges": _sql(f"SELECT bytecode_hash, start_pc, CASE WHEN last_op NOT IN {_in(evm.BREAKS)} THEN next_pc END AS falls_to, last_op IN ('56', '57') AS jumps, CAST(CASE WHEN last_op IN ('56', '57') THEN n_jumpdests + CASE WHEN last_op = '57' AND next_pc IS NOT NULL AND next_op <> '5b' THEN 1 ELSE 0 END WHEN last_op NOT IN {_in(evm.BREAKS)} AND next_pc IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS n_successors FROM blocks"),
    "reachable_blocks": _sql("SELECT bytecode_hash, start_pc, reachable FROM reach"),
    "factory_blocks": _sql("SELECT bytecode_hash, start_pc, contains_create, contains_create2 FROM reach WHERE reachable AND (contains_create OR contains_create2)"),
    "verified_creates": _sql("SELECT * FROM ver"),
    "raw_create_positions": _sql("SELECT bytecode_hash, array_to_string(f0, ',') AS creates, array_to_string(f5, ',') AS create2s FROM raw"),
    "false_positive_positions": _sql("SELECT raw.bytecode_hash, array_to_string(list_sort(list_concat(list_filter(f0, lambda x: NOT list_contains(coalesce(v.c, []), x)), list_filter(f5, lambda x: NOT list_contains(coalesce(v.c2, []), x)))), ',') AS positions FROM raw LEFT JOIN (SELECT bytecode_hash, list(pc) FILTER (op = 'f0') AS c, list(pc) FILTER (op = 'f5') AS c2 FROM ver GROUP BY ALL) v USING (bytecode_hash)"),
    "detect_baseline": _sql(f", {_BASE} SELECT bytecode_hash, len(c) + len(c2) > 0 AS is_factory, {_COLUMNS} FROM whole"),
    "detect_enhanced": _sql(f", {_ENH} SELECT bytecode_hash, coalesce(len(c) + len(c2) > 0 AND score >= 0.3, false) AS is_factory, {_COLUMNS}, CAST(blocks AS INTEGER) AS factory_blocks, CAST(deep AS INTEGER) AS deep_factory_blocks, round(score, 6) AS confidence_score FROM scored"),
    "confidence_score": _sql(f", {_ENH} SELECT bytecode_hash, round(score, 6) AS confidence_score FROM scored WHERE score IS NOT NULL"),
    "static_jump_targets": _sql("SELECT bytecode_hash, jump_pc, target_pc FROM tgt"),
    "enhanced_edges": _sql("SELECT * FROM edg"),
    "block_depth": _sql("SELECT bytecode_hash, start_pc, depth, depth >= 5 AS deep FROM dep"),
    "create_context": _sql("SELECT bytecode_hash, pc, kept FROM ctx WHERE op = 'f0' AND stops = 0"),
    "strip_0x": _sql(f"SELECT bytecode_hash, {_STRIP} AS stripped FROM codes"),
    "bytecode_hash": sql("SELECT address, sha256(coalesce(code, 'None')) AS bytecode_hash FROM v_contracts", "contracts"),
    "naive_create_bytes": _sql("SELECT bytecode_hash, CAST((length(code) - length(replace(code, 'f0', ''))) / 2 AS BIGINT) AS f0, CAST((length(code) - length(replace(code, 'f5', ''))) / 2 AS BIGINT) AS f5 FROM codes"),
}
