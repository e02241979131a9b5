"""Queries of what comes in: scans by kind of chain, fetched rows, appends, and detection by SQL and table functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bytecode as B
from ..operators import kernel
from ..operators import scans as S
from ..sources import files, views
from ..sources.views import sql
from ..streaming import jobs
from . import bytecode as _b

START, END = "1996-01-01", "1998-01-01"
#: Chains of the views, by the kind of their tables; the longest code that guarded detection looks at.
KINDS, LONGEST = {"ethereum": "direct", "polygon": "direct", "arbitrum": "join"}, 600


def scan_dispatch(spark, sf_dir):
    """Every chain by its kind of scan."""
    out = None
    for chain, kind in KINDS.items():
        tables = {"contracts": lambda chain=chain: views.contracts(spark, sf_dir).where(F.col("chain") == chain), "transactions": lambda: views.transactions(spark, sf_dir), "receipts": lambda: views.receipts(spark, sf_dir)}
        found = S.scan_chain(kind, tables, START, END).select(F.lit(chain).alias("chain"), "address", "block_number", F.length("code").alias("code_length"))
        out = found if out is None else out.unionByName(found)
    return out


def renamed_columns(spark, sf_dir):
    return S.renamed(views.transactions(spark, sf_dir), {"transaction_hash": "hash", "code": "input", "block_number": "block_number"}).select("transaction_hash", "block_number", F.length("code").alias("code_length"))


def _fetched(spark, sf_dir):
    """Rows as a service gives them: times as text of several forms, some missing or wrong."""
    k = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    time = F.when(k % 11 == 0, F.lit(None)).when(k % 13 == 0, F.lit("soon")).when(k % 3 == 0, F.concat(day, F.lit("T01:02:03Z"))).when(k % 3 == 1, F.concat(day, F.lit("T01:02:03+01:00"))).otherwise(F.concat(day, F.lit(" 01:02:03")))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("block_number"), time.alias("block_timestamp"), F.when(k % 17 == 0, F.lit(None)).otherwise(F.concat(F.lit("0xAB"), k.cast("string"))).alias("address"))


def fetch_normalised(spark, sf_dir):
    return S.good(S.normalised(_fetched(spark, sf_dir), F.lit("2020-01-01").cast("timestamp"))).select("block_number", "address", F.date_format("block_timestamp", "yyyy-MM-dd HH:mm:ss").alias("time"))


def fetch_problems(spark, sf_dir):
    """How many rows are passed over, and why."""
    return S.normalised(_fetched(spark, sf_dir)).where("problem IS NOT NULL").groupBy("problem").agg(F.count("*").alias("n"))


def last_block(spark, sf_dir):
    return S.last_block(views.contracts(spark, sf_dir))


def chain_titles(spark, sf_dir):
    return views.contracts(spark, sf_dir).groupBy(F.initcap("chain").alias("chain")).agg(F.count("*").alias("n"))


def results_append(spark, sf_dir):
    """What two appends keep that have half of their rows in common, the second with a further column."""
    path = jobs.scratch(spark, "results")
    rows = views.contracts(spark, sf_dir).select("chain", "address", "block_number")
    files.append_results(rows.where("block_number % 2 = 0"), path)
    files.append_results(rows.withColumn("extra", F.lit(1)), path)
    return files.read_results(spark, path).select("chain", "address", "block_number", "extra")


def fetch_fixpoint(spark, sf_dir):
    """Addresses that no source can be fetched for, after rounds of which each brings some."""
    path = jobs.scratch(spark, "fetched")
    have = views.sources(spark, sf_dir).where("id % 4 <> 0").select("chain", "address")
    have.limit(0).write.parquet(path)
    cached = lambda: spark.read.parquet(path)

    def fetch(left):
        found = left.join(have, ["chain", "address"], "left_semi")
        first = found.where(F.substring("address", 3, 1) < "8")
        (found if first.isEmpty() else first).write.mode("append").parquet(path)

    wanted = views.factory_addresses(spark, sf_dir).select("chain", "factory_address")
    S.fetch_until_settled(wanted, cached, fetch)
    return S.fetch_plan(wanted, cached())


def input_fallback(spark, sf_dir):
    """Addresses of the first provider that has some."""
    real = lambda: views.factory_addresses(spark, sf_dir).select("chain", "factory_address")
    return S.first_available(lambda: spark.read.parquet(f"{sf_dir}/absent.parquet"), lambda: real().limit(0), real)


def _codes(spark, sf_dir):
    kernel.register(spark)
    return B.codes_once(views.contracts(spark, sf_dir), ["block_number"], jobs.keep)


def block_info(spark, sf_dir):
    return B.block_info(B.block_rows(B.with_blocks(B.instruction_rows(B.dealt(_codes(spark, sf_dir))))))


def block_info_depth(spark, sf_dir):
    """Blocks with the depth at which the enhanced search reaches them, null where it does not."""
    codes = B.dealt(_codes(spark, sf_dir))
    info = B.block_rows(B.with_blocks(B.instruction_rows(codes))).select("bytecode_hash", "start_pc", "end_pc", "n_instructions", "contains_create", "contains_create2")
    return info.join(kernel.block_rows(codes, "bytecode_hash"), ["bytecode_hash", "start_pc"], "left")


def table_function_blocks(spark, sf_dir):
    return spark.sql("SELECT c.bytecode_hash, b.* FROM {codes} c, LATERAL basic_blocks(c.code) b", codes=_codes(spark, sf_dir)).withColumn("n_instructions", F.col("n_instructions").cast("bigint"))


def table_function_instructions(spark, sf_dir):
    return spark.sql("SELECT c.bytecode_hash, d.* FROM {codes} c, LATERAL disassemble(c.code) d", codes=_codes(spark, sf_dir))


def _verdict(found, false: str):
    text = lambda c: F.array_join(found[c].cast("array<string>"), ",").alias(c)
    return found.select("bytecode_hash", "is_factory", "factory_type", text("create_positions"), text("create2_positions"), F.size(false).cast("bigint").alias("false_positives"))


def detect_function(spark, sf_dir):
    return _verdict(spark.sql("SELECT bytecode_hash, v.* FROM (SELECT bytecode_hash, detect_factory(code) AS v FROM {codes})", codes=_codes(spark, sf_dir)), "false_positive_positions")


def detect_function_enhanced(spark, sf_dir):
    return _verdict(spark.sql("SELECT bytecode_hash, v.* FROM (SELECT bytecode_hash, detect_factory_enhanced(code) AS v FROM {codes})", codes=_codes(spark, sf_dir)), "false_positive_positions")


def detect_improved(spark, sf_dir):
    """The older interface: its function, and the verdicts under its names."""
    codes = _codes(spark, sf_dir)
    by_name = _verdict(spark.sql("SELECT bytecode_hash, v.* FROM (SELECT bytecode_hash, detect_factory_improved(code) AS v FROM {codes})", codes=codes), "false_positives")
    same = kernel.legacy(kernel.verdicts(codes)).select("bytecode_hash", F.size("false_positives").cast("bigint").alias("n"), "cfg_analysis")
    return by_name.join(same, "bytecode_hash").withColumn("cfg_analysis", F.col("cfg_analysis") & (F.col("n") == F.col("false_positives"))).drop("n")


def detect_guarded(spark, sf_dir):
    """Codes longer than a bound count as timed out."""
    found = kernel.verdicts(_codes(spark, sf_dir), longest=LONGEST)
    return found.select("bytecode_hash", "is_factory", "factory_type", "error", F.when(F.col("error") == "timeout", 10000).otherwise(0).alias("execution_time_ms"))


#: Steps that the analysis of a code may take in detect_budgeted.
STEPS = 250


def detect_budgeted(spark, sf_dir):
    """Codes whose baseline analysis takes more steps than a bound count as timed out, whatever their length."""
    found = kernel.verdicts(_codes(spark, sf_dir), may=STEPS)
    return found.select("bytecode_hash", "is_factory", "factory_type", "error", F.when(F.col("error") == "timeout", 10000).otherwise(0).alias("execution_time_ms"))


QUERIES = {f.__name__: f for f in (scan_dispatch, renamed_columns, fetch_normalised, fetch_problems, last_block, chain_titles, results_append, fetch_fixpoint, input_fallback, block_info, block_info_depth, table_function_blocks, table_function_instructions, detect_function, detect_function_enhanced, detect_improved, detect_guarded, detect_budgeted)}

_DIRECT = f"SELECT chain, lower(address) AS address, block_number, CAST(length(code) AS INTEGER) AS code_length FROM v_contracts WHERE block_timestamp >= TIMESTAMP '{START}' AND block_timestamp < TIMESTAMP '{END}' AND code IS NOT NULL AND length(code) > 0"
_JOIN = f"SELECT 'arbitrum', lower(r.contract_address), t.block_number, CAST(length(t.input) AS INTEGER) FROM v_transactions t JOIN v_receipts r ON t.hash = r.transaction_hash WHERE t.to_address IS NULL AND r.contract_address IS NOT NULL AND r.status = 1 AND length(t.input) > 2 AND t.block_timestamp >= TIMESTAMP '{START}' AND t.block_timestamp < TIMESTAMP '{END}'"
_TIME = "CASE WHEN o_orderkey % 11 = 0 THEN '2020-01-01 00:00:00' ELSE strftime(o_orderdate + CASE WHEN o_orderkey % 3 = 1 THEN INTERVAL 123 SECOND ELSE INTERVAL 3723 SECOND END, '%Y-%m-%d %H:%M:%S') END"
_BAD_TIME = "o_orderkey % 11 <> 0 AND o_orderkey % 13 = 0"
_EDGES = f"e AS (SELECT DISTINCT bytecode_hash, start_pc, dst FROM (SELECT bytecode_hash, start_pc, next_pc AS dst FROM blocks WHERE last_op NOT IN {_b._in(_b.evm.BREAKS)} AND next_pc IS NOT NULL UNION ALL SELECT a.bytecode_hash, a.start_pc, b.start_pc FROM blocks a JOIN blocks b USING (bytecode_hash) WHERE a.last_op IN ('56', '57') AND b.first_op = '5b'))"
_POSITIONS = f"bytecode_hash, {_b._TYPE} AS factory_type, array_to_string(c, ',') AS create_positions, array_to_string(c2, ',') AS create2_positions, CASE WHEN n IS NULL THEN 0 ELSE fp END AS false_positives"

ORACLE_SQL = {
    "scan_dispatch": sql(f"{_DIRECT} UNION ALL {_JOIN}", "contracts", "transactions", "receipts"),
    "renamed_columns": sql("SELECT hash AS transaction_hash, block_number, CAST(length(input) AS INTEGER) AS code_length FROM v_transactions", "transactions"),
    "fetch_normalised": f"SELECT o_orderkey AS block_number, lower('0xAB' || o_orderkey) AS address, {_TIME} AS time FROM orders WHERE o_orderkey % 17 <> 0 AND NOT ({_BAD_TIME})",
    "fetch_problems": f"SELECT CASE WHEN o_orderkey % 17 = 0 THEN 'address' ELSE 'time' END AS problem, count(*) AS n FROM orders WHERE o_orderkey % 17 = 0 OR ({_BAD_TIME}) GROUP BY 1",
    "last_block": sql("SELECT chain, max(block_number) AS last_block FROM v_contracts GROUP BY chain", "contracts"),
    "chain_titles": sql("SELECT upper(chain[1]) || substr(chain, 2) AS chain, count(*) AS n FROM v_contracts GROUP BY 1", "contracts"),
    "results_append": sql("SELECT chain, address, block_number, CASE WHEN block_number % 2 = 0 THEN NULL ELSE 1 END AS extra FROM v_contracts", "contracts"),
    "fetch_fixpoint": sql("SELECT DISTINCT f.chain, lower(f.factory_address) AS address FROM v_factory_addresses f WHERE NOT EXISTS (SELECT 1 FROM v_sources s WHERE s.id % 4 <> 0 AND s.chain = f.chain AND s.address = lower(f.factory_address))", "factory_addresses", "sources"),
    "input_fallback": sql("SELECT chain, factory_address FROM v_factory_addresses", "factory_addresses"),
    "block_info": _b._sql(f", {_EDGES}, o AS (SELECT bytecode_hash, start_pc, count(*) AS n FROM e GROUP BY ALL), i AS (SELECT bytecode_hash, dst AS start_pc, count(*) AS n FROM e GROUP BY ALL) SELECT b.bytecode_hash, b.start_pc, b.end_pc, b.n_instructions, b.contains_create, b.contains_create2, b.reachable, coalesce(o.n, 0) AS n_successors, coalesce(i.n, 0) AS n_predecessors FROM reach b LEFT JOIN o USING (bytecode_hash, start_pc) LEFT JOIN i USING (bytecode_hash, start_pc)"),
    "block_info_depth": _b._sql("SELECT b.bytecode_hash, b.start_pc, b.end_pc, b.n_instructions, b.contains_create, b.contains_create2, dep.depth FROM blocks b LEFT JOIN dep USING (bytecode_hash, start_pc)"),
    "table_function_blocks": _b._sql("SELECT bytecode_hash, start_pc, end_pc, n_instructions, contains_create, contains_create2, reachable FROM reach"),
    "table_function_instructions": _b._sql("SELECT bytecode_hash, i, pc, op, operand FROM ins"),
    "detect_function": _b._sql(f", {_b._BASE} SELECT {_POSITIONS}, len(c) + len(c2) > 0 AS is_factory FROM whole"),
    "detect_function_enhanced": _b._sql(f", {_b._ENH} SELECT {_POSITIONS}, coalesce(len(c) + len(c2) > 0 AND score >= 0.3, false) AS is_factory FROM scored"),
    "detect_improved": _b._sql(f", {_b._BASE} SELECT {_POSITIONS}, len(c) + len(c2) > 0 AS is_factory, true AS cfg_analysis FROM whole"),
    "detect_guarded": _b._sql(f", {_b._BASE} SELECT bytecode_hash, length(k.code) <= {LONGEST} AND len(c) + len(c2) > 0 AS is_factory, CASE WHEN length(k.code) > {LONGEST} THEN 'NONE' ELSE {_b._TYPE} END AS factory_type, CASE WHEN length(k.code) > {LONGEST} THEN 'timeout' WHEN n IS NULL THEN 'No valid instructions found' END AS error, CASE WHEN length(k.code) > {LONGEST} THEN 10000 ELSE 0 END AS execution_time_ms FROM whole JOIN codes k USING (bytecode_hash)"),
}
