"""Queries of scans, joins, planning and progress."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import CHAINS, CUTOFF, KNOWN_FACTORIES, PERIOD_DAYS
from ..functions import evm
from ..operators import kernel
from ..operators import scans as S
from ..operators import paging, skew
from ..operators.bytecode import codes_once, distinct_codes
from ..operators.order import numbered
from ..sources import files, views
from ..sources.views import sql
from ..streaming.jobs import detect_in_batches, keep, scratch

START, END = "1996-01-01", "1998-01-01"
CUT = "1999-01-01"


def _c(spark, sf_dir):
    return views.contracts(spark, sf_dir)


def _results(spark, sf_dir):
    """Detection results of every contract: verdict on its code, with a run time that follows from the block."""
    found = kernel.verdicts(distinct_codes(_c(spark, sf_dir))).select("bytecode_hash", "is_factory", "factory_type")
    contracts = _c(spark, sf_dir).withColumn("bytecode_hash", evm.bytecode_hash(F.col("code"))).drop("code")
    rows = skew.keyed_join(contracts, found, "bytecode_hash").withColumns(S.exclusive_flags(F.col("factory_type")))
    return rows.withColumn("execution_time_ms", (F.col("block_number") % 97).cast("double")).withColumn("deployment_date", F.to_date("block_timestamp"))


def _cached(spark, sf_dir):
    """Addresses whose sources are in the cache."""
    return views.sources(spark, sf_dir).where("id % 3 = 0").select("chain", "address")


def scan_contracts_window(spark, sf_dir):
    return S.scan_window(_c(spark, sf_dir), START, END).select("chain", "address", "block_number", F.length("code").alias("code_length"))


def scan_contracts_join(spark, sf_dir):
    return S.scan_join(views.transactions(spark, sf_dir), views.receipts(spark, sf_dir), START, END).select("address", "block_number", F.length("code").alias("code_length"))


def unique_bytecodes(spark, sf_dir):
    out = S.unique_codes(_c(spark, sf_dir), carry={"code_sha256": F.sha2("code", 256), "code_length": F.length("code")})
    return out.select("chain", "bytecode_hash", "code_sha256", "code_length", "address", "deployment_timestamp", "block_number")


def paged_scan(spark, sf_dir):
    """A page after the first 20 rows, each with its code's digest."""
    first = S.unique_codes(_c(spark, sf_dir), carry={"code_sha256": F.sha2("code", 256)})
    return S.page(first, ["block_number", "address"], 20, 50).select("chain", "address", "block_number", "code_sha256")


#: Rows of a page of the whole table.
PAGE = 40


def keyset_pages(spark, sf_dir):
    """All pages of the unique codes: number, bounds, rows, and the least and largest digest of the codes on them."""
    keys = ["block_number", "address"]
    path = scratch(spark, "pages")
    index = paging.store(S.unique_codes(_c(spark, sf_dir), carry={"c": F.sha2("code", 256)}), keys, path, PAGE)
    rows = spark.read.parquet(f"{path}/rows")
    number = numbered(rows, keys, "_no").select(F.floor((F.col("_no") - 1) / PAGE).cast("long").alias("page"), "c")
    codes = number.groupBy("page").agg(F.min("c").alias("least_code"), F.max("c").alias("largest_code"))
    return index.join(codes, "page").select("page", F.col("first.block_number").alias("first_block"), F.col("first.address").alias("first_address"), F.col("last.block_number").alias("last_block"), F.col("last.address").alias("last_address"), "n", "least_code", "largest_code")


def expand_bytecodes(spark, sf_dir):
    return S.expand(_c(spark, sf_dir), distinct_codes(_c(spark, sf_dir)).where(F.col("bytecode_hash") < "3"), CUT).select("chain", "address", "block_number")


def verdict_expand(spark, sf_dir):
    codes = codes_once(_c(spark, sf_dir).where(F.col("block_timestamp") < F.to_timestamp(F.lit(CUTOFF))), ["block_number"], keep)
    found = kernel.verdicts(codes.where("length(code) > 2")).select("code", "is_factory", "factory_type")
    return S.expand_verdicts(_c(spark, sf_dir), found).select("chain", "address", "is_factory", "factory_type")


def memo_reuse(spark, sf_dir):
    earlier = _results(spark, sf_dir).where("block_number % 2 = 0 AND bytecode_hash < '9'").select("bytecode_hash", "is_factory", "is_create_only", "is_create2_only", "is_both")
    return S.reuse(distinct_codes(_c(spark, sf_dir)), earlier, ["is_factory", "is_create_only", "is_create2_only", "is_both"]).drop("code")


def new_addresses(spark, sf_dir):
    rows = _c(spark, sf_dir).select("chain", "address")
    return S.only_new(rows, rows.where(F.substring("address", 3, 1) < "9"), "chain", "address")


def _hashes(spark, sf_dir):
    """Contracts by their codes' digests, so that neither codes are shuffled nor verdicts reached only to count."""
    return _c(spark, sf_dir).where("code IS NOT NULL").select("chain", evm.bytecode_hash(F.col("code")).alias("bytecode_hash"))


def distinct_bytecodes(spark, sf_dir):
    return _hashes(spark, sf_dir).select("bytecode_hash").distinct()


def duplicate_bytecodes(spark, sf_dir):
    return _hashes(spark, sf_dir).groupBy("bytecode_hash", "chain").agg(F.count("*").alias("n")).where("n > 1")


def count_contracts(spark, sf_dir):
    return _c(spark, sf_dir).groupBy("chain").agg(F.count("*").alias("n"))


def shard_union(spark, sf_dir):
    """The union of all hash shards is the whole; one shuffle takes their place."""
    shard = F.pmod(F.xxhash64("code"), F.lit(64))
    return _c(spark, sf_dir).where("length(code) > 2").withColumn("shard", shard).groupBy("shard", "chain").agg(F.countDistinct(F.sha2("code", 256)).alias("codes"), F.count("*").alias("n")).groupBy("chain").agg(F.sum("codes").alias("codes"), F.sum("n").alias("contracts"))


def result_summary(spark, sf_dir):
    found = kernel.verdicts(distinct_codes(_c(spark, sf_dir)))
    contracts = _c(spark, sf_dir).select("chain", evm.bytecode_hash(F.col("code")).alias("bytecode_hash"), (F.col("block_number") % 97).cast("double").alias("execution_time_ms"))
    out = S.summary_by_code(contracts, found)
    return out.withColumn("avg_execution_time", F.round("avg_execution_time", 6))


def daily_type_counts(spark, sf_dir):
    from ..operators.traces import daily_type_counts as counts

    return counts(_results(spark, sf_dir))


def factory_rate(spark, sf_dir):
    out = _results(spark, sf_dir).agg(F.count("*").alias("contracts"), F.count_if("is_factory").alias("factories"), F.sum("execution_time_ms").alias("ms"))
    return out.select("contracts", "factories", F.round(F.try_divide(F.col("factories") * 100.0, F.col("contracts")), 6).alias("factory_percent"), F.round(F.try_divide("ms", "contracts"), 6).alias("ms_per_contract"))


def unique_factories(spark, sf_dir):
    return kernel.verdicts(distinct_codes(_c(spark, sf_dir))).agg(F.count_if("is_factory").alias("unique_factories"), F.count("*").alias("codes"))


def factory_flags(spark, sf_dir):
    rows = kernel.verdicts(distinct_codes(_c(spark, sf_dir)))
    more = {f"only_{k}": v for k, v in S.exclusive_flags(F.col("factory_type")).items()}
    return rows.withColumns(S.inclusive_flags(F.col("is_factory"), F.col("factory_type"))).withColumns(more).select("bytecode_hash", "is_create", "is_create2", "is_both", *more)


def chain_statistics(spark, sf_dir):
    return S.statistics(_c(spark, sf_dir))


def active_chains(spark, sf_dir):
    return S.active_chains(_c(spark, sf_dir))


def known_factories(spark, sf_dir):
    known = spark.createDataFrame(KNOWN_FACTORIES, "chain string, address string, name string, project string, contract_type string")
    return S.known_factories(known, _c(spark, sf_dir))


def _planned(spark, sf_dir):
    """Periods from each chain's first contract to the cut, by number."""
    plan = S.periods_of(S.active_chains(_c(spark, sf_dir)).select("chain", F.col("first_seen").alias("genesis")), CUT)
    return plan.withColumn("number", S.period_number(F.date_sub("end_date", 1), CUT))


def time_periods(spark, sf_dir):
    """Planned periods with the contracts that fall in them."""
    made = _c(spark, sf_dir).select("chain", S.period_number(F.col("block_timestamp"), CUT).alias("number")).groupBy("chain", "number").agg(F.count("*").alias("contracts"))
    return _planned(spark, sf_dir).join(made, ["chain", "number"], "left").select("chain", "start_date", "end_date", F.coalesce("contracts", F.lit(0)).cast("long").alias("contracts"))


def pending_periods(spark, sf_dir):
    """Planned periods that are not completed; completed are those in which a contract stands whose block is a multiple of 499."""
    done = _c(spark, sf_dir).where("block_number % 499 = 0").select("chain", S.period_number(F.col("block_timestamp"), CUT).alias("number"))
    return S.only_new(_planned(spark, sf_dir), done, "chain", "number").select("chain", "start_date", "end_date")


def _log(spark, sf_dir):
    """An append-only log of periods: begun, and completed for some."""
    p = views.events(spark, sf_dir).select(F.when(F.col("user_id") % 2 == 0, "ethereum").otherwise("polygon").alias("chain"), (F.col("event_id") % 20).alias("period"), F.when(F.col("event_id") % 4 == 3, "completed").otherwise("in_progress").alias("status"), (F.col("event_id") * 3).alias("contracts_processed"), F.col("event_id").alias("updated_at"))
    return p


def progress_upsert(spark, sf_dir):
    return S.progress_log_latest(_log(spark, sf_dir), ["chain", "period"])


def progress_replace(spark, sf_dir):
    """A stored log by chain, of which one chain's partition is exchanged for its newest row; the other chain's stays."""
    path = scratch(spark, "progress")
    _log(spark, sf_dir).write.partitionBy("chain").parquet(path)
    newest = S.progress_log_latest(spark.read.parquet(path).where("chain = 'polygon'"), ["chain"]).drop("chain")
    files.swap_partition(newest, path, "chain", "polygon")
    return spark.read.parquet(path).select("chain", "period", "status", "contracts_processed", "updated_at")


def progress_default(spark, sf_dir):
    chains = spark.createDataFrame(CHAINS, "chain string, query_type string, genesis string, status string").select("chain")
    latest = S.progress_log_latest(_log(spark, sf_dir), ["chain"])
    return chains.join(latest, "chain", "left").select("chain", F.coalesce("contracts_processed", F.lit(0)).cast("bigint").alias("processed_contracts"), F.coalesce("status", F.lit("not_started")).alias("status"))


def progress_stats(spark, sf_dir):
    rows = views.events(spark, sf_dir).select("event_id", (F.col("event_id") % 1000).alias("processed"), F.lit(1000).cast("bigint").alias("total_contracts"), (F.col("event_id") % 50).cast("double").alias("elapsed_s"))
    out = S.progress_stats(rows)
    return out.select("event_id", *[F.round(c, 6).alias(c) for c in ("progress_pct", "rate_per_hour", "eta_hours")])


def resume_plan(spark, sf_dir):
    """Codes that are still to be analysed: those without a result of their hash."""
    done = _results(spark, sf_dir).where("block_number % 60 = 0").select("bytecode_hash")
    return S.only_new(distinct_codes(_c(spark, sf_dir)).select("bytecode_hash"), done, "bytecode_hash")


def detect_batches(spark, sf_dir):
    """What stands in a results table that was filled batch by batch, in two runs."""
    path, rows = scratch(spark, "batches"), _c(spark, sf_dir)
    detect_in_batches(rows, path, 3)
    detect_in_batches(rows, path, 3)
    return spark.read.parquet(path).select("chain", "address", "bytecode_hash", "is_factory", "factory_type")


def results_sink(spark, sf_dir):
    """What an append keeps: one row of each chain and address."""
    rows = _results(spark, sf_dir).select("chain", "address", "is_factory")
    return rows.unionByName(rows.where(F.substring("address", 3, 1) == "A")).dropDuplicates(["chain", "address"])


def factory_only(spark, sf_dir):
    return S.factory_only(views.factory_addresses(spark, sf_dir)).select("chain", "factory_address")


def factory_addresses(spark, sf_dir):
    return views.factory_addresses(spark, sf_dir).where(F.col("chain").isin("ethereum")).select("chain", F.lower("factory_address").alias("factory_address"), S.numeric("total_creations").alias("total_creations"), S.numeric("unique_creations").alias("unique_creations"))


def topn_per_chain(spark, sf_dir):
    return S.top_per_chain(views.factory_addresses(spark, sf_dir), 30, offset=5, limit=20).select("chain", "factory_address", "rank_value", F.col("place").cast("bigint").alias("place"))


def topn_global(spark, sf_dir):
    return S.top_global(views.factory_addresses(spark, sf_dir), 40, "unique_creations").select("chain", "factory_address", "rank_value")


def fetch_plan(spark, sf_dir):
    return S.fetch_plan(views.factory_addresses(spark, sf_dir), _cached(spark, sf_dir), factory=True)


def cache_coverage(spark, sf_dir):
    out = S.coverage(views.factory_addresses(spark, sf_dir), _cached(spark, sf_dir))
    return out.withColumn("percent", F.round("percent", 6))


def factories_with_sources(spark, sf_dir):
    src = views.sources(spark, sf_dir).where("id % 4 <> 0").select("chain", "address", F.element_at("files", 1)["path"].alias("path"))
    made = S.factory_only(views.factory_addresses(spark, sf_dir)).select("chain", F.lower("factory_address").alias("address"), S.numeric("unique_creations").alias("unique_creations"))
    return made.join(S.last_of_each(src, ["chain", "address"], ["path"]), ["chain", "address"])


def weights_lookup(spark, sf_dir):
    src = views.sources(spark, sf_dir).select("chain", "address")
    w = views.factory_addresses(spark, sf_dir).where("id % 5 <> 0").select("chain", F.lower("factory_address").alias("address"), S.numeric("unique_creations").alias("w"))
    return src.join(w, ["chain", "address"], "left").select("chain", "address", F.coalesce("w", F.lit(1.0)).alias("weight"))


def address_normalise(spark, sf_dir):
    raw = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("M_"), F.col("p_name"))).when(F.col("p_partkey") % 5 == 1, F.concat(F.lit(" "), F.substring(F.sha2(F.col("p_partkey").cast("string"), 256), 1, 40))).when(F.col("p_partkey") % 5 == 2, F.lit("0x12")).otherwise(F.concat(F.lit("0x"), F.substring(F.sha2(F.col("p_partkey").cast("string"), 256), 1, 40)))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", S.normalised_address(raw).alias("address"))


def mock_contracts(spark, sf_dir):
    """Addresses and codes made up from blocks' and customers' numbers."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(F.col("o_orderkey").alias("id"), S.mock_address(F.col("o_orderkey")).alias("address"), S.mock_code(F.col("o_custkey")).alias("bytecode"))


QUERIES = {f.__name__: f for f in (scan_contracts_window, scan_contracts_join, unique_bytecodes, paged_scan, keyset_pages, expand_bytecodes, verdict_expand, memo_reuse, new_addresses, distinct_bytecodes, duplicate_bytecodes, count_contracts, shard_union, result_summary, daily_type_counts, factory_rate, unique_factories, factory_flags, chain_statistics, active_chains, known_factories, time_periods, pending_periods, progress_upsert, progress_replace, progress_default, progress_stats, resume_plan, detect_batches, results_sink, factory_only, factory_addresses, topn_per_chain, topn_global, fetch_plan, cache_coverage, factories_with_sources, weights_lookup, address_normalise, mock_contracts)}

from . import bytecode as _b  # noqa: E402

_V = f"{_b.CTES.strip()}, {_b._BASE}, vd AS (SELECT k.code, k.bytecode_hash, len(c) + len(c2) > 0 AS is_factory, {_b._TYPE} AS factory_type FROM whole w JOIN codes k USING (bytecode_hash)),\nres AS (SELECT c.*, v.bytecode_hash, v.is_factory, v.factory_type, v.factory_type = 'CREATE_ONLY' AS is_create_only, v.factory_type = 'CREATE2_ONLY' AS is_create2_only, v.factory_type = 'BOTH_CREATE_CREATE2' AS is_both, CAST(c.block_number % 97 AS DOUBLE) AS execution_time_ms, CAST(c.block_timestamp AS DATE) AS deployment_date FROM v_contracts c JOIN vd v USING (code))"


def _r(text: str) -> str:
    return sql(f"WITH RECURSIVE {_V} {text}", "contracts")


_UNIQUE = f"uq AS (SELECT * FROM v_contracts WHERE block_timestamp < TIMESTAMP '{CUTOFF}' AND code IS NOT NULL AND length(code) > 2 QUALIFY row_number() OVER (PARTITION BY chain, code ORDER BY block_number, block_timestamp, address) = 1)"
_CH = "ch AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', '{d}')" for a, b, c, d in CHAINS) + ") t(chain, query_type, genesis, status))"
_SEEN = f"{_CH}, seen AS (SELECT chain, query_type, CAST(min(block_timestamp) AS DATE) AS first_seen, CAST(max(block_timestamp) AS DATE) AS last_seen, count(*) AS contracts FROM v_contracts JOIN ch USING (chain) WHERE status = 'active' GROUP BY chain, query_type)"
_PER = f"""{_SEEN}, per AS (SELECT chain, greatest(CAST(e - INTERVAL {PERIOD_DAYS} DAY AS DATE), first_seen) AS start_date, CAST(e AS DATE) AS end_date FROM (
  SELECT chain, first_seen, unnest(generate_series(TIMESTAMP '{CUT}', CAST(first_seen AS TIMESTAMP) + INTERVAL 1 DAY, INTERVAL (-{PERIOD_DAYS}) DAY)) AS e FROM seen WHERE first_seen < DATE '{CUT}'))"""
_LOG = "lg AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'ethereum' ELSE 'polygon' END AS chain, event_id % 20 AS period, CASE WHEN event_id % 4 = 3 THEN 'completed' ELSE 'in_progress' END AS status, event_id * 3 AS contracts_processed, event_id AS updated_at FROM events)"
_NUM = "TRY_CAST({} AS DOUBLE)"
_U, _T = _NUM.format("unique_creations"), _NUM.format("total_creations")
_CACHED = "cached AS (SELECT chain, address FROM v_sources WHERE id % 3 = 0)"

ORACLE_SQL = {
    "scan_contracts_window": sql(f"SELECT chain, lower(address) AS address, block_number, CAST(length(code) AS INTEGER) AS code_length FROM v_contracts WHERE block_timestamp >= TIMESTAMP '{START}' AND block_timestamp < TIMESTAMP '{END}' AND code IS NOT NULL AND length(code) > 0", "contracts"),
    "scan_contracts_join": sql(f"SELECT lower(r.contract_address) AS address, t.block_number, CAST(length(t.input) AS INTEGER) AS code_length FROM v_transactions t JOIN v_receipts r ON t.hash = r.transaction_hash WHERE t.to_address IS NULL AND r.contract_address IS NOT NULL AND r.status = 1 AND length(t.input) > 2 AND t.block_timestamp >= TIMESTAMP '{START}' AND t.block_timestamp < TIMESTAMP '{END}'", "transactions", "receipts"),
    "unique_bytecodes": sql(f"WITH {_UNIQUE} SELECT chain, sha256(code) AS bytecode_hash, sha256(code) AS code_sha256, CAST(length(code) AS INTEGER) AS code_length, address, block_timestamp AS deployment_timestamp, block_number FROM uq", "contracts"),
    "keyset_pages": sql(
        f"WITH {_UNIQUE}, n AS (SELECT *, (row_number() OVER (ORDER BY block_number, address) - 1) // {PAGE} AS page FROM uq) SELECT page, min(block_number) AS first_block, arg_min(address, (block_number, address)) AS first_address, max(block_number) AS last_block, "
        "arg_max(address, (block_number, address)) AS last_address, count(*) AS n, min(sha256(code)) AS least_code, max(sha256(code)) AS largest_code FROM n GROUP BY page", "contracts"),
    "paged_scan": sql(f"WITH {_UNIQUE} SELECT chain, address, block_number, sha256(code) AS code_sha256 FROM uq ORDER BY block_number, address LIMIT 50 OFFSET 20", "contracts"),
    "expand_bytecodes": sql(f"SELECT chain, address, block_number FROM v_contracts WHERE block_timestamp < TIMESTAMP '{CUT}' AND code IN (SELECT code FROM v_contracts WHERE code IS NOT NULL AND sha256(code) < '3')", "contracts"),
    "verdict_expand": _r(", lowered AS (SELECT DISTINCT ON (lower(code)) lower(code) AS k, is_factory, factory_type FROM vd WHERE length(code) > 2) SELECT c.chain, c.address, l.is_factory, l.factory_type FROM v_contracts c JOIN lowered l ON lower(c.code) = l.k"),
    "memo_reuse": _r(", memo AS (SELECT bytecode_hash, any_value(is_factory) AS is_factory, any_value(is_create_only) AS is_create_only, any_value(is_create2_only) AS is_create2_only, any_value(is_both) AS is_both FROM res WHERE block_number % 2 = 0 AND bytecode_hash < '9' GROUP BY 1) SELECT k.bytecode_hash, m.is_factory, m.is_create_only, m.is_create2_only, m.is_both FROM codes k LEFT JOIN memo m USING (bytecode_hash)"),
    "new_addresses": sql("SELECT chain, address FROM v_contracts WHERE NOT substr(address, 3, 1) < '9'", "contracts"),
    "distinct_bytecodes": sql("SELECT DISTINCT sha256(code) AS bytecode_hash FROM v_contracts WHERE code IS NOT NULL", "contracts"),
    "duplicate_bytecodes": sql("SELECT sha256(code) AS bytecode_hash, chain, count(*) AS n FROM v_contracts WHERE code IS NOT NULL GROUP BY ALL HAVING count(*) > 1", "contracts"),
    "count_contracts": sql("SELECT chain, count(*) AS n FROM v_contracts GROUP BY chain", "contracts"),
    "shard_union": sql("SELECT chain, count(DISTINCT code) AS codes, count(*) AS contracts FROM v_contracts WHERE length(code) > 2 GROUP BY chain", "contracts"),
    "result_summary": _r("SELECT chain, count(*) AS total_contracts, count(*) FILTER (is_factory) AS total_factories, count(*) FILTER (is_create_only) AS create_only, count(*) FILTER (is_create2_only) AS create2_only, count(*) FILTER (is_both) AS both, round(avg(execution_time_ms), 6) AS avg_execution_time FROM res GROUP BY chain"),
    "daily_type_counts": _r("SELECT chain, deployment_date, count(*) AS total_factories, count(*) FILTER (is_create_only) AS create_only, count(*) FILTER (is_create2_only) AS create2_only, count(*) FILTER (is_both) AS both FROM res WHERE is_factory GROUP BY ALL"),
    "factory_rate": _r("SELECT count(*) AS contracts, count(*) FILTER (is_factory) AS factories, round(count(*) FILTER (is_factory) * 100.0::DOUBLE / count(*), 6) AS factory_percent, round(sum(execution_time_ms) / count(*), 6) AS ms_per_contract FROM res"),
    "unique_factories": _r("SELECT count(*) FILTER (is_factory) AS unique_factories, count(*) AS codes FROM vd"),
    "factory_flags": _r("SELECT bytecode_hash, CASE WHEN is_factory THEN factory_type IN ('CREATE_ONLY', 'BOTH_CREATE_CREATE2') END AS is_create, CASE WHEN is_factory THEN factory_type IN ('CREATE2_ONLY', 'BOTH_CREATE_CREATE2') END AS is_create2, CASE WHEN is_factory THEN factory_type = 'BOTH_CREATE_CREATE2' END AS is_both, factory_type = 'CREATE_ONLY' AS only_is_create_only, factory_type = 'CREATE2_ONLY' AS only_is_create2_only, factory_type = 'BOTH_CREATE_CREATE2' AS only_is_both FROM vd"),
    "chain_statistics": sql("WITH s AS (SELECT chain, count(*) AS total_contracts, count(DISTINCT code) AS unique_bytecodes FROM v_contracts GROUP BY chain) SELECT * FROM s UNION ALL SELECT 'all', CAST(sum(total_contracts) AS BIGINT), CAST(sum(unique_bytecodes) AS BIGINT) FROM s", "contracts"),
    "active_chains": sql(f"WITH {_SEEN} SELECT * FROM seen", "contracts"),
    "known_factories": sql(
        "WITH k AS (SELECT * FROM (VALUES " + ", ".join(str(r) for r in KNOWN_FACTORIES) + ") t(chain, address, name, project, contract_type)) "
        "SELECT *, EXISTS (SELECT 1 FROM v_contracts c WHERE c.chain = k.chain AND lower(c.address) = lower(k.address)) AS seen, (SELECT count(*) FROM v_contracts c WHERE c.chain = k.chain) AS chain_contracts FROM k", "contracts"),
    "time_periods": sql(f"WITH {_PER} SELECT per.*, (SELECT count(*) FROM v_contracts c WHERE c.chain = per.chain AND c.block_timestamp >= per.start_date AND c.block_timestamp < per.end_date) AS contracts FROM per", "contracts"),
    "pending_periods": sql(f"WITH {_PER} SELECT * FROM per WHERE NOT EXISTS (SELECT 1 FROM v_contracts c WHERE c.chain = per.chain AND c.block_number % 499 = 0 AND c.block_timestamp >= per.start_date AND c.block_timestamp < per.end_date)", "contracts"),
    "progress_upsert": f"WITH {_LOG} SELECT * FROM lg QUALIFY row_number() OVER (PARTITION BY chain, period ORDER BY updated_at DESC) = 1",
    "progress_replace": f"WITH {_LOG} SELECT * FROM lg WHERE chain <> 'polygon' UNION ALL (SELECT * FROM lg WHERE chain = 'polygon' ORDER BY updated_at DESC LIMIT 1)",
    "progress_default": f"WITH {_CH}, {_LOG}, last AS (SELECT * FROM lg QUALIFY row_number() OVER (PARTITION BY chain ORDER BY updated_at DESC) = 1) SELECT ch.chain, coalesce(contracts_processed, 0) AS processed_contracts, coalesce(last.status, 'not_started') AS status FROM ch LEFT JOIN last USING (chain)",
    "progress_stats": "WITH r AS (SELECT event_id, event_id % 1000 AS processed, event_id % 50 AS s FROM events), q AS (SELECT *, CASE WHEN s > 0 THEN processed / s ELSE 0.0 END::DOUBLE AS rate FROM r) SELECT event_id, round(processed * 100.0::DOUBLE / 1000, 6) AS progress_pct, round(rate * 3600, 6) AS rate_per_hour, round(CASE WHEN rate > 0 THEN (1000 - processed) / rate ELSE 0.0 END::DOUBLE / 3600, 6) AS eta_hours FROM q",
    "resume_plan": sql("SELECT DISTINCT sha256(code) AS bytecode_hash FROM v_contracts WHERE code IS NOT NULL AND code NOT IN (SELECT code FROM v_contracts WHERE block_number % 60 = 0 AND code IS NOT NULL)", "contracts"),
    "detect_batches": _r("SELECT DISTINCT chain, address, bytecode_hash, is_factory, factory_type FROM res"),
    "results_sink": _r("SELECT DISTINCT chain, address, is_factory FROM res"),
    "factory_only": sql(f"SELECT chain, factory_address FROM v_factory_addresses WHERE coalesce({_U} >= 1, false) OR {_T} >= 1", "factory_addresses"),
    "factory_addresses": sql(f"SELECT chain, lower(factory_address) AS factory_address, {_T} AS total_creations, {_U} AS unique_creations FROM v_factory_addresses WHERE chain = 'ethereum'", "factory_addresses"),
    "topn_per_chain": sql(f"SELECT chain, factory_address, {_T} AS rank_value, row_number() OVER (PARTITION BY chain ORDER BY {_T} DESC, factory_address) AS place FROM v_factory_addresses WHERE {_T} IS NOT NULL QUALIFY place > 5 AND place <= 25", "factory_addresses"),
    "topn_global": sql(f"SELECT chain, factory_address, {_U} AS rank_value FROM v_factory_addresses WHERE {_U} IS NOT NULL ORDER BY rank_value DESC, factory_address LIMIT 40", "factory_addresses"),
    "fetch_plan": sql(f"WITH {_CACHED} SELECT DISTINCT f.chain, lower(factory_address) AS address FROM v_factory_addresses f WHERE {_U} >= 1 AND NOT EXISTS (SELECT 1 FROM cached c WHERE c.chain = f.chain AND c.address = lower(f.factory_address))", "factory_addresses", "sources"),
    "cache_coverage": sql(f"WITH {_CACHED}, w AS (SELECT DISTINCT chain, lower(factory_address) AS address FROM v_factory_addresses) SELECT w.chain, count(*) AS total, count(c.address) AS cached, round(count(c.address) * 100.0::DOUBLE / count(*), 6) AS percent FROM w LEFT JOIN cached c USING (chain, address) GROUP BY w.chain", "factory_addresses", "sources"),
    "factories_with_sources": sql(f"SELECT f.chain, lower(f.factory_address) AS address, {_U} AS unique_creations, s.path FROM v_factory_addresses f JOIN v_sources s ON s.chain = f.chain AND s.address = lower(f.factory_address) WHERE s.id % 4 <> 0 AND (coalesce({_U} >= 1, false) OR {_T} >= 1)", "factory_addresses", "sources"),
    "weights_lookup": sql(f"SELECT s.chain, s.address, coalesce({_U}, 1.0)::DOUBLE AS weight FROM v_sources s LEFT JOIN (SELECT * FROM v_factory_addresses WHERE id % 5 <> 0) f ON f.chain = s.chain AND lower(f.factory_address) = s.address", "factory_addresses", "sources"),
    "address_normalise": "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 2 THEN NULL ELSE '0x' || substr(sha256(CAST(p_partkey AS VARCHAR)), 1, 40) END AS address FROM part",
    "mock_contracts": "SELECT o_orderkey AS id, '0x' || lpad(lower(hex(o_orderkey)), 40, '0') AS address, '0x' || lpad(lower(hex(o_custkey)), 64, '0') AS bytecode FROM orders",
}
