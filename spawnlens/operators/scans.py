"""Scans, deduplication, reuse of earlier verdicts, expansion, and progress."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import CHAINS, CUTOFF, PERIOD_DAYS
from ..functions import evm
from . import skew


def scan_window(contracts: DataFrame, start: str, end: str, least: int = 0, code_col: str = "code") -> DataFrame:
    """Contracts of [start, end) whose code is longer than `least`; addresses in lower case."""
    kept = (F.col("block_timestamp") >= F.to_timestamp(F.lit(start))) & (F.col("block_timestamp") < F.to_timestamp(F.lit(end))) & F.col(code_col).isNotNull() & (F.length(code_col) > least)
    return contracts.where(kept).withColumn("address", F.lower("address"))


def scan_join(transactions: DataFrame, receipts: DataFrame, start: str, end: str) -> DataFrame:
    """Deployments of chains without a contracts table: transactions without a recipient whose receipt has a contract and succeeded."""
    sent = transactions.where(F.col("to_address").isNull() & (F.col("block_timestamp") >= F.to_timestamp(F.lit(start))) & (F.col("block_timestamp") < F.to_timestamp(F.lit(end))) & F.col("input").isNotNull() & (F.length("input") > 2))
    done = receipts.where(F.col("contract_address").isNotNull() & (F.col("status") == 1))
    return sent.join(done, sent["hash"] == done["transaction_hash"]).select(F.lower("contract_address").alias("address"), F.col("input").alias("code"), "block_timestamp", "block_number", "transaction_hash")


def kept_codes(contracts: DataFrame, cutoff: str = CUTOFF) -> DataFrame:
    """Contracts before the cutoff whose code is not empty."""
    return contracts.where((F.col("block_timestamp") < F.to_timestamp(F.lit(cutoff))) & F.col("code").isNotNull() & (F.length("code") > 2))


def scan_chain(kind: str, tables: dict[str, DataFrame], start: str, end: str) -> DataFrame:
    """Contracts of one chain by the kind of its tables: direct (contracts) or join (transactions and receipts).

    tables: by name; a function that reads one may stand for it, so that only the tables of the kind are read.
    """
    read = lambda name: tables[name]() if callable(tables[name]) else tables[name]
    if kind == "direct":
        found = scan_window(read("contracts"), start, end)
    elif kind == "join":
        found = scan_join(read("transactions"), read("receipts"), start, end)
    else:
        raise ValueError(f"unknown kind of scan: {kind}")
    return found.select("address", "code", "block_timestamp", "block_number", "transaction_hash")


def renamed(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns of a chain's table under common names: names is {common: own}."""
    return rows.select(*[F.col(own).alias(common) for common, own in names.items()])


def normalised(rows: DataFrame, now: Column | None = None) -> DataFrame:
    """Fetched rows with addresses in lower case and times as times, and problem: why a row is to be passed over, null if it is good.

    A time may be text by ISO 8601, with Z or an offset; a missing one is now. A row without an address, or whose time is no time, is bad.
    """
    told = F.col("block_timestamp")
    time = F.expr("try_cast(block_timestamp AS timestamp)")
    problem = F.when(F.col("address").isNull(), "address").when(told.isNotNull() & time.isNull(), "time")
    fixed = F.when(told.isNull(), F.current_timestamp() if now is None else now).otherwise(time)
    return rows.withColumns({"problem": problem, "address": F.lower("address"), "block_timestamp": fixed})


def good(rows: DataFrame) -> DataFrame:
    return rows.where("problem IS NULL").drop("problem")


def last_block(rows: DataFrame) -> DataFrame:
    return rows.groupBy("chain").agg(F.max("block_number").alias("last_block"))


def fetch_until_settled(wanted: DataFrame, cached, fetch, rounds: int = 100) -> int:
    """Fetches what is wanted and not in the cache, again and again until nothing is left or a round brings nothing new; the number of addresses left.

    cached(): the cache as it is now. fetch(left): tries to fetch addresses into the cache.
    """
    left = fetch_plan(wanted, cached()).count()
    for _ in range(rounds):
        if not left:
            break
        fetch(fetch_plan(wanted, cached()))
        now = fetch_plan(wanted, cached()).count()
        if now >= left:
            break
        left = now
    return left


def first_available(*providers) -> DataFrame:
    """The first provider's rows that can be read and are not none; an error that names all failures if there are none."""
    failures = []
    for provider in providers:
        try:
            rows = provider()
            if not rows.isEmpty():
                return rows
            failures.append("no rows")
        except (PySparkException, OSError) as e:
            failures.append(str(e).splitlines()[0])
    raise FileNotFoundError("no provider has the rows: " + "; ".join(failures))


def unique_codes(contracts: DataFrame, cutoff: str = CUTOFF, carry: dict[str, Column] | None = None) -> DataFrame:
    """The first contract of each code and chain, by block, time, address, with its code. Codes are told apart by digest, and each task sends one row of a code on, so
    that what is shuffled is as large as the different codes of each task.

    carry: by name, what is wanted of the code instead of the code itself, such as its length; then no code is sorted or shuffled. It must follow from the code alone.
    """
    carry = {"code": F.col("code")} if carry is None else carry
    # Whether a code counts is asked after codes are made distinct: asked before, each would be read once more. A null code has no digest and does not count.
    about = F.struct((F.length("code") > 2).alias("kept"), *[c.alias(k) for k, c in carry.items()])
    rows = contracts.where(F.col("block_timestamp") < F.to_timestamp(F.lit(cutoff))).select("chain", F.sha2("code", 256).alias("bytecode_hash"), "block_number", "block_timestamp", "address", about.alias("about"))
    first = rows.groupBy("chain", "bytecode_hash").agg(F.min(F.struct("block_number", "block_timestamp", "address", "about")).alias("f")).where("f.about.kept")
    return first.select("chain", "bytecode_hash", F.col("f.address").alias("address"), F.col("f.block_timestamp").alias("deployment_timestamp"), F.col("f.block_number").alias("block_number"), *[F.col("f.about")[k].alias(k) for k in carry])


def expand(contracts: DataFrame, codes: DataFrame, cutoff: str = CUTOFF) -> DataFrame:
    """All contracts before the cutoff that have one of the codes."""
    digest = F.sha2("code", 256)
    wanted = codes.select(digest.alias("_k")).distinct()
    return contracts.where(F.col("block_timestamp") < F.to_timestamp(F.lit(cutoff))).withColumn("_k", digest).join(wanted, "_k", "left_semi").drop("_k")


def page(df: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def expand_verdicts(contracts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Each contract, without its code, with the verdict on it, matched in lower case. The digest is the key, so codes are not shuffled; a code that very many
    contracts share stays where it is read."""
    digest = F.sha2(F.lower("code"), 256)
    found = verdicts.withColumn("k", digest).drop("code").dropDuplicates(["k"])
    return skew.keyed_join(contracts.withColumn("k", digest).drop("code"), found, "k").drop("k")


def reuse(codes: DataFrame, earlier: DataFrame, flags: list[str]) -> DataFrame:
    """Codes with an earlier verdict by hash, or null flags where there is none."""
    memo = earlier.groupBy("bytecode_hash").agg(*[F.any_value(f).alias(f) for f in flags])
    return codes.join(memo, "bytecode_hash", "left")


def only_new(rows: DataFrame, known: DataFrame, *key: str) -> DataFrame:
    return rows.join(known.select(*key).distinct(), list(key), "left_anti")


def merge(target: DataFrame, source: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of target with the source's values where the key matches; none are added. Of source rows of one key the largest in their columns' order counts."""
    new = source.groupBy(key).agg(F.max(F.struct(*columns)).alias("_s")).select(key, *[F.col("_s")[c].alias(f"_{c}") for c in columns], F.lit(True).alias("_hit"))
    joined = target.join(new, key, "left")
    return joined.select(*[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns])


def chain_list(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CHAINS, "chain string, query_type string, genesis string, status string")


def active_chains(contracts: DataFrame) -> DataFrame:
    """Chains that are active by the list and have contracts: chain, query_type, first_seen and last_seen (dates), contracts."""
    seen = contracts.groupBy("chain").agg(F.to_date(F.min("block_timestamp")).alias("first_seen"), F.to_date(F.max("block_timestamp")).alias("last_seen"), F.count("*").alias("contracts"))
    return chain_list(contracts.sparkSession).where("status = 'active'").select("chain", "query_type").join(seen, "chain")


def period_number(at: Column, cutoff: str = CUTOFF, days: int = PERIOD_DAYS) -> Column:
    """Which period before the cutoff a time falls in, from 0; null from the cutoff on."""
    before = F.datediff(F.lit(cutoff).cast("date"), F.to_date(at))
    return F.when(before > 0, F.floor((before - 1) / days))


def known_factories(known: DataFrame, contracts: DataFrame) -> DataFrame:
    """The factories that are known beforehand, with whether the contracts have them, and how many contracts their chain has."""
    chains = contracts.groupBy("chain").agg(F.count("*").alias("chain_contracts"))
    wanted = F.broadcast(known.select("chain", F.lower("address").alias("_a")))  # a fixed list
    own = contracts.select("chain", F.lower("address").alias("_a"))
    hit = own.join(wanted, ["chain", "_a"]).distinct().withColumn("seen", F.lit(True))
    out = known.withColumn("_a", F.lower("address")).join(hit, ["chain", "_a"], "left").join(chains, "chain", "left")
    return out.select("chain", "address", "name", "project", "contract_type", F.coalesce("seen", F.lit(False)).alias("seen"), F.coalesce("chain_contracts", F.lit(0)).cast("long").alias("chain_contracts"))


def mock_address(number: Column) -> Column:
    """0x and a number, padded with zeros to 20 bytes."""
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(number)), 40, "0"))


def mock_code(number: Column, size: int = 32) -> Column:
    """0x and a number, padded with zeros to `size` bytes."""
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(number)), 2 * size, "0"))


def periods(spark: SparkSession, cutoff: str = CUTOFF, days: int = PERIOD_DAYS) -> DataFrame:
    """Each active chain's periods, backward from the cutoff; the last is cut at the chain's beginning."""
    return periods_of(chain_list(spark).where("status = 'active'"), cutoff, days)


def periods_of(chains: DataFrame, cutoff: str = CUTOFF, days: int = PERIOD_DAYS) -> DataFrame:
    """Periods of chains (chain, genesis), backward from the cutoff; none of a chain that begins at the cutoff or later."""
    chains = chains.where(F.to_date("genesis") < F.lit(cutoff).cast("date"))
    ends = chains.select("chain", F.to_date("genesis").alias("g"), F.explode(F.expr(f"sequence(DATE '{cutoff}', date_add(to_date(genesis), 1), INTERVAL -{days} DAY)")).alias("end_date"))
    return ends.select("chain", F.greatest(F.date_sub("end_date", days), F.col("g")).alias("start_date"), "end_date")


def progress_log_latest(log: DataFrame, key: list[str], at: str = "updated_at") -> DataFrame:
    """The newest row of each key of an append-only progress log; it aggregates within tasks, so a key's rows are not gathered."""
    rest = [c for c in log.columns if c not in (at, *key)]
    newest = log.groupBy(*key).agg(F.max(F.struct(at, *rest)).alias("_m"))
    return newest.select(*[F.col(c) if c in key else F.col("_m")[c].alias(c) for c in log.columns])


def last_of_each(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with the same keys the last in the order, as a map that is filled in this order keeps it."""
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_m"))
    return last.select(*[F.col(c) if c in keys else F.col("_m")[c].alias(c) for c in rows.columns])


def result_summary(results: DataFrame) -> DataFrame:
    return results.groupBy("chain").agg(F.count("*").alias("total_contracts"), F.count_if("is_factory").alias("total_factories"), F.count_if("is_create_only").alias("create_only"), F.count_if("is_create2_only").alias("create2_only"), F.count_if("is_both").alias("both"), F.avg("execution_time_ms").alias("avg_execution_time"))


def summary_by_code(contracts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """result_summary of contracts (chain, bytecode_hash, execution_time_ms) by the verdicts on their codes (bytecode_hash once, is_factory, factory_type). Contracts
    are counted by code before they meet the verdicts, so that a frequent code is one row of the join and is not looked for."""
    each = contracts.groupBy("chain", "bytecode_hash").agg(F.count("*").alias("n"), F.count("execution_time_ms").alias("timed"), F.sum("execution_time_ms").alias("ms"))
    having = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0).cast("bigint"))
    flags = exclusive_flags(F.col("factory_type"))
    kinds = [having(flags[f"is_{k}"]).alias(k) for k in ("create_only", "create2_only", "both")]
    rows = each.join(verdicts.select("bytecode_hash", "is_factory", "factory_type"), "bytecode_hash")
    return rows.groupBy("chain").agg(F.sum("n").alias("total_contracts"), having(F.col("is_factory")).alias("total_factories"), *kinds, F.try_divide(F.sum("ms"), F.sum("timed")).alias("avg_execution_time"))


def exclusive_flags(kind: Column) -> dict[str, Column]:
    """Each factory has one of the flags."""
    return {"is_create_only": kind == "CREATE_ONLY", "is_create2_only": kind == "CREATE2_ONLY", "is_both": kind == "BOTH_CREATE_CREATE2"}


def inclusive_flags(is_factory: Column, kind: Column) -> dict[str, Column]:
    """A factory of both has all flags; no factory has null flags."""
    return {"is_create": F.when(is_factory, kind.isin("CREATE_ONLY", "BOTH_CREATE_CREATE2")), "is_create2": F.when(is_factory, kind.isin("CREATE2_ONLY", "BOTH_CREATE_CREATE2")), "is_both": F.when(is_factory, kind == "BOTH_CREATE_CREATE2")}


def numeric(col: str) -> Column:
    """As a number, null for what is none."""
    return F.expr(f"try_cast({col} AS DOUBLE)")


def factory_only(df: DataFrame) -> DataFrame:
    """Rows with at least one creation by either count, or by the one that the table has."""
    have = [c for c in ("unique_creations", "total_creations") if c in df.columns]
    if not have:
        return df
    cond = numeric(have[0]) >= 1
    for c in have[1:]:
        cond = F.coalesce(cond, F.lit(False)) | (numeric(c) >= 1)
    return df.where(cond)


def ranking_column(df: DataFrame, wanted: str | None = None) -> str | None:
    return next((c for c in (wanted, "total_creations", "unique_creations") if c and c in df.columns), None)


def top_per_chain(df: DataFrame, n: int, by: str | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Each chain's n highest by the ranking column, of which offset and limit then take a slice; ties to smaller addresses."""
    col = ranking_column(df, by)
    ranked = df.withColumn("rank_value", numeric(col)).where("rank_value IS NOT NULL")
    ranked = ranked.withColumn("place", F.row_number().over(Window.partitionBy("chain").orderBy(F.col("rank_value").desc(), "factory_address"))).where(F.col("place") <= n)
    last = n if limit is None else min(n, offset + limit)
    return ranked.where((F.col("place") > offset) & (F.col("place") <= last))


def top_global(df: DataFrame, n: int, by: str | None = None) -> DataFrame:
    col = ranking_column(df, by)
    return df.withColumn("rank_value", numeric(col)).where("rank_value IS NOT NULL").orderBy(F.col("rank_value").desc(), "factory_address").limit(n)


def fetch_plan(wanted: DataFrame, cached: DataFrame, min_unique: float | None = None, factory: bool = False) -> DataFrame:
    """Addresses whose sources are to be fetched: filtered, distinct, without those in the cache. A least unique count goes before the factory filter."""
    if min_unique is not None and "unique_creations" in wanted.columns:
        wanted = wanted.where(numeric("unique_creations") >= min_unique)
    elif factory:
        col = next((c for c in ("unique_creations", "total_creations") if c in wanted.columns), None)
        wanted = wanted.where(numeric(col) >= 1) if col else wanted
    addresses = wanted.where("factory_address IS NOT NULL").select("chain", F.lower("factory_address").alias("address")).distinct()
    return addresses.join(cached.select("chain", "address"), ["chain", "address"], "left_anti")


def coverage(wanted: DataFrame, cached: DataFrame) -> DataFrame:
    """Share of each chain's addresses that are in the cache, in percent."""
    hit = cached.select("chain", "address").distinct().withColumn("hit", F.lit(1))
    joined = wanted.select("chain", F.lower("factory_address").alias("address")).distinct().join(hit, ["chain", "address"], "left")
    return joined.groupBy("chain").agg(F.count("*").alias("total"), F.count("hit").alias("cached")).withColumn("percent", F.try_divide(F.col("cached") * 100.0, F.col("total")))


def progress_stats(rows: DataFrame) -> DataFrame:
    """Percent done, rate by hour and hours left, from processed, total_contracts and elapsed_s."""
    rate = F.when(F.col("elapsed_s") > 0, F.col("processed") / F.col("elapsed_s")).otherwise(0.0)
    eta = F.when(rate > 0, (F.col("total_contracts") - F.col("processed")) / rate).otherwise(0.0)
    return rows.withColumn("progress_pct", F.try_divide(F.col("processed") * 100.0, F.col("total_contracts"))).withColumn("rate_per_hour", rate * 3600).withColumn("eta_hours", eta / 3600)


def statistics(contracts: DataFrame) -> DataFrame:
    """Contracts and distinct codes by chain, and the chains' sums (not distinct across chains). Codes are told apart by digest, so that no code is shuffled."""
    by = contracts.groupBy("chain").agg(F.count("*").alias("total_contracts"), F.countDistinct(F.sha2("code", 256)).alias("unique_bytecodes"))
    return by.unionByName(by.agg(F.sum("total_contracts").alias("total_contracts"), F.sum("unique_bytecodes").alias("unique_bytecodes")).withColumn("chain", F.lit("all")))


def normalised_address(raw: Column) -> Column:
    """Stripped; M_ entries dropped; 0x set before bare ones; null unless 42 characters long."""
    s = F.trim(raw)
    whole = F.when(s.startswith("0x"), s).when(s.startswith("M_"), F.lit(None)).otherwise(F.concat(F.lit("0x"), s))
    return F.when(F.length(whole) == 42, whole)
