"""Queries over traces and creations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import CUTOFF, ZERO_ADDRESS
from ..functions.numbers import BINS, LAST_BIN, nice_upper_bound
from ..operators import traces as T
from ..sources import views
from ..sources.views import sql

AFTER, BEFORE = "1996-01-01", "2000-01-01"


def _made(spark, sf_dir):
    return T.creations(views.traces(spark, sf_dir))


def factory_creations(spark, sf_dir):
    return _made(spark, sf_dir).drop("ingested_at").withColumn("value", F.round(F.col("value").cast("double"), 3))


def cutoff_filter(spark, sf_dir):
    return T.creations(views.traces(spark, sf_dir), BEFORE).select("chain", "created_contract_address", "block_date")


def daily_active_factories(spark, sf_dir):
    return T.daily_active_factories(_made(spark, sf_dir))


def daily_create_traces(spark, sf_dir):
    return T.daily_create_traces(_made(spark, sf_dir))


def _rounded(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


def bytecode_reuse_distribution(spark, sf_dir):
    return _rounded(T.reuse_distribution(_made(spark, sf_dir)), "cumulative_contract_fraction", "cumulative_runtime_fraction")


def factory_activity_distribution(spark, sf_dir):
    return _rounded(T.activity_distribution(_made(spark, sf_dir)), "cumulative_fraction")


def candidate_factories(spark, sf_dir):
    return T.candidate_factories(views.traces(spark, sf_dir), AFTER, BEFORE).select("factory_address", "create_count")


def factory_address_summary(spark, sf_dir):
    return T.address_summary(_made(spark, sf_dir))


def factory_lifespan(spark, sf_dir):
    return T.lifespan(_made(spark, sf_dir))


def capped_cdf(spark, sf_dir):
    return _rounded(T.capped_cdf(T.reuse_distribution(_made(spark, sf_dir)), "contract_reuse_count", "contracts_in_group", 100), "cdf")


def binned_cdf(spark, sf_dir):
    return _rounded(T.binned_cdf(T.activity_distribution(_made(spark, sf_dir)), "create_count", "factory_group_count"), "cdf")


def axis_limits(spark, sf_dir):
    return _rounded(T.axis_limits(T.daily_create_traces(_made(spark, sf_dir)), "create_trace_count"), "lower_bound", "upper_bound")


def daily_series_cropped(spark, sf_dir):
    return T.cropped_series(T.daily_create_traces(_made(spark, sf_dir)).withColumn("create_trace_count", F.greatest(F.col("create_trace_count") - 1, F.lit(0))), "create_trace_count")


def trace_depth(spark, sf_dir):
    return views.traces(spark, sf_dir).groupBy(F.col("trace_address"), T.trace_depth(F.col("trace_address")).alias("depth")).agg(F.count("*").alias("n"))


def safe_numeric(spark, sf_dir):
    return views.traces(spark, sf_dir).select("value", F.expr("try_cast(value AS DECIMAL(38, 9))").cast("double").alias("as_number")).distinct()


def nice_upper_bounds(spark, sf_dir):
    return T.activity_distribution(_made(spark, sf_dir)).select("chain", "create_count", nice_upper_bound(F.col("create_count").cast("double")).alias("upper"))


def log_widths(spark, sf_dir):
    """Widths of bars on a logarithmic axis: between the midpoints of neighbours' logarithms, the ends as far out as in."""
    w = Window.partitionBy("chain").orderBy("create_count")
    v = T.activity_distribution(_made(spark, sf_dir)).select("chain", "create_count", F.log10("create_count").alias("l"))
    before, after = F.lag("l").over(w), F.lead("l").over(w)
    v = v.withColumn("lo", F.coalesce((F.col("l") + before) / 2, F.col("l") - (after - F.col("l")) / 2, F.col("l") - 0.5)).withColumn("hi", F.coalesce((F.col("l") + after) / 2, F.col("l") + (F.col("l") - before) / 2, F.col("l") + 0.5))
    return v.select("chain", "create_count", F.round(F.pow(F.lit(10.0), "hi") - F.pow(F.lit(10.0), "lo"), 6).alias("width"))


def topn_coverage(spark, sf_dir):
    """How many of the most active factories of each chain have a source package."""
    counts = T.address_summary(_made(spark, sf_dir))
    w = Window.partitionBy("chain").orderBy(F.col("total_creations").desc(), "factory_address")
    top = counts.withColumn("r", F.row_number().over(w)).where("r <= 20")
    cached = top.where(F.substring("factory_address", 3, 1) < "8").select("chain", "factory_address")
    return top.join(cached.withColumn("hit", F.lit(1)), ["chain", "factory_address"], "left").groupBy("chain").agg(F.count("*").alias("wanted"), F.count("hit").alias("cached"))


QUERIES = {f.__name__: f for f in (factory_creations, cutoff_filter, daily_active_factories, daily_create_traces, bytecode_reuse_distribution, factory_activity_distribution, candidate_factories, factory_address_summary, factory_lifespan, capped_cdf, binned_cdf, axis_limits, daily_series_cropped, trace_depth, safe_numeric, log_widths, topn_coverage)} | {"nice_upper_bound": nice_upper_bounds}

_DEPTH = "coalesce(len(string_split(nullif(trace_address, ''), ',')), 0)"
_MADE = f"""made AS (SELECT chain, lower(from_address) AS factory_address, lower(to_address) AS created_contract_address, transaction_hash, block_number, block_timestamp, CAST(block_timestamp AS DATE) AS block_date, trace_address, CAST({_DEPTH} AS INTEGER) AS trace_depth,
  round(CAST(TRY_CAST(value AS DECIMAL(38, 9)) AS DOUBLE), 3) AS value, input AS init_code, output AS runtime_code, gas, gas_used, status FROM v_traces
  WHERE trace_type = 'create' AND status = 1 AND to_address IS NOT NULL AND from_address IS NOT NULL AND from_address <> '{ZERO_ADDRESS}' AND block_timestamp < TIMESTAMP '{CUTOFF}' AND {_DEPTH} >= 1)"""
_REUSE = """, codes AS (SELECT chain, runtime_code, count(*) AS contract_reuse_count FROM made WHERE runtime_code IS NOT NULL AND runtime_code <> '' GROUP BY ALL),
groups AS (SELECT chain, contract_reuse_count, count(*) AS runtime_group_count, CAST(sum(contract_reuse_count) AS BIGINT) AS contracts_in_group FROM codes GROUP BY ALL)"""
_ACTIVE = """, f AS (SELECT chain, factory_address, count(*) AS create_count FROM made GROUP BY ALL), groups AS (SELECT chain, create_count, count(*) AS factory_group_count FROM f GROUP BY ALL)"""
_BIN = "CASE " + " ".join(f"WHEN create_count BETWEEN {lo} AND {hi} THEN '{label}'" for lo, hi, label in BINS) + f" ELSE '{LAST_BIN}' END"
_PLACE = "CASE " + " ".join(f"WHEN create_count BETWEEN {lo} AND {hi} THEN {k}" for k, (lo, hi, _) in enumerate(BINS)) + f" ELSE {len(BINS)} END"


def _sql(text: str) -> str:
    return sql(f"WITH {_MADE}{text}", "traces")


ORACLE_SQL = {
    "factory_creations": _sql(" SELECT * FROM made"),
    "cutoff_filter": _sql(f" SELECT chain, created_contract_address, block_date FROM made WHERE block_timestamp < TIMESTAMP '{BEFORE}'"),
    "daily_active_factories": _sql(f" SELECT chain, block_date, count(DISTINCT factory_address) AS active_factory_count FROM made WHERE block_date < DATE '{CUTOFF}' GROUP BY ALL"),
    "daily_create_traces": _sql(f" SELECT chain, block_date, count(*) AS create_trace_count FROM made WHERE block_date < DATE '{CUTOFF}' GROUP BY ALL"),
    "bytecode_reuse_distribution": _sql(_REUSE + """, o AS (SELECT *, CAST(sum(contracts_in_group) OVER w AS BIGINT) AS cumulative_contracts, CAST(sum(contracts_in_group) OVER (PARTITION BY chain) AS BIGINT) AS total_contracts, CAST(sum(runtime_group_count) OVER w AS BIGINT) AS cumulative_runtime_groups, CAST(sum(runtime_group_count) OVER (PARTITION BY chain) AS BIGINT) AS total_runtime_groups FROM groups WINDOW w AS (PARTITION BY chain ORDER BY contract_reuse_count))
SELECT *, round(cumulative_contracts / total_contracts, 6) AS cumulative_contract_fraction, round(cumulative_runtime_groups / total_runtime_groups, 6) AS cumulative_runtime_fraction FROM o"""),
    "factory_activity_distribution": _sql(_ACTIVE + """, o AS (SELECT *, CAST(sum(factory_group_count) OVER (PARTITION BY chain ORDER BY create_count) AS BIGINT) AS cumulative_factories, CAST(sum(factory_group_count) OVER (PARTITION BY chain) AS BIGINT) AS total_factories FROM groups)
SELECT *, round(cumulative_factories / total_factories, 6) AS cumulative_fraction FROM o"""),
    "candidate_factories": sql(f"SELECT from_address AS factory_address, count(*) AS create_count FROM v_traces WHERE trace_type = 'create' AND status = 1 AND from_address IS NOT NULL AND from_address <> '{ZERO_ADDRESS}' AND block_timestamp > TIMESTAMP '{AFTER}' AND block_timestamp < TIMESTAMP '{BEFORE}' GROUP BY 1 HAVING count(*) >= 2", "traces"),
    "factory_address_summary": _sql(" SELECT chain, lower(factory_address) AS factory_address, count(*) AS total_creations, count(DISTINCT created_contract_address) AS unique_creations FROM made GROUP BY 1, 2"),
    "factory_lifespan": _sql(" SELECT chain, lower(factory_address) AS factory_address, count(*) AS total_creations, count(DISTINCT created_contract_address) AS unique_creations, min(block_date) AS first_seen_date, max(block_date) AS last_seen_date FROM made GROUP BY 1, 2 HAVING count(DISTINCT created_contract_address) >= 1"),
    "capped_cdf": _sql(_REUSE + " SELECT chain, contract_reuse_count AS x, contracts_in_group AS n, round(sum(contracts_in_group) OVER (PARTITION BY chain ORDER BY contract_reuse_count) / sum(contracts_in_group) OVER (PARTITION BY chain), 6) AS cdf FROM groups WHERE contract_reuse_count > 0 AND contract_reuse_count <= 100"),
    "binned_cdf": _sql(_ACTIVE + f""", s AS (SELECT chain, {_BIN} AS bin, {_PLACE} AS place, CAST(sum(factory_group_count) AS BIGINT) AS c FROM groups GROUP BY ALL), frame AS (SELECT * FROM (SELECT DISTINCT chain FROM s) CROSS JOIN (SELECT DISTINCT bin, place FROM s)),
filled AS (SELECT frame.*, coalesce(s.c, 0) AS n FROM frame LEFT JOIN s USING (chain, bin, place)) SELECT chain, bin, place, n, round(coalesce(sum(n) OVER (PARTITION BY chain ORDER BY place) / sum(n) OVER (PARTITION BY chain), 0), 6) AS cdf FROM filled"""),
    "axis_limits": _sql(", d AS (SELECT chain, block_date, count(*) AS v FROM made GROUP BY ALL), g AS (SELECT max(v) AS y_max, min(v) FILTER (v > 0) AS least FROM d) SELECT CASE WHEN least IS NULL THEN 0.0 WHEN least >= 1 THEN 1.0 ELSE least END::DOUBLE AS lower_bound, round(greatest(CASE WHEN y_max > 0 THEN y_max * 1.1::DOUBLE ELSE 1 END, CASE WHEN least >= 1 THEN 1.1 ELSE 0 END::DOUBLE), 6) AS upper_bound FROM g"),
    "daily_series_cropped": _sql(", d AS (SELECT chain, block_date, greatest(count(*) - 1, 0) AS create_trace_count FROM made GROUP BY ALL), e AS (SELECT *, min(block_date) FILTER (create_trace_count > 0) OVER (PARTITION BY chain) AS lo, max(block_date) FILTER (create_trace_count > 0) OVER (PARTITION BY chain) AS hi FROM d) SELECT chain, block_date, create_trace_count FROM e WHERE chain <> 'polygon' OR lo IS NULL OR block_date BETWEEN lo AND hi"),
    "trace_depth": sql(f"SELECT trace_address, CAST({_DEPTH} AS INTEGER) AS depth, count(*) AS n FROM v_traces GROUP BY ALL", "traces"),
    "safe_numeric": sql("SELECT DISTINCT value, CAST(TRY_CAST(value AS DECIMAL(38, 9)) AS DOUBLE) AS as_number FROM v_traces", "traces"),
    "nice_upper_bound": _sql(_ACTIVE + ", p AS (SELECT *, pow(10.0, floor(log10(create_count))) AS base FROM groups) SELECT chain, create_count, CASE WHEN create_count / base <= 1 THEN 1 WHEN create_count / base <= 2 THEN 2 WHEN create_count / base <= 5 THEN 5 ELSE 10 END * base AS upper FROM p"),
    "log_widths": _sql(_ACTIVE + """, l AS (SELECT chain, create_count, log10(create_count) AS l, lag(log10(create_count)) OVER w AS b, lead(log10(create_count)) OVER w AS a FROM groups WINDOW w AS (PARTITION BY chain ORDER BY create_count))
SELECT chain, create_count, round(pow(10.0, coalesce((l + a) / 2, l + (l - b) / 2, l + 0.5)) - pow(10.0, coalesce((l + b) / 2, l - (a - l) / 2, l - 0.5)), 6) AS width FROM l"""),
    "topn_coverage": _sql(", s AS (SELECT chain, factory_address, count(*) AS n FROM made GROUP BY ALL), t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY chain ORDER BY n DESC, factory_address) <= 20) SELECT chain, count(*) AS wanted, count(*) FILTER (substr(factory_address, 3, 1) < '8') AS cached FROM t GROUP BY chain"),
}
