"""Queries of detector evaluation and error analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import evm, notes
from ..operators import evaluation as E
from ..operators import scans
from ..operators.quantiles import percentiles
from ..sources import views
from ..sources.views import sql
from ..streaming.jobs import keep
from . import bytecode as _b

PERCENTILES = [0.25, 0.5, 0.75, 0.9, 0.95, 0.99]


def _gt(spark, sf_dir):
    return views.ground_truth(spark, sf_dir)


def _fn(spark, sf_dir):
    return E.with_outcome(_gt(spark, sf_dir)).where("outcome = 'FN'")


def _fp(spark, sf_dir):
    return E.with_outcome(_gt(spark, sf_dir)).where("outcome = 'FP'")


def ground_truth_scan(spark, sf_dir):
    return scans.page(_gt(spark, sf_dir).where("is_factory_ground_truth"), ["address", "id"], 5, 25).select("address", "source_type", "execution_time")


def confusion_matrix(spark, sf_dir):
    out = E.confusion(_gt(spark, sf_dir))
    return out.select("tp", "fp", "tn", "fn", "n", "total_time", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy", "avg_time")])


def _second(spark, sf_dir):
    return _gt(spark, sf_dir).withColumn("is_factory_detected", F.coalesce(F.col("is_factory_detected"), F.lit(True)) & (F.col("confidence_score") > 0))


def detector_comparison(spark, sf_dir):
    out = E.compare(E.confusion(_gt(spark, sf_dir)), E.confusion(_second(spark, sf_dir)))
    return out.select("fp_reduction", "fn_reduction", *[F.round(f"{m}_change", 6).alias(f"{m}_change") for m in ("precision", "recall", "f1", "accuracy")])


def error_slices(spark, sf_dir):
    return E.with_outcome(_gt(spark, sf_dir)).select("address", "outcome")


def errors_by_type(spark, sf_dir):
    return _fp(spark, sf_dir).groupBy("factory_type").agg(F.count("*").alias("n"))


def errors_by_source(spark, sf_dir):
    return E.with_outcome(_gt(spark, sf_dir)).where("outcome IN ('FP', 'FN')").groupBy("outcome", "source_type").agg(F.count("*").alias("n"))


def share_by_source(spark, sf_dir):
    from ..functions.numbers import share, total

    by = _fp(spark, sf_dir).withColumn("k", F.lit("all")).groupBy("k", "source_type").agg(F.count("*").alias("n"))
    return by.select("source_type", "n", F.round(share(F.col("n") * 100.0, total("n", "k")), 6).alias("percent"))


def create_count_stats(spark, sf_dir):
    counts = _fn(spark, sf_dir).select(notes.executed_count(F.col("verification_notes")).alias("c")).where("c IS NOT NULL")
    return counts.agg(F.min("c").alias("least"), F.max("c").alias("most"), F.round(F.avg("c"), 6).alias("mean"), F.count("*").alias("n")).crossJoin(E.upper_median(counts, "c"))  # one row each


def create_count_buckets(spark, sf_dir):
    counts = _fn(spark, sf_dir).select(notes.executed_count(F.col("verification_notes")).alias("c")).where("c IS NOT NULL")
    return counts.groupBy(E.size_class(F.col("c")).alias("bucket")).agg(F.count("*").alias("n"))


def time_by_outcome(spark, sf_dir):
    rows = E.with_outcome(_gt(spark, sf_dir)).where("execution_time <> 0 AND outcome IS NOT NULL")
    return rows.groupBy("outcome").agg(F.round(F.avg("execution_time"), 6).alias("mean"), F.min("execution_time").alias("least"), F.max("execution_time").alias("most"))


def annotation_quality(spark, sf_dir):
    out = _gt(spark, sf_dir).agg(F.count("*").alias("n"), F.avg(F.col("is_factory_ground_truth").cast("double")).alias("factory_ratio"), F.avg("confidence_score").alias("mean"), F.min("confidence_score").alias("least"), F.max("confidence_score").alias("most"), F.avg((F.col("confidence_score") >= 0.8).cast("double")).alias("high"))
    return out.select("n", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in ("factory_ratio", "mean", "least", "most", "high")])


def gt_statistics(spark, sf_dir):
    t = F.col("is_factory_ground_truth")
    return _gt(spark, sf_dir).agg(F.count("*").alias("total_contracts"), F.count_if(t).alias("factory_contracts"), F.count_if(~t).alias("non_factory_contracts"), F.countDistinct("bytecode").alias("unique_bytecodes"), F.count_if(F.col("source_type") == "etherscan").alias("etherscan_contracts"), F.count_if(F.col("source_type") == "traces").alias("traces_contracts"))


def gt_distribution(spark, sf_dir):
    """Counts by label and source, by label, and in all."""
    return _gt(spark, sf_dir).rollup("is_factory_ground_truth", "source_type").agg(F.count("*").alias("n"))


def needs_detection(spark, sf_dir):
    return _gt(spark, sf_dir).where("is_factory_detected IS NULL").select("address")


def merge_detection(spark, sf_dir):
    """Verdicts are set where a newer one has the address; other rows stay."""
    target = _gt(spark, sf_dir).select("address", "is_factory_detected", "execution_time")
    source = _gt(spark, sf_dir).where("id % 4 = 0").select("address", (F.col("id") % 8 == 0).alias("is_factory_detected"), F.lit(1).cast("bigint").alias("execution_time"))
    return scans.merge(target, source, "address", ["is_factory_detected", "execution_time"])


def gt_insert_dedup(spark, sf_dir):
    """Rows whose code is not in the table yet, one of each code (the smallest id)."""
    have = _gt(spark, sf_dir).where("id % 5 = 0").select("bytecode")
    new = _gt(spark, sf_dir).where("id % 5 <> 0").groupBy("bytecode").agg(F.min("id").alias("id"))
    return scans.only_new(new, have, "bytecode").select("id")


def sample_errors(spark, sf_dir):
    return _fn(spark, sf_dir).orderBy("address").limit(10).select("address", "execution_time")


def zero_conf_fn(spark, sf_dir):
    return _fn(spark, sf_dir).where(F.coalesce("confidence_score", F.lit(0.0)) == 0).select("address")


def fn_byte_presence(spark, sf_dir):
    t = F.lower("bytecode")
    f0, f5 = F.contains(t, F.lit("f0")), F.contains(t, F.lit("f5"))
    return _fn(spark, sf_dir).agg(F.count_if(f0).alias("with_create"), F.count_if(f5).alias("with_create2"), F.count_if(~f0 & ~f5).alias("with_neither"))


def fn_explanation(spark, sf_dir):
    return E.explanations(_fn(spark, sf_dir)).groupBy("why").agg(F.count("*").alias("n"))


def fp_name_counts(spark, sf_dir):
    return _fp(spark, sf_dir).groupBy(notes.contract_name(F.col("verification_notes")).alias("name")).agg(F.count("*").alias("n"))


def name_pattern_class(spark, sf_dir):
    return _fp(spark, sf_dir).groupBy(notes.name_class(notes.contract_name(F.col("verification_notes"))).alias("pattern")).agg(F.count("*").alias("n"))


def contract_name_extract(spark, sf_dir):
    return _gt(spark, sf_dir).select("id", notes.contract_name(F.col("verification_notes")).alias("name"))


def executed_count(spark, sf_dir):
    return _gt(spark, sf_dir).select("id", notes.executed_count(F.col("verification_notes")).alias("executed"))


def vanity_address(spark, sf_dir):
    return _gt(spark, sf_dir).select("address", notes.is_vanity(F.col("address")).alias("vanity"), notes.leading_zeros(F.col("address")).cast("bigint").alias("zeros"))


def vanity_classes(spark, sf_dir):
    return _fn(spark, sf_dir).groupBy(notes.vanity_class(F.col("address")).alias("class")).agg(F.count("*").alias("n"))


def error_export_fn(spark, sf_dir):
    return E.error_table(_gt(spark, sf_dir), "FN")


def error_export_fp(spark, sf_dir):
    return E.error_table(_gt(spark, sf_dir), "FP")


def exec_time_percentiles(spark, sf_dir):
    times = _gt(spark, sf_dir).select(F.lit(0).alias("k"), "execution_time")
    found = percentiles(times, ["k"], "execution_time", PERCENTILES, keep)
    got = times.agg(F.avg("execution_time").alias("mean"), F.max("execution_time").alias("most")).withColumn("k", F.lit(0)).join(found, "k", "left")  # a row each
    return got.select(*[F.round(F.col("percentiles")[k], 6).alias(f"p{round(100 * q)}") for k, q in enumerate(PERCENTILES)], F.round("mean", 6).alias("mean"), "most")


def ecdf(spark, sf_dir):
    return E.ecdf(_gt(spark, sf_dir), "execution_time").select("value", F.round("cdf", 6).alias("cdf"))


def exec_time_hist(spark, sf_dir):
    return E.histogram(_gt(spark, sf_dir), "execution_time", 2.0, 100.0)


def gt_json_roundtrip(spark, sf_dir):
    """To JSON and back, null fields included."""
    rows = _gt(spark, sf_dir).select("id", "address", "is_factory_ground_truth", "is_factory_detected", "execution_time", "source_type")
    text = rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j"))
    return text.select(F.from_json("j", rows.schema).alias("r")).select("r.*")


QUERIES = {f.__name__: f for f in (ground_truth_scan, confusion_matrix, detector_comparison, error_slices, errors_by_type, errors_by_source, share_by_source, create_count_stats, create_count_buckets, time_by_outcome, annotation_quality, gt_statistics, gt_distribution, needs_detection, merge_detection, gt_insert_dedup, sample_errors, zero_conf_fn, fn_byte_presence, fn_explanation, fp_name_counts, name_pattern_class, contract_name_extract, executed_count, vanity_address, vanity_classes, error_export_fn, error_export_fp, exec_time_percentiles, ecdf, exec_time_hist, gt_json_roundtrip)}

_OUT = "o AS (SELECT *, CASE WHEN is_factory_ground_truth AND is_factory_detected THEN 'TP' WHEN NOT is_factory_ground_truth AND is_factory_detected THEN 'FP' WHEN is_factory_ground_truth AND NOT is_factory_detected THEN 'FN' WHEN NOT is_factory_ground_truth AND NOT is_factory_detected THEN 'TN' END AS outcome FROM v_ground_truth)"


def _o(text: str) -> str:
    return sql(f"WITH {_OUT} {text}", "ground_truth")


def _measures(name: str, source: str) -> str:
    return f"""{name}_c AS (SELECT count(*) FILTER (g AND d) AS tp, count(*) FILTER (NOT g AND d) AS fp, count(*) FILTER (NOT g AND NOT d) AS tn, count(*) FILTER (g AND NOT d) AS fn, avg(execution_time) AS avg_time, CAST(sum(execution_time) AS BIGINT) AS total_time, count(*) AS n FROM ({source}) WHERE d IS NOT NULL),
{name}_r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce((tp + tn) / nullif(n, 0), 0) AS accuracy FROM {name}_c), {name} AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM {name}_r)"""


_FIRST = _measures("m1", "SELECT is_factory_ground_truth AS g, is_factory_detected AS d, execution_time FROM v_ground_truth")
_SECOND = _measures("m2", "SELECT is_factory_ground_truth AS g, coalesce(is_factory_detected, true) AND confidence_score > 0 AS d, execution_time FROM v_ground_truth")
_NAME = "CASE WHEN contains(verification_notes, 'Contract:') AND trim(string_split(verification_notes, 'Contract:')[-1]) <> '' THEN regexp_split_to_array(trim(string_split(verification_notes, 'Contract:')[-1]), '\\s+')[1] ELSE 'Unknown' END"
_EXEC = "TRY_CAST(regexp_extract(verification_notes, '(?:^|\\s)executed\\s+(\\d+)(?:\\s|$)', 1) AS BIGINT)"
_VAN = f"starts_with(lower(address), '{notes.VANITY}')"
_ZEROS = f"CASE WHEN {_VAN} THEN length(regexp_extract(substr(address, 3), '^(0*)', 1)) ELSE 0 END"
_CLEAN = "lower(CASE WHEN bytecode LIKE '0x%' THEN substr(bytecode, 3) ELSE bytecode END)"


def _naive(b: str) -> str:
    return f"CAST((length({_CLEAN}) - length(replace({_CLEAN}, '{b}', ''))) / 2 AS BIGINT)"


_WHY = _b.CTES.replace("SELECT DISTINCT code, sha256(code) AS bytecode_hash FROM v_contracts WHERE code IS NOT NULL", "SELECT DISTINCT bytecode AS code, sha256(bytecode) AS bytecode_hash FROM v_ground_truth").strip()

ORACLE_SQL = {
    "ground_truth_scan": sql("SELECT address, source_type, execution_time FROM v_ground_truth WHERE is_factory_ground_truth ORDER BY address, id LIMIT 25 OFFSET 5", "ground_truth"),
    "confusion_matrix": sql(f"WITH {_FIRST} SELECT tp, fp, tn, fn, n, total_time, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(accuracy, 6) AS accuracy, round(avg_time, 6) AS avg_time FROM m1", "ground_truth"),
    "detector_comparison": sql(f"WITH {_FIRST}, {_SECOND} SELECT m1.fp - m2.fp AS fp_reduction, m1.fn - m2.fn AS fn_reduction, round(m2.precision - m1.precision, 6) AS precision_change, round(m2.recall - m1.recall, 6) AS recall_change, round(m2.f1 - m1.f1, 6) AS f1_change, round(m2.accuracy - m1.accuracy, 6) AS accuracy_change FROM m1, m2", "ground_truth"),
    "error_slices": _o("SELECT address, outcome FROM o"),
    "errors_by_type": _o("SELECT factory_type, count(*) AS n FROM o WHERE outcome = 'FP' GROUP BY 1"),
    "errors_by_source": _o("SELECT outcome, source_type, count(*) AS n FROM o WHERE outcome IN ('FP', 'FN') GROUP BY 1, 2"),
    "share_by_source": _o("SELECT source_type, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS percent FROM o WHERE outcome = 'FP' GROUP BY 1"),
    "create_count_stats": _o(f", c AS (SELECT {_EXEC} AS c FROM o WHERE outcome = 'FN'), s AS (SELECT list_sort(list(c)) AS l FROM c WHERE c IS NOT NULL) SELECT l[1] AS least, l[-1] AS most, round(list_avg(l), 6) AS mean, CAST(len(l) AS BIGINT) AS n, l[len(l) // 2 + 1] AS median FROM s"),
    "create_count_buckets": _o(f", c AS (SELECT {_EXEC} AS c FROM o WHERE outcome = 'FN') SELECT CASE WHEN c <= 100 THEN 'up to 100' WHEN c <= 1000 THEN '101-1000' WHEN c <= 10000 THEN '1001-10000' ELSE 'over 10000' END AS bucket, count(*) AS n FROM c WHERE c IS NOT NULL GROUP BY 1"),
    "time_by_outcome": _o("SELECT outcome, round(avg(execution_time), 6) AS mean, min(execution_time) AS least, max(execution_time) AS most FROM o WHERE execution_time <> 0 AND outcome IS NOT NULL GROUP BY 1"),
    "annotation_quality": sql("SELECT count(*) AS n, round(avg(is_factory_ground_truth::INT), 6) AS factory_ratio, round(avg(confidence_score)::DOUBLE, 6) AS mean, min(confidence_score)::DOUBLE AS least, max(confidence_score)::DOUBLE AS most, round(avg((confidence_score >= 0.8)::INT), 6) AS high FROM v_ground_truth", "ground_truth"),
    "gt_statistics": sql("SELECT count(*) AS total_contracts, count(*) FILTER (is_factory_ground_truth) AS factory_contracts, count(*) FILTER (NOT is_factory_ground_truth) AS non_factory_contracts, count(DISTINCT bytecode) AS unique_bytecodes, count(*) FILTER (source_type = 'etherscan') AS etherscan_contracts, count(*) FILTER (source_type = 'traces') AS traces_contracts FROM v_ground_truth", "ground_truth"),
    "gt_distribution": sql("SELECT is_factory_ground_truth, source_type, count(*) AS n FROM v_ground_truth GROUP BY ROLLUP (is_factory_ground_truth, source_type)", "ground_truth"),
    "needs_detection": sql("SELECT address FROM v_ground_truth WHERE is_factory_detected IS NULL", "ground_truth"),
    "merge_detection": sql("SELECT address, CASE WHEN id % 4 = 0 THEN id % 8 = 0 ELSE is_factory_detected END AS is_factory_detected, CASE WHEN id % 4 = 0 THEN 1 ELSE execution_time END AS execution_time FROM v_ground_truth", "ground_truth"),
    "gt_insert_dedup": sql("SELECT min(id) AS id FROM v_ground_truth WHERE id % 5 <> 0 AND bytecode NOT IN (SELECT bytecode FROM v_ground_truth WHERE id % 5 = 0) GROUP BY bytecode", "ground_truth"),
    "sample_errors": _o("SELECT address, execution_time FROM o WHERE outcome = 'FN' ORDER BY address LIMIT 10"),
    "zero_conf_fn": _o("SELECT address FROM o WHERE outcome = 'FN' AND coalesce(confidence_score, 0) = 0"),
    "fn_byte_presence": _o("SELECT count(*) FILTER (contains(lower(bytecode), 'f0')) AS with_create, count(*) FILTER (contains(lower(bytecode), 'f5')) AS with_create2, count(*) FILTER (NOT contains(lower(bytecode), 'f0') AND NOT contains(lower(bytecode), 'f5')) AS with_neither FROM o WHERE outcome = 'FN'"),
    "fn_explanation": sql(f"WITH RECURSIVE {_OUT}, {_WHY}, h AS (SELECT bytecode_hash, count(*) AS nblocks, count(*) FILTER (reachable) AS reached FROM reach WHERE contains_create OR contains_create2 GROUP BY 1) SELECT CASE WHEN {_naive('f0')} + {_naive('f5')} = 0 THEN 'no creation bytes: a proxy or another contract creates' WHEN h.nblocks IS NULL THEN 'bytes in operands only' WHEN h.reached = 0 THEN 'creating blocks are unreachable' ELSE 'should have been found' END AS why, count(*) AS n FROM o LEFT JOIN h ON h.bytecode_hash = sha256(o.bytecode) WHERE outcome = 'FN' GROUP BY 1", "ground_truth"),
    "fp_name_counts": _o(f"SELECT {_NAME} AS name, count(*) AS n FROM o WHERE outcome = 'FP' GROUP BY 1"),
    "name_pattern_class": _o(f", n AS (SELECT {_NAME} AS name FROM o WHERE outcome = 'FP') SELECT CASE WHEN contains(name, 'Factory') THEN 'factory' WHEN contains(name, 'Mint') THEN 'mint' WHEN contains(name, 'Token') THEN 'token' WHEN contains(name, 'Router') OR contains(name, 'Swap') THEN 'router or swap' ELSE 'other' END AS pattern, count(*) AS n FROM n GROUP BY 1"),
    "contract_name_extract": sql(f"SELECT id, {_NAME} AS name FROM v_ground_truth", "ground_truth"),
    "executed_count": sql(f"SELECT id, {_EXEC} AS executed FROM v_ground_truth", "ground_truth"),
    "vanity_address": sql(f"SELECT address, {_VAN} AS vanity, CAST({_ZEROS} AS BIGINT) AS zeros FROM v_ground_truth", "ground_truth"),
    "vanity_classes": _o(f"SELECT CASE WHEN NOT {_VAN} THEN 'normal' WHEN {_ZEROS} >= 8 THEN '8 or more' WHEN {_ZEROS} >= 4 THEN '4 to 7' ELSE 'other' END AS class, count(*) AS n FROM o WHERE outcome = 'FN' GROUP BY 1"),
    "error_export_fn": _o(f"SELECT row_number() OVER (ORDER BY address, id) AS no, address, coalesce(format('{{:,}}', {_EXEC}), 'Unknown') AS executed, {_naive('f0')} AS create_bytes, {_naive('f5')} AS create2_bytes, {_VAN} AS vanity, execution_time FROM o WHERE outcome = 'FN'"),
    "error_export_fp": _o(f"SELECT row_number() OVER (ORDER BY address, id) AS no, address, {_NAME} AS name, factory_type, create_positions, execution_time FROM o WHERE outcome = 'FP'"),
    "exec_time_percentiles": sql("SELECT " + ", ".join(f"round(quantile_cont(execution_time, {q}), 6)::DOUBLE AS p{round(100 * q)}" for q in PERCENTILES) + ", round(avg(execution_time), 6) AS mean, max(execution_time) AS most FROM v_ground_truth", "ground_truth"),
    "ecdf": sql("SELECT execution_time AS value, round(row_number() OVER (ORDER BY execution_time) / count(*) OVER (), 6) AS cdf FROM v_ground_truth WHERE execution_time IS NOT NULL", "ground_truth"),
    "exec_time_hist": sql("WITH t AS (SELECT least(max(execution_time), 100.0)::DOUBLE AS top FROM v_ground_truth) SELECT CAST(least(floor(execution_time / 2.0::DOUBLE), greatest(ceil(top / 2) - 1, 0)) AS BIGINT) AS bin, count(*) AS n FROM v_ground_truth, t WHERE execution_time >= 0 AND execution_time <= top GROUP BY 1", "ground_truth"),
    "gt_json_roundtrip": sql("SELECT id, address, is_factory_ground_truth, is_factory_detected, execution_time, source_type FROM v_ground_truth", "ground_truth"),
}
