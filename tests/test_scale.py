"""Operators that must hold on hot keys and lost jobs: split joins, exact percentiles, pages, staged writes."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from spawnlens.operators import paging, quantiles, skew
from spawnlens.operators import scans as S
from spawnlens.sources import files
from spawnlens.streaming.jobs import keep


def hot(spark, n=20_000, share=0.9):
    key = F.when(F.col("id") % 100 < int(100 * share), F.lit("hot")).when(F.col("id") % 100 == 99, F.lit(None)).otherwise(F.concat(F.lit("k"), (F.col("id") % 977).cast("string")))
    return spark.range(0, n, 1, 8).select("id", key.alias("k"))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_split_join_is_the_join(spark, how):
    left = hot(spark, 4000)
    right = spark.createDataFrame([("hot", 1), ("k3", 2), ("k4", 3), ("absent", 4), (None, 5)], "k string, v int")
    got, want = skew.keyed_join(left, right, "k", how), left.join(right, "k", how)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert skew.keyed_join(left.where("k = 'none'"), right, "k", how).count() == 0


def test_a_hot_key_gives_no_large_task(spark):
    left = hot(spark)
    assert skew.heavy_keys(left, "k") == ["hot"]
    right = left.where("k IS NOT NULL").select("k", F.length("k").alias("v")).distinct()
    rows = skew.rows_by_task(skew.keyed_join(left, right, "k", "left"))
    assert sum(rows) == 20_000 and max(rows) <= 2 * statistics.median(sorted(rows)[-8:])


def test_contracts_of_one_code_are_spread(spark):
    code = F.when(F.col("id") % 10 < 9, F.lit("F0FD")).otherwise(F.concat(F.lit("00"), F.lpad(F.col("id").cast("string"), 6, "0")))
    contracts = spark.range(0, 20_000, 1, 8).select(F.col("id").cast("string").alias("address"), code.alias("code"))
    verdicts = contracts.select(F.lower("code").alias("code")).distinct().withColumn("is_factory", F.col("code") == "f0fd")
    got = S.expand_verdicts(contracts, verdicts)
    rows = skew.rows_by_task(got)
    assert got.where("is_factory").count() == 18_000 and sum(rows) == 20_000 and max(rows) <= 2 * statistics.median(sorted(rows)[-8:])


def exact(values, p):
    v = sorted(values)
    pos = (len(v) - 1) * p
    k = int(pos)
    return v[k] + (pos - k) * (v[min(k + 1, len(v) - 1)] - v[k])


SHARES = [0.0, 0.1, 0.25, 0.5, 0.9, 0.99, 1.0]


@pytest.mark.parametrize(("at_once", "pivots"), [(4096, 64), (8, 4), (50, 16)])
def test_percentiles_are_exact(spark, at_once, pivots):
    rng = random.Random(at_once)
    rows = [("hot", rng.choice([rng.gauss(0, 1), 2.0 ** rng.randrange(-60, 60), float(rng.randrange(5))])) for _ in range(3000)]
    rows += [("ties", 7.0)] * 200 + [("ties", 8.0)] * 100 + [("one", -1.5), ("none", None), (None, 1.0), (None, 3.0), ("ints", 3.0), ("ints", 4.0)]
    got = quantiles.percentiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", SHARES, keep, at_once, pivots).collect()
    by = {}
    for g, x in rows:
        if x is not None:
            by.setdefault(g, []).append(x)
    assert {r["g"] for r in got} == set(by)
    for r in got:
        assert r["percentiles"] == pytest.approx([exact(by[r["g"]], p) for p in SHARES], rel=1e-12)


def test_percentiles_of_no_rows_and_many_groups(spark):
    none = spark.createDataFrame([], "g int, x double")
    assert quantiles.percentiles(none, ["g"], "x", [0.5], keep).collect() == []
    rows = spark.range(3000).select((F.col("id") % 500).alias("g"), F.lit("u").alias("h"), (F.col("id") * 7919 % 3000).alias("x"))
    got = {r["g"]: r["percentiles"][0] for r in quantiles.percentiles(rows, ["g", "h"], "x", [0.5], keep).collect()}
    want = {r["g"]: r["p"] for r in rows.groupBy("g").agg(F.percentile("x", 0.5).alias("p")).collect()}
    assert got == want


def test_pages_by_key_are_the_table(spark, tmp_path):
    rng = random.Random(5)
    rows = sorted({(rng.randrange(40), f"a{rng.randrange(100):03}") for _ in range(300)})
    df = spark.createDataFrame([(*r, f"code-{r}") for r in rows], "block long, address string, code string")
    path, keys = str(tmp_path / "p"), ["block", "address"]
    index = paging.store(df, keys, path, 32)
    stored = spark.read.parquet(f"{path}/rows")
    assert index.count() == -(-len(rows) // 32)
    pages = [paging.read_page(stored, keys, index, k) for k in range(index.count())]
    found = [sorted((r["block"], r["address"]) for r in p.collect()) for p in pages]
    assert [r for p in found for r in p] == rows and all(r["code"] == f"code-{(r['block'], r['address'])}" for r in pages[1].collect())
    assert paging.read_page(stored, keys, index, 99).collect() == []
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    plan = paging.read_page(stored, keys, index, 1)._jdf.queryExecution().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "PushedFilters" in plan and "GreaterThanOrEqual(block," in plan and "LessThanOrEqual(block," in plan
    after, got = None, []
    while part := paging.next_page(stored, keys, after, 50).collect():
        got += [(r["block"], r["address"]) for r in part]
        after = got[-1]
    assert got == rows


def test_unique_codes_come_with_their_code(spark):
    t = "TIMESTAMP '2020-01-01'"
    rows = spark.sql(f"SELECT * FROM VALUES ('e', '0xb', 'f0f0', {t}, 2), ('e', '0xa', 'f0f0', {t}, 2), ('e', '0xa', 'f0f0', {t}, 2), ('e', '0xc', '0011', {t}, 1), ('p', NULL, 'f0f0', {t}, 5), ('e', '0xd', '0x', {t}, 1), ('e', '0xe', NULL, {t}, 1) AS v(chain, address, code, block_timestamp, block_number)")
    got = sorted((r["chain"], str(r["address"]), r["code"], r["block_number"]) for r in S.unique_codes(rows).collect())
    assert got == [("e", "0xa", "f0f0", 2), ("e", "0xc", "0011", 1), ("p", "None", "f0f0", 5)]


def test_merge_takes_one_of_equal_keys(spark):
    target = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "address string, n int")
    source = spark.createDataFrame([("a", 5), ("a", 9), ("c", 7), (None, 8)], "address string, n int")
    assert sorted(S.merge(target, source, "address", ["n"]).collect(), key=str) == sorted([("a", 9), ("b", 2), (None, 3)], key=str)


def test_null_keys_are_appended_once(spark, tmp_path):
    path = str(tmp_path / "r")
    rows = spark.createDataFrame([("e", None), (None, "x"), ("e", "x")], "chain string, address string")
    for _ in range(3):
        files.append_results(rows, path)
    assert files.read_results(spark, path).count() == 3


def test_a_batch_is_published_once_and_whole(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "r")
    rows = lambda *a: spark.createDataFrame([("e", x) for x in a], "chain string, address string")
    assert files.append_results(rows("a", "b"), path, "one")
    with monkeypatch.context() as m:  # lost between stage and publish
        m.setattr(files, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            files.append_results(rows("c", "b"), path, "two")
    assert files.read_results(spark, path).count() == 2
    assert files.append_results(rows("c", "b"), path, "two") and not files.append_results(rows("c", "b"), path, "two")
    assert sorted(r["address"] for r in files.read_results(spark, path).collect()) == ["a", "b", "c"]
    staged = str(tmp_path / "late")
    rows("z").write.parquet(staged)
    assert not files.publish(spark, staged, f"{path}/batch=two") and files.read_results(spark, path).count() == 3


def test_a_partition_is_exchanged_whole(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    df = lambda *a: spark.createDataFrame([(x,) for x in a], "n int")
    files.swap_partition(df(1, 2), path, "chain", "e")
    files.swap_partition(df(5), path, "chain", "p")
    files.swap_partition(df(3), path, "chain", "e")
    read = lambda: sorted((r["chain"], r["n"]) for r in spark.read.parquet(path).collect())
    assert read() == [("e", 3), ("p", 5)]
    # Lost between the renames: the old partition stands aside, and comes back.
    src, fs = files._hadoop(spark, f"{path}/chain=e")
    fs.rename(src, files._hadoop(spark, f"{path}-staged/chain=e.old")[0])
    assert files.recover_partition(spark, path, "chain", "e") and read() == [("e", 3), ("p", 5)]
    assert not files.recover_partition(spark, path, "chain", "e")


def test_a_failed_period_does_not_stop_the_others(spark, tmp_path):
    from spawnlens.streaming import jobs

    periods = spark.sql("SELECT chain, DATE'2020-01-01' AS start_date, DATE'2020-01-31' AS end_date FROM VALUES ('a'), ('b'), ('c') AS v(chain)")
    seen = []

    def work(chain, start, end):
        seen.append(chain)
        if chain == "a" and len(seen) == 1:
            raise ValueError("no rows")
        return 1, 0

    with pytest.raises(jobs.PeriodsFailed, match="1 periods failed, 2 completed") as e:
        jobs.process_periods(periods, str(tmp_path / "log"), work)
    assert seen == ["a", "b", "c"] and [k[0] for k in e.value.errors] == ["a"]
    assert jobs.process_periods(periods, str(tmp_path / "log"), work) == 1 and seen[-1] == "a"


def test_stored_tables_are_held_against_their_schemas(spark):
    from spawnlens.schemas import StructType, stored_signature

    declared = StructType.fromDDL("a int NOT NULL, b string, c bigint, d date NOT NULL")
    stored = spark.createDataFrame([(1, "x", 1.5), (None, None, 2.0)], "a int, b string, c double")
    got = [tuple(r) for r in stored_signature(declared, stored).collect()]
    assert got == [("a", "int", "REQUIRED", 2, 1, True), ("b", "string", "NULLABLE", 2, 1, False), ("c", "double", "NULLABLE", 2, 0, True), ("d", None, "REQUIRED", 2, 2, True)]
    empty = [tuple(r)[3:] for r in stored_signature(declared, stored.where("a = 9")).collect()]
    assert empty == [(0, 0, False), (0, 0, False), (0, 0, True), (0, 0, True)]


def test_periods_hold_their_contracts(spark):
    chains = spark.createDataFrame([("e", "2024-01-15"), ("late", "2024-06-01")], "chain string, genesis string")
    plan = S.periods_of(chains, "2024-04-01").withColumn("n", S.period_number(F.date_sub("end_date", 1), "2024-04-01")).collect()
    assert [(str(r["start_date"]), str(r["end_date"]), r["n"]) for r in plan] == [("2024-03-02", "2024-04-01", 0), ("2024-02-01", "2024-03-02", 1), ("2024-01-15", "2024-02-01", 2)]
    days = spark.sql("SELECT explode(sequence(DATE'2024-01-15', DATE'2024-04-02')) AS d").withColumn("n", S.period_number(F.col("d"), "2024-04-01")).collect()
    assert all(r["n"] is None if str(r["d"]) >= "2024-04-01" else any(p["n"] == r["n"] and p["start_date"] <= r["d"] < p["end_date"] for p in plan) for r in days)


def test_known_factories_are_seen_in_any_case(spark):
    known = spark.createDataFrame([("e", "0xAB", "n", "p", "t"), ("p", "0xcd", "n", "p", "t")], "chain string, address string, name string, project string, contract_type string")
    contracts = spark.createDataFrame([("e", "0xaB"), ("e", "0xab"), ("e", None), ("x", "0xcd")], "chain string, address string")
    assert [(r["chain"], r["seen"], r["chain_contracts"]) for r in S.known_factories(known, contracts).orderBy("chain").collect()] == [("e", True, 3), ("p", False, 0)]


def test_detection_goes_on_with_the_batches_that_are_not_there(spark, tmp_path, monkeypatch):
    from spawnlens.streaming import jobs

    contracts = spark.createDataFrame([("e", f"a{k}", "f0fd" if k % 3 else "00") for k in range(60)] + [("e", "a1", "f0fd"), ("e", "none", None), ("p", "a1", "00")], "chain string, address string, code string")
    path, publish, calls = str(tmp_path / "r"), files.publish, []

    def lost_at_third(*a):
        calls.append(a)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return publish(*a)

    monkeypatch.setattr(files, "publish", lost_at_third)
    with pytest.raises(RuntimeError, match="lost"):
        jobs.detect_in_batches(contracts, path, 4)
    assert files.read_results(spark, path).select("batch").distinct().count() <= 2
    assert jobs.detect_in_batches(contracts, path, 4) == 2 and jobs.detect_in_batches(contracts, path, 4) == 0
    rows = [(r["chain"], r["address"], r["is_factory"]) for r in files.read_results(spark, path).collect()]
    assert sorted(rows) == sorted([("e", f"a{k}", bool(k % 3)) for k in range(60)] + [("p", "a1", False)])


def test_unique_codes_send_no_code_on(spark):
    rows = [("a", "0x3", "f0" * 40, "2020-01-02", 2), ("a", "0x2", "f0" * 40, "2020-01-01", 1), ("a", "0x1", "f0" * 40, "2020-01-01", 1), ("b", "0x4", "f0" * 40, "2020-01-01", 9)]
    rows += [("a", "0x5", None, "2020-01-01", 3), ("a", "0x6", "None", "2020-01-01", 4), ("a", "0x7", "0x", "2020-01-01", 5), ("a", "0x8", "", "2020-01-01", 6), ("a", "0x9", "ff" * 4, "2999-01-01", 7)]
    contracts = spark.createDataFrame(rows, "chain string, address string, code string, t string, block_number long").withColumn("block_timestamp", F.to_timestamp("t")).drop("t")
    got = S.unique_codes(contracts, carry={"digest": F.sha2("code", 256), "size": F.length("code")})
    whole = S.unique_codes(contracts)
    want = whole.select("chain", "bytecode_hash", "address", "deployment_timestamp", "block_number", F.sha2("code", 256).alias("digest"), F.length("code").alias("size"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert {(r["chain"], r["address"], r["size"]) for r in got.collect()} == {("a", "0x1", 80), ("b", "0x4", 80), ("a", "0x6", 4)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "code#" not in next(x for x in plan.splitlines() if "Aggregate" in x)


def test_codes_once_are_the_distinct_codes(spark):
    from spawnlens.operators import bytecode as B

    rows = [(k % 5, f"0x{k % 7}f0" if k % 11 else None) for k in range(200)] + [(None, "aa"), (3, "None"), (3, "")]
    contracts = spark.createDataFrame(rows, "at int, code string")
    want = sorted(map(tuple, B.distinct_codes(contracts).collect()))
    for most in (1 << 22, 2, 0):
        kept = []
        got = B.codes_once(contracts, ["at"], lambda df: kept.append(keep(df)) or kept[-1], most=most)
        assert sorted(map(tuple, got.select("code", "bytecode_hash").collect())) == want and len(kept) == 2
    assert B.codes_once(contracts.limit(0), ["at"], keep).count() == 0


def test_tasks_of_instructions_are_bounded_by_characters(spark):
    from spawnlens.operators import bytecode as B

    codes = keep(spark.range(3000).select(F.concat(F.lit("5b6001565b"), F.lpad(F.col("id").cast("string"), 60, "0")).alias("code")).withColumn("bytecode_hash", F.sha2("code", 256)))
    assert [B.dealt(codes, n).rdd.getNumPartitions() for n in (1 << 30, 21_000, 2100)] == [1, 10, 100]
    assert B.dealt(codes.limit(0)).rdd.getNumPartitions() == 1
    blocks = B.reachability(B.block_rows(B.with_blocks(B.instruction_rows(B.dealt(codes, 21_000)))))
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan  # codes are shuffled, their instructions are not
    assert blocks.count() == B.block_rows(B.with_blocks(B.instruction_rows(codes))).count()


def test_targets_by_blocks_are_those_by_rows(spark):
    from spawnlens.operators import bytecode as B

    codes = spark.createDataFrame([("6004565b00",), ("5b600056",), ("60056006575b5bf0",), ("6099565b",), ("",)], "code string").withColumn("bytecode_hash", F.sha2("code", 256))
    rows = B.with_blocks(B.instruction_rows(codes))
    got, want = (sorted(map(tuple, t.collect())) for t in (B.static_targets(rows, B.block_rows(rows)), B.static_targets(rows)))
    assert got == want and len(got) >= 2


def test_each_code_is_judged_once_for_all_batches(spark, tmp_path, monkeypatch):
    from spawnlens.streaming import jobs

    contracts = spark.createDataFrame([("e", f"a{k}", "f0fd" if k % 3 else "00") for k in range(40)], "chain string, address string, code string")
    judge, seen = jobs.kernel.verdicts, []

    def counted(codes, **more):
        seen.append(codes.count())
        return judge(codes, **more)

    monkeypatch.setattr(jobs.kernel, "verdicts", counted)
    assert jobs.detect_in_batches(contracts, str(tmp_path / "r"), 4) == 4 and jobs.detect_in_batches(contracts, str(tmp_path / "r"), 4) == 0
    assert seen == [2] and files.read_results(spark, str(tmp_path / "r")).where("is_factory = (factory_type <> 'NONE')").count() == 40


def test_slow_rows_are_spread(spark):
    rows = spark.range(0, 1000, 1, 1)
    assert skew.spread(rows).rdd.getNumPartitions() == 4 and skew.spread(rows, 10).rdd.getNumPartitions() == 100
    assert sorted(r["id"] for r in skew.spread(rows, 10).collect()) == list(range(1000)) and max(skew.rows_by_task(skew.spread(rows, 10))) <= 20
    assert skew.spread(rows.limit(0)).count() == 0
