"""Operators on small hand-made tables."""

import json

import pytest
from pyspark.sql import functions as F

from spawnlens.functions import notes, numbers
from spawnlens.functions import source_features as SF
from spawnlens.operators import clustering as C
from spawnlens.operators import evaluation as E
from spawnlens.operators import scans as S
from spawnlens.operators import traces as T
from spawnlens.sources import fetch, files
from spawnlens.streaming import jobs

ZERO = "0x" + "0" * 40
TRACES = [
    ("create", 1, "0xAA", "0x01", "0", "2025-01-01", "0xaa", "12"), ("create", 1, "0xaa", "0x02", "0,1", "2025-01-01", "0xaa", "x"), ("create", 1, "0xbb", "0x03", "", "2025-01-01", "0xbb", None), ("create", 1, "0xbb", "0x04", None, "2025-01-01", "0xbb", None),
    ("create", 0, "0xbb", "0x05", "0", "2025-01-01", "0xbb", None), ("call", 1, "0xbb", "0x06", "0", "2025-01-01", None, None), ("create", 1, "0xbb", None, "0", "2025-01-01", "0xbb", None), ("create", 1, ZERO, "0x08", "0", "2025-01-01", "0xbb", None),
    ("create", 1, "0xbb", "0x09", "1", "2025-01-02", "0xbb", "9" * 30), ("create", 1, "0xbb", "0x10", "1", "2025-06-01", "0xbb", None), ("create", 1, "0xbb", "0x11", "2", "2025-01-02", "", None),
]


def _made(spark):
    df = spark.createDataFrame([("ethereum", *t) for t in TRACES], "chain string, trace_type string, status bigint, from_address string, to_address string, trace_address string, d string, output string, value string")
    df = df.select("*", F.to_timestamp("d").alias("block_timestamp"), F.lit("0x").alias("transaction_hash"), F.lit(1).alias("block_number"), F.lit("0x").alias("input"), F.lit(1).alias("gas"), F.lit(1).alias("gas_used"))
    return T.creations(df)


def test_creations(spark):
    rows = {r["created_contract_address"]: r for r in _made(spark).collect()}
    assert set(rows) == {"0x01", "0x02", "0x09", "0x11"}
    assert rows["0x02"]["trace_depth"] == 2 and str(rows["0x01"]["value"]) == "12.000000000" and rows["0x02"]["value"] is None and rows["0x09"]["value"] is None


def test_distributions(spark):
    made = _made(spark)
    assert sorted((str(r[1]), r[2]) for r in T.daily_active_factories(made).collect()) == [("2025-01-01", 1), ("2025-01-02", 1)]
    assert sorted((str(r[1]), r[2]) for r in T.daily_create_traces(made).collect()) == [("2025-01-01", 2), ("2025-01-02", 2)]
    reuse = sorted((r["contract_reuse_count"], r["runtime_group_count"], r["contracts_in_group"], r["cumulative_contracts"], r["cumulative_runtime_fraction"]) for r in T.reuse_distribution(made).collect())
    assert reuse == [(1, 1, 1, 1, 0.5), (2, 1, 2, 3, 1.0)]
    assert [(r["create_count"], r["factory_group_count"], r["cumulative_fraction"]) for r in T.activity_distribution(made).collect()] == [(2, 2, 1.0)]


def test_partitions_are_replaced(spark, tmp_path):
    made = _made(spark)
    for _ in range(2):
        T.write_creations(made, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == 4


def test_confusion_of_known_counts(spark):
    rows = spark.createDataFrame([(True, True)] * 485 + [(False, True)] * 24 + [(False, False)] * 2335 + [(True, False)] * 63, "is_factory_ground_truth boolean, is_factory_detected boolean").withColumn("execution_time", F.lit(1))
    r = E.confusion(rows).first()
    assert (r["tp"], r["fp"], r["tn"], r["fn"]) == (485, 24, 2335, 63)
    assert (r["precision"], r["recall"], r["f1"], r["accuracy"]) == (0.9528487229862476, 0.885036496350365, 0.9176915799432357, 0.9700722394220846)
    none = E.confusion(rows.where("false")).first()
    assert none["precision"] == 0 and none["accuracy"] == 0


def test_upper_median(spark):
    for values, want in (([1, 2, 3, 4], 3), ([5], 5), ([1, 1, 2], 1)):
        assert E.upper_median(spark.createDataFrame([(v,) for v in values], "c bigint"), "c").first()[0] == want


def test_notes(spark):
    df = spark.createDataFrame([("Verified non-factory: no create/create2/new keywords. Contract: Juniper",), ("Factory contract identified from traces: executed 4616 CREATE operations",), (None,), ("Contract: ",)], "n string")
    got = [(r[0], r[1]) for r in df.select(notes.contract_name(F.col("n")), notes.executed_count(F.col("n"))).collect()]
    assert got == [("Juniper", None), ("Unknown", 4616), ("Unknown", None), ("Unknown", None)]
    a = spark.createDataFrame([("0x00000000000311612d",), ("0x00000000500e2fec",)], "a string").select(notes.is_vanity(F.col("a")), notes.leading_zeros(F.col("a"))).collect()
    assert [tuple(x) for x in a] == [(True, 11), (False, 0)]


SOURCE = """import "openzeppelin/Ownable.sol";
contract PairFactory is Ownable {
  using Clones for address;
  mapping(address => address[]) public pools;
  event Made(address p);
  function make(bytes32 salt) external onlyOwner { create2(0, 0, 0, salt); }
}
"""


def test_source_features(spark):
    found = SF.all_features(F.col("t"))
    assert len(found) == 92
    r = spark.createDataFrame([(SOURCE,)], "t string").select(*[c.alias(k) for k, c in found.items()]).first().asDict()
    want = {"n_functions": 1, "n_events": 1, "n_mappings": 1, "n_arrays": 1, "n_imports": 1, "n_contracts": 1, "public_ratio": 0.5, "external_ratio": 0.5, "n_lines": 7, "n_using": 1, "n_distinct_using": 1, "has_create": 0, "has_create2": 1, "has_salt": 1, "has_openzeppelin": 1, "has_ownable": 1, "has_only_owner": 1, "lib_Clones": 1, "name_factory": 1, "name_pair": 1, "bow_factory": 0, "bow_pool": 0}
    assert {k: r[k] for k in want} == want


def test_periods_are_cut_at_the_beginning(spark):
    rows = sorted((str(r["start_date"]), str(r["end_date"])) for r in S.periods(spark).where("chain = 'ethereum'").collect())
    assert rows[-1] == ("2025-05-02", "2025-06-01") and rows[0][0] == "2015-07-30"
    assert all(a[1] == b[0] for a, b in zip(rows, rows[1:], strict=False))


def test_numbers(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (3.0,), (20.5,), (50.0,), (6e6,)], "x double")
    got = [(r[0], r[1]) for r in df.select(numbers.bin_label(F.col("x")), numbers.nice_upper_bound(F.col("x"))).collect()]
    assert got == [(">5M", 1.0), ("1", 1.0), ("3", 5.0), (">5M", 50.0), ("21-50", 50.0), (">5M", 1e7)]


def test_addresses(spark):
    df = spark.createDataFrame([(" 0x" + "a" * 40,), ("M_x",), ("b" * 40,), ("0x12",), (None,)], "a string")
    assert [r[0] for r in df.select(S.normalised_address(F.col("a"))).collect()] == ["0x" + "a" * 40, None, "0x" + "b" * 40, None, None]


def test_merge_and_expand(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    s = spark.createDataFrame([("b", None), ("c", 9)], "k string, v int")
    assert sorted((r["k"], r["v"]) for r in S.merge(t, s, "k", ["v"]).collect()) == [("a", 1), ("b", None)]
    c = spark.createDataFrame([("x", "F000"), ("y", "f000"), ("z", "00")], "address string, code string")
    v = spark.createDataFrame([("f000", True)], "code string, is_factory boolean")
    assert sorted(r["address"] for r in S.expand_verdicts(c, v).collect()) == ["x", "y"]


def test_rotation_and_hulls(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 2.0, 0.0)], "id int, px double, py double")
    got = {r["id"]: (round(r["px"], 6), round(r["py"], 6)) for r in C.rotate(p, 90).collect()}
    assert got == {1: (1.0, -1.0), 2: (1.0, 1.0)}
    assert C.rotate(p, 360) is p


def test_quoted_csv_and_lists(spark, tmp_path):
    (tmp_path / "v.csv").write_text('note, here\n"Txhash","Address","Name"\n"0x1","0xA","Foo, Bar"\n"0x2","0xB"\n')
    assert [tuple(r) for r in files.read_verified(spark, str(tmp_path / "v.csv")).collect()] == [("0xA", "Foo, Bar")]
    (tmp_path / "l.csv").write_text("chain,factory_address\nethereum,0xAb\npolygon,0xCd\n")
    r = files.read_factory_addresses(spark, str(tmp_path / "l.csv"), ["ethereum"]).collect()
    assert [(x["factory_address"], x["total_creations"]) for x in r] == [("0xab", None)]
    assert sorted(x[0] for x in files.read_address_list(spark, str(tmp_path / "l.csv")).collect()) == ["0xAb", "0xCd"]


def test_packages(spark, tmp_path):
    root = tmp_path / "sources" / "ethereum"
    root.mkdir(parents=True)
    (root / "0xAA.json").write_text(json.dumps({"chain": "wrong", "files": [{"path": "a.sol", "content": "x"}]}, indent=1))
    (root / "0xBB.json").write_text("{ broken")
    rows = files.read_packages(spark, str(tmp_path / "sources")).collect()
    assert [(r["chain"], r["address"]) for r in rows] == [("ethereum", "0xaa")]


def test_fetch(spark, tmp_path):
    base = tmp_path / "partial_match" / "ethereum" / "0xaa"
    (base / "sources").mkdir(parents=True)
    (base / "metadata.json").write_text(json.dumps({"compiler": {"version": "0.8"}, "sources": {"a.sol": {}, "b.sol": {"content": "inline"}, "c.sol": {}}}))
    (base / "sources" / "a.sol").write_text("A")
    got = fetch.fetch(fetch.FolderProvider(str(tmp_path)), "ethereum", "0xaa")
    assert got["source_status"] == "partial_match" and got["files"] == [("a.sol", "A"), ("b.sol", "inline")]
    spark.dataSource.register(fetch.PackageSource)
    rows = spark.read.format("contract_sources").options(chain="ethereum", addresses="0xaa,0xbb").load(str(tmp_path)).collect()
    assert [(r["address"], len(r["files"])) for r in rows] == [("0xaa", 2)]


def test_results_are_appended_once_and_schema_grows(spark, tmp_path):
    path = str(tmp_path / "r")
    files.append_results(spark.createDataFrame([("e", "a"), ("e", "a")], "chain string, address string"), path)
    files.append_results(spark.createDataFrame([("e", "b", 1)], "chain string, address string, extra int"), path)
    rows = spark.read.option("mergeSchema", True).parquet(path)
    assert rows.count() == 2 and "extra" in rows.columns


def test_incremental_detection_is_idempotent(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = "address string, code string"
    spark.createDataFrame([("a", "f000"), ("b", "00")], schema).write.parquet(src)
    for k in range(3):
        if k == 2:
            spark.createDataFrame([("c", "f000"), ("d", "f500")], schema).write.mode("append").parquet(src)
        jobs.detect_incrementally(spark.readStream.schema(schema).parquet(src), out, state)
        assert spark.read.parquet(out).count() == (2 if k < 2 else 3)


def test_scans_by_kind_of_chain(spark):
    with pytest.raises(ValueError, match="other"):
        S.scan_chain("other", {}, "2020-01-01", "2021-01-01")
    t = spark.createDataFrame([("h", "6001", None, "2020-05-05 00:00:00", 7)], "hash string, input string, to_address string, t string, block_number long").withColumn("block_timestamp", F.col("t").cast("timestamp"))
    r = spark.createDataFrame([("h", "0xAB", 1)], "transaction_hash string, contract_address string, status long")
    tables = {"contracts": lambda: 1 / 0, "transactions": lambda: t, "receipts": r}  # what a kind does not need is not read
    assert [x["address"] for x in S.scan_chain("join", tables, "2020-01-01", "2021-01-01").collect()] == ["0xab"]


def test_fetched_rows(spark):
    rows = [("0xAB", "2020-01-02T03:04:05Z"), ("0xAC", None), ("0xAD", "2020-01-02T03:04:05+02:00"), (None, "2020-01-02"), ("0xAE", "soon"), ("0xAF", "")]
    got = S.normalised(spark.createDataFrame(rows, "address string, block_timestamp string"), F.lit("2021-01-01").cast("timestamp")).collect()
    assert [r["problem"] for r in got] == [None, None, None, "address", "time", "time"]
    assert [str(r["block_timestamp"]) for r in got[:3]] == ["2020-01-02 03:04:05", "2021-01-01 00:00:00", "2020-01-02 01:04:05"] and got[0]["address"] == "0xab"


def test_fetching_until_settled(spark):
    wanted = spark.createDataFrame([("e", f"0x{i}") for i in range(9)], "chain string, factory_address string")
    have: set = set()
    cached = lambda: spark.createDataFrame([("e", a) for a in sorted(have)], "chain string, address string")

    def fetch(left):
        have.update(sorted(r["address"] for r in left.collect() if r["address"] != "0x8")[:3])

    assert S.fetch_until_settled(wanted, cached, fetch) == 1 and len(have) == 8
    assert S.fetch_until_settled(wanted.limit(0), cached, fetch) == 0


def test_first_provider_that_has_rows(spark, tmp_path):
    one = spark.range(1)
    assert S.first_available(lambda: spark.read.parquet(str(tmp_path / "none")), lambda: one.limit(0), lambda: one).count() == 1
    with pytest.raises(FileNotFoundError, match="no rows"):
        S.first_available(lambda: spark.read.parquet(str(tmp_path / "none")), lambda: one.limit(0))
    with pytest.raises(ZeroDivisionError):
        S.first_available(lambda: 1 / 0, lambda: one)


def test_results_are_appended_once_only(spark, tmp_path):
    path = str(tmp_path / "r")
    assert files.read_results(spark, path) is None
    for rows in ([("e", "a", 1), ("e", "b", 1)], [("e", "b", 2), ("p", "b", 2)], []):
        files.append_results(spark.createDataFrame(rows, "chain string, address string, n int"), path)
    assert sorted(map(tuple, files.read_results(spark, path).collect())) == [("e", "a", 1), ("e", "b", 1), ("p", "b", 2)]


def test_tables_are_created_once(spark):
    from spawnlens.schemas import schema

    assert files.create_table(spark, "made_once", schema("progress"), ["chain"]) and files.create_table(spark, "made_once", schema("progress"), ["chain"])
    assert not files.create_table(spark, "made_once", schema("results"), ["chain"])
    spark.sql("DROP TABLE made_once")


def test_rows_in_order_without_one_task(spark):
    import random

    from spawnlens.operators import order

    rng = random.Random(1)
    values = [rng.choice([None, 1, 1, 1, 2, rng.randint(3, 500)]) for _ in range(400)]
    df = spark.createDataFrame([(v, k) for k, v in enumerate(values)], "v int, k int")
    got = order.numbered(df, ["v", "k"])
    want = sorted(((v, k) for k, v in enumerate(values)), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [(r["v"], r["k"]) for r in sorted(got.collect(), key=lambda r: r["no"])] == want
    assert sorted(r["no"] for r in got.collect()) == list(range(1, 401))
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    sums = order.running(df.where("v is not null").groupBy("v").agg(F.count("*").alias("n")), ["v"], F.col("n"), "upto").collect()
    assert all(r["upto"] == sum(1 for v in values if v is not None and v <= r["v"]) for r in sums)
    assert order.numbered(df.where("false"), ["v", "k"]).count() == 0
    assert sorted(r["j"] for r in order.repeated(spark.createDataFrame([(5,)], "n long"), "n", "j", 2).collect()) == [0, 1, 2, 3, 4]


def test_ties_have_places_of_their_own(spark):
    got = E.ecdf(spark.createDataFrame([(3,), (1,), (3,), (None,)], "t int"), "t").collect()
    assert sorted((r["value"], round(r["cdf"], 6)) for r in got) == [(1, 0.333333), (3, 0.666667), (3, 1.0)]


def test_varimax_rotates_back():
    import numpy as np

    rng = np.random.default_rng(1)
    simple = np.kron(np.eye(3), np.ones((5, 1))) + 0.01 * rng.normal(size=(15, 3))
    turn, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    got = C.varimax(simple @ turn, rounds=200, tolerance=1e-12)
    assert np.allclose(np.sort(np.abs(got).max(axis=0)), np.sort(simple.max(axis=0)), atol=0.03) and (np.abs(got) > 0.5).sum() == 15


def test_silhouettes(spark):
    import math
    import random

    rng = random.Random(2)
    rows = [(c, [rng.gauss(3 * c, 1), rng.gauss(0, 1)]) for c in (0, 1, 2) for _ in range(20)] + [(7, [50.0, 0.0]), (0, [0.0, 0.0]), (0, [0.0, 0.0])]
    widths = []
    for i, (c, x) in enumerate(rows):
        by = {}
        for j, (o, y) in enumerate(rows):
            if i != j:
                by.setdefault(o, []).append(math.dist(x, y))
        if c not in by:
            widths.append(0.0)
            continue
        a, b = sum(by[c]) / len(by[c]), min(sum(d) / len(d) for o, d in by.items() if o != c)
        widths.append((b - a) / max(a, b))
    df = spark.createDataFrame(rows, "label int, x array<double>")
    assert C.silhouette(df, at_once=10).first()[0] == pytest.approx(sum(widths) / len(widths))
    assert C.silhouette(df.where("label = 0")).first()[0] is None
    assert C.quality_of(df.where("label = 0"))["silhouette"] == -1.0
    assert [r["k"] for r in C.select_k(spark.createDataFrame([(0, [1.0])] * 4, df.schema), 2, 3).collect()] == [1]


def test_convex_hulls(spark):
    import random

    rng = random.Random(3)
    points = [(c, rng.gauss(c, 1), rng.gauss(0, 1)) for c in (0, 1) for _ in range(300)] + [(2, 0.0, 0.0), (2, 1.0, 0.0), (2, 2.0, 0.0), (2, 2.0, 2.0), (2, 0.0, 2.0), (2, 1.0, 1.0), (3, 5.0, 5.0), (3, 5.0, 5.0), (4, None, 1.0)]
    got = C.convex_hulls(spark.createDataFrame(points, "label int, px double, py double").repartition(5)).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["label"], r["corner"])):
        by.setdefault(r["label"], []).append((r["px"], r["py"]))
    assert by[2] == [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)] and by[3] == [(5.0, 5.0)] and 4 not in by
    for c in (0, 1):
        own = [(x, y) for k, x, y in points if k == c]
        edges = list(zip(by[c], by[c][1:] + by[c][:1], strict=True))
        assert set(by[c]) <= set(own) and all((b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) >= -1e-12 for a, b in edges for x, y in own)


def test_last_of_each_and_bad_packages(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 2, "z"), ("b", 1, None)], "k string, n int, v string")
    assert sorted(map(tuple, S.last_of_each(rows, ["k"], ["n"]).collect())) == [("a", 3, "y"), ("b", 1, None)]
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "0xa.json").write_text('{"address": ""}')
    (tmp_path / "e" / "0xb.json").write_text('{"address": ')
    assert [r["path"][-8:] for r in files.bad_packages(spark, str(tmp_path)).collect()] == ["0xb.json"]


class Shouting:
    """A provider that the test names."""

    def __init__(self, root):
        from spawnlens.sources.fetch import FolderProvider

        self.inner = FolderProvider(root)

    def get(self, path):
        text = self.inner.get(path)
        return text.upper() if text is not None and "/sources/" in path else text


def test_other_providers():
    assert fetch.provider_class("") is fetch.FolderProvider and fetch.provider_class(f"{__name__}:Shouting").__name__ == "Shouting"


def test_periods_are_marked_and_resumed(spark, tmp_path):
    path, seen = str(tmp_path / "log"), []
    periods = spark.createDataFrame([("e", "2020-01-01", "2020-01-31"), ("e", "2020-01-31", "2020-03-01"), ("p", "2020-01-01", "2020-01-31")], "chain string, a string, b string").selectExpr("chain", "to_date(a) AS start_date", "to_date(b) AS end_date")

    def work(chain, start, end):
        if chain == "p" and not any(c == "p" for c, _ in seen):
            seen.append((chain, str(start)))
            raise RuntimeError("lost")
        seen.append((chain, str(start)))
        return 5, 2

    with pytest.raises(RuntimeError, match="lost"):
        jobs.process_periods(periods, path, work)
    assert jobs.process_periods(periods, path, work) == 1 and jobs.process_periods(periods, path, work) == 0
    assert seen == [("e", "2020-01-01"), ("e", "2020-01-31"), ("p", "2020-01-01"), ("p", "2020-01-01")]
    latest = S.progress_log_latest(jobs.read_log(spark, path), ["chain", "start_date"]).collect()
    assert len(latest) == 3 and all(r["status"] == "completed" and r["factories_found"] == 2 for r in latest)


def test_features_of_one_pass_are_those_of_single_patterns(spark):
    from spawnlens.functions import source_features as SF

    texts = ["", "contract A is Ownable { using SafeMath for uint; function f() public { } }\r\nlibrary L {}\n", "import import_x IMPORT public,public external_ external Factory factory FACTORY erc20 x_erc20 clones Clones beacon-proxy",
             "abstract contract TokenVault{} contract PoolFactoryRouter is X { bytes32 salt; create2 ( a ); delegateCall; mapping (a=>b) m; onlyOwner; uint[] a; }", "aa dao\ndao AA nft_ nft"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, text string")
    names = SF.feature_names()
    assert len(names) == 92 and names == sorted(names)
    one = SF.with_features(df).select("id", *names).orderBy("id").collect()
    each = df.select("id", *[c.alias(k) for k, c in SF.all_features(F.col("text")).items()]).orderBy("id").collect()
    assert one == each and any(r["bow_factory"] == 3 for r in one) and any(r["name_vault"] == 1 for r in one)


def test_silhouettes_of_several_labels(spark):
    """Widths of three ways to label the same rows, in blocks smaller than a cluster: those of each way alone, copies counted as often as they stand; rows are sent once a block."""
    import math
    import random

    from spawnlens.operators import blocks

    rng = random.Random(5)
    rows = [(k % 2, k % 3, k % 5 if k % 7 else 5, [rng.gauss(4 * (k % 3), 1), 1e4 + rng.gauss(0, 1)]) for k in range(90)]
    rows += rows[:9] * 3
    want = []
    for way in range(3):
        widths = []
        for i, r in enumerate(rows):
            by = {}
            for j, s in enumerate(rows):
                if i != j:
                    by.setdefault(s[way], []).append(math.dist(r[3], s[3]))
            a, b = sum(by[r[way]]) / len(by[r[way]]), min(sum(d) / len(d) for c, d in by.items() if c != r[way])
            widths.append((b - a) / max(a, b))
        want.append(sum(widths) / len(widths))
    df = spark.createDataFrame(rows, "one int, two int, three int, x array<double>")
    got = {r["name"]: r["silhouette"] for r in C.silhouettes(df, ["one", "two", "three"], at_once=8).collect()}
    assert [got[c] for c in ("one", "two", "three")] == pytest.approx(want, abs=1e-9)
    assert [C.silhouette(df.withColumnRenamed(c, "label"), at_once=50).first()[0] for c in ("one", "two", "three")] == pytest.approx(want, abs=1e-9)
    assert blocks.deal([10, 3, 25, 4, 5], 10) == ([0, 1, 2, 1, 5], [1, 1, 3, 1, 1])


def test_summary_by_code(spark):
    """The same as the summary of joined rows, with codes without a verdict, without a hash and without times; no frequent keys are looked for."""
    rows = [("a" if k % 3 else "b", None if k % 11 == 0 else f"h{k % 7}", None if k % 5 == 0 or k % 3 == 0 else float(k % 97)) for k in range(300)]
    contracts = spark.createDataFrame(rows, "chain string, bytecode_hash string, execution_time_ms double")
    found = spark.createDataFrame([("h0", True, "CREATE_ONLY"), ("h1", True, "CREATE2_ONLY"), ("h2", True, "BOTH_CREATE_CREATE2"), ("h3", False, "NONE"), ("h4", None, None)], "bytecode_hash string, is_factory boolean, factory_type string")
    want = S.result_summary(contracts.join(found, "bytecode_hash").withColumns(S.exclusive_flags(F.col("factory_type"))))
    got = S.summary_by_code(contracts, found)
    assert got.dtypes == want.dtypes and sorted(got.collect()) == sorted(want.collect())
    assert S.summary_by_code(contracts.where("false"), found).count() == 0
