import math
import random

from spawnlens.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, score double"


def brute(rows, k):
    ok = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in {i: v for i, v in sorted(ok, reverse=True) if i % 100 == 0}.items():
        scores = sorted(((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in ok if i != q and len(a) == len(b)))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


def run(spark, rows, k=10):
    df = spark.createDataFrame([(*r, 0, 0.5) for r in rows], SCHEMA)
    got = topk.search(df, df.where("vec_id % 100 = 0"), k)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    return sorted(tuple(r) for r in got.collect())


def f32(x):
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


def test_against_brute_force_with_ties(spark):
    rng = random.Random(2)
    rows = [(i, [f32(rng.choice([-0.5, 0.0, 0.25, 1.0])) for _ in range(4)]) for i in range(900)]
    assert run(spark, rows) == brute(rows, 10)


def test_hot_vector_and_few_candidates(spark):
    rows = [(i, [0.5, 0.5]) for i in range(400)]
    assert run(spark, rows) == brute(rows, 10)
    assert run(spark, [(0, [1.0]), (1, [2.0])]) == [(0, 1, 1, 1024 * 2048)]
    assert run(spark, [(0, [1.0])]) == []


def test_odd_vectors_and_empty_table(spark):
    rows = [(0, [1.0, 1.0]), (100, None), (200, [1.0, None]), (300, [float("nan"), 1.0]), (400, [float("inf"), 1.0]), (None, [1.0, 1.0]), (1, [0.5, 0.5]), (2, [1.0]), (3, []), (500, []), (5, [0.5, 0.5])]
    assert run(spark, rows) == brute(rows, 10)
    assert run(spark, []) == []


def test_large_products_stay_exact(spark):
    rows = [(0, [f32(3e7), 1.0]), (1, [f32(2e5), 1.0]), (2, [f32(2e5), 2.0])]
    assert run(spark, rows) == brute(rows, 10)


def test_slices(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, [f32(rng.uniform(-1, 1)) for _ in range(3)]) for i in range(0, 1200)]
    monkeypatch.setattr(topk, "SLICE_BYTES", 200)
    assert run(spark, rows) == brute(rows, 10)


def test_few_bins(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, [f32(rng.gauss(0, 3)) for _ in range(6)], 0, 0.0) for i in range(400)]
    want = brute(rows, 5)
    monkeypatch.setattr(topk, "HISTOGRAM_BYTES", 1)
    monkeypatch.setattr(topk, "LEAST", 2)
    df = spark.createDataFrame(rows, SCHEMA)
    assert topk.bins_of(4) == 2
    got = topk.search(df, df.where("vec_id % 100 = 0"), k=5)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
