import random
import re

import numpy as np
import pytest

from spawnlens.llm import neardup as N

SCHEMA = "doc_id long, text string, component_id string, n long"


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    k = min(k, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(rows, k):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingle_set(t, k))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            if any(s and t and 100 * len(s & t) >= 80 * len(s | t) for s in sets[a] for t in sets[b]):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {i: find(i) for i in ids}


def check(spark, rows, k=2):
    got = N.near_duplicates(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA), k=k).collect()
    want = brute(rows, k)
    assert len(got) == len(rows)
    assert sorted((r["id"], r["component_id"]) for r in got if r["id"] is not None) == sorted((i, want[i]) for i, _ in rows if i is not None)
    assert sorted(r["n_shingles"] for r in got) == sorted(len(shingle_set(t, k)) for _, t in rows)


def vary(text, edits, seed):
    rng, w = random.Random(seed), text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"w{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("k", [2, 5])
def test_against_brute_force(spark, prose, k):
    rows = []
    for g in range(25):
        base = prose(60, g)
        rows += [(g * 10 + 7 * j, vary(base, j, j)) for j in range(4)]
    rows += [(1000, rows[0][1]), (1001, rows[0][1].upper()), (1002, "  " + rows[4][1] + "\n")]
    check(spark, rows, k)


def test_chains_and_members_that_link_nothing(spark):
    # Each text drops words at one end and takes new ones at the other: neighbours link, the ends do not.
    words = [f"t{i}" for i in range(400)]
    rows = [(500 - i, " ".join(words[5 * i : 5 * i + 100])) for i in range(40)]
    base = " ".join(f"b{i}" for i in range(120))
    rows += [(1000 + i, vary(base, 2 + i % 14, i)) for i in range(120)]
    check(spark, rows)


def test_odd_rows(spark, prose):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "a b"), (7, "a b"), (8, " a b"), (9, prose(30_000, 1)), (10, prose(30_000, 1) + " end"), (None, "a b"), (None, None), (11, "İ ß"), (12, "İ ß"), (13, "x y z"), (13, "x y z"), (14, "q r s t"), (14, "a b")]
    check(spark, rows)
    check(spark, [])
    check(spark, [(5, "only one here")])


def test_blocks_of_clusters(spark, monkeypatch):
    monkeypatch.setattr(N, "MEMBERS", 16)
    monkeypatch.setattr(N, "OTHERS", 4)
    base = " ".join(f"b{i}" for i in range(100))
    check(spark, [(i, vary(base, 3 + i % 10, i)) for i in range(150)])


def test_smallest_ids_of_clusters(spark):
    # x and y link, but every bucket they share is headed by a text too short to link either; z, which links none, puts both in one cluster.
    rows = []
    for g in range(8):
        rng, core, one, two = random.Random(g), [f"c{g}.{i}" for i in range(90)], [f"x{g}.{i}" for i in range(10)], [f"y{g}.{i}" for i in range(10)]
        texts = [rng.sample(core, 75) for _ in range(40)] + [core + one, core[:75] + one + two + [f"z{g}.{i}" for i in range(5)], core + two]
        rows += [(1000 * g + i, " ".join(t)) for i, t in enumerate(texts)]
    check(spark, rows, 1)


def test_joint_estimate():
    rng = np.random.default_rng(1)
    for j in (0.3, 0.6, 0.8, 0.95):
        n = 4000
        both, own = rng.integers(0, 2**64, int(n * j), dtype=np.uint64), rng.integers(0, 2**64, (2, int(n * (1 - j) / 2)), dtype=np.uint64)
        a, b = (N.sketch(np.concatenate([both, x])) for x in own)
        size = np.array([float(len(both) + own.shape[1])])
        got = N.joint_similarity(size, size, np.array([(a > b).sum()]), np.array([(a < b).sum()]))[0]
        assert abs(got - j) < 0.13
        assert (N.sketch(np.concatenate([both, *own])) == np.maximum(a, b)).all()  # registers of a union


def test_components_of_long_paths(spark):
    rows = [(i, i + 1) for i in range(1, 200)] + [(300 + i, 300) for i in range(1, 40)] + [(500, 500)]
    got = {r["id"]: r["comp"] for r in N.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(2, 201)}, **{300 + i: 300 for i in range(1, 40)}}
