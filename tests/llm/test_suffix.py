import random

import numpy as np
import pytest

from spawnlens.llm import suffix_dedup as S

SCHEMA = "doc_id long, text string, spans string, source string"


def test_suffix_arrays():
    rng = random.Random(3)
    for _ in range(1500):
        s = [rng.randint(1, rng.choice((1, 2, 3, 9))) for _ in range(rng.randint(0, 40))]
        assert S.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])
    for s in ("ab" * 200, "a" * 300, "abracadabra" * 30):
        assert S.suffix_array(s.encode()) == sorted(range(len(s)), key=lambda i: s[i:])


def brute(rows, length):
    seen, out = {}, []
    for i, t in rows:
        raw = (t or "").encode()
        if i is not None:
            for k in range(len(raw) - length + 1):
                seen[raw[k : k + length]] = min(i, seen.get(raw[k : k + length], i))
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1 if i is not None else 0):
            if seen[raw[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        spans = []
        for k, g in enumerate(gone):
            if g and (not k or not gone[k - 1]):
                spans.append([k, k])
            if g:
                spans[-1][1] = k + 1
        out.append((i, len(raw), tuple(map(tuple, spans)), bytes(x for x, g in zip(raw, gone, strict=True) if not g)))
    return sorted(out, key=str)


def check(spark, rows, length=50, **kw):
    got = S.remove_repeats(spark.createDataFrame([(i, t, "x", "s") for i, t in rows], SCHEMA), length=length, **kw)
    assert got.columns == ["doc_id", "source", "n_bytes", "spans", "kept"]
    assert sorted(((r["doc_id"], r["n_bytes"], tuple((x["start"], x["end"]) for x in r["spans"]), bytes(r["kept"])) for r in got.collect()), key=str) == brute(rows, length)


@pytest.mark.parametrize("hot", [2000, 3])
def test_against_brute_force(spark, prose, hot):
    rng = random.Random(5)
    passages = [prose(rng.randint(8, 40), 1000 + i) for i in range(12)]
    rows = []
    for i in range(80):
        parts = [prose(rng.randint(0, 30), i)]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages), prose(rng.randint(0, 10), rng.randrange(10**6))]
        rows.append((i * 3 % 80, "\n".join(parts)))
    rows += [(100, rows[3][1]), (101, rows[3][1][5:]), (102, "short")]
    check(spark, rows, part_bytes=4000, hot=hot)


def test_few_symbols_and_periods(spark):
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randint(0, 300)))) for i in range(30)] + [(50, "a" * 9000), (51, "a" * 5000 + "b" + "a" * 60), (52, "ab" * 3000), (53, "ba" * 60)]
    check(spark, rows)


def test_odd_rows(spark, prose):
    long = prose(30_000, 1)
    rows = [(1, None), (2, ""), (3, "é" * 30), (4, "x" + "é" * 30), (5, long), (6, long[:5000] + "!"), (None, long), (None, None), (7, "🙂" * 20), (7, "🙂" * 20), (8, "🙂" * 20)]
    check(spark, rows)
    check(spark, [])


def test_whole_characters(spark):
    rows = [(1, "x" + "é" * 30), (2, "é" * 30 + "y" * 60), (3, "ÿ" + "y" * 50)]
    got = {r["doc_id"]: r["kept"] for r in S.remove_repeats(spark.createDataFrame([(i, t, "x", "s") for i, t in rows], SCHEMA), whole_characters=True).collect()}
    assert {i: bytes(t).decode() for i, t in got.items()} == {1: "x" + "é" * 30, 2: "y" * 60, 3: "ÿ"}
    assert S.whole("aéb".encode(), [[2, 4]]) == [[3, 4]] and S.whole("aéb".encode(), [[0, 2]]) == [[0, 1]] and S.whole("é".encode(), [[1, 2]]) == []


def test_keys_that_share_their_bits(spark, prose, monkeypatch):
    """Minimisers that look alike only make work."""
    monkeypatch.setattr(S, "short_keys", lambda keys, buckets: (keys % S.np.uint64(buckets)) << S.np.uint64(32) | keys % S.np.uint64(5))
    passages = [prose(30, 1000 + i) for i in range(5)]
    check(spark, [(i, prose(20, i) + passages[i % 5] + prose(10, 50 + i)) for i in range(30)], part_bytes=4000)


def test_texts_of_several_sections(spark, prose):
    rng = random.Random(9)
    long = prose(130_000, 1)
    assert len(long) > 2 * S.SECTION
    edited = "".join(c if rng.random() > 0.0005 else "#" for c in long)
    at = [S.SECTION + k for k in (-30, 0, 1, 25, 49, 50, 60)]
    rows = [(1, long[at[0] - 40 : at[-1] + 40]), (2, long), (3, "x" + edited), (4, "a" * 600_000), (5, "a" * 60), (0, "b" * 50 + "a" * 55)]
    check(spark, rows)


def test_sections_hold_each_window_once():
    texts = [bytes(range(256)) * 3, b"z" * 50, b"q" * 49, bytes(300)]
    x = S.Sections([(k, 10 * k, 0, t) for k, t in enumerate(texts) if len(t) >= 50], 50)
    at = S.np.flatnonzero(x.valid)
    assert [x.raw[k : k + 50] for k in at] == [t[k : k + 50] for t in texts if len(t) >= 50 for k in range(len(t) - 49)]
    assert x.row[x.of(at)].tolist() == [k for k, t in enumerate(texts) for _ in range(len(t) - 49)]


def test_digests():
    rng = random.Random(3)
    raw = bytes(rng.choice(b"ab") for _ in range(4000))
    pieces, _ = S.window_keys(raw, 50)
    start = S.np.array([rng.randrange(3000) for _ in range(4000)])
    stop = start + S.np.array([rng.choice((33, 50, 51, 66, 67, 84, 300, 900)) for _ in range(4000)])
    by = {}
    for a, b, d in zip(start.tolist(), stop.tolist(), S.digests(pieces, start, stop).tolist(), strict=True):
        by.setdefault(d, set()).add(raw[a:b])
    assert all(len(x) == 1 for x in by.values()) and len(by) == len({raw[a:b] for a, b in zip(start.tolist(), stop.tolist(), strict=True)})


def test_strings_are_found_by_digest_and_minimiser():
    known, keys = S.np.array([1, 5, 5, 5, 9], S.np.uint64), S.np.array([0, 1, 2, 3, 0], S.np.uint64)
    got = S.found_at(known, keys, S.np.array([5, 5, 5, 5, 9, 10, 0], S.np.uint64), S.np.array([3, 1, 2, 4, 0, 0, 0], S.np.uint64))
    assert got.tolist() == [3, 1, 2, -1, 4, -1, -1]


def test_joined_arrays():
    some = [np.arange(5, dtype=np.uint64) << np.uint64(60), np.zeros(0, np.uint8), np.array([-3, 7], np.int16), np.array([True, False]), np.arange(3, dtype=np.uint32)]
    got = S.arrays(S.joined(*some))
    assert [x.dtype for x in got] == [x.dtype for x in some] and all((a == b).all() for a, b in zip(got, some, strict=True))
    assert {chr(S.joined(x)[0]) for x in some} <= set("LBh?I") and S.arrays(b"") == []
