"""The filter audit against plain Python over all orders."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spawnlens.llm import filter_audit


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def plain(text):
    w = words(text)
    return (len(w), len(set(w)), len(re.findall("[A-Z]", text)), len(re.findall(r"[#$%&*|]", text)), len(text))


def scanned(texts):
    c = filter_audit.Counts(*filter_audit.buffers(pa.array(texts, pa.string())))
    return list(zip(c.words.tolist(), c.distinct.tolist(), c.capitals.tolist(), c.symbols.tolist(), c.points.tolist(), strict=True))


@pytest.fixture()
def section(monkeypatch):
    def to(n):
        monkeypatch.setattr(filter_audit, "SECTION", n)
        filter_audit._tables.cache_clear()

    yield to
    monkeypatch.undo()
    filter_audit._tables.cache_clear()


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1 << 20])
def test_scan_equals_plain_counts(section, size):
    section(size)
    rng = random.Random(size)
    pieces = ["a", "B", "ab", "ba", "é", "日本", " ", "\t", "\n\n", "#", "A|", " ", "\x1f", " ", "wordword" * 3, "x" * 30]
    texts = ["", " ", "a", "", "a b a"] + ["".join(rng.choice(pieces) for _ in range(rng.randrange(40))) for _ in range(60)] + ["", ""]
    assert scanned(texts) == [plain(t) for t in texts]
    array = pa.array(["skipped A", *texts, "also"], pa.string()).slice(1, len(texts))
    c = filter_audit.Counts(*filter_audit.buffers(array))
    assert c.words.tolist() == [len(words(t)) for t in texts]
    assert scanned([]) == [] and scanned(["", ""]) == [(0, 0, 0, 0, 0)] * 2


def test_equal_hashes_of_different_words_are_told_apart(monkeypatch):
    tables = filter_audit._tables()
    flat = (tables[0], np.ones(256, np.uint64), np.ones_like(tables[2]), np.ones_like(tables[3]))  # all words of a length share a hash
    monkeypatch.setattr(filter_audit, "_tables", lambda: flat)
    texts = ["ab cd ab ef cd", "ab ab", "x y z x", ""]
    assert [r[1] for r in scanned(texts)] == [3, 1, 3, 0]


def by_hand(docs, labels):
    """docs: (doc_id, text, lang)."""
    quality = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for i, t, lang in docs:
        t = t or ""
        w, d, c, s, n = plain(t)
        fails = {f for f, x in zip("ABCD", (w < 200, 100 * d < 50 * w, 100 * c > 3 * n, s > 0), strict=True) if x}
        if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs):
            fails.add("E")
        rows.append((lang or "", fails, i in quality, i in toxic))
    out, shapley = {}, {}
    for part in {r[0] for r in rows}:
        for order in itertools.permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                mine = [r for r in rows if r[0] == part and f in r[1]]
                out[part, "".join(order), k + 1] = [len(left) - len(gone), len(gone), len(mine) - len(gone), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
                left = [r for r in left if f not in r[1]]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def check(spark, docs, labels):
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, lang string, part string, n int")
    m = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(filter_audit.mask_counts(d, m)).collect()
    have = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in got}
    assert len(got) == len(have) and have == by_hand(docs, labels)


def test_all_orders_equal_plain_python(spark):
    long = " ".join(f"w{k}" for k in range(220))
    docs = [(1, long, "en"), (2, long, "de"), (3, long, "en"), (3, long, "en"), (4, None, None), (5, "", "en"), (6, "AAA #", ""), (7, "a " * 300, "en"), (8, long.upper(), "de"),
            (9, long + " |", "de"), (None, long, "en"), (None, "", None), (1, "other", "fr"), (10, "AAA #", "fr"), (11, long + "  ", "fr")]
    labels = [(1, 1, 0), (2, 1, 1), (3, 0, 1), (3, 1, None), (7, None, 1), (None, 1, 1), (8, 1, 1), (99, 1, 1), (10, 0, 0)]
    check(spark, docs, labels)
    check(spark, docs, [])


def test_no_documents(spark):
    d = spark.createDataFrame([], "doc_id long, text string, lang string")
    m = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.mask_counts(d, m)).collect() == []


def test_copies_are_not_gathered(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one text").alias("text"), F.lit("en").alias("lang"))
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = {r["mask"]: r["n"] for r in filter_audit.mask_counts(docs, marks).collect()}
    assert rows == {1: 1, 17: 3999}
