"""Toxicity: folding, matching against a plain search, exceptions, held-out documents, odd input."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from spawnlens.llm import queries, toxicity
from spawnlens.llm.common import table

BAD = ("moron", "scumbag", "worthless", "loser")


def test_folding():
    same = ["Loser", "l0ser", "1oser", "lоsеr", "ＬＯＳＥＲ", "lo​ser", "L0$ER", "lo­ser"]
    assert {toxicity.folded(x) for x in same} == {" ioser "}
    assert toxicity.folded("You 1d10t! $tupid, st@te; 2024 a1 — mail 15$ 'no'") == " you idiot stupid state 2024 ai maii 15 no "
    assert toxicity.folded("Москва по-русски") == " москва по русски "  # a word of another script stays
    assert toxicity.folded(None) == toxicity.folded(" ... ") == " "
    text = "ab cd " * 50_000
    assert toxicity.folded(text) == " " + text


def plain_matches(text, model):
    """Every entry is looked for at every word; words of phrases are passed over."""
    words = toxicity.folded(text).split()
    held = {t: model.odds.weight(*n) for t, n in model.terms.items()}
    skip = set()
    for p in model.phrases:
        q = p.split()
        skip |= {k + j for k in range(len(words)) if words[k : k + len(q)] == q for j in range(len(q))}
    found = []
    for k, w in enumerate(words):
        weights = [held[t] for t in {f" {w} ", *(f" {w[:n]}" for n in range(1, len(w) + 1))} if t in held]
        if k not in skip and max(weights, default=0) > 0:
            found.append((k, max(weights)))
    return found, len(words)


def test_automaton_equals_plain_search():
    rng = random.Random(3)
    words = ["ba", "bab", "baba", "abba", "b", "a", "aab", "babab"]
    for _ in range(60):
        terms = {t: (rng.randrange(2, 30), rng.randrange(0, 3)) for w in rng.sample(words, 4) for t in toxicity.entries([w])}
        phrases = [f" {rng.choice(words)} {rng.choice(words)} " for _ in range(2)]
        m = toxicity.Model(toxicity.Odds(40, 400), terms, phrases)
        text = " ".join(rng.choice(words) for _ in range(30))
        f = toxicity.folded(text)
        want, n = plain_matches(text, m)
        assert [(f[: k + 1].count(" ") - 1, w) for k, _, w in toxicity.matches(f, m)] == want
        assert toxicity.features(text, m)[0] == pytest.approx(toxicity.math.log1p(100 * sum(w for _, w in want) / (n + toxicity.LENGTH)))


def made(prose, n, seed, share=0.3):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = prose(rng.randrange(40, 120), seed * 1000 + i).split()
        toxic = rng.random() < share
        for _ in range(rng.randrange(3, 6) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        if not toxic and rng.random() < 0.12:
            words[5:5] = ["sore", "loser"]  # stands in clean texts only
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def frames(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, 0.5, "x") for i, t in rows], "doc_id long, text string, score double, _y string")
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_learns_words_phrases_and_disguises(spark, prose):
    rows, labels = made(prose, 600, 1)
    docs, marks = frames(spark, rows, labels)
    m = toxicity.train(docs, marks, F.col("doc_id") < 450)
    assert " sore ioser " in m.phrases and {f" {w} ".replace("l", "i") for w in BAD} <= set(m.terms)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, m).collect()}
    held = [(got[i], y) for i, y in labels if i >= 450]
    assert sum((s >= 0.7) == y for s, y in held) >= 0.98 * len(held)
    base = prose(60, 77)
    s = lambda t: m.score(toxicity.features(t, m))
    assert min(s(f"{base} m0ron {base} w0rthl3ss m0rоn 1oser scumb@g"), s(f"{base} moron moron loser scumbag")) > 0.7
    assert max(s(base), s(f"{base} a sore loser, a sore loser"), s(""), s(None), s("!!!")) < 0.3
    # Length counts: the same words in a much longer text say less.
    assert s(f"{base} moron loser") > s(" ".join([base] * 40) + " moron loser")


def test_a_given_exception_phrase_is_passed_over(spark, prose):
    docs, marks = frames(spark, *made(prose, 200, 2))
    m = toxicity.train(docs, marks, F.lit(True), exceptions=["Moron Mountains"])
    text = f"{prose(30, 5)} moron mountains, the moron mountains"
    assert toxicity.matches(toxicity.folded(text), m) == []
    assert len(toxicity.matches(toxicity.folded(text.replace("mountains", "hills")), m)) == 2


def test_long_texts_are_scored_whole(spark, prose):
    docs, marks = frames(spark, *made(prose, 200, 4))
    m = toxicity.train(docs, marks, F.lit(True))
    text = " ".join([prose(200, 9)] * 400)
    assert len(text) > 4 * toxicity.PIECE
    tail = text + " moron loser worthless" * 5000
    assert toxicity.features(text, m) == (0.0, 0.0) and toxicity.features(tail, m)[0] > 1
    pieces = list(toxicity.pieces(tail))
    assert len(pieces) > 4 and "".join(pieces) == tail


def test_odd_rows(spark, prose):
    rows, labels = made(prose, 120, 6)
    docs, marks = frames(spark, [*rows, (500, None), (501, ""), (None, rows[0][1]), (0, rows[0][1])], [*labels, (500, 1), (501, 0), (None, 1), (3, None), (4, 7), (900, 1)])
    m = toxicity.train(docs, marks, F.lit(True))
    got = toxicity.score(docs, m)
    assert got.columns == ["doc_id", "_y", "score"]
    out = got.collect()
    assert len(out) == 124 and all(0 <= r["score"] <= 1 for r in out)
    by = {r["doc_id"]: r["score"] for r in out}
    assert by[500] == by[501] < 0.5 and by[None] == by[0]
    empty = docs.where(F.lit(False))
    assert toxicity.score(empty, m).collect() == []
    assert toxicity.train(empty, marks, F.lit(True)).score((0, 0)) == pytest.approx(sum(y == 1 for _, y in [*labels, (0, 1), (0, 0), (0, 1)]) / (len(labels) + 3), abs=0.02)
    for label, want in ((0, 0.0), (1, 1.0)):
        only = marks.where(F.col("toxic") == label)
        assert toxicity.train(docs, only, F.lit(True)).score((0, 0)) == pytest.approx(want)
    assert toxicity.train(docs, marks.where(F.lit(False)), F.lit(True)).score((0, 0)) == pytest.approx(0.5)


def test_query_on_documents_that_it_did_not_learn_from(spark, sf_dir):
    got = {r["doc_id"]: r for r in queries.op11_toxicity(spark, sf_dir.replace("sf0.001", "sf0.01")).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    marks = table(spark, sf_dir.replace("sf0.001", "sf0.01"), "labels").where("quality = 1").collect()
    held = [(got[r["doc_id"]]["predicted"], r["toxic"]) for r in marks if got[r["doc_id"]]["held_out"]]
    assert sum(p == y for p, y in held) >= 0.97 * len(held)
    assert not any(p for p, y in held if y == 0)
