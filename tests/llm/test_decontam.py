import random
from collections import Counter

import pytest

from spawnlens.llm import decontam as D

DOCS, ITEMS = "doc_id long, text string, item_id string, n long", "item_id long, text string"


def index(items):
    df = Counter(w for _, t in items for w in set(D.words(t)))
    return D.Index(items, df, len(items), sum(len(D.words(t)) for _, t in items) / len(items))


def test_wand_retrieves_all_above_the_threshold(prose):
    rng = random.Random(1)
    items = [(i, prose(rng.randint(3, 30), i)) for i in range(300)]
    ix = index(items)
    for _ in range(60):
        terms = rng.sample(range(len(ix.terms)), rng.randint(1, 60))
        score = Counter()
        for t in terms:
            for n, w in zip(ix.items[t], ix.weights[t], strict=True):
                score[n] += w
        for threshold in (0.2, 0.5, 0.8):
            got = dict(ix.retrieve(terms, threshold))
            assert got.keys() == {n for n, s in score.items() if s >= threshold - 1e-12}
            assert all(got[n] == pytest.approx(score[n]) for n in got)


def brute(docs, items):
    """Items whose words stand in a row in the document."""
    return sorted(((d, i) for d, t in docs for i, x in items if D.words(x) and f" {' '.join(D.words(x))} " in f" {' '.join(D.words(t))} "), key=str)


def pairs(spark, docs, items):
    d = spark.createDataFrame([(*x, "c", 1) for x in docs], DOCS)
    got = D.leaks(d, spark.createDataFrame(items, ITEMS))
    rest = D.clean(d, spark.createDataFrame(items, ITEMS))
    assert rest.columns == d.columns
    found = sorted(((r["doc_id"], r["item_id"]) for r in got.collect()), key=str)
    assert rest.count() == len(docs) - len({d for d, _ in found}) or len({d for d, _ in docs}) < len(docs)
    return found


def test_leaks_are_found_and_clean_documents_left(spark, prose):
    items = [(i, prose(12, 5000 + i).capitalize() + ". " + prose(6, 6000 + i) + ".") for i in range(40)]
    docs = [(i, prose(150 + i, i) + (" " + items[i // 3][1].upper() + " " if i % 3 == 0 else " ") + prose(80, 100 + i)) for i in range(90)]
    assert pairs(spark, docs, items) == brute(docs, items) != []


def test_edited_and_partial_leaks(spark, prose):
    q, a = prose(40, 1) + ".", prose(20, 2) + "."
    items = [(1, f"{q} {a}")]
    edited = f"{q} {a}".split()
    edited[7] = "zebra"
    docs = [(1, prose(50, 3) + " " + " ".join(edited)), (2, q + " " + prose(60, 4)), (3, " ".join(q.split()[:12]) + " " + prose(60, 5)), (4, a + " " + prose(60, 6)), (5, " ".join(sorted(f"{q} {a}".split())))]
    assert pairs(spark, docs, items) == [(1, 1), (2, 1)]


def test_questions_shorter_than_their_answers(spark, prose):
    items = [(i, prose(4 + i, 5000 + i) + ". " + prose(40 - i, 6000 + i) + ".") for i in range(20)] + [(90, "?! " + prose(9, 7000))]
    docs = [(i, prose(150, i) + " " + t.split(". ")[0] + " " + prose(80, 100 + i)) for i, t in items[:20]] + [(90, prose(60, 90))]
    assert pairs(spark, docs, items) == sorted(((i, i) for i in range(20)), key=str)


def test_short_questions_alone_are_no_leak(spark, prose):
    items = [(1, "Zyx wvu. " + prose(20, 1) + "."), (2, prose(5, 2) + ". " + prose(30, 3) + "."), (3, "Qrst")]
    docs = [(1, prose(90, 10) + " zyx wvu " + prose(40, 11)), (2, prose(60, 12) + " " + items[0][1] + " " + prose(60, 13)), (3, prose(60, 14) + " " + items[1][1].split(". ")[0] + " " + prose(9, 15)), (4, prose(30, 16) + " qrst")]
    d, b = spark.createDataFrame([(*x, "c", 1) for x in docs], DOCS), spark.createDataFrame(items, ITEMS)
    for least, want in ((1, {(1, 1), (2, 1), (3, 2), (4, 3)}), (D.SHINGLE, {(2, 1), (3, 2), (4, 3)}), (6, {(2, 1), (4, 3)})):
        assert {(r["doc_id"], r["item_id"]) for r in D.leaks(d, b, alone_words=least).collect()} == want
        assert {r["doc_id"] for r in D.clean(d, b, alone_words=least).collect()} == {1, 2, 3, 4} - {x for x, _ in want}


def test_every_text_that_passes_the_rule_is_retrieved(prose):
    rng = random.Random(2)
    items = [(i, prose(rng.randint(1, 20), i) + ". " + prose(rng.randint(1, 30), 500 + i) + ".") for i in range(60)]
    ix, n = index(items), 0
    for i, t in items:
        question, answer = map(D.words, D.question_answer(t))
        for _ in range(15):
            # Stretches of question and answer, far from each other's words.
            cut = [w[(a := rng.randint(0, len(w) - (k := rng.randint(1, len(w))))) : a + k] for w in (question, answer)]
            text = cut[0] + ["zz"] * 4 + cut[1] * rng.randint(0, 1)
            share = [len(D.shingle_set(w) & {tuple(text[x : x + k]) for x in range(len(text)) for k in range(1, 6)}) / len(D.shingle_set(w)) for w in (question, answer)]
            leaked = share[0] >= D.ALONE or (share[0] >= D.QUESTION and share[1] >= D.ANSWER)
            assert (i in [x[0] for x in ix.leaked(" ".join(text))]) == leaked
            n += leaked
    assert n > 100


def test_odd_rows(spark, prose):
    items = [(1, None), (2, ""), (3, "!?"), (4, prose(9, 1)), (4, prose(9, 2)), (None, prose(9, 3)), (5, "Zyx")]
    docs = [(1, None), (2, ""), (3, prose(50_000, 7) + " " + prose(9, 1)), (None, prose(9, 2)), (6, prose(9, 3)), (7, "a zyx"), (7, "a zyx")]
    got = pairs(spark, docs, items)
    assert {(3, 4), (7, 5)} <= set(got) and not {x for x in got if x[0] in (1, 2, 6)}
    assert got.count((7, 5)) == 2
    assert pairs(spark, [], items) == [] and pairs(spark, docs, []) == []


def test_shards(spark, prose, monkeypatch):
    items = [(i, prose(15, 5000 + i)) for i in range(30)]
    docs = [(i, prose(60, i) + " " + items[i][1]) for i in range(0, 30, 2)]
    whole = pairs(spark, docs, items)
    monkeypatch.setattr(D, "SHARD_CHARS", 200)
    assert pairs(spark, docs, items) == whole == brute(docs, items)


def test_long_texts_in_blocks_of_passages(prose, monkeypatch):
    rng = random.Random(3)
    items = [(i, prose(12, 5000 + i) + ". " + prose(6, 6000 + i) + ".") for i in range(30)]
    ix = index(items)
    text = " ".join(prose(rng.randint(1, 60), 100 + i) + " " + rng.choice(items)[1] for i in range(120))
    whole = ix.leaked(text)
    assert whole
    for at_once in (1, 3, 7):
        monkeypatch.setattr(D, "PASSAGES", at_once)
        assert ix.leaked(text) == whole
