from pyspark.sql import functions as F

from spawnlens.llm import langid
from spawnlens.llm.common import fold

SCHEMA = "doc_id long, text string, lang string"


def test_held_out_and_mixtures(spark, prose, german):
    rows = [(i, prose(40, i, german) if i % 3 == 0 else prose(40, i), "de" if i % 3 == 0 else "en") for i in range(240)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = langid.train(docs, fold("doc_id", 4) != 2)
    got = langid.identify(docs.select("doc_id", "text"), model).join(docs.select("doc_id", "lang"), "doc_id").where(fold("doc_id", 4) == 2).collect()
    assert all(r["lang_pred"] == r["lang"] and 0.5 < r["score"] <= 1 for r in got)
    lang, share = model.predict(prose(150, 1, german) + " " + prose(50, 2))
    assert lang == "de" and 0.6 < share < 0.9


def test_odd_rows(spark, prose, german):
    docs = spark.createDataFrame([(1, prose(30, 1), "en"), (2, prose(30, 2, german), "de"), (3, None, "en"), (4, "", None), (None, prose(5, 3), "en")], SCHEMA)
    model = langid.train(docs, F.lit(True))
    odd = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "123 !! ", 1), (4, "A", 1), (5, prose(100_000, 4), 1), (None, "the", 1)], "doc_id long, text string, score int")
    got = [(r["lang_pred"], r["score"]) for r in langid.identify(odd, model).collect()]
    assert got[:3] == [("und", 0.0)] * 3 and got[4][0] == "en" and all(0 <= s <= 1 for _, s in got)
    assert langid.identify(odd.where("false"), model).count() == 0
    none = langid.train(docs.where("false"), F.lit(True))
    assert {r["lang_pred"] for r in langid.identify(odd, none).collect()} == {"und"}


def test_against_plain_expectation_maximisation(spark, prose, german):
    import math
    from collections import Counter

    rows = [(i, prose(40, i, german) if i % 3 == 0 else prose(40, i), "de" if i % 3 == 0 else "en") for i in range(60)] + [(i, " ".join(f"zor{j}vik ul{j}da" for j in "abcdefgh"[i % 3 :]), "xx") for i in range(60, 80)]
    model = langid.train(spark.createDataFrame(rows, SCHEMA), F.lit(True))
    assert model.languages == ["de", "en", "xx"]
    for text in (prose(30, 900), prose(30, 901, german), prose(60, 902) + " " + prose(60, 903, german), "der", "zoravik", prose(400, 904) + " zoravik ulada " * 60):
        counts = Counter(langid.trigrams(text).tolist())
        n = sum(counts.values())

        def mixture(langs, rounds):
            pi = [1 / len(langs)] * len(langs)
            for _ in range(rounds):
                part = [0.0] * len(langs)
                for g, c in counts.items():
                    p = [s * model.p[g, k] for s, k in zip(pi, langs, strict=True)]
                    for j, x in enumerate(p):
                        part[j] += c * x / sum(p)
                pi = [max(x / n, 1e-9) for x in part]
                pi = [x / sum(pi) for x in pi]
            return pi, sum(c * math.log(sum(s * model.p[g, k] for s, k in zip(pi, langs, strict=True))) for g, c in counts.items())

        fee = langid.PENALTY * math.log(n + 1)
        whole, _ = mixture([0, 1, 2], langid.ROUNDS)
        order, options = sorted(range(3), key=lambda k: -whole[k]), []
        for k in range(3):
            options.append((mixture([k], 1)[1] - fee, k))
        for size in (2, 3):
            part = sorted(order[:size])
            share, fit = mixture(part, 3 * langid.ROUNDS)
            options.append((fit - size * fee, part[max(range(size), key=share.__getitem__)]))
        best = max(options, key=lambda o: o[0])[1]
        lang, score = model.predict(text)
        assert lang == model.languages[best] and abs(score - (whole[best] * n + 1) / (n + 3)) < 1e-6


def test_samples_of_large_languages(spark, prose, german):
    rows = [(i, prose(12, i, german) if i % 10 == 0 else prose(12, i), "de" if i % 10 == 0 else "en") for i in range(600)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = langid.train(docs, F.lit(True), sample=20)
    assert all(model.predict(t)[0] == lang for _, t, lang in rows[:100])
