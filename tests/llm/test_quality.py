from pyspark.sql import functions as F

from spawnlens.llm import quality
from spawnlens.llm.common import fold


def _tables(spark, prose, n=400):
    docs, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        text = prose(60, i) if not bad else ("spam$$$ " + prose(60, i)).upper().replace(" ", "!! ") if i % 8 else f"{prose(1, i)} " * 150
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, 0 if bad else 1, 0))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark, prose):
    docs, labels = _tables(spark, prose)
    model = quality.train(docs, labels, fold("doc_id", 5) != 0)
    got = quality.score(docs.select("doc_id", "text"), model).join(labels, "doc_id").where(fold("doc_id", 5) == 0).collect()
    assert sum((r["score"] >= 0.3) == (r["quality"] == 1) for r in got) / len(got) > 0.95


def test_odd_rows(spark, prose):
    docs, labels = _tables(spark, prose, 60)
    labels = labels.unionByName(spark.createDataFrame([(1, None, None), (2, 7, 0), (None, 1, 0)], labels.schema))
    model = quality.train(docs, labels, F.lit(True))
    odd = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, prose(200_000, 1), 9), (3, "x", 9), (None, "y", 9)], "doc_id long, text string, score int")
    got = quality.score(odd, model).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got) and got[0]["score"] == got[1]["score"]
    assert quality.score(odd.where("false"), model).count() == 0
    assert quality.accepted(odd, model, 0.0).count() == 5 and quality.accepted(odd, model, 0.0).columns == odd.columns


def test_without_labels_of_both_classes(spark, prose):
    docs, labels = _tables(spark, prose, 20)
    for some, want in ((labels.where("quality = 1"), 1.0), (labels.where("quality = 0"), 0.0), (labels.where("false"), 0.5)):
        model = quality.train(docs, some, F.lit(True))
        assert all(abs(r["score"] - want) < 1e-6 for r in quality.score(docs.select("doc_id", "text"), model).collect())


def test_texts_without_anything_to_learn(spark, prose):
    docs, labels = _tables(spark, prose, 20)
    empty = docs.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.lit("")))
    for some in (docs.where("false"), empty, docs.where("doc_id % 4 = 0")):
        model = quality.train(some, labels, F.lit(True))
        assert all(abs(r["score"] - 0.75) < 1e-9 for r in quality.score(docs.select("doc_id", "text"), model).collect())
    assert quality.accepted(docs.where("false"), model, 0.3).count() == 0


def test_score_against_plain_recomputation(spark, prose):
    import math

    import zstandard as z

    docs, labels = _tables(spark, prose)
    model = quality.train(docs, labels, fold("doc_id", 5) != 0)
    odd = spark.createDataFrame([(900, None), (901, ""), (902, "é" * 5000), (903, prose(9000, 7)), (903, prose(9000, 7))], "doc_id long, text string")
    for r in odd.unionByName(docs.select("doc_id", "text").limit(60)).join(quality.score(odd.unionByName(docs.select("doc_id", "text").limit(60)), model), "doc_id").collect():
        raw, sizes = (r["text"] or "").encode(), []
        for d in (model.good, model.bad, None):
            made = z.ZstdCompressor(level=quality.LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False, **({"dict_data": z.ZstdCompressionDict(d)} if d else {}))
            sizes.append(sum(len(made.compress(raw[k : k + quality.BLOCK])) for k in range(0, len(raw), quality.BLOCK)))
        x = (sizes[1] - sizes[0]) / (sizes[0] + sizes[1]) if raw else 0.0
        y = max(0.0, math.log(quality.PROSE * len(raw) / sizes[2])) if raw else 0.0
        w = model.weights
        assert abs(r["score"] - 1 / (1 + math.exp(-(w[0] + w[1] * x + w[2] * y)))) < 0.02


def test_whole_texts_in_bounded_bytes(spark, prose):
    docs, labels = _tables(spark, prose, 40)
    late = docs.withColumn("text", F.concat(F.lit("x" * 5000), "text"))  # what tells the classes apart stands after 5000 characters
    model = quality.train(late, labels, F.lit(True))
    got = quality.score(docs.select("doc_id", "text"), model).join(labels, "doc_id").collect()
    good, bad = ([r["score"] for r in got if r["quality"] == y] for y in (1, 0))
    assert sum(good) / len(good) > sum(bad) / len(bad)
    few = quality.train(docs, labels, F.lit(True), sample_bytes=2000)
    assert len(few.good) <= 2000 and len(few.bad) <= 2000
