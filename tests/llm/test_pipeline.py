"""The pipeline's stages on odd tables and against plain recomputation."""

import pytest

import corpus_pipeline as C
from spawnlens.llm import decontam, quality
from spawnlens.llm.common import materialise, remove_materialised, shared_dir

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, folder, docs, labels, items):
    """Tables whose columns clash with those that operators add."""
    spark.createDataFrame([(*d, 0.5, "k", 7) for d in docs], DOCS + ", score double, kept string, n_bytes int").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def folder(spark, prose, tmp_path_factory):
    items = [(i, prose(12, 9000 + i).capitalize() + ". " + prose(6, 9500 + i) + ".") for i in range(12)] + [(None, prose(9, 1)), (50, None), (51, "")]
    docs = []
    for i in range(90):
        text = prose(60, i) if i % 5 else ("spam$$$ " + prose(60, i)).upper().replace(" ", "!! ")
        docs.append((i, text + (" " + items[i % 12][1] if i % 9 == 4 else ""), "en", "s", len(text)))
    docs += [(100, docs[1][1], "en", None, None), (101, docs[2][1] + " so", None, "s", 1), (102, None, None, None, None), (103, "", "en", "s", 0), (None, prose(40, 900), "en", "s", 3), (104, " \n ", "en", "s", 3), (105, "x" * 70_000 + " " + prose(3000, 77), "en", "s", 3), (1, docs[1][1], "en", "s", 5)]
    labels = [(i, 0 if i % 5 == 0 else 1, 0) for i in range(90)] + [(102, None, None), (None, 1, 0), (103, 9, 0)]
    return write(spark, tmp_path_factory.mktemp("odd"), docs, labels, items)


def test_quality_stage_against_plain_scores(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"), C.F.lit(True))
    want = [tuple(r[c] for c in C.COLUMNS) for r in docs.collect() if model.score(quality.features(model, r["text"])) >= C.QUALITY]
    got = C.good_documents(spark, docs, folder)
    assert got.columns == C.COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and 0 < len(want) < docs.count()


def test_leak_stage_against_every_window(spark, folder):
    """All passages of a document, each held against all items."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if r["item_id"] is not None and decontam.words(r["text"])]
    longest = max(len(decontam.words(t)) for _, t in items)
    size = -(-longest // decontam.SEGMENTS)

    def leaked(text):
        ws = decontam.words(text)
        for k in range(max(1, -(-len(ws) // size))):
            passage = ws[k * size : (k + decontam.SEGMENTS + 1) * size]
            for _, t in items:
                q, a = map(decontam.words, decontam.question_answer(t))
                share = []
                for x in (q or a, a if q else []):
                    wanted = decontam.shingle_set(x)
                    n = len(next(iter(wanted))) if wanted else 1
                    there = {tuple(passage[i : i + n]) for i in range(len(passage) - n + 1)}
                    share.append(len(wanted & there) / len(wanted) if wanted else 1.0)
                if share[0] >= decontam.QUESTION and (share[1] >= decontam.ANSWER or share[0] >= decontam.ALONE):
                    return True
        return False

    got = C.without_leaks(spark, docs, folder)
    assert got.columns == C.COLUMNS
    want = [tuple(r[c] for c in C.COLUMNS) for r in docs.collect() if not leaked(r["text"])]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and 0 < len(want) < docs.count()


def test_every_stage_takes_odd_rows(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, stage) in enumerate(C.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert name == "tokens" or docs.columns == C.COLUMNS
        assert docs.count() > 0
    assert docs.where("not round_trip").isEmpty()


def test_empty_tables(spark, tmp_path):
    folder = write(spark, tmp_path, [], [], [])
    assert C.run(spark, folder).count() == 0


def test_labels_without_documents(spark, prose, tmp_path):
    folder = write(spark, tmp_path, [(1, None, None, None, None), (2, "", None, None, None)], [(1, 0, 0), (2, 1, 0), (3, 1, 1)], [])
    assert C.good_documents(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).count() == 2  # nothing is known against them


def test_materialised_tables_can_be_removed(spark):
    import os

    remove_materialised(spark)
    df = materialise(spark.range(3), "removable")
    path = df.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path) and remove_materialised(spark) == 1 and not os.path.exists(path) and remove_materialised(spark) == 0
    assert shared_dir(spark)
