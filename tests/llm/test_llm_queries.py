"""Queries of the llm operators against their SQL, and the pipeline against plain Python."""

import hashlib
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import connect, same  # noqa: E402

from spawnlens.llm.oracles import ORACLE_SQL  # noqa: E402
from spawnlens.llm.queries import QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, sf_dir, duck, name):
    same(QUERIES[name](spark, sf_dir), duck, ORACLE_SQL[name])


def test_tokens(spark, sf_dir, duck):
    import public_tokenizers as P

    from spawnlens.llm.tokenizer import encoding

    enc = encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    texts = dict(duck.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())
    for r in QUERIES["op3_bpe"](spark, sf_dir).collect():
        ids = enc.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())


def test_languages(spark, sf_dir, duck):
    want = dict(duck.execute("SELECT doc_id, lang FROM documents").fetchall())
    got = QUERIES["op5_language"](spark, sf_dir).where("held_out").collect()
    assert sum(r["lang_pred"] == want[r["doc_id"]] for r in got) / len(got) > 0.95


def test_quality(spark, sf_dir, duck):
    want = dict(duck.execute("SELECT doc_id, quality FROM labels").fetchall())
    got = [r for r in QUERIES["op2_quality"](spark, sf_dir).collect() if r["doc_id"] in want]
    assert sum(r["predicted"] == want[r["doc_id"]] for r in got) / len(got) > 0.9


def test_pages(spark, sf_dir, duck):
    got = QUERIES["op4_html"](spark, sf_dir).collect()
    assert all(r["n_chars"] == len(r["text"]) and r["text"] for r in got)


def test_leaks(spark, sf_dir, duck):
    want = duck.execute("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)").fetchall()
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op10_decontaminate"](spark, sf_dir).collect()}
    assert set(want) <= got and len(got) <= len(want) + 1


def test_pipeline(spark, sf_dir, tmp_path):
    import corpus_pipeline as C
    from test_neardup import brute as groups
    from test_suffix import brute as repeats

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {r["doc_id"]: r for r in docs.collect()}
    for k, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, sf_dir)
        path = str(tmp_path / str(k))
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        after = {r["doc_id"]: r for r in docs.collect()}
        assert len(after) == docs.count() > 0 and after.keys() <= before.keys()
        if name != "tokens":
            assert docs.columns == C.COLUMNS
        if name == "near-duplicates":
            comps = groups([(i, r["text"]) for i, r in before.items()], 5)
            assert after.keys() == {i for i, c in comps.items() if i == c}
        elif name == "repeats":
            assert after.keys() == before.keys()
            for i, _, spans, kept in repeats([(i, r["text"]) for i, r in before.items()], 50):
                assert after[i]["n_chars"] == len(after[i]["text"])
                assert after[i]["text"] == before[i]["text"] if not spans else len(kept) <= len(after[i]["text"].encode()) <= len(kept) + 6 * len(spans)
        elif name == "tokens":
            assert all(r["round_trip"] and r["n_tokens"] == len(r["token_ids"]) for r in after.values())
        else:
            assert all(after[i] == before[i] for i in after)
        before = after
    assert sorted(map(str, C.run(spark, sf_dir).collect())) == sorted(map(str, before.values()))
