import random

import pytest

from spawnlens.llm import tokenizer

P = pytest.importorskip("public_tokenizers")
FILE = P.path("byte_bpe_50k.tiktoken")


def test_long_texts_encode_as_the_library_does(prose):
    enc, pieces_of = tokenizer.encoding(FILE, P.PATTERN), tokenizer.piece_encoding(FILE)
    rng = random.Random(1)
    pieces = [" ", "  ", "\n", "\t \n", " a", "don't", "é", "数据", "🙂", "12 3", "!?", " ", "　", "x" * 50, " " * 300, "\n" * 400, " the", "\x1c", "​"]
    for n in (0, 1, 5, 400, 3000):
        for _ in range(5):
            text = "".join(rng.choice(pieces) for _ in range(n))
            want = enc.encode_ordinary(text)
            assert tokenizer.encode(enc, text, pieces_of) == want
            assert [i for part in tokenizer.split_safely(text, 40) for i in enc.encode_ordinary(part)] == want
            assert enc.decode_bytes(want) == text.encode()
    text = prose(200_000, 3)
    assert tokenizer.encode(enc, text, pieces_of) == enc.encode_ordinary(text)


def test_runs_of_white_space_that_the_library_cannot_take():
    enc = tokenizer.encoding(FILE, P.PATTERN)
    text = "a" + " " * 200_000 + "b\n"
    ids = tokenizer.encode(enc, text, tokenizer.piece_encoding(FILE))
    assert enc.decode_bytes(ids) == text.encode() and ids[-2:] == enc.encode_ordinary(" b\n")[-2:]


def test_rows(spark):
    df = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "Hi there", "k"), (3, "Hi there", "k"), (None, "퟿", "k")], "doc_id long, text string, token_ids string")
    got = tokenizer.encode_decode(df, "text", FILE, P.PATTERN)
    assert got.columns == ["doc_id", "token_ids", "decoded"]
    rows = got.collect()
    assert [bytes(r["decoded"]) for r in rows] == [b"", b"", b"Hi there", b"Hi there", "퟿".encode()] and rows[0]["token_ids"] == []
    assert tokenizer.encode_decode(df.where("false"), "text", FILE, P.PATTERN).count() == 0


def test_other_patterns(spark):
    assert tokenizer.PATTERN == P.PATTERN
    text, other = "a" + " " * 300 + "b c  d\n" * 50, r"\s+|\S+"
    got = tokenizer.encode_decode(spark.createDataFrame([(1, text)], "doc_id long, text string"), "text", FILE, other).first()
    assert list(got["token_ids"]) == tokenizer.encoding(FILE, other).encode_ordinary(text)
