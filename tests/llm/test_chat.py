import hashlib
import random

import pytest

from spawnlens.llm import chat
from spawnlens.llm.common import materialise

SCHEMA = "conv_id long, turn long, role string, text string, node string"


def brute(rows):
    by = {}
    for c, t, r, x in sorted(rows, key=lambda v: [(k is not None, k if k is not None else 0) if not isinstance(k, str) else (True, k) for k in (v[0], v[1])] + [(v[2] is not None, v[2] or ""), (v[3] is not None, v[3] or "")]):
        by.setdefault(c, []).append((r or "", x or ""))
    out = []
    for c, turns in by.items():
        said, loss = "".join(f"{r}\n{x}\n" for r, x in turns), "".join(x for r, x in turns if r == "assistant")
        out.append((c, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len(chat.format_turn(*t)[0]) for t in turns)))
    return sorted(out, key=str)


def run(spark, rows):
    t = materialise(chat.turns(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)), "t")
    packed = materialise(chat.pack(t, materialise), "p")
    return sorted((tuple(r) for r in chat.read_back(t, packed).collect()), key=str), t, packed


@pytest.mark.parametrize("s", ["", "plain", "\\", "\\\\l", "<|end|>\n", "<|turn user|>\n", "\\### Assistant: </turn> ok", "a|b<c\\p", "\n", "é🙂"])
def test_escapes(s):
    assert chat.unescape(chat.escape(s)) == s
    assert chat.parse_turn(chat.format_turn(s, s)[0]) == (s, s)
    assert chat.CLOSE not in chat.escape(s) and chat.OPEN not in chat.escape(s)


def test_tree(spark):
    rng = random.Random(4)
    rows = []
    for c in range(60):
        path = []
        for t in range(rng.randint(1, 6)):
            path.append(rng.choice(["hello <|end|>", "b", "c\\"]))
            rows.append((c, t, ("user", "assistant")[t % 2], path[-1]))
    got, turns, packed = run(spark, rows)
    assert got == brute(rows)
    nodes = sorted(packed.collect(), key=lambda r: r["start"])
    assert len(nodes) == turns.select("node").distinct().count()  # shared turns are put out once
    at, by = 0, {bytes(r["node"]): r for r in nodes}
    for r in nodes:
        assert r["start"] == at and r["end"] == at + len(r["formatted"])
        at = r["end"]
        up, path = bytes(r["parent"]), []
        while up:
            path.append(by[up])
            up = bytes(by[up]["parent"])
        assert r["pos"] == sum(len(p["formatted"]) for p in path) and r["depth"] == len(path)
        assert {x for a in r["attends"] for x in range(a["start"], a["end"])} == {x for p in path for x in range(p["start"], p["end"])}
        assert not path or path[0]["start"] < r["start"]
    # Depth first: a node's descendants stand together.
    for r in nodes:
        below = [s for s in nodes if s["depth"] > r["depth"] and any(a["start"] <= r["start"] < a["end"] for a in s["attends"])]
        assert not below or max(s["end"] for s in below) == r["end"] + sum(len(s["formatted"]) for s in below)


def test_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (2, 0, "user", None), (2, 0, "user", None), (3, 1, "assistant", "b"), (3, 1, "assistant", "a"), (3, None, "system", "s"), (None, 0, "user", "n"), (4, 0, "assistant", "long " * 40_000), (5, 0, "user", "hi"), (6, 0, "user", "hi")]
    assert run(spark, rows)[0] == brute(rows)
    assert run(spark, [])[0] == []


def test_one_long_conversation_and_many_copies(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"t{t}") for t in range(3000)] + [(c, t, "user", f"same {t}") for c in range(2, 200) for t in range(3)]
    got, _, packed = run(spark, rows)
    assert got == brute(rows) and packed.count() == 3003


def test_tokens(spark):
    P = pytest.importorskip("public_tokenizers")
    enc = chat.encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    rng = random.Random(5)
    rows = [(c, t, ("user", "assistant")[t % 2], rng.choice(["hello there", "b", "c\\ <|d"])) for c in range(40) for t in range(1 + c % 5)] + [(90, 0, None, None), (91, 0, "assistant", " " * 5000)]
    _, _, packed = run(spark, rows)
    nodes = {bytes(r["node"]): r for r in packed.collect()}
    got = sorted(chat.tokens(packed, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, materialise).collect(), key=lambda r: r["start"])
    assert [bytes(r["node"]) for r in got] == sorted(nodes, key=lambda n: nodes[n]["start"])
    at, by = 0, {bytes(r["node"]): r for r in got}
    for r in got:
        node = nodes[bytes(r["node"])]
        assert enc.decode_bytes(r["token_ids"]) == node["formatted"].encode()
        assert enc.decode_bytes([i for i, m in zip(r["token_ids"], r["loss_mask"], strict=True) if m]) == node["formatted"][node["loss_start"] : node["loss_end"]].encode()
        assert r["start"] == at and r["end"] == at + len(r["token_ids"])
        at, up, before = r["end"], bytes(r["parent"]), []
        while up:
            before.append(by[up])
            up = bytes(by[up]["parent"])
        n = sum(len(x["token_ids"]) for x in before)
        assert r["position_ids"] == list(range(n, n + len(r["token_ids"])))
        assert [x for a in r["attends"] for x in range(a["start"], a["end"])] == sorted(x for b in before for x in range(b["start"], b["end"]))
    assert chat.tokens(packed.where("false"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, materialise).count() == 0


def test_conversations_are_read_back_from_tokens(spark):
    """Repeated turns, empty texts, odd characters and shared beginnings, through token ids, position ids and loss mask."""
    import public_tokenizers as P

    coder = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", ""), (1, 2, "user", "hi"), (1, 3, "assistant", "é|<\\ 日本 \n\n"), (2, 0, "user", "hi"), (2, 1, "assistant", ""), (2, 2, "user", "no"), (3, 0, None, None),
            (None, 0, "assistant", "x" * 300), (4, 0, "user", "hi"), (4, 0, "user", "hi")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    turned = materialise(chat.turns(df), "test-turns")
    packed = materialise(chat.pack(turned, materialise), "test-packed")
    by_text = sorted(map(tuple, chat.read_back(turned, packed).collect()), key=str)
    by_token = sorted(map(tuple, chat.read_back(turned, chat.decoded(chat.tokens(packed, *coder, materialise), *coder)).collect()), key=str)
    assert by_text == by_token and len(by_token) == 5
