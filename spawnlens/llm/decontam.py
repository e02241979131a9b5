"""Benchmark decontamination: a BM25 inverted index of test items, queried with every training passage by block-max WAND.

Documents are cut into overlapping passages, so long that every item lies whole in one of them. An item counts as leaked if its question's word
shingles are in the passage, and its answer's too or nearly all of the question's, if this has `alone_words` words at least: a question shorter
than a shingle stands in many clean texts. The item stands in the index once for each of these two ways, as a
whole and as its question alone. Weights in the index are BM25 terms divided by a bound under the least score of a passage that has so many
of the shingles, so one threshold, 1, holds for all entries and keeps every leak. Entries stand in blocks, and the index knows the largest
weight of each term in each block. A passage for which the sums of these are under the threshold in every block retrieves nothing and is
passed over, as is one without any shingle of a question; this is tested for all passages of a document at once. For the others all entries of at least the threshold are retrieved,
skipping blocks of postings whose maxima cannot reach it, and the shingles of their items counted. An item's answer is its last sentence, its
question what stands before; items of one sentence, or with words in the last one only, are all question. An item's score in a passage is a
share of its score against itself.

Items are indexed in shards of bounded size, each sent to all tasks; the document frequencies of words are those of all items.

Results for odd input: null and empty texts and items without words have no passages and are never retrieved; items shorter than a
shingle are one shingle; rows that repeat a document each give their rows; repeated items are found each; rows with a null item id are
left out; items that tie are all retrieved; other columns are ignored by `leaks` and kept by `clean`; empty tables give no leaks.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, tidy

#: BM25's constants; blocks of entries at most; segments that make up the longest item; sum of weights that retrieves an entry; words of a
#: shingle.
K1, B, BLOCKS, SEGMENTS, RETRIEVE, SHINGLE = 1.2, 0.75, 64, 4, 1.0, 5
#: Shares of the question's and the answer's shingles that must be in the passage, and of the question's alone.
QUESTION, ANSWER, ALONE = 0.5, 0.5, 0.9
#: Characters of items in a shard; passages of a text that are tested at once.
SHARD_CHARS, PASSAGES = 8 << 20, 256
WORDS = re.compile(r"\w+")
SENTENCE_END = re.compile(r"[.!?]\s+")


def words(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def question_answer(text: str) -> tuple[str, str]:
    ends = [m.end() for m in SENTENCE_END.finditer(text.strip())]
    at = ends[-1] if ends and ends[-1] < len(text.strip()) else len(text.strip())
    return text.strip()[:at], text.strip()[at:]


def shingle_set(ws: list[str]) -> set[tuple[str, ...]]:
    k = min(SHINGLE, len(ws))
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if ws else set()


def window_keys(terms: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k terms in a row."""
    h = np.zeros(max(0, len(terms) - k + 1), np.uint64)
    for i in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + terms[i : len(h) + i].astype(np.uint64) + np.uint64(1)
    return h


def least_score(shingles: set[tuple[str, ...]], own: dict[str, float], share: float) -> float:
    """A bound under the weights of the words of any `share` of the shingles; own has the words that count.

    A word is absent only if all shingles that hold it are, so the words absent hold at most as many places as the absent shingles have.
    """
    absent = len(shingles) - next(n for n in range(len(shingles) + 1) if n >= share * len(shingles))
    held = Counter(w for s in shingles for w in set(s))
    places = sum(sorted((len(set(s)) for s in shingles), reverse=True)[:absent])
    left = 0.0
    for w in sorted(own, key=lambda w: held[w] / own[w]):
        taken = min(places, held[w])
        places -= taken
        left += own[w] * (1 - taken / held[w])
    return left


class Index:
    def __init__(self, items: list[tuple[int, str]], frequency: dict[str, int], total: int, mean_length: float, alone_words: int = 1):
        parsed = [(i, words(t), t) for i, t in items]
        parsed = [x for x in parsed if x[1]]
        self.ids = [i for i, _, _ in parsed]
        self.sets, self.alone = [], []
        for _, _, t in parsed:
            q, a = map(words, question_answer(t))
            self.sets.append((shingle_set(q or a), shingle_set(a if q else [])))
            self.alone.append(len(q) >= alone_words)
        self.longest = max((len(w) for _, w, _ in parsed), default=1)
        idf = lambda t: math.log(1 + (total - frequency[t] + 0.5) / (frequency[t] + 0.5))
        lists: dict[str, list[tuple[int, float]]] = {}
        self.own: list[dict[str, float]] = []
        #: The item of each entry.
        self.of: list[int] = []
        for n, (_, ws, _) in enumerate(parsed):
            own = {t: idf(t) * f * (K1 + 1) / (f + K1 * (1 - B + B * len(ws) / mean_length)) for t, f in Counter(ws).items()}
            whole = sum(own.values())
            self.own.append({t: w / whole for t, w in own.items()})
            question, answer = self.sets[n]
            asked = {t: w for t, w in own.items() if any(t in s for s in question)}
            told = {t: w for t, w in own.items() if t not in asked}
            entries = [(own, least_score(question, asked, QUESTION) + least_score(answer, told, ANSWER))]
            if answer and self.alone[n]:
                entries.append((asked, least_score(question, asked, ALONE)))
            for of, least in entries:
                for t, w in of.items():
                    lists.setdefault(t, []).append((len(self.of), w / least))
                self.of.append(n)
        self.terms = {t: k for k, t in enumerate(lists)}
        self.items = [[n for n, _ in p] for p in lists.values()]
        self.weights = [[w for _, w in p] for p in lists.values()]
        size = max(1, -(-len(self.of) // BLOCKS))
        self.block_last: list[list[int]] = []
        self.block_max: list[list[float]] = []
        #: By term and block the largest weight; the last row is that of words which no item has.
        self.most = np.zeros((len(lists) + 1, max(1, -(-len(self.of) // size))))
        for t, (items_of, weights) in enumerate(zip(self.items, self.weights, strict=True)):
            for n, w in zip(items_of, weights, strict=True):
                self.most[t, n // size] = max(self.most[t, n // size], w)
            blocks = np.flatnonzero(self.most[t])
            self.block_last.append([min((k + 1) * size, len(self.of)) - 1 for k in blocks.tolist()])
            self.block_max.append(self.most[t, blocks].tolist())
        self.bound = self.most.max(axis=1, initial=0.0)
        asked: dict[int, set[int]] = {}
        for s in {s for question, _ in self.sets for s in question}:
            asked.setdefault(len(s), set()).update(window_keys(np.array([self.terms.get(w, len(lists)) for w in s]), len(s)).tolist())
        #: By size the sorted hashes of the questions' shingles.
        self.asked = {k: np.array(sorted(x), np.uint64) for k, x in asked.items()}

    def retrieve(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All entries whose summed weights over the (different) terms reach the threshold, by block-max WAND."""
        least = threshold - 1e-12
        at = [[self.items[t][0], 0, t] for t in terms]  # item, place in the list, term
        most, out = self.bound, []

        def to(cursor: list, item: int) -> None:
            cursor[1] = bisect_left(self.items[cursor[2]], item, cursor[1])
            cursor[0] = self.items[cursor[2]][cursor[1]] if cursor[1] < len(self.items[cursor[2]]) else -1

        while True:
            at = sorted(c for c in at if c[0] >= 0)
            bound, pivot = 0.0, -1
            for k, c in enumerate(at):
                bound += most[c[2]]
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                return out
            item = at[pivot][0]
            while pivot + 1 < len(at) and at[pivot + 1][0] == item:
                pivot += 1
            bound, after = 0.0, at[pivot + 1][0] if pivot + 1 < len(at) else 1 << 60
            for c in at[: pivot + 1]:
                k = bisect_left(self.block_last[c[2]], item)
                if k < len(self.block_last[c[2]]):
                    bound += self.block_max[c[2]][k]
                    after = min(after, self.block_last[c[2]][k] + 1)
            if bound < least:  # no item before the end of these blocks can reach the threshold
                for c in at[: pivot + 1]:
                    to(c, max(after, item + 1))
            elif at[0][0] == item:
                score = sum(self.weights[c[2]][c[1]] for c in at[: pivot + 1])
                if score >= least:
                    out.append((item, score))
                for c in at[: pivot + 1]:
                    to(c, item + 1)
            else:
                for c in at[:pivot]:
                    if c[0] < item:
                        to(c, item)

    def reaching(self, terms: np.ndarray, size: int, near: np.ndarray) -> Iterator[int]:
        """The near passages whose segments' largest weights may reach the threshold in some block; PASSAGES at once, however long the text is."""
        absent = len(self.terms)
        for a in range(0, len(near), PASSAGES):
            if not near[a : a + PASSAGES].any():
                continue
            part = terms[a * size : (a + PASSAGES + SEGMENTS) * size]
            keys = np.unique(np.arange(len(part)) // size * (absent + 1) + part)
            first = np.searchsorted(keys, np.arange(-(-len(part) // size)) * (absent + 1))
            sums = np.concatenate([np.zeros((1, self.most.shape[1])), np.cumsum(np.add.reduceat(self.most[keys % (absent + 1)], first, axis=0), axis=0)])
            at = np.arange(len(near[a : a + PASSAGES]))
            reach = (sums[np.minimum(at + SEGMENTS + 1, len(first))] - sums[at]).max(axis=1)
            yield from (a + np.flatnonzero(near[a : a + PASSAGES] & (reach >= RETRIEVE - 1e-9))).tolist()

    def leaked(self, text: str | None) -> list[tuple[int, float, float, float]]:
        """(item id, best score, question's and answer's overlap) of the items that leaked into the text."""
        ws = words(text)
        if not ws or not self.ids:
            return []
        absent = len(self.terms)
        terms = np.fromiter(map(self.terms.get, ws, repeat(absent)), np.int64, len(ws))
        size = -(-self.longest // SEGMENTS)
        near = np.zeros(max(1, -(-len(ws) // size) - SEGMENTS) + 1, np.int64)
        for k, asked in self.asked.items():
            h = window_keys(terms, k)
            p = np.flatnonzero(asked[np.minimum(np.searchsorted(asked, h), len(asked) - 1)] == h)
            np.add.at(near, np.maximum(0, -(-(p + k) // size) - SEGMENTS - 1), 1)
            np.add.at(near, np.minimum(len(near) - 2, p // size) + 1, -1)
        near = np.cumsum(near)[:-1] > 0
        if not near.any():
            return []
        found: dict[int, tuple[float, float, float]] = {}
        for k in self.reaching(terms, size, near):
            a, b = k * size, (k + SEGMENTS + 1) * size
            own = np.unique(terms[a:b])
            if self.most[own].sum(axis=0).max() < RETRIEVE - 1e-9:
                continue
            got = self.retrieve([t for t in own.tolist() if t < absent], RETRIEVE)
            if not got:
                continue
            passage = ws[a:b]
            by_size: dict[int, set] = {}
            there = set(passage)
            for item in {self.of[n] for n, _ in got}:
                share = []
                for wanted in self.sets[item]:
                    if not wanted:
                        share.append(1.0)
                        continue
                    k = len(next(iter(wanted)))
                    if k not in by_size:
                        by_size[k] = {tuple(passage[i : i + k]) for i in range(len(passage) - k + 1)}
                    share.append(len(wanted & by_size[k]) / len(wanted))
                if share[0] >= QUESTION and (share[1] >= ANSWER or (share[0] >= ALONE and self.alone[item])):
                    score = sum(w for t, w in self.own[item].items() if t in there)
                    found[item] = max(found.get(item, (0.0, 0.0, 0.0)), (score, *share))
        return [(self.ids[n], *x) for n, x in sorted(found.items())]


def shards(items: DataFrame, id_col: str, text_col: str, alone_words: int) -> Iterator[Index]:
    """Indexes over at most SHARD_CHARS characters of items; only one is on the driver at a time."""
    rows = items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where(F.col("i").isNotNull() & F.col("t").isNotNull())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ws = [words(t) for t in b.column(1).to_pylist()]
            pairs = [(w, 0) for x in ws for w in set(x)] + [("", len(x)) for x in ws if x]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.int64())], names=["w", "n"])

    counts = rows.mapInArrow(tidy(count), "w string, n long").groupBy("w").agg(F.count("*").alias("df"), F.sum("n").alias("n"))
    whole = counts.where("w = ''").first()
    total, mean = (whole["df"], whole["n"] / whole["df"]) if whole else (0, 1.0)

    def index(part: list[tuple[int, str]]) -> Index:
        wanted = F.broadcast(items.sparkSession.createDataFrame([(w,) for w in {w for _, t in part for w in words(t)}] or [("",)], "w string"))
        return Index(part, {r["w"]: r["df"] for r in counts.join(wanted, "w").collect()}, total, mean, alone_words)

    part: list[tuple[int, str]] = []
    size = 0
    for r in rows.orderBy("i", "t").toLocalIterator():
        part.append((r["i"], r["t"]))
        size += len(r["t"])
        if size >= SHARD_CHARS:
            yield index(part)
            part, size = [], 0
    if part:
        yield index(part)


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", alone_words: int = 1) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap for each item that leaked into a document."""
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    bounded_batches(docs.sparkSession)
    src, out = docs.select(F.col(id_col).cast("long"), text_col), None
    for ix in shards(items, item_id, item_text, alone_words):
        sent = docs.sparkSession.sparkContext.broadcast(ix)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [(d.as_py(), *x) for d, t in zip(b.column(0), b.column(1), strict=True) for x in sent.value.leaked(t.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64() if k < 2 else pa.float64()) for k in range(5)], names=[x.split()[0] for x in schema.split(", ")])

        got = src.mapInArrow(tidy(run), schema)
        out = got if out is None else out.unionByName(got)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", alone_words: int = 1) -> DataFrame:
    """The documents into which no item leaked, with all their columns."""
    bounded_batches(docs.sparkSession)
    for ix in shards(items, item_id, item_text, alone_words):
        sent = docs.sparkSession.sparkContext.broadcast(ix)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not sent.value.leaked(t.as_py()) for t in b.column(b.schema.get_field_index(text_col))], pa.bool_()))

        docs = docs.mapInArrow(tidy(run), docs.schema)
    return docs
