"""Audit of how document filters overlap: what each removes, alone and in every order.

Texts are scanned in their Arrow buffers. NumPy marks each byte with its classes, and prefix sums of the marks, read off at the bounds of the
texts, count words, capitals, symbols and code points. A word's hash is the difference of two prefix sums of byte values times powers of an
odd number, brought to a common power; the hashes of a document are sorted, neighbours of equal hash are compared byte by byte, and a
document in which two words share a hash without being equal is counted by its words themselves. Each document becomes a mask of the
filters that it fails. Masks are counted by part, and all orders are read off these counts, so that no order is ever run over documents.

Copies are found by the SHA-256 of the text: of equal texts the rows of the smallest id pass, the others fail, whatever the other filters
say of them. Rows are aggregated before they are dealt by digest, so a group of copies is a few rows from each task.

Results for odd input: null text is empty; an empty text has no word, fails A alone, and is a copy of other empty texts. Rows of a repeated id
are counted each, and none is a copy of the other by itself. A null id is neither smaller nor larger than another, so such rows never fail E, and
make none fail. A null part is the empty string. Labels that are null or absent count as not 1; of several labels of an id one that is 1
suffices. Input columns besides those named are not read, whatever their names. An empty table gives an empty table. Long texts are scanned in
sections of `SECTION` bytes; what grows with a text is about 60 bytes for each of its words.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, tidy

#: Filters in the order of their bits in a mask.
FILTERS = "ABCDE"
#: Least words; least distinct words and most capitals, of a hundred.
WORDS, DISTINCT, CAPITALS = 200, 50, 3
SYMBOLS = b"#$%&*|"
#: Bytes that are scanned at once.
SECTION = 1 << 20
MULTIPLIER, INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SPACE, CAPITAL, SYMBOL, FOLLOWS = 1, 2, 4, 8


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Classes and values of bytes; powers of MULTIPLIER and of its inverse, modulo 2^64."""
    b = np.arange(256)
    classes = (((b == 32) | ((b >= 9) & (b <= 13))) * SPACE + ((b >= 65) & (b <= 90)) * CAPITAL + np.isin(b, list(SYMBOLS)) * SYMBOL + ((b & 0xC0) == 0x80) * FOLLOWS).astype(np.uint8)
    values = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ np.uint64(0xA5A5A5A55A5A5A5A)
    powers = []
    for m in (MULTIPLIER, INVERSE):
        p = np.full(SECTION + 1, m, np.uint64)
        p[0] = 1
        powers.append(np.multiply.accumulate(p))
    return classes, values, *powers


class Counts:
    """Of each text: words, distinct words, capitals, symbols and code points."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        """data: bytes of all texts; text k is data[bounds[k] : bounds[k + 1]]."""
        self.data, self.bounds = data, bounds
        n = len(bounds) - 1
        self.capitals, self.symbols, self.points = (np.zeros(n, np.int64) for _ in range(3))
        #: Start and hash of the word that the last section cut.
        self.open: tuple[int, np.ndarray] | None = None
        starts, ends, hashes = [], [], []
        for a, b in self._sections():
            s, e, h = self._scan(a, b)
            starts.append(s), ends.append(e), hashes.append(h)
        self.starts, self.ends, self.hashes = (np.concatenate([*x, np.zeros(0, t)]) for x, t in ((starts, np.int64), (ends, np.int64), (hashes, np.uint64)))
        owner = np.searchsorted(bounds, self.starts, "right") - 1
        self.words = np.bincount(owner, minlength=n)
        self.distinct = self._distinct(owner, n)

    def _sections(self) -> Iterator[tuple[int, int]]:
        """Bounds of sections of SECTION bytes at most; a section may cut a text or a word."""
        for a in range(int(self.bounds[0]), int(self.bounds[-1]), SECTION):
            yield a, min(a + SECTION, int(self.bounds[-1]))

    def _scan(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Adds the section's counts, and returns start, end and hash of the words that end in it. A word that is cut is carried on."""
        classes, values, power, inverse = _tables()
        raw = self.data[a:b]
        kind = classes[raw]
        first, last = np.searchsorted(self.bounds, [a, b], "right") - 1
        last = min(int(last), len(self.bounds) - 2)
        at = np.clip(self.bounds[first : last + 2], a, b) - a
        for marks, total in ((kind & CAPITAL, self.capitals), (kind & SYMBOL, self.symbols), ((kind & FOLLOWS) ^ FOLLOWS, self.points)):
            sums = np.concatenate([[0], np.cumsum(marks != 0)])
            total[first : last + 1] += np.diff(sums[at])
        word = (kind & SPACE) == 0
        # A word ends where a space follows or its text does.
        edge = np.zeros(b - a + 1, bool)
        edge[at] = True
        begins, stops = word.copy(), word.copy()
        begins[1:] &= ~word[:-1] | edge[1:-1]
        stops[:-1] &= ~word[1:] | edge[1:-1]
        s, e = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[raw] * power[: b - a], dtype=np.uint64)])
        h = (sums[e] - sums[s]) * inverse[s]
        s, e = s + a, e + a
        if self.open is not None:
            start, begun = self.open
            if len(s) and s[0] == a:
                s[0] = start
                h[:1] = begun + h[:1] * np.array([pow(int(MULTIPLIER), a - start, 1 << 64)], np.uint64)
            else:
                s, e, h = (np.concatenate(x) for x in (([start], s), ([a], e), (begun, h)))
        cut = len(e) > 0 and e[-1] == b and b != self.bounds[-1] and b != self.bounds[last]
        self.open = (int(s[-1]), h[-1:]) if cut else None
        return (s[:-1], e[:-1], h[:-1]) if cut else (s, e, h)

    def _distinct(self, owner: np.ndarray, n: int) -> np.ndarray:
        order = np.lexsort((self.hashes, owner))
        h, d = self.hashes[order], owner[order]
        same = np.flatnonzero((h[1:] == h[:-1]) & (d[1:] == d[:-1]))
        out = self.words - np.bincount(d[same], minlength=n)
        for k in np.unique(d[same[~self._equal(order[same], order[same + 1])]]):
            mine = owner == k
            out[k] = len({self.data[s:e].tobytes() for s, e in zip(self.starts[mine], self.ends[mine], strict=True)})
        return out

    def _equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the words of numbers a and b have the same bytes, in blocks of about SECTION bytes; a longer word is compared alone."""
        size = self.ends[a] - self.starts[a]
        equal = size == self.ends[b] - self.starts[b]
        long = np.flatnonzero(equal & (size > SECTION))
        for k in long:
            equal[k] = np.array_equal(self.data[self.starts[a[k]] : self.ends[a[k]]], self.data[self.starts[b[k]] : self.ends[b[k]]])
        todo = np.flatnonzero(equal & (size <= SECTION))
        block = np.cumsum(size[todo]) // SECTION
        for part in np.split(todo, np.flatnonzero(np.diff(block)) + 1):
            if not len(part):
                continue
            length = size[part]
            begin = np.cumsum(length) - length
            within = np.arange(int(length.sum())) - np.repeat(begin, length)
            differ = self.data[np.repeat(self.starts[a[part]], length) + within] != self.data[np.repeat(self.starts[b[part]], length) + within]
            equal[part] = np.add.reduceat(differ, begin, dtype=np.int64) == 0
        return equal

    def masks(self) -> np.ndarray:
        """Bits 0 to 3: fails A, B, C, D."""
        fails = (self.words < WORDS, 100 * self.distinct < DISTINCT * self.words, 100 * self.capitals > CAPITALS * self.points, self.symbols > 0)
        return sum(f.astype(np.int32) << k for k, f in enumerate(fails))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array without nulls, and the bounds of its texts in them."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, bounds, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    where = np.frombuffer(bounds, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), where


def text_masks(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Replaces the text by _mask int, the filters of the text alone that it fails (bits 0 to 3), and _digest binary."""
    bounded_batches(docs.sparkSession)
    whole = F.coalesce(F.col(text_col), F.lit(""))
    others = [c for c in docs.columns if c != text_col]
    ready = docs.select(*others, F.unhex(F.sha2(whole.cast("binary"), 256)).alias("_digest"), whole.alias("_text"))
    schema = ready.drop("_text").withColumn("_mask", F.lit(None).cast("int")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Counts(*buffers(batch.column(batch.num_columns - 1))).masks()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.int32())], names=schema.names)

    return ready.mapInArrow(tidy(run), schema)


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, mask, n, good, toxic: rows of each part and mask, with those labelled quality 1 and toxic 1."""
    masked = text_masks(docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("_part"), F.col(text_col).alias("text")))
    is_1 = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(is_1("quality").alias("_good"), is_1("toxic").alias("_toxic"))
    # Rows without an id are dealt by their text; no label is theirs.
    masked = masked.withColumn("_salt", F.when(F.col("_id").isNull(), F.xxhash64("_digest")).otherwise(F.lit(0)))
    marked = masked.join(marks.withColumn("_salt", F.lit(0).cast("long")), ["_id", "_salt"], "left")
    flags = [F.coalesce(c, F.lit(0)).alias(c) for c in ("_good", "_toxic")]
    key = ["_digest", "_part", "_mask", "_good", "_toxic"]
    ids = marked.select("_id", "_salt", "_digest", "_part", "_mask", *flags).groupBy("_id", "_salt", *key).agg(F.count("*").alias("n"))
    # The rows of the smallest id, and all rows, of each text; nulls come last.
    least = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("n").alias("n")))
    groups = ids.groupBy(*key).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"), least.alias("first"))
    smallest = F.min(F.when(~F.col("first.none"), F.col("first.id"))).over(Window.partitionBy("_digest"))
    passing = F.col("no_id") + F.when(~F.col("first.none") & (F.col("first.id") == F.col("_smallest")), F.col("first.n")).otherwise(0)
    split = groups.withColumn("_smallest", smallest).withColumn("_pass", passing)
    fails_e = 1 << FILTERS.index("E")
    both = F.explode(F.array(F.struct(F.col("_mask").alias("mask"), F.col("_pass").alias("n")), F.struct((F.col("_mask") + fails_e).alias("mask"), (F.col("n") - F.col("_pass")).alias("n"))))
    rows = split.select(F.col("_part").alias("part"), "_good", "_toxic", both.alias("x")).select("part", "_good", "_toxic", "x.mask", "x.n")
    total = lambda c: F.sum(c).cast("long")
    return rows.groupBy("part", "mask").agg(total("n").alias("n"), total(F.col("n") * F.col("_good")).alias("good"), total(F.col("n") * F.col("_toxic")).alias("toxic"))


def orders() -> list[tuple[str, int, int, int]]:
    """filter_order, step, bit of the step's filter, bits of the filters before it; for all orders."""
    bit = {f: 1 << k for k, f in enumerate(FILTERS)}
    return [("".join(p), k + 1, bit[f], sum(bit[x] for x in p[:k])) for p in permutations(FILTERS) for k, f in enumerate(p)]


def audit(counts: DataFrame) -> DataFrame:
    """From mask_counts(): a row for each part, order and step, with kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley."""
    listed = json.dumps([dict(zip(("filter_order", "step", "bit", "before"), o, strict=True)) for o in orders()])
    step = F.explode(F.from_json(F.lit(listed), "array<struct<filter_order: string, step: int, bit: int, before: int>>"))  # one constant
    rows = counts.select("*", step.alias("o")).select("part", "mask", "n", "good", "toxic", "o.*")
    fails, earlier = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    number = lambda cond, c="n": F.sum(F.when(cond, F.col(c)).otherwise(0)).cast("long")
    steps = rows.groupBy("part", "filter_order", "step", "bit").agg(
        number(~fails & ~earlier).alias("kept"), number(fails & ~earlier).alias("removed"), number(fails & earlier).alias("redundant"), number(F.col("mask") == F.col("bit")).alias("unique_fails"),
        number(fails & ~earlier, "good").alias("good_lost"), number(fails & ~earlier, "toxic").alias("toxic_lost"))
    return steps.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit")).cast("long")).drop("bit")
