"""Quality classifier by compression: zstandard dictionaries of good and bad text.

Two dictionaries are trained, one on text labelled good and one on text labelled bad. A text is cut into blocks; all of them are
compressed with either dictionary, and the difference of the summed sizes, normalised by their sum, is turned into a score by a logistic
curve that is fitted on labelled texts the dictionaries have not seen. Text that repeats itself is small with either dictionary, so the curve
has a second term: how far the size without a dictionary falls below that of prose. Training takes whole texts of at most `sample` labelled rows and
`sample_bytes` bytes of each class, in the order of a hash of their id; a row whose text does not fit in what is left of the bytes is passed over. Scoring takes
the whole of every text.

Results for odd input: null and empty texts score as a difference of 0 and no repetition; ids, labels, language and source are not inputs of a score; repeated
rows are scored each; labels that are null or neither 0 nor 1, and documents without a label, are not learnt from. Without labels of both
classes every score is the share of class 1, or 0.5; so it is if no text of one class can be learnt from, as in an empty table or where all are empty. Input columns named like the result's are replaced. An empty table gives an
empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, least_hashes, tidy

#: Labelled rows and bytes of each class that training takes at most, bytes of a dictionary, of a block, and level.
SAMPLE, SAMPLE_BYTES, DICT_BYTES, BLOCK, LEVEL = 3000, 16 << 20, 112 << 10, 2048, 3
#: Compressed share below which text counts as repeating itself.
PROSE = 0.35


class Model:
    """Dictionaries and the curve: score = 1 / (1 + exp(-(w0 + w1 * difference + w2 * repetition)))."""

    def __init__(self, good: bytes, bad: bytes, weights: tuple[float, float, float] = (0.0, 0.0, 0.0)):
        self.good, self.bad, self.weights = good, bad, weights

    def score(self, features: tuple[float, float]) -> float:
        z = self.weights[0] + self.weights[1] * features[0] + self.weights[2] * features[1]
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


@lru_cache(maxsize=4)
def compressors(good: bytes, bad: bytes, level: int):
    import zstandard as z

    made = [z.ZstdCompressionDict(x, dict_type=z.DICT_TYPE_AUTO) for x in (good, bad)]
    for d in made:
        d.precompute_compress(level=level)
    return [z.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False) for d in (*made, None)]


def features(model: Model, text: str | None, block: int = BLOCK, level: int = LEVEL) -> tuple[float, float]:
    """Over all blocks: (size by the bad dictionary - size by the good one) / their sum; and log(PROSE / (size without dictionary / size)), 0 at least."""
    raw = (text or "").encode()
    if not raw or not model.good:
        return 0.0, 0.0
    good, bad, plain = compressors(model.good, model.bad, level)
    view = memoryview(raw)
    g, b, p = (sum(len(c.compress(view[k : k + block])) for k in range(0, len(raw), block)) for c in (good, bad, plain))
    return (b - g) / (b + g), max(0.0, math.log(PROSE * len(raw) / p))


def fit_curve(x: np.ndarray, y: np.ndarray, rounds: int = 100, ridge: float = 1e-3) -> tuple[float, ...]:
    """Logistic regression by Newton's method: the intercept and a weight for each column of x."""
    scale = np.maximum(np.std(x, axis=0), 1e-9)
    a = np.concatenate([np.ones((len(x), 1)), x / scale], axis=1)
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return (float(w[0]), *(float(v) for v in w[1:] / scale))


def flat(share: float) -> Model:
    """Scores every text by the share of class 1."""
    share = min(max(share, 1e-17), 1 - 1e-16)
    return Model(b"", b"", (math.log(share / (1 - share)), 0.0, 0.0))


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """may_learn: a condition on the id column; other rows are not looked at. The share of the classes in the sample is undone in the curve."""
    import zstandard as z

    spark = docs.sparkSession
    marked = labels.where(may_learn & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    totals = {r["_y"]: r["n"] for r in marked.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return flat(float(next(iter(totals), 0.5)))
    share = totals[1] / (totals[0] + totals[1])
    rows = []
    for y in sorted(totals):
        rows += marked.where((F.col("_y") == y) & least_hashes("_id", sample, totals[y])).orderBy(F.xxhash64("_id"), "_id").limit(sample).collect()
    place = T.StructType([T.StructField("_id", docs.schema[id_col].dataType), T.StructField("_y", T.IntegerType()), T.StructField("_k", T.IntegerType())])
    named = lambda chosen: F.broadcast(spark.createDataFrame(chosen, place))
    have = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).where(F.col("_t").isNotNull() & (F.col("_t") != ""))
    sizes = have.join(named([(r["_id"], int(r["_y"]), k) for k, r in enumerate(rows)]), "_id").groupBy("_id", "_y", "_k").agg(F.max(F.octet_length("_t")).alias("n")).orderBy("_k").collect()
    left, chosen = {0: sample_bytes, 1: sample_bytes}, []
    for r in sizes:
        if r["n"] <= left[r["_y"]]:
            left[r["_y"]] -= r["n"]
            chosen.append((r["_id"], r["_y"], r["_k"]))
    if len({y for _, y, _ in chosen}) < 2:
        return flat(share)
    got = have.join(named(chosen), "_id").groupBy("_k", "_y").agg(F.max(F.struct(F.octet_length("_t"), "_t"))["_t"].alias("_t")).orderBy("_k").toArrow()
    k, y, texts = np.asarray(got["_k"]), np.asarray(got["_y"]), got["_t"].to_pylist()
    # Every third text of either class is left for the curve.
    kept = k % 3 == 2
    corpora = {c: [t.encode() for t, yy, h in zip(texts, y, kept, strict=True) if yy == c and not h] for c in (0, 1)}
    dicts = {}
    for c, parts in corpora.items():
        blocks = [p[i : i + BLOCK] for p in parts for i in range(0, len(p), BLOCK)]
        try:
            dicts[c] = z.train_dictionary(DICT_BYTES, blocks).as_bytes()
        except z.ZstdError:  # too little text for the trainer: the text itself is the dictionary
            dicts[c] = b"\n".join(parts)[:DICT_BYTES] or b" " * 8
    model = Model(dicts[1], dicts[0])
    use = kept if len(set(y[kept])) == 2 else np.ones(len(y), bool)
    x = np.array([features(model, t) for t, u in zip(texts, use, strict=True) if u])
    yy = y[use].astype(float)
    w = fit_curve(x, yy)
    taken = {c: max(1, int((yy == c).sum())) for c in (0, 1)}
    return Model(dicts[1], dicts[0], (w[0] + math.log(totals[1] / totals[0]) - math.log(taken[1] / taken[0]), *w[1:]))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Replaces the text by score double."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    others = [c for c in docs.columns if c not in (text_col, "score")]
    schema = T.StructType([docs.schema[c] for c in others] + [T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            got = [m.score(features(m, texts[k].as_py())) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.select(others).columns, pa.array(got, pa.float64())], names=[*others, "score"])

    return docs.select(*others, text_col).mapInArrow(tidy(run), schema)


def accepted(docs: DataFrame, model: Model, threshold: float, text_col: str = "text") -> DataFrame:
    """The documents that score at least the threshold, with all their columns."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            yield batch.filter(pa.array([m.score(features(m, texts[k].as_py())) >= threshold for k in range(batch.num_rows)], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
