"""Language identification by mixture inference.

A language is a distribution over hashed character trigrams. For each document, expectation-maximisation estimates the proportions in which
languages make up its trigrams; the set of languages is chosen by likelihood less a penalty for each language, and the language
with the largest proportion in the chosen set is the prediction.

Training takes the whole texts of at most `sample` labelled documents of each language, chosen by a hash of their id; prediction takes the whole
of every text.

Results for odd input: a null text, or one without a letter, is `und` with score 0; without any language learnt every text is `und`; null
languages are not learnt from; source and id are not inputs; repeated rows are predicted each; equal likelihoods go to the language that
is first in order. Input columns named like the result's are replaced. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, tidy

#: Documents of a language that training takes at most; trigram buckets; smoothing; rounds; penalty by language.
SAMPLE, BUCKETS, SMOOTH, ROUNDS, PENALTY = 1500, 1 << 16, 0.05, 12, 2.0
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def trigrams(text: str | None) -> np.ndarray:
    """Buckets of the text's trigrams of lower-cased letters, words being set off by a space; empty without letters."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    alpha = letters()[codes]
    if not alpha.any():
        return np.zeros(0, dtype=np.int64)
    codes = np.concatenate([[32], np.where(alpha, codes, 32), [32]]).astype(np.uint64)
    codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]
    if len(codes) < 3:
        codes = np.pad(codes, (0, 3 - len(codes)), constant_values=32)
    mixed = (codes[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (codes[2:] * np.uint64(0x165667B19E3779F9))
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(48)).astype(np.int64) % BUCKETS


class Model:
    def __init__(self, languages: list[str], probabilities: np.ndarray):
        self.languages, self.p = languages, probabilities

    def mixture(self, p: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
        """Proportions of p's columns by expectation-maximisation, and the log-likelihood."""
        pi, n = np.full(p.shape[1], 1 / p.shape[1]), counts.sum()
        for _ in range(rounds):
            pi = pi * (p.T @ (counts / (p @ pi))) / n
            pi = np.maximum(pi, 1e-9) / np.maximum(pi, 1e-9).sum()
        return pi, float(counts @ np.log(p @ pi))

    def predict(self, text: str | None) -> tuple[str, float]:
        grams = trigrams(text)
        if not len(grams) or not self.languages:
            return UNKNOWN, 0.0
        where, counts = np.unique(grams, return_counts=True)
        p, counts = self.p[where], counts.astype(np.float64)
        n = counts.sum()
        pi, best = self.mixture(p, counts)
        fee = PENALTY * np.log(n + 1.0)
        single = counts @ np.log(p)
        chosen, value = [int(np.argmax(single))], float(single.max()) - fee
        if best - 2 * fee > value:  # more than one language can only pay if all of them would
            order = np.argsort(-pi, kind="stable")
            for k in range(2, len(order) + 1):
                part = np.sort(order[:k])
                share, fit = self.mixture(p[:, part], counts, 3 * ROUNDS)
                if fit - k * fee > value:
                    chosen, value = [int(part[np.argmax(share)]), *part.tolist()], fit - k * fee
        # The proportions over all languages with one more trigram of each.
        return self.languages[chosen[0]], float((pi[chosen[0]] * n + 1) / (n + len(pi)))


def train(docs: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """may_learn: a condition on the id column; rows without it are not looked at."""
    rows = docs.where(may_learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"))
    spark = docs.sparkSession
    totals = rows.groupBy("_lang").agg(F.count("*").alias("n")).collect()
    # Few rows of each language are sorted: those under a bound of the hash that leaves some four times as many as are taken.
    bounds = [(r["_lang"], max(-(2**63), min(2**63 - 1, int(-(2**63) + 4 * sample / r["n"] * 2**64)))) for r in totals]
    few = rows.join(F.broadcast(spark.createDataFrame(bounds, "_lang string, _most long")), "_lang").where(F.xxhash64("_id") <= F.col("_most"))
    place = F.row_number().over(Window.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id"))
    chosen = few.withColumn("_k", place).where(F.col("_k") <= sample).select("_id", "_lang").distinct().collect()
    if not chosen:
        return Model([], np.zeros((BUCKETS, 0)))
    ids = F.broadcast(spark.createDataFrame(chosen, T.StructType([T.StructField("_id", docs.schema[id_col].dataType), T.StructField("_lang", T.StringType())])))
    texts = docs.where(may_learn).select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_t")).join(ids, ["_id", "_lang"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = np.bincount(trigrams(text), minlength=BUCKETS)
                sums[lang] = sums[lang] + got if lang in sums else got
        for lang, got in sums.items():
            at = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(got[at])], names=["lang", "g", "n"])

    found = texts.select("_lang", "_t").mapInArrow(tidy(count), "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n")).toArrow()  # languages x BUCKETS rows at most
    langs = np.asarray(found["lang"].to_pylist(), dtype=object)
    names = sorted(set(langs))
    counts = np.zeros((BUCKETS, len(names)))
    for k, name in enumerate(names):
        own = langs == name
        counts[np.asarray(found["g"])[own], k] = np.asarray(found["n"])[own]
    return Model(names, (counts + SMOOTH) / (counts.sum(axis=0) + SMOOTH * BUCKETS))


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Replaces the text by lang_pred string and score double."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages doubles
    others = [c for c in docs.columns if c not in (text_col, "lang_pred", "score")]
    schema = T.StructType([docs.schema[c] for c in others] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            got = [m.predict(texts[k].as_py()) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.select(others).columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*others, "lang_pred", "score"])

    return docs.select(*others, text_col).mapInArrow(tidy(run), schema)
