"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

Folding: compatibility forms (NFKC), lower case, no invisible characters, look-alike letters of other scripts in words that also hold Latin letters become
Latin ones, and digits and signs that stand for letters within such words (`0 1 3 4 5 7 @ $ !`) become these letters. As `1` stands for `i` and for `l`, both
fold to `i`. Accents stay, since they tell words of other languages apart. What is left of a text is its words between single spaces.

Lexicon: whole words and beginnings of words of 3 to 8 characters, weighted by the lower end of the confidence interval of their log-odds between documents
labelled toxic and clean. The `size` heaviest are kept. Exception phrases, a lexicon entry with the word before or after it, come from the caller
and from labelled documents: a phrase is one where clean documents have it and the log-odds' upper end is below 0. The automaton holds entries and phrases;
an entry that lies within a phrase does not count, and of several entries that begin at one word the heaviest does.

Score: the weights found, added up and divided by the number of words, and the sum over different words, which a repeated word does not raise, go through a
logistic curve as logarithms. It is fitted with each document's own part taken out of the weights, so that it holds for documents that were not learnt from, and
the classes' shares are put back.

Training looks at about `sample` labelled documents of each class, those of the least hashes of their ids, and reads their whole texts on executors; what reaches
the driver is the lexicon, the phrases and two numbers a document. Scoring reads whole texts.

Results for odd input: null and empty texts and texts without a word score as texts of two words without a match; labels that are null or neither 0 nor 1, null
ids, and documents without a label are not learnt from; of several labels of an id the larger counts; an id that repeats is learnt from once for each row.
Without labels of both classes every score is the share of class 1, or 0.5 without any. Input columns named like the result's are replaced.
An empty table gives an empty table. A very long text is folded in pieces of about `PIECE` characters, cut between words.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, least_hashes, materialise, tidy
from .quality import fit_curve

#: Labelled documents of each class that training reads, about; entries of the lexicon at most; lengths of beginnings of words.
SAMPLE, SIZE, SHORTEST, LONGEST = 20_000, 4000, 3, 8
#: Least toxic documents that hold an entry, and least clean ones that hold a phrase; standard errors of the interval; least weight of an entry; most phrases.
SUPPORT, PHRASE_SUPPORT, ERRORS, LEAST, PHRASES = 2, 3, 1.96, 1.0, 2000
PIECE = 1 << 16
#: Words by which a text's length is lengthened, so that one match in a word or two does not weigh all.
LENGTH = 5

#: Letters of other scripts that look like Latin ones.
LOOK_ALIKES = dict(zip(
    "авеёкмнорстухіїјѕԁһԛԝүαβεηικνορτυχϲ"
    "ɑɡıłøđℓ",
    "abeekmhopctyxiijsdhqwyabenikvoptuxc"
    "agiiodi", strict=True))  # fmt: skip
#: Digits and signs that are written for letters.
SUBSTITUTES = dict(zip("013457@$!|", "oieastasii", strict=True))
_FOREIGN = str.maketrans(LOOK_ALIKES)
_DIGITS = str.maketrans(SUBSTITUTES)
_WORD = re.compile(r"[^\W_]+(?:[@$!|](?=[^\W_])[^\W_]+)*|[@$](?=[a-z])[^\W_]+(?:[@$!|](?=[^\W_])[^\W_]+)*")
_ODD = re.compile(r"[0-9@$!|]|[^\x00-\x7f]")
_LATIN = re.compile("[a-z]")
_HIDDEN = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁤︀-️﻿]")


def fold_words(text: str) -> list[str]:
    """The words of a text, folded."""
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text))
    found = _WORD.findall(text.lower())
    for k, w in enumerate(found):
        if _ODD.search(w) is not None and _LATIN.search(w) is not None:
            found[k] = w.translate(_FOREIGN).translate(_DIGITS)
    return [w.replace("l", "i") for w in found]


def pieces(text: str | None, size: int = PIECE) -> Iterator[str]:
    """A text in pieces that end at white space where there is any."""
    text = text or ""
    a = 0
    while len(text) - a > size:
        b = a + size
        while b < len(text) and not text[b].isspace():
            b += 1
        yield text[a:b]
        a = b
    yield text[a:]


def folded(text: str | None) -> str:
    """The folded words of a text between single spaces, with one before and after."""
    return " " + "".join(f"{w} " for p in pieces(text) for w in fold_words(p))


def entries(words: Iterable[str]) -> set[str]:
    """Entries that words stand for: ` word ` and the beginnings of words, ` wor`."""
    out = set()
    for w in set(words):
        out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in range(SHORTEST, min(LONGEST, len(w)) + 1))
    return out


class Odds:
    """Log-odds of being in a toxic rather than a clean document, from numbers of documents."""

    def __init__(self, toxic: int, clean: int):
        self.toxic, self.clean = toxic, clean

    def between(self, a: int, c: int, toxic: int | None = None, clean: int | None = None) -> tuple[float, float]:
        """Both ends of the interval for a term in `a` of the toxic and `c` of the clean documents."""
        toxic, clean = self.toxic if toxic is None else toxic, self.clean if clean is None else clean
        x = math.log((a + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))
        e = ERRORS * math.sqrt(1 / (a + 0.5) + 1 / (c + 0.5))
        return x - e, x + e

    def weight(self, a: int, c: int, own: int | None = None) -> float:
        """The weight of an entry, 0 if it is not one; without a document of class `own` that holds it."""
        toxic, clean = self.toxic - (own == 1), self.clean - (own == 0)
        a, c = a - (own == 1), c - (own == 0)
        w = self.between(a, c, toxic, clean)[0] if a >= SUPPORT else 0.0
        return w if w >= LEAST else 0.0


class Model:
    """Entries with their numbers of toxic and clean documents, exception phrases (` word word `), and the curve."""

    def __init__(self, odds: Odds, terms: dict[str, tuple[int, int]], phrases: Iterable[str] = (), curve: tuple[float, float, float] = (0.0, 0.0, 0.0)):
        self.odds, self.terms, self.phrases, self.curve = odds, terms, tuple(phrases), curve

    def weights(self) -> dict[str, float]:
        return {t: self.odds.weight(*n) for t, n in self.terms.items()}

    @property
    def key(self) -> tuple:
        return tuple(self.terms.items()), self.phrases, self.odds.toxic, self.odds.clean

    def score(self, features: tuple[float, float]) -> float:
        z = self.curve[0] + self.curve[1] * features[0] + self.curve[2] * features[1]
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


@lru_cache(maxsize=4)
def _automaton(key: tuple):
    import ahocorasick

    terms, phrases, toxic, clean = key
    odds = Odds(toxic, clean)
    held: dict[str, tuple] = {t: (len(t), t, odds.weight(*n), *n) for t, n in terms}
    for p in phrases:
        held[p] = (len(p), p, None, 0, 0)
    a = ahocorasick.Automaton()
    for t, v in held.items():
        a.add_word(t, v)
    a.make_automaton()
    return a


def matches(text: str, model: Model, own: int | None = None) -> list[tuple[int, str, float]]:
    """Place, entry and weight of what a folded text holds; own: the class of a document that was learnt from, whose part is taken out."""
    if not model.terms:
        return []
    best: dict[int, tuple[str, float]] = {}
    covered: list[tuple[int, int]] = []
    for end, (size, term, weight, a, c) in _automaton(model.key).iter(text):
        start = end - size + 1
        if weight is None:
            covered.append((start, end))
            continue
        w = weight if own is None else model.odds.weight(a, c, own)
        if w > best.get(start, ("", 0.0))[1]:
            best[start] = (term, w)
    for start, end in covered:
        k = start
        while k != -1 and k < end:  # all words of the phrase
            best.pop(k, None)
            k = text.find(" ", k + 1)
    return [(k, *best[k]) for k in sorted(best)]


def features(text: str | None, model: Model, own: int | None = None) -> tuple[float, float]:
    """Logarithms of the weights found a hundred words, and of the sum of the weights of different words."""
    total, words = 0.0, 0
    different: dict[str, float] = {}
    for p in pieces(text):
        f = folded(p)
        words += f.count(" ") - 1
        for k, _, w in matches(f, model, own):
            total += w
            different[f[k + 1 : f.index(" ", k + 1)]] = w
    return math.log1p(100 * total / (max(words, 2) + LENGTH)), math.log1p(sum(different.values()))


def _marked(labels: DataFrame, may_learn: Column, id_col: str, label_col: str, sample: int) -> tuple[DataFrame, dict[int, int]]:
    """_id, _y of about `sample` labelled rows of each class, and the number of rows of each class."""
    marked = labels.where(may_learn & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    totals = {r["_y"]: r["n"] for r in marked.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    taken = F.lit(False)
    for y, n in totals.items():
        # least_hashes() keeps four times what it is asked for.
        taken = taken | ((F.col("_y") == y) & least_hashes("_id", max(1, sample // 4), n))
    return marked.where(taken), totals


def _counted(rows: DataFrame, terms_of) -> DataFrame:
    """term, toxic, clean: in how many documents of each class a term is; counted within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts[y].update(terms_of(t.as_py()))
            terms = list(counts[1].keys() | counts[0].keys())
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([counts[y][t] for t in terms], pa.int64()) for y in (1, 0))], names=["term", "toxic", "clean"])

    return rows.select("_y", "_t").mapInArrow(tidy(run), "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _phrases_of(text: str | None, model: Model) -> set[str]:
    """The entries of a text with the word before and the word after."""
    out = set()
    for p in pieces(text):
        f = folded(p)
        for k, _, _ in matches(f, model):
            end = f.find(" ", k + 1)
            after = f.find(" ", end + 1)
            if k > 0:
                out.add(f[f.rfind(" ", 0, k) : end + 1])
            if after != -1:
                out.add(f[k : after + 1])
    return out


def flat(share: float) -> Model:
    """Scores every text by the share of class 1."""
    share = min(max(share, 1e-17), 1 - 1e-16)
    return Model(Odds(0, 0), {}, (), (math.log(share / (1 - share)), 0.0, 0.0))


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, size: int = SIZE, exceptions: Iterable[str] = ()) -> Model:
    """may_learn: a condition on the id column of labels; other rows are not looked at. exceptions: phrases that are never toxic."""
    spark = docs.sparkSession
    bounded_batches(spark)
    marked, totals = _marked(labels, may_learn, id_col, label_col, sample)
    if len(totals) < 2:
        return flat(float(next(iter(totals), 0.5)))
    # Texts are read once: the sample's ids are few, so they go to the texts, and what is learnt from is a table of its own.
    rows = materialise(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(F.broadcast(materialise(marked, "toxicity-ids")), "_id").select("_y", "_t"), "toxicity-sample")
    seen = {r["_y"]: r["n"] for r in rows.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    odds = Odds(seen.get(1, 0), seen.get(0, 0))
    if not odds.toxic or not odds.clean:
        return flat(totals[1] / (totals[0] + totals[1]))
    terms = _counted(rows, lambda t: entries(w for p in pieces(t) for w in fold_words(p)))
    low = F.log((F.col("toxic") + 0.5) / (odds.toxic + 1)) - F.log((F.col("clean") + 0.5) / (odds.clean + 1)) - ERRORS * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    kept = terms.where((F.col("toxic") >= SUPPORT) & (low >= LEAST)).orderBy(low.desc(), "term").limit(size).collect()
    given = [folded(p) for p in exceptions]
    model = Model(odds, {r["term"]: (r["toxic"], r["clean"]) for r in kept}, given)
    if model.terms:
        sent = spark.sparkContext.broadcast(model)
        # Documents, not places, are counted; a phrase that few clean documents hold says nothing.
        some = _counted(rows, lambda t: _phrases_of(t, sent.value)).where(F.col("clean") >= PHRASE_SUPPORT)
        up = F.log((F.col("toxic") + 0.5) / (odds.toxic + 1)) - F.log((F.col("clean") + 0.5) / (odds.clean + 1)) + ERRORS * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
        model.phrases += tuple(r["term"] for r in some.where(up < 0).orderBy(up, "term").limit(PHRASES).collect())
    final = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [features(t.as_py(), final.value, y) for y, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([g[k] for g in got], pa.float64()) for k in (0, 1))], names=["y", "a", "b"])

    found = rows.mapInArrow(tidy(run), "y int, a double, b double").toArrow().sort_by([("a", "ascending"), ("b", "ascending"), ("y", "ascending")])
    y, x = np.asarray(found["y"], float), np.stack([np.asarray(found["a"]), np.asarray(found["b"])], axis=1)
    w = fit_curve(x, y)
    shift = math.log(totals[1] / totals[0]) - math.log(odds.toxic / odds.clean)
    model.curve = (w[0] + shift, w[1], w[2])
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Replaces the text by score double."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    others = [c for c in docs.columns if c not in (text_col, "score")]
    schema = T.StructType([docs.schema[c] for c in others] + [T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            got = [m.score(features(t.as_py(), m)) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(got, pa.float64())], names=[*others, "score"])

    return docs.select(*others, text_col).mapInArrow(tidy(run), schema)
