"""Near-duplicate detection with SetSketch registers.

A document's set of word shingles is sketched into registers, the exponentially spaced levels of truncated minima: register i is
floor(1 - log_b(a * x_i)), x_i the least of the elements' exponential variables, so registers of a union are the larger of two. Documents
with the same set are one class. Classes whose registers agree in a band share a bucket. The similarity of a pair is estimated jointly
from the counts of larger, equal and smaller registers and the known set sizes, by maximum likelihood; pairs that may be similar enough are
verified on the full sets.

A bucket's pairs are not all formed. First each member is compared with the bucket's smallest id, and found links are joined to components.
In buckets that then hold members of different components, these are compared with another member, chosen by a hash. Last, what may still
be linked is compared outright, in one of two ways. Pairs that were too far apart to be verified are not in question; the others make
clusters. In a cluster, the members outside its largest component are compared with all of it, block by block on full sets, and only links are
given out. Members of one bucket that are in different clusters are compared as pairs. What a bucket would link is therefore linked, and a
group of n near copies costs about n comparisons, and those of its members that link nothing about n each. Components are found by hooking and
pointer jumping over tables of links.

With ROWS registers in each of BANDS bands, a pair of similarity 0.8 shares no bucket with probability 1.3e-7.

Results for odd input: null and empty texts, and texts of white space, have the empty set and are linked with nothing; a text of fewer
words than a shingle has one shingle, its whole sequence; very long texts are sketched in blocks; documents with a null id are linked with
nothing; rows that repeat an id are one document that has the links of all of them; other columns are ignored; an empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, tidy

#: Registers of a band, bands; base, rate and highest level of the sketch.
ROWS, BANDS = 5, 40
REGISTERS, BASE, RATE, TOP = ROWS * BANDS, 1.001, 20.0, 65535
#: One bit of each register is kept beside them, in BITS longs. Of 200 bits a pair of similarity 0.8 differs in 20 on average, in over FAR with
#: probability 5e-8.
BITS, FAR = [f"s{k}" for k in range(4)], 44
#: Further members that those of a mixed bucket are compared with before all are.
STARS = 1
#: Of a cluster, members and others that are compared at once, and elements of their sets at most.
MEMBERS, OTHERS, ELEMENTS = 256, 128, 1 << 19
#: Ids, and rows of ids with register bits, that are sent to all tasks as a broadcast at most.
BROADCAST_IDS, BROADCAST_ROWS = 1 << 21, 1 << 18
#: A pair is verified unless its estimate is so far under the threshold (over five standard deviations).
SLACK = 0.16
#: Elements sketched at once; words whose hashes a task keeps; sets of documents that a task keeps while it verifies.
BLOCK, WORDS_KEPT, SETS_KEPT = 512, 1 << 18, 64
BATCH_BYTES = 4 << 20


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, k: int, hashes: WordHashes) -> np.ndarray:
    """The sorted set of 64-bit hashes of the text's k-word shingles. A-Z are lower-cased; words are runs without ASCII white space."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(k, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - k + 1 + i])
    return np.unique(h)


@lru_cache(maxsize=1)
def multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return (rng.integers(0, 1 << 31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None], rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)[:, None]


def sketch(elements: np.ndarray) -> np.ndarray:
    """The registers of a set that is not empty."""
    a, b = multipliers()
    x = (elements >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), BLOCK):
        least = np.minimum(least, ((x[None, k : k + BLOCK] ^ b) * a).min(axis=1))
    exponential = -np.log1p(-(least + 0.5) / 2.0**32)
    return np.clip(np.floor(1 - np.log(RATE * exponential) / np.log(BASE)) + 20000, 0, TOP).astype(np.uint16)


def joint_similarity(na: np.ndarray, nb: np.ndarray, more: np.ndarray, fewer: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Maximum-likelihood Jaccard similarities from set sizes and counts of registers that are larger and smaller in the first set."""
    u, v = na / (na + nb), nb / (na + nb)
    equal = REGISTERS - more - fewer
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def fit(j):
        x, y = p(u - v * j), p(v - u * j)
        return more * np.log(np.maximum(x, 1e-12)) + fewer * np.log(np.maximum(y, 1e-12)) + equal * np.log(np.maximum(1 - x - y, 1e-12))

    lo, hi = np.zeros_like(u), np.minimum(u / v, v / u)
    for _ in range(rounds):  # the likelihood has one peak
        s, t = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        up = fit(s) < fit(t)
        lo, hi = np.where(up, s, lo), np.where(up, hi, t)
    return (lo + hi) / 2


def sketches(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """id, n (set size), key (digest of the set), regs, and one bit of each register; all but n null if the set is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            texts, ns, keys, regs, bits = b.column(1), [], [], [], []
            for i in range(b.num_rows):
                s = shingles(texts[i].as_py(), k, hashes)
                ns.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                r = sketch(s) if len(s) else None
                regs.append(r.tobytes() if len(s) else None)
                bits.append(np.packbits(np.pad((r & 1).astype(np.uint8), (0, 64 * len(BITS) - REGISTERS))).view(np.int64).tolist() if len(s) else [None] * len(BITS))
            arrays = [b.column(0), pa.array(ns, pa.int64()), pa.array(keys, pa.binary()), pa.array(regs, pa.binary()), *(pa.array([x[i] for x in bits], pa.int64()) for i in range(len(BITS)))]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "n", "key", "regs", *BITS])

    return docs.select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(tidy(run), "id long, n long, key binary, regs binary, " + ", ".join(f"{b} long" for b in BITS))


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each class and band: bucket, id."""
    for b in batches:
        if not b.num_rows:
            continue
        regs = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(-1, BANDS, ROWS).astype(np.uint64)
        h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), regs.shape[:2]).copy()
        for i in range(ROWS):
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + regs[:, :, i] + np.uint64(1))
        yield pa.RecordBatch.from_arrays([pa.array(h.reshape(-1).view(np.int64)), pa.array(np.repeat(np.asarray(b.column(0)), BANDS))], names=["bucket", "id"])


def _likely(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ra, rb = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint16).reshape(-1, REGISTERS) for k in (4, 5))
            got = joint_similarity(np.asarray(b.column(2), dtype=float), np.asarray(b.column(3), dtype=float), (ra > rb).sum(axis=1), (ra < rb).sum(axis=1))
            at = pa.array(np.flatnonzero(got >= threshold - SLACK))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], names=["a", "b"])

    return run


def _verify(k: int, threshold: float):
    percent = round(100 * threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, kept = WordHashes(), {}
        for b in batches:
            out: list[list[int]] = [[], []]
            for i in range(b.num_rows):
                x, y = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                text = b.column(2)[i].as_py()
                if x not in kept or kept[x][0] != hash(text):
                    if len(kept) >= SETS_KEPT:
                        kept.clear()
                    kept[x] = (hash(text), shingles(text, k, hashes))
                sets = (kept[x][1], shingles(b.column(3)[i].as_py(), k, hashes))
                both = len(np.intersect1d(*sets, assume_unique=True))
                if both and 100 * both >= percent * (len(sets[0]) + len(sets[1]) - both):
                    out[0].append(x)
                    out[1].append(y)
            yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], names=["a", "b"])

    return run


def may_link(threshold: float) -> Column:
    """Whether sizes and register bits of a and b leave it possible that they are similar enough."""
    percent = round(100 * threshold)
    differ = sum((F.bit_count(F.col(f"{x}a").bitwiseXOR(F.col(f"{x}b"))) for x in BITS), F.lit(0))
    return (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & (differ <= FAR)


def small(ids: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """For a broadcast, if it holds few ids: what it is joined with then stays where it is, and a hot key is no task's alone."""
    return F.broadcast(ids) if ids.count() <= most else ids


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int, threshold: float) -> DataFrame:
    """The links among pairs (a, b): first by the joint estimate, then on the full sets."""
    one, two = (classes.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("regs").alias(f"r{x}")) for x in "ab")
    likely = pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "ra", "rb")
    likely = materialise(likely.mapInArrow(tidy(_likely(threshold)), "a long, b long"), "near-likely")
    wanted = small(materialise(likely.select(F.col("a").alias("id")).union(likely.select(F.col("b").alias("id"))).distinct(), "near-wanted"))
    texts = materialise(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(wanted, "id", "left_semi"), "near-texts")
    full = likely.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    return materialise(full.select("a", "b", "ta", "tb").mapInArrow(tidy(_verify(k, threshold)), "a long, b long").distinct(), "near-links")


def components(links: DataFrame) -> DataFrame:
    """id, comp (the smallest id that links reach) for the ids of links (a, b) that reach a smaller one.

    Each id is hooked to its smallest linked id, the trees are flattened by pointer jumping, links are redrawn between their roots, until
    none is left between different roots.
    """
    edges = materialise(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    found: DataFrame | None = None
    while not edges.isEmpty():
        hooks = materialise(edges.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("comp")), "hooks")
        while True:
            up = hooks.select(F.col("id").alias("comp"), F.col("comp").alias("higher"))
            jumped = materialise(hooks.join(up, "comp", "left").select("id", F.coalesce("higher", "comp").alias("comp"), F.col("higher").isNotNull().alias("moved")), "jumps")
            hooks = jumped.select("id", "comp")
            if jumped.where("moved").isEmpty():
                break
        root = lambda c, h=hooks: h.select(F.col("id").alias(c), F.col("comp").alias(f"r{c}"))
        moved = edges.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y"))
        edges = materialise(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        if found is not None:
            up = hooks.select(F.col("id").alias("comp"), F.col("comp").alias("higher"))
            found = found.join(up, "comp", "left").select("id", F.coalesce("higher", "comp").alias("comp")).unionByName(hooks)
        else:
            found = hooks
        found = materialise(found, "components")
    if found is None:
        found = edges.select(F.col("a").alias("id"), F.col("b").alias("comp"))
    return found


def bucket_pairs(left: DataFrame, right: DataFrame, threshold: float, more: Column | None = None) -> DataFrame:
    """a, b: ids of one bucket in different components that may be linked, the smaller first."""
    side = lambda df, x: df.select("bucket", *[F.col(c).alias(f"{c}{x}") for c in df.columns if c != "bucket"])
    wanted = (F.col("l.bucket") == F.col("r.bucket")) & (F.col("compa") != F.col("compb")) & may_link(threshold)
    got = side(left, "a").alias("l").join(side(right, "b").alias("r"), wanted if more is None else wanted & more)
    return got.select(F.least("ida", "idb").alias("a"), F.greatest("ida", "idb").alias("b"))


def merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """The components when links (a, b) between ids are added."""
    named = lambda c: comps.select(F.col("id").alias(c), F.col("comp").alias(f"c{c}"))
    tied = links.join(named("a"), "a", "left").join(named("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    between = components(tied)
    known = comps.unionByName(between.select("id", F.col("id").alias("comp")).join(comps.select("id"), "id", "left_anti"))
    up = between.select(F.col("id").alias("comp"), F.col("comp").alias("higher"))
    return materialise(known.join(up, "comp", "left").select("id", F.coalesce("higher", "comp").alias("comp")), "components")


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            texts = b.column(b.num_columns - 1)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([shingles(texts[i].as_py(), k, hashes).tobytes() for i in range(b.num_rows)], pa.binary())], names=[*b.schema.names[:-1], "elements"])

    return run


def _compare(threshold: float):
    percent = round(100 * threshold)

    def run(table: pa.Table) -> pa.Table:
        ids, comps = np.asarray(table.column("id")), np.asarray(table.column("comp"))
        other = np.asarray(table.column("other"))
        sets = [np.frombuffer(x, np.uint64) for x in table.column("elements").to_pylist()]
        own, out = np.flatnonzero(~other), ([], [])
        if len(own):
            sizes = np.array([len(sets[i]) for i in own])
            elements, rows = np.concatenate([sets[i] for i in own]), np.repeat(np.arange(len(own)), sizes)
            order = np.argsort(elements, kind="stable")
            elements, rows = elements[order], rows[order]
            for i in np.flatnonzero(other):
                lo, hi = np.searchsorted(elements, sets[i], "left"), np.searchsorted(elements, sets[i], "right")
                n = hi - lo
                at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                both = np.bincount(rows[at], minlength=len(own))
                hit = own[(100 * both >= percent * (sizes + len(sets[i]) - both)) & (comps[own] != comps[i])]
                out[0].extend([ids[i]] * len(hit))
                out[1].extend(ids[hit].tolist())
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    return run


def within_clusters(clusters: DataFrame, comps: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int, threshold: float) -> DataFrame:
    """The links (a, b) in each cluster between members outside its largest component and all members of other components."""
    placed = clusters.select("id", F.col("comp").alias("cluster")).join(comps, "id", "left").select("id", "cluster", F.coalesce("comp", "id").alias("comp")).join(classes.select("id", "n"), "id")
    counts = placed.groupBy("cluster", "comp").agg(F.count("*").alias("m"), F.sum("n").alias("e"))
    whole = counts.groupBy("cluster").agg(F.sum("m").alias("all"), F.sum("e").alias("e"), F.max(F.struct("m", "comp")).alias("top")).where(F.col("all") > F.col("top.m"))
    blocks = lambda m, at_once: F.greatest(F.ceil(m / at_once), F.ceil(F.col("e") / ELEMENTS)).cast("int")
    mixed = placed.join(whole, "cluster").select("id", "cluster", "comp", (F.col("comp") != F.col("top.comp")).alias("other"), blocks(F.col("all"), MEMBERS).alias("nm"), blocks(F.col("all") - F.col("top.m"), OTHERS).alias("no"))
    mixed = materialise(mixed, "near-mixed")
    rows = small(mixed).join(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "id")
    schema = "id long, cluster long, comp long, other boolean, nm int, no int, elements binary"
    sets = materialise(rows.select("id", "cluster", "comp", "other", "nm", "no", "text").mapInArrow(tidy(_sets(k)), schema), "near-sets")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    members = sets.select("cluster", place("nm").alias("x"), every("no").alias("y"), "id", "comp", F.lit(False).alias("other"), "elements")
    others = sets.where("other").select("cluster", every("nm").alias("x"), place("no").alias("y"), "id", "comp", F.lit(True).alias("other"), "elements")
    return members.unionByName(others).groupBy("cluster", "x", "y").applyInArrow(_compare(threshold), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: float = 0.8) -> DataFrame:
    """id, n_shingles, component_id for every row of docs; links are pairs with a Jaccard similarity of at least the threshold."""
    bounded_batches(docs.sparkSession)
    all_rows = materialise(sketches(docs, id_col, text_col, k), "near-sketches")
    named = all_rows.where(F.col("id").isNotNull() & F.col("key").isNotNull())
    leads = named.groupBy("key").agg(F.min("id").alias("lead"))
    classes = materialise(named.alias("s").join(leads.withColumnRenamed("lead", "id"), ["key", "id"]).select("id", "n", "regs", *BITS).distinct(), "near-classes")
    member = materialise(named.select("id", "key").distinct().join(leads, "key").select("id", "lead"), "near-members")
    bands = classes.select("id", "regs").mapInArrow(tidy(_bands), "bucket long, id long")
    buckets = materialise(bands.groupBy("bucket").agg(F.count("*").alias("size"), F.min("id").alias("first")).where("size > 1"), "near-buckets")
    near = materialise(bands.join(buckets, "bucket"), "near-shared")
    one, two = (classes.select(F.col("id").alias(x), *[F.col(c).alias(f"{c}{x}") for c in ("n", *BITS)]) for x in "ab")
    stars = near.where("first <> id").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct().join(two, "b").alias("s").join(one.alias("t"), (F.col("s.a") == F.col("t.a")) & may_link(threshold)).select("s.a", "b")
    stars = materialise(stars, "near-stars")
    links = confirmed(stars, classes, docs, id_col, text_col, k, threshold)
    # Rows of one id in several classes link these.
    links = links.unionByName(member.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).join(classes.select(F.col("id").alias("b")).distinct(), "b", "left_semi").select("a", "b"))
    links = links.unionByName(member.groupBy("id").agg(F.min("lead").alias("a"), F.max("lead").alias("b")).where("a <> b").select("a", "b"))
    comps = components(links)
    inner, tried = near.where("size > 2").select("bucket", "id", "first"), stars
    for turn in range(STARS):
        # Members of a bucket that are in different components. The bucket's first is known to link none of the others.
        placed = inner.join(comps, "id", "left").select("bucket", "id", "first", F.coalesce("comp", "id").alias("comp"))
        mixed = placed.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.min_by("id", F.xxhash64("id", F.lit(turn))).alias("star")).where("x <> y").select("bucket", "star")
        rest = materialise(placed.join(small(materialise(mixed, "near-mixed-buckets")), "bucket").where("first <> id").join(classes.select("id", "n", *BITS), "id"), "near-rest")
        inner = rest.select("bucket", "id", "first")
        pairs = materialise(bucket_pairs(small(rest.where(F.col("id") == F.col("star")), BROADCAST_ROWS), rest, threshold).distinct(), "near-pairs")
        tried = tried.unionByName(pairs)
        comps = merged(comps, confirmed(pairs, classes, docs, id_col, text_col, k, threshold))
    clusters = components(tried)
    # components() leaves the smallest id of each out.
    clusters = clusters.unionByName(clusters.select(F.col("comp").alias("id"), "comp").distinct())
    comps = merged(comps, materialise(within_clusters(clusters, comps, classes, docs, id_col, text_col, k, threshold), "near-found"))
    placed = inner.join(comps, "id", "left").join(clusters.select("id", F.col("comp").alias("cluster")), "id", "left").select("bucket", "id", F.coalesce("comp", "id").alias("comp"), F.coalesce("cluster", "id").alias("cluster"))
    mixed = placed.groupBy("bucket").agg(F.min("cluster").alias("x"), F.max("cluster").alias("y")).where("x <> y").select("bucket")
    rest = materialise(placed.join(small(materialise(mixed, "near-mixed-buckets")), "bucket", "left_semi").join(classes.select("id", "n", *BITS), "id"), "near-rest")
    pairs = materialise(bucket_pairs(rest, rest, threshold, (F.col("ida") < F.col("idb")) & (F.col("clustera") != F.col("clusterb"))).distinct(), "near-pairs")
    if not pairs.isEmpty():
        comps = merged(comps, confirmed(pairs, classes, docs, id_col, text_col, k, threshold))
    labels = member.groupBy("id").agg(F.min("lead").alias("lead")).join(comps.select(F.col("id").alias("lead"), "comp"), "lead", "left").select("id", F.coalesce("comp", "lead").alias("component_id"))
    return all_rows.select("id", F.col("n").alias("n_shingles")).join(labels, "id", "left").select("id", "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
