"""Removal of repeated passages by suffix arrays.

Every byte of a document is removed that a string of `length` bytes covers which also starts in a document with a smaller id.

The suffix array is built by linear grouping: suffixes are grouped by Lyndon prefixes, groups are processed in descending order while
previous-smaller pointers are set, and each group's order is then emitted by following those pointers, without renaming symbols
in a recursion.

To spread the work, each window of `length` bytes is keyed by its minimiser, the least hash of its ANCHOR-byte pieces; equal windows have equal
minimisers. A run of windows with one minimiser is a string of its own. First the minimisers alone (32 bits of each in its bucket) are exchanged, to find those of several
documents; then, for these, digests of their strings with the smallest document each is in, and digests of what stands to the left and
to the right of the minimiser: two strings that have a window in common agree on one side at least. Strings that agree with no other are
in no order to be found: their windows belong to their smallest document. The others, as at the ends of a passage, are exchanged
themselves, each side for itself, with the piece on which they agree as one symbol: those with one piece are put behind one another, their
suffixes are sorted, and neighbours that agree in `length` bytes form a group, whose smallest document is the answer for all its windows. Answers go back to the parts that hold the string, not to each document, so a
passage in a third of all documents costs a bucket one row a part. A minimiser of over HOT documents, such as of a short line that many share
in different surroundings, has its windows spread over buckets by their content, each window a string of its own.

Results for odd input: a null text counts as empty; texts shorter than `length` are kept; rows with a null id neither lose bytes nor make others
lose some; rows that repeat an id are one document and don't take from each other; long runs of windows with one minimiser are cut;
other columns stay, clashing ones (`n_bytes`, `spans`, `kept`) are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import gc
import pickle
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, release_memory, tidy

#: Bytes of a repeated string, of a minimiser's pieces, of text in a part; windows of a string at most; documents that make a key hot.
LENGTH, ANCHOR, PART_BYTES, RUN, HOT = 50, 16, 4 << 20, 4096, 20_000
#: Instead of digests to the left and right, where these are not known; and which side of strings agrees with another.
UNKNOWN, ON_LEFT, ON_RIGHT, IN_DOUBT = 0, 1, 2, 4
#: Where a string has no piece that is one symbol: it is whole, or a window of a hot minimiser. The symbol, over those of bytes.
WHOLE, WINDOW, PIECE = -1, -2, 258
#: Symbols of small groups that are sorted together, and of those that are sorted in compact arrays; windows that are compared at once.
TOGETHER, COMPACT, ROWS = 1 << 15, 1 << 17, 1 << 13
#: Bytes of texts that are looked at together, and of a section of a long text.
SECTION = 1 << 18


def suffix_array(symbols: Sequence[int]) -> Sequence[int]:
    """Start positions of the suffixes in ascending order. Symbols are positive integers."""
    s = [*symbols, 0]
    n = len(s)
    many = (lambda x: array("i", x)) if n > COMPACT else list  # lists are faster, but take five times the memory
    at = many(sorted(range(n), key=s.__getitem__))  # suffixes by group; a group is a range, known by its start
    place, group, size, before = (many([x]) * n for x in (0, 0, 0, -1))
    start = 0
    for k, p in enumerate(at):
        if k and s[p] != s[at[k - 1]]:
            start = k
        place[p], group[p] = k, start
        size[start] += 1
    end = n - 1
    while end >= 0:
        g = group[at[end]]
        if g == end:  # a group of one suffix: at most one other leaves its group
            p = at[g]
            j = p - 1
            while j >= 0 and group[j] >= g:
                j = before[j]
            before[p] = j
            end = g - 1
            if j >= 0 and (m := size[h := group[j]]) > 1:
                to, k = h + m - 1, place[j]
                other = at[to]
                at[k], at[to], place[other], place[j] = other, j, k, to
                size[h], size[to], group[j] = m - 1, 1, to
            continue
        times: dict[int, int] = {}
        for p in sorted(at[g : end + 1]):
            j = p - 1
            while j >= 0 and group[j] >= g:
                j = before[j]
            before[p] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        end = g - 1
        if not times:
            continue
        levels: dict[int, list[int]] = {}
        for j, c in times.items():
            levels.setdefault(c, []).append(j)
        for c in sorted(levels, reverse=True):
            # These suffixes continue with c times the group's prefix: they leave their groups for new ones right behind.
            moved: dict[int, int] = {}
            for j in levels[c]:
                h = group[j]
                moved[h] = m = moved.get(h, 0) + 1
                to, k = h + size[h] - m, place[j]
                other = at[to]
                at[k], at[to], place[other], place[j] = other, j, k, to
            for h, m in moved.items():
                size[h] -= m
                new = h + size[h]
                size[new] = m
                if new != h:
                    for k in range(new, new + m):
                        group[at[k]] = new
    del place, size, at
    out, done, free = many([0]) * n, bytearray(n), many(range(n))
    out[0] = n - 1
    for i in range(n):
        p = out[i] - 1
        while p >= 0 and not done[p]:
            g = group[p]
            out[free[g]] = p
            free[g] += 1
            done[p] = 1
            p = before[p]
    return out[1:]


def repeated_windows(strings: list[np.ndarray], owners: list[int], length: int) -> list[np.ndarray]:
    """For each string of symbols over 1, the smallest owner of each of its windows of `length` symbols, over all strings."""
    if len(strings) == 1:
        return [np.full(len(strings[0]) - length + 1, owners[0], np.int64)]
    starts = np.cumsum([0] + [len(x) + 1 for x in strings[:-1]])
    symbols = np.ones(starts[-1] + len(strings[-1]), np.int32)  # 1 stands between strings, less than every symbol
    owner, whole = np.zeros(len(symbols), np.int64), np.zeros(len(symbols), bool)
    for a, x, d in zip(starts.tolist(), strings, owners, strict=True):
        symbols[a : a + len(x)] = x
        owner[a : a + len(x) - length + 1] = d
        whole[a : a + len(x) - length + 1] = True
    order = np.array(suffix_array(symbols.tolist()))
    order = order[whole[order]]  # suffixes that are a window of one string; equal windows are neighbours
    windows, new = np.lib.stride_tricks.sliding_window_view(symbols, length), np.ones(len(order), bool)
    for a in range(1, len(order), ROWS):  # in blocks, as a copy of all windows is as long as all symbols `length` times
        b = min(len(order), a + ROWS)
        new[a:b] = (windows[order[a:b]] != windows[order[a - 1 : b - 1]]).any(axis=1)
    first = np.flatnonzero(new)
    least = np.minimum.reduceat(owner[order], first)
    owner[order] = np.repeat(least, np.diff(np.append(first, len(order))))
    return [owner[a : a + len(x) - length + 1] for a, x in zip(starts.tolist(), strings, strict=True)]


def window_keys(raw: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each ANCHOR-byte piece of the text, and the least of each window, its minimiser."""
    n = len(raw) - ANCHOR + 1
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,)).copy()
    h = eight[:n] * np.uint64(0x9E3779B97F4A7C15) ^ (eight[8 : 8 + n] * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(7))
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    pieces, span, have = h, length - ANCHOR + 1, 1
    while have < span:  # running minimum over span pieces, by doubling
        step = min(have, span - have)
        h = np.minimum(h[:-step], h[step:])
        have += step
    return pieces, h


def short_keys(keys: np.ndarray, buckets: int) -> np.ndarray:
    """A minimiser's bucket, and 32 bits of the rest: two minimisers of one bucket that share them only make work."""
    return (keys % np.uint64(buckets)) << np.uint64(32) | (keys // np.uint64(buckets)) & np.uint64(0xFFFFFFFF)


def _in_bucket(keys: np.ndarray) -> np.ndarray:
    """What a bucket is sent of its short keys."""
    return (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _changes(x: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before it."""
    return np.concatenate([np.ones(min(1, len(x)), bool), x[1:] != x[:-1]])


def _places(pieces: np.ndarray, keys: np.ndarray, start: np.ndarray, end: np.ndarray, length: int) -> np.ndarray:
    """Where the one piece stands that is the minimiser of a run of windows; -1 if there are several."""
    span = length - ANCHOR + 1
    wide = np.lib.stride_tricks.sliding_window_view(np.concatenate([pieces, np.zeros(2 * span, np.uint64)]), 2 * span)
    out = np.empty(len(start), np.int64)
    for a in range(0, len(start), ROWS):
        k = slice(a, a + ROWS)
        hit = (wide[start[k]] == keys[k, None]) & (np.arange(2 * span) < (end[k] + span - 1 - start[k])[:, None])
        # One piece is in `span` windows, so longer runs have several.
        out[k] = np.where((hit.sum(axis=1) == 1) & (end[k] - start[k] <= span), start[k] + hit.argmax(axis=1), -1)
    return out


def _fold(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    h = (h ^ x) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(29))


def digests(pieces: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit digests of the strings from start to stop, from the hashes of pieces that cover them."""
    h = _fold(np.full(len(start), 0xA0761D6478BD642F, np.uint64), (stop - start).astype(np.uint64))
    last, own, at = stop - ANCHOR, np.arange(len(start)), start
    while (more := at < last[own]).any():
        own, at = own[more], at[more]
        h[own] = _fold(h[own], pieces[at])
        at = at + ANCHOR
    return _fold(h, pieces[last])


def found_at(known: np.ndarray, known_keys: np.ndarray, digest: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where in the known strings, sorted by digest, the one with this digest and minimiser is; -1 if it is unknown."""
    if not len(known):
        return np.full(len(digest), -1)
    at = np.searchsorted(known, digest)
    while True:
        here = np.minimum(at, len(known) - 1)
        same = (at < len(known)) & (known[here] == digest)
        other = same & (known_keys[here] != key)
        if not other.any():
            return np.where(same, here, -1)
        at = at + other


def _narrow(x: np.ndarray) -> np.ndarray:
    """In fewer bytes, if the values allow it."""
    for kind in (np.int8, np.int16, np.int32):
        if len(x) and x.min() >= np.iinfo(kind).min and x.max() <= np.iinfo(kind).max:
            return x.astype(kind)
    return x


def joined(*columns: np.ndarray) -> bytes:
    """Arrays as bytes, with five more for each: there are many blobs in a large table, and few values in each."""
    return b"".join(y for x in columns for y in (x.dtype.char.encode(), len(x).to_bytes(4, "little"), x.tobytes()))


def arrays(blob: bytes) -> list[np.ndarray]:
    """What joined() was given."""
    at, out = 0, []
    while at < len(blob):
        out.append(np.frombuffer(blob, chr(blob[at]), int.from_bytes(blob[at + 1 : at + 5], "little"), at + 5))
        at += 5 + out[-1].nbytes
    return out


#: The first byte of what is pickled; that of joined arrays is a letter or a question mark.
PICKLED, NOTHING = 0x80, np.zeros(0, np.uint8)


def _quick(run, *tables: pa.Table) -> pa.Table:
    """Runs what makes many small objects, and no cycles of them, without the collector of cycles."""
    gc.disable()
    try:
        return run(*tables)
    finally:
        gc.enable()
        release_memory()


def runs(keys: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of valid windows with one key, RUN windows at most."""
    differ = keys[1:] != keys[:-1]
    new, last = valid.copy(), valid.copy()
    new[1:] &= differ | ~valid[:-1]
    last[:-1] &= differ | ~valid[1:]
    start, end = np.flatnonzero(new), np.flatnonzero(last) + 1
    if (end - start).max(initial=0) > RUN:
        cuts = [(a, b) for x, y in zip(start.tolist(), end.tolist(), strict=True) for a in range(x, y, RUN) for b in [min(a + RUN, y)]]
        start, end = np.array([c[0] for c in cuts]), np.array([c[1] for c in cuts])
    return start, end


class Sections:
    """Texts that are looked at together, end to end, long ones in overlapping sections of which each window is in one."""

    def __init__(self, parts: list[tuple[int, int, int, bytes]], length: int):
        """parts: row, id, offset in its text, bytes."""
        self.raw = b"".join(x[3] for x in parts)
        self.row, self.owner, self.base = (np.array([x[k] for x in parts], np.int64) for k in range(3))
        sizes = np.array([len(x[3]) for x in parts])
        self.start = np.cumsum(sizes) - sizes
        self.pieces, self.keys = window_keys(self.raw, length)
        edges = np.zeros(len(self.raw) + 1, np.int64)  # the windows across the end of a section are none
        edges[self.start + sizes - length + 1] += 1
        edges[self.start + sizes] -= 1
        self.valid = np.cumsum(edges)[: len(self.keys)] == 0

    def of(self, start: np.ndarray) -> np.ndarray:
        """The section of each place."""
        return np.searchsorted(self.start, start, "right") - 1


def _packed_texts(text_col: str):
    """Replaces texts by their compressed bytes, null by those of an empty text: each is exchanged once and read four times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            at = b.schema.get_field_index(text_col)
            texts = b.column(at)
            columns = [*b.columns[:at], pa.array([pack((texts[k].as_py() or "").encode()) for k in range(b.num_rows)], pa.binary()), *b.columns[at + 1 :]]
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return run


def _unpacked(texts: pa.ChunkedArray) -> Iterator[bytes]:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for x in texts:
        yield unpack(x.as_py())


def _sections(table: pa.Table, id_col: str, text_col: str, length: int) -> Iterator[Sections]:
    """The texts that have a window and an id."""
    parts, size = [], 0
    for k, (d, raw) in enumerate(zip(table.column(id_col).to_pylist(), _unpacked(table.column(text_col)), strict=True)):
        if d is None:
            continue
        for at in range(0, len(raw) - length + 1, SECTION):
            parts.append((k, d, at, raw[at : at + SECTION + length - 1]))
            size += len(parts[-1][3])
            if size >= SECTION:
                yield Sections(parts, length)
                parts, size = [], 0
    if parts:
        yield Sections(parts, length)


def _by_bucket(keys: np.ndarray, buckets: int):
    """(bucket, places of its keys)."""
    at = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    edges = np.flatnonzero(_changes(at[order]))
    for a, b in zip(edges, np.append(edges[1:], len(at)), strict=False):
        yield int(at[order[a]]), order[a:b]


def whole(text: bytes, spans: list[list[int]]) -> list[list[int]]:
    """The spans without characters that they hold a part of only."""
    inside = lambda k: k < len(text) and text[k] & 0xC0 == 0x80
    out = []
    for a, b in spans:
        while a < b and inside(a):
            a += 1
        while b > a and inside(b):
            b -= 1
        if a < b:
            out.append([a, b])
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, part_bytes: int = PART_BYTES, hot: int = HOT, whole_characters: bool = False) -> DataFrame:
    """Replaces the text by n_bytes long, spans array<struct<start, end>> (maximal removed runs of bytes) and kept binary.

    whole_characters: characters that are removed in part only are kept, so that what is kept is text.
    """
    bounded_batches(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = max(12, -(-total // part_bytes))
    others = [c for c in docs.columns if c not in (text_col, "n_bytes", "spans", "kept", "_part")]
    kept_types = [docs.schema[c] for c in others]
    parted = docs.select(*others, text_col).withColumn("_part", F.pmod(F.xxhash64(F.col(id_col), F.when(F.col(id_col).isNull(), F.xxhash64(text_col))), F.lit(parts)).cast("int"))
    stored = T.StructType([T.StructField(f.name, T.BinaryType() if f.name == text_col else f.dataType) for f in parted.schema.fields])
    grouped = parted.mapInArrow(tidy(_packed_texts(text_col)), stored).groupBy("_part")

    def packed(name: str, rows: list[tuple[int, bytes]], **fixed: int) -> pa.Table:
        own = {k: pa.array([v] * len(rows), pa.int32()) for k, v in fixed.items()}
        return pa.table({name: pa.array([r[0] for r in rows], pa.int32()), **own, "blob": pa.array([r[1] for r in rows], pa.binary())})

    def split(number: np.ndarray, *columns: np.ndarray) -> list[tuple[int, tuple]]:
        return [(n, tuple(c[at] for c in columns)) for n, at in _by_bucket(number, parts)]

    def sent(number: np.ndarray, *columns: np.ndarray) -> list[tuple[int, bytes]]:
        return [(n, joined(*x)) for n, x in split(number, *columns)]

    def own_keys(table: pa.Table) -> pa.Table:
        """The part's minimisers and in how many of its texts each is."""
        if not table.num_rows:
            return packed("bucket", [], part=0)
        keys, part = [np.zeros(0, np.uint64)], table.column("_part")[0].as_py()
        for x in _sections(table, id_col, text_col, length):
            new = x.valid.copy()
            new[1:] &= (x.keys[1:] != x.keys[:-1]) | ~x.valid[:-1]
            at = np.flatnonzero(new)
            key, row = short_keys(x.keys[at], parts), x.row[x.of(at)]
            order = np.lexsort((key, row))  # each text counts a minimiser once
            keys.append(key[order][_changes(key[order]) | _changes(row[order])])
        key, count = np.unique(np.concatenate(keys), return_counts=True)
        return packed("bucket", sent(key >> np.uint64(32), _in_bucket(key), _narrow(count)), part=part)

    def shared_keys(table: pa.Table) -> pa.Table:
        """By part: its minimisers that are in several documents, and those in over `hot`."""
        blobs = [arrays(x) for x in table.column("blob").to_pylist()]
        key, count = (np.concatenate([b[k] for b in blobs]) for k in range(2))
        part = np.repeat(np.asarray(table.column("part")), [len(b[0]) for b in blobs])
        order = np.argsort(key)
        key, count, part = key[order], count[order], part[order]
        first = np.flatnonzero(_changes(key))
        docs_in = np.repeat(np.add.reduceat(count.astype(np.int64), first), np.diff(np.append(first, len(key))))
        own = docs_in > 1
        return packed("_part", [(p, joined(keys[~many], keys[many])) for p, (keys, many) in split(part[own].astype(np.uint64), key[own], docs_in[own] > hot)], bucket=table.column("bucket")[0].as_py())

    def answered(found: pa.Table) -> list[tuple]:
        """Blobs that buckets sent to a part, minimisers with their bucket: two columns of shared_keys(), or six of verdicts() and rows of answers()."""
        out = []
        for bucket, blob in zip(found.column("bucket").to_pylist(), found.column("blob").to_pylist(), strict=True):
            if blob[0] == PICKLED:
                out.append((*[NOTHING] * 6, pickle.loads(blob)))
                continue
            got = arrays(blob)
            widened = (0, 1) if len(got) == 2 else (0, 3)
            told = tuple(x.astype(np.uint64) | np.uint64(bucket << 32) if k in widened else x for k, x in enumerate(got))
            out.append(told if len(got) == 2 else (*told, ()))
        return out

    def shared_runs(table: pa.Table, shared: np.ndarray):
        """Of texts that are looked at together, the runs of windows whose minimiser is shared: (texts, minimisers, short minimisers, starts, ends, sections)."""
        if not len(shared):
            return
        for x in _sections(table, id_col, text_col, length):
            start, end = runs(x.keys, x.valid)
            own = short_keys(x.keys[start], parts)
            at = np.minimum(np.searchsorted(shared, own), len(shared) - 1)
            if (found := np.flatnonzero(shared[at] == own)).size:
                yield x, x.keys[start[found]], own[found], start[found], end[found], x.of(start[found])

    def union(keys: list[np.ndarray]) -> np.ndarray:
        return np.unique(np.concatenate([np.zeros(0, np.uint64), *keys]))

    def by_string(digest: np.ndarray, key: np.ndarray) -> np.ndarray:
        """An order in which equal strings are neighbours."""
        order = np.argsort(digest)
        if ((digest[order][1:] == digest[order][:-1]) & (key[order][1:] != key[order][:-1])).any():
            order = np.lexsort((digest, key))
        return order

    def own_records(table: pa.Table, found: pa.Table) -> pa.Table:
        """Of the part's strings under shared minimisers: minimiser, digest, digests to the left and right, smallest document, whether there are more."""
        if not table.num_rows or not found.num_rows:
            return packed("bucket", [], part=0)
        part, side, records = table.column("_part")[0].as_py(), (length - ANCHOR + 1) // 2, [[np.zeros(0, t)] for t in (np.uint64, np.uint64, np.uint32, np.uint32, np.int64)]
        for x, whole_keys, keys, start, end, section in shared_runs(table, union([b[0] for b in answered(found)])):
            stop = end + length - 1
            digest = digests(x.pieces, start, stop)
            p = _places(x.pieces, whole_keys, start, end, length)
            sides = []
            # Where a window's minimiser stands is not known, it may agree with any other.
            for a, b in ((p - side, p + ANCHOR), (p, p + ANCHOR + side)):
                inside = (p >= 0) & (a >= start) & (b <= stop)
                near = digests(x.pieces, np.where(inside, a, start), np.where(inside, b, stop))
                sides.append(np.where(p < 0, UNKNOWN, near & np.uint64(0xFFFFFFFF)).astype(np.uint32))  # they only save work: half of their bits will do
            for to, got in zip(records, (keys, digest, *sides, x.owner[section]), strict=True):
                to.append(got)
        key, digest, left, right, owner = map(np.concatenate, records)
        order = by_string(digest, key)
        key, digest, left, right, owner = (x[order] for x in (key, digest, left, right, owner))
        first = np.flatnonzero(_changes(digest) | _changes(key))
        least, most = (f.reduceat(owner, first) if len(first) else owner for f in (np.minimum, np.maximum))
        return packed("bucket", sent(key[first] >> np.uint64(32), _in_bucket(key[first]), *(x[first] for x in (digest, left, right)), _narrow(least), most > least), part=part)

    def verdicts(table: pa.Table) -> pa.Table:
        """By part: minimisers, digests and owners of strings that agree with no other; minimisers and digests of those that do."""
        blobs = [arrays(x) for x in table.column("blob").to_pylist()]
        key, digest, left, right, owner, more = (np.concatenate([b[k] for b in blobs]) for k in range(6))
        part = np.repeat(np.asarray(table.column("part")), [len(b[0]) for b in blobs])

        def groups(order: np.ndarray, *by: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            first = np.flatnonzero(np.any([_changes(x[order]) for x in by], axis=0))
            return order, first, np.diff(np.append(first, len(key)))

        def spread(values: np.ndarray, order: np.ndarray, size: np.ndarray) -> np.ndarray:
            out = np.empty(len(key), values.dtype)
            out[order] = np.repeat(values, size)
            return out

        side = np.zeros(len(key), np.uint8)
        for x, mark in ((left, ON_LEFT), (right, ON_RIGHT)):
            order, first, size = groups(np.argsort(key.astype(np.uint64) << np.uint64(32) | x), x, key)
            low, high = np.minimum.reduceat(digest[order], first), np.maximum.reduceat(digest[order], first)
            side[spread(low != high, order, size)] |= mark
        if (left == UNKNOWN).any():
            order, first, size = groups(np.argsort(key), key)
            doubt = np.logical_or.reduceat((left == UNKNOWN)[order], first) & (np.minimum.reduceat(digest[order], first) != np.maximum.reduceat(digest[order], first))
            side[spread(doubt, order, size)] = IN_DOUBT
        order, first, size = groups(by_string(digest, key), digest, key)
        least = spread(np.minimum.reduceat(owner[order], first), order, size)
        # The smallest document with the whole string takes it from the others, whatever else agrees with parts of it. A document is in one part.
        same = more | (owner > least)
        agree = side > 0
        rows: dict[int, list] = {}
        for p, own in split(part[same].astype(np.uint64), key[same], digest[same], _narrow(least[same])):
            rows.setdefault(p, [NOTHING] * 6)[:3] = own
        for p, own in split(part[agree].astype(np.uint64), key[agree], digest[agree], side[agree]):
            rows.setdefault(p, [NOTHING] * 6)[3:6] = own
        return packed("_part", [(p, joined(*x)) for p, x in rows.items()], bucket=table.column("bucket")[0].as_py())

    def own_strings(table: pa.Table, found: pa.Table) -> pa.Table:
        """The part's strings that agree with others, and windows of hot minimisers: minimiser, group, bytes, smallest and largest document."""
        if not table.num_rows or not found.num_rows:
            return packed("bucket", [], part=0)
        part, strings = table.column("_part")[0].as_py(), {}
        blobs = answered(found)
        spread = {k for b in blobs if len(b) == 2 for k in b[1].tolist()}
        told = [b for b in blobs if len(b) == 7]
        wanted_keys, wanted, sides = (np.concatenate([np.zeros(0, t), *(b[k] for b in told)]) for k, t in ((3, np.uint64), (4, np.uint64), (5, np.uint8)))
        order = np.argsort(wanted)
        wanted_keys, wanted, sides = wanted_keys[order], wanted[order], sides[order]
        spread_keys = np.array(sorted(spread), np.uint64)
        keys_of = [b[1] if len(b) == 2 else b[3] for b in blobs]
        half = (length - ANCHOR + 1) // 2

        def keep(key: int, group: int, s: bytes, hole: int, digest: int, at: int, d: int) -> None:
            held = strings.setdefault((key, group, s, hole), {})
            _, lo, hi = held.get(digest, (at, d, d))
            held[digest] = (at, min(lo, d), max(hi, d))

        for x, whole_keys, keys, start, end, section in shared_runs(table, union(keys_of)):
            raw, pieces = x.raw, x.pieces
            digest = digests(pieces, start, end + length - 1)
            at = found_at(wanted, wanted_keys, digest, keys)
            need = np.flatnonzero((at >= 0) | np.isin(keys, spread_keys))
            mark = np.where(at >= 0, sides[np.maximum(at, 0)], 0) if len(sides) else np.zeros(len(at), np.uint8)
            for whole_key, key, digest, side, a, b, d in zip(*(y[need].tolist() for y in (whole_keys, keys, digest, mark, start, end, x.owner[section])), strict=True):
                stop = b + length - 1
                if key in spread:
                    for w in range(a, b):
                        s = raw[w : w + length]
                        h = xxhash.xxh3_64_intdigest(s)
                        keep(key, h, s, WINDOW, h, 0, d)
                    continue
                if side == IN_DOUBT:
                    keep(key, key, raw[a:stop], WHOLE, digest, 0, d)
                elif side:
                    # A window has the minimiser's piece with `half` bytes to its left, or else with as many to its right.
                    p = a + int((pieces[a : stop - ANCHOR + 1] == whole_key).argmax())
                    if side & ON_LEFT and (to := min(b, p - half + 1)) > a:
                        at = p - half
                        keep(key, xxhash.xxh3_64_intdigest(raw[at : p + ANCHOR], ON_LEFT), raw[a:at] + raw[p + ANCHOR : to + length - 1], at - a, digest, 0, d)
                    if side & ON_RIGHT and (at := max(a, p - half + 1)) < b:
                        to = p + ANCHOR + half
                        keep(key, xxhash.xxh3_64_intdigest(raw[p:to], ON_RIGHT), raw[at:p] + raw[to:stop], p - at, digest, at - a, d)
        by: dict[int, list] = {}
        for (key, group, s, hole), held in strings.items():
            by.setdefault(group % parts, []).append((key, group, s, hole, [(k, *v) for k, v in held.items()]))
        return packed("bucket", [(k, pickle.dumps(x, 5)) for k, x in by.items()], part=part)

    def answers(table: pa.Table) -> pa.Table:
        """By part: minimiser, whether it is hot, digest of the string, and spans of its windows with their smallest documents."""
        groups: dict[tuple[int, int, bool], dict[tuple[bytes, int], list]] = {}
        for part, blob in zip(table.column("part").to_pylist(), table.column("blob").to_pylist(), strict=True):
            for key, group, s, hole, held in pickle.loads(blob):
                groups.setdefault((key, group, hole >= 0), {}).setdefault((s, hole), []).extend((part, *x) for x in held)
        # With a piece as one symbol, windows have so many symbols.
        short = length - ANCHOR - (length - ANCHOR + 1) // 2 + 1
        out: dict[int, list] = {}

        def give(key: int, hole: int, held: list, least: np.ndarray) -> None:
            values = least.tolist()
            spans, begun = [], 0
            for k in range(1, len(values) + 1):
                if k == len(values) or values[k] != values[begun]:
                    spans.append((begun, k, values[begun]))
                    begun = k
            for part, digest, at, _, hi in held:
                if own := [(at + x, at + y, n) for x, y, n in spans if n < hi]:
                    out.setdefault(part, []).append((key, hole == WINDOW, digest, own))

        def sort_out(held_of: list, symbols: list, width: int) -> None:
            owners = [min(x[3] for x in held) for _, _, held in held_of]
            for (key, hole, held), least in zip(held_of, repeated_windows(symbols, owners, width), strict=True):
                give(key, hole, held, least)

        batch: tuple[list, list] = ([], [])
        size = 0
        for number, ((key, _, holed), strings) in enumerate(groups.items()):
            own: tuple[list, list] = ([], [])
            for (s, hole), held in strings.items():
                x = np.frombuffer(s, np.uint8).astype(np.int64) + 2
                own[0].append((key, hole, held))
                # Each group's piece is a symbol of its own, so that groups can be sorted together.
                own[1].append(np.concatenate([x[:hole], [PIECE + number], x[hole:]]) if holed else x)
            if not holed or len(own[0]) == 1:
                sort_out(*own, short if holed else length)
                continue
            batch[0].extend(own[0])
            batch[1].extend(own[1])
            size += sum(map(len, own[1]))
            if size >= TOGETHER:
                sort_out(*batch, short)
                batch, size = ([], []), 0
        if batch[0]:
            sort_out(*batch, short)
        return packed("_part", [(p, pickle.dumps(own, 5)) for p, own in out.items()], bucket=0)

    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def removed(table: pa.Table, found: pa.Table) -> pa.Table:
        blobs = answered(found) if table.num_rows else []
        whole_keys, whole_strings, least_of = (np.concatenate([np.zeros(0, t), *(b[k] for b in blobs)]) for k, t in ((0, np.uint64), (1, np.uint64), (2, np.int64)))
        order = np.argsort(whole_strings)
        whole_keys, whole_strings, least_of = whole_keys[order], whole_strings[order], least_of[order]
        sorted_out: dict[tuple[int, int], list] = {}
        spread = set()
        for b in blobs:
            for key, is_hot, digest, own in b[6]:
                sorted_out.setdefault((key, digest), []).extend(own)
                if is_hot:
                    spread.add(key)
        strings_of = np.array(sorted(digest for _, digest in sorted_out), np.uint64)
        spread_keys = np.array(sorted(spread), np.uint64)
        shared = union([whole_keys, np.array([key for key, _ in sorted_out], np.uint64)])
        covers: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(3)]  # rows, starts, ends
        for x, _, keys, start, end, section in shared_runs(table, shared):
            digest, stop, owner = digests(x.pieces, start, end + length - 1), end + length - 1, x.owner[section]
            shift = x.base[section] - x.start[section]
            at = found_at(whole_strings, whole_keys, digest, keys)
            gone = (at >= 0) & (least_of[np.maximum(at, 0)] < owner) if len(least_of) else np.zeros(len(at), bool)
            rest = np.flatnonzero(~gone & (np.isin(digest, strings_of) | np.isin(keys, spread_keys)))
            more: list[list[int]] = [[], [], []]
            for key, digest, a, b, d, row, moved in zip(*(y[rest].tolist() for y in (keys, digest, start, end, owner, x.row[section], shift)), strict=True):
                if key in spread:
                    cut = [(w, w + length) for w in range(a, b) if any(y[2] < d for y in sorted_out.get((key, xxhash.xxh3_64_intdigest(x.raw[w : w + length])), ()))]
                else:
                    cut = [(a + y, a + z + length - 1) for y, z, least in sorted_out.get((key, digest), ()) if least < d]
                more[0] += [row] * len(cut)
                more[1] += [y + moved for y, _ in cut]
                more[2] += [z + moved for _, z in cut]
            for to, got, extra in zip(covers, (x.row[section][gone], (start + shift)[gone], (stop + shift)[gone]), more, strict=True):
                to.append(got)
                to.append(np.array(extra, np.int64))
        row, start, end = map(np.concatenate, covers)
        far = end.max(initial=0) + 2  # rows are set so far apart that spans of different ones do not touch
        order = np.lexsort((start, row))
        start, end = (start + row * far)[order], np.maximum.accumulate((end + row * far)[order])
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(start)), bool), start[1:] > end[:-1]]))
        last = np.append(first[1:] - 1, len(start) - 1) if len(first) else first
        merged_of: dict[int, list[list[int]]] = {}
        for a, b in zip(start[first].tolist(), end[last].tolist(), strict=True):
            merged_of.setdefault(a // far, []).append([a % far, b % far])
        sizes, spans, rest = [], [], []
        for k, raw in enumerate(_unpacked(table.column(text_col))):
            merged = merged_of.get(k, [])
            if whole_characters:
                merged = whole(raw, merged)
            at, pieces = 0, []
            for a, b in merged:
                pieces.append(raw[at:a])
                at = b
            pieces.append(raw[at:])
            sizes.append(len(raw))
            spans.append([{"start": a, "end": b} for a, b in merged])
            rest.append(b"".join(pieces))
        return pa.table([*(table.column(c) for c in others), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(rest, pa.binary())], names=[*others, "n_bytes", "spans", "kept"])

    by_bucket, by_part = "bucket int, part int, blob binary", "_part int, bucket int, blob binary"
    shared = grouped.applyInArrow(own_keys, by_bucket).groupBy("bucket").applyInArrow(shared_keys, by_part)
    told = grouped.cogroup(shared.groupBy("_part")).applyInArrow(lambda t, f: _quick(own_records, t, f), by_bucket).groupBy("bucket").applyInArrow(verdicts, by_part)
    strings = grouped.cogroup(shared.unionByName(told).groupBy("_part")).applyInArrow(lambda t, f: _quick(own_strings, t, f), by_bucket)
    found = told.unionByName(strings.groupBy("bucket").applyInArrow(lambda t: _quick(answers, t), by_part))
    schema = T.StructType([*kept_types, T.StructField("n_bytes", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept", T.BinaryType())])
    return grouped.cogroup(found.groupBy("_part")).applyInArrow(lambda t, f: _quick(removed, t, f), schema)
