"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are split before they are encoded, only where the pattern cannot match across: before a single space that stands between
two characters other than white space. Long runs of white space, on which the library's pattern engine runs out of stack, are cut out and
encoded as the piece that the pattern makes of them. Both hold for the pattern PATTERN; by any other, texts go to the library whole, in its limits.

Results for odd input: null text counts as empty; an empty text has no ids and decodes to no bytes; repeated rows and null ids of documents
are kept as they are; columns of the input other than the text stay, and a clash with `token_ids` or `decoded` is resolved by replacing
the input's column. An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import bounded_batches, tidy

# Fixed value: the pattern of public byte-level vocabularies that texts are cut by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a text from which it is split, and the least white space that is handled apart.
SPLIT_CHARS, LONG_SPACE = 1 << 16, 256
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
BOUNDARY = re.compile(f"(?<=[^{SPACE}]) (?=[^{SPACE}])")
LONG_RUN = re.compile(f"[{SPACE}]{{{LONG_SPACE},}}")
#: Bytes of text after which a batch is handed on.
BATCH_BYTES = 4 << 20


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def piece_encoding(rank_file: str):
    """Encodes a text as one piece."""
    return encoding(rank_file, r"[\s\S]+")


def split_safely(text: str, size: int = SPLIT_CHARS) -> Iterator[str]:
    at = 0
    while len(text) - at > size:
        if not (m := BOUNDARY.search(text, at + size)):
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def encode(enc, text: str, pieces=None) -> list[int]:
    """The ids that enc.encode_ordinary(text) gives, for texts of any length if enc's pattern is PATTERN and `pieces` encodes a text as one piece."""
    if len(text) <= LONG_SPACE or pieces is None:
        return enc.encode_ordinary(text)
    out: list[int] = []
    for part in split_safely(text):
        at = 0
        for m in LONG_RUN.finditer(part):
            # The pattern leaves the last character of a run to what follows it.
            end = m.end() if m.end() == len(part) else m.end() - 1
            out += enc.encode_ordinary(part[at : m.start()])
            out += pieces.encode_ordinary(part[m.start() : end])
            at = end
        out += enc.encode_ordinary(part[at:])
    return out


def encode_decode(df: DataFrame, text_col: str, rank_file: str, pattern: str) -> DataFrame:
    """Adds token_ids array<int> and decoded binary, the bytes that the ids stand for."""
    bounded_batches(df.sparkSession)
    kept = [c for c in df.columns if c not in ("token_ids", "decoded")]
    src = df.select(*kept)
    schema = T.StructType([f for f in src.schema.fields if f.name != text_col] + [T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])
    others = [c for c in kept if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, pieces = encoding(rank_file, pattern), piece_encoding(rank_file) if pattern == PATTERN else None
        for batch in batches:
            texts, start, size, ids, raw = batch.column(batch.schema.get_field_index(text_col)), 0, 0, [], []
            rest = batch.select(others)
            for k in range(batch.num_rows):
                text = texts[k].as_py() or ""
                ids.append(encode(enc, text, pieces))
                raw.append(enc.decode_bytes(ids[-1]))
                size += len(text)
                if size >= BATCH_BYTES or k == batch.num_rows - 1:
                    arrays = [*rest.slice(start, k + 1 - start).columns, pa.array(ids, pa.list_(pa.int32())), pa.array(raw, pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, names=[*others, "token_ids", "decoded"])
                    start, size, ids, raw = k + 1, 0, [], []

    return src.mapInArrow(tidy(run), schema)
