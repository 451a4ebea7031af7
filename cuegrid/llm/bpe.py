"""Operator 1: byte-level BPE encoding and decoding with the tiktoken library.

Null text counts as empty and gives no ids. Long texts are cut before the library sees them,
at places where the split pattern always ends a match, so the ids are those of the whole text.
Repeated rows are encoded each, null ids like others; an empty table gives no rows. Other columns are
not read, whatever their names.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from cuegrid.llm.common import slices, texts

MULTI_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Texts are cut into pieces of about this many characters.
PIECE_CHARS = 32_768
#: No match of the pattern holds a letter or a digit followed by a character of another class,
#: nor one that is not blank followed by a blank; a match always ends there. Matches look ahead
#: only past blanks, and a piece never ends in a blank.
SAFE_END = regex.compile(r"(?<=\p{L})(?!\p{L})|(?<=\p{N})(?!\p{N})|(?<=[!-~])(?=[ \n])")


@lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str = public_tokenizers.PATTERN) -> tiktoken.Encoding:
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """``text`` cut at the first safe boundary after every ``size`` characters."""
    start = 0
    while len(text) - start > size:
        m = SAFE_END.search(text, start + size)
        if m is None or m.start() >= len(text):
            break
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


def encode_text(enc: tiktoken.Encoding, text: str, size: int = PIECE_CHARS) -> list[int]:
    if len(text) <= size:
        return enc.encode_ordinary(text)
    return [i for p in pieces(text, size) for i in enc.encode_ordinary(p)]


def encode(docs: DataFrame, ranks_path: str = MULTI_RANKS, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """doc_id, ids: the token ids of each whole text, without special tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_path)
        for b in slices(batches):
            ids = pa.array((encode_text(enc, t.as_py(), piece_chars) for t in b["text"]), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b["doc_id"], ids], names=["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts(docs).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str = MULTI_RANKS) -> DataFrame:
    """doc_id, ids, bytes: the raw bytes of the ids, whether or not they are valid UTF-8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_path)
        for b in slices(batches):
            ids = b["ids"]
            out = pa.array((enc.decode_bytes(row.values.to_numpy().tolist()) if row.is_valid else None for row in ids), pa.binary())
            yield pa.RecordBatch.from_arrays([b["doc_id"], ids, out], names=["doc_id", "ids", "bytes"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids array<int>, bytes binary")
