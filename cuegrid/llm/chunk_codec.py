"""Token ids by the tokenizers library, with a bounded memory of chunks met before.

A place between a character that is not blank and a space always ends a match of the
byte-level split pattern, so a text may be cut before such spaces and the ids of its chunks
joined. Words repeat, so most chunks have been encoded before. A new chunk is encoded from the
ranks of the same vocabulary, which gives the same ids for ordinary text in half the time;
chunks that hold a special token go through the tokenizer itself.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

from cuegrid.llm.bpe import encoding

#: Chunks remembered in a Python worker; beyond it the memory starts anew.
MEMORY = 600_000
#: Longer chunks are not remembered.
LONG = 200
_BLANK_BEFORE_SPACE = re.compile(r"\s ")
_SAFE_SPACE = re.compile(r"(?<=[!-~À-ɏ]) ")


class ChunkCodec:
    def __init__(self, path: str, ranks_path: str, memory: int = MEMORY):
        self.tokenizer = Tokenizer.from_file(path)
        self.ordinary = encoding(ranks_path).encode_ordinary
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        self.memory = memory
        self.known: dict[str, bytes] = {}

    def _ids(self, chunk: str) -> bytes:
        if self.special.search(chunk):
            return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        ids = array("I", self.ordinary(chunk))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        if len(self.known) > self.memory:
            self.known = {}
        known = self.known
        cut, fresh, first = [], set(), []
        for t in texts:
            parts = _SAFE_SPACE.split(t) if _BLANK_BEFORE_SPACE.search(t) else t.split(" ")
            first.append(parts[0])
            cut.append(parts)
            fresh.update(parts)
            parts[0] = None
        fresh.difference_update(known)
        fresh.discard(None)
        for c in fresh:
            known[c] = self._ids(" " + c)
        out = [self._ids(head) + b"".join([known[p] for p in parts[1:]]) for head, parts in zip(first, cut)]
        for c in fresh:
            if len(c) > LONG:
                del known[c]
        return out


@lru_cache(maxsize=2)
def codec(path: str, ranks_path: str) -> ChunkCodec:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker on every core
    return ChunkCodec(path, ranks_path)
