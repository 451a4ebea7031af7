"""Many words in texts at once: automata over slices of a word list, each small enough to broadcast.

An automaton reads a text once, however many words there are. A list of more than ``MOST_WORDS`` is
cut into slices of so many in the order of rank; every slice reads the texts by itself, and what
the slices find is put together. So no list is held whole anywhere, and no text is cut into pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

MOST_WORDS = 500_000


@lru_cache(maxsize=4)
def _automaton(words: tuple[str, ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for k, w in enumerate(words):
        found.add_word(w, k)
    if words:
        found.make_automaton()
    return found


class Words:
    """A slice of a word list, in order of rank, broadcast to the tasks. Ranks within it are places."""

    def __init__(self, spark: SparkSession, words: tuple[str, ...]):
        self.shared = spark.sparkContext.broadcast(words)

    def udf(self, of: Callable[[Iterator[tuple[int, int, str]]], object], kind: DataType | str):
        """An Arrow function of texts: ``of`` gets (rank, end, word) of every place where a word ends."""
        shared = self.shared

        @F.pandas_udf(kind)
        def run(texts: pd.Series) -> pd.Series:
            hits = finder(shared.value)
            return pd.Series([of(hits(t)) for t in texts], dtype="object")

        return run


def finder(words: tuple[str, ...]) -> Callable[[str | None], Iterator[tuple[int, int, str]]]:
    """Of a text, (rank, end, word) of every place where a word ends. To be made once a batch: looking
    up the automaton reads the whole list."""
    found = _automaton(words)
    return lambda text: ((k, end, words[k]) for end, k in found.iter(text)) if words and text else iter(())


def hits_of(text: str | None, words: tuple[str, ...]) -> Iterator[tuple[int, int, str]]:
    return finder(words)(text)


def in_slices(rows: DataFrame, order: list[str], most: int | None = None) -> Iterator[list[Row]]:
    """The rows in the order of columns that identify them, as many at a time as may be on the driver; at least one list."""
    most = MOST_WORDS if most is None else most
    key = F.struct(*order)
    part = rows.orderBy(*order).limit(most).collect()
    yield part
    while len(part) == most:
        last = F.struct(*[F.lit(part[-1][c]).cast(rows.schema[c].dataType).alias(c) for c in order])
        part = rows.filter(key > last).orderBy(*order).limit(most).collect()
        if part:
            yield part


def word_slices(rows: DataFrame, column: str, rank: str | None = None) -> Iterator[Words]:
    """The words of a column in slices, the least rank first."""
    listed = rows.filter(F.col(column) != "").groupBy(F.col(column).alias("word")).agg(F.min(rank if rank else column).alias("rank"))
    for part in in_slices(listed, ["rank", "word"]):
        yield Words(rows.sparkSession, tuple(r.word for r in part))


def substitution(spark: SparkSession, terms: list[tuple[str, str]]):
    """An Arrow function that replaces the terms of a slice one after the other, wrapped in brackets.

    Only the terms that a text holds are tried. Brackets part what was replaced from the rest, so
    no others can match later but those that hold a bracket or stand in a replacement.
    """
    shared = spark.sparkContext.broadcast((tuple(t for t, _ in terms), tuple(r or "" for _, r in terms)))

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        words, new = shared.value
        found = _automaton(words)
        later = _later(words, new)

        def one(text: str | None) -> str | None:
            if text and words:
                for k in sorted({k for _, k in found.iter(text)} | later):
                    text = text.replace(words[k], f"⟦{new[k]}⟧")
            return text

        return texts.map(one)

    return run


@lru_cache(maxsize=4)
def _later(words: tuple[str, ...], new: tuple[str, ...]) -> frozenset[int]:
    found = _automaton(words)
    return frozenset(k for k, w in enumerate(words) if "⟦" in w or "⟧" in w) | frozenset(k for r in set(new) if words for _, k in found.iter(r))


def any_hit(hits: Iterator[tuple[int, int, str]]) -> bool:
    return next(hits, None) is not None


def best_hit(hits: Iterator[tuple[int, int, str]]) -> str | None:
    """The word of least rank."""
    return min(hits, default=(0, 0, None))[2]


def longest_at(hits: Iterator[tuple[int, int, str]]) -> list[tuple[int, str]]:
    """Places in order, and the longest word at each."""
    at: dict[int, str] = {}
    for _, end, word in hits:
        start = end + 1 - len(word)
        if len(word) > len(at.get(start, "")):
            at[start] = word
    return sorted(at.items())


def uncovered(hits: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """Of the hits in order, those that do not begin inside an earlier one that stays."""
    out, free = [], 0
    for start, word in hits:
        if start >= free:
            out.append((start, word))
            free = start + len(word)
    return out


def longest_hits(hits: Iterator[tuple[int, int, str]]) -> list[tuple[int, str]]:
    """The longest word at each place, without those that begin inside an earlier one."""
    return uncovered(longest_at(hits))
