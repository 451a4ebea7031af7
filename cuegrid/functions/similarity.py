"""Similarity of two texts, for Arrow functions over candidate pairs only."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from cuegrid.functions.text import BIG_KANA, SMALL_KANA

_KANA = str.maketrans(SMALL_KANA, BIG_KANA)
#: Characters between two looks at whether a comparison is decided.
STEP = 256


def ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def alike(a: str, b: str, least: float) -> bool:
    """Is the ratio ``least`` or more; its cheap upper bounds come first."""
    m = SequenceMatcher(None, a, b)
    return m.real_quick_ratio() >= least and m.quick_ratio() >= least and m.ratio() >= least


def compare_key(t: str) -> str:
    return re.sub(r"\.{2,}", "...", unicodedata.normalize("NFKC", t)).translate(_KANA)


def has_subsequence(a: str, b: str, least: int) -> bool:
    """Have a and b a common subsequence of ``least`` characters, with a bit for every character of a.

    Texts of any length are compared; what opens or ends both is in it, and only characters of both can be.
    """
    for ends in (False, True):
        pairs = zip(reversed(a), reversed(b)) if ends else zip(a, b)
        k = next((i for i, (x, y) in enumerate(pairs) if x != y), min(len(a), len(b)))
        a, b = (a[: len(a) - k], b[: len(b) - k]) if ends else (a[k:], b[k:])
        least -= k
    both = Counter(a) & Counter(b)
    if least <= 0 or both.total() < least:
        return least <= 0
    a, b = ("".join(c for c in t if c in both) for t in (a, b))
    bits = {c: bytearray(len(a) // 8 + 1) for c in both}
    for i, c in enumerate(a):
        bits[c][i >> 3] |= 1 << (i & 7)
    where = {c: int.from_bytes(x, "little") for c, x in bits.items()}
    free = everything = (1 << len(a)) - 1
    for at in range(0, len(b), STEP):
        for c in b[at : at + STEP]:
            met = free & where[c]
            free = ((free + met) | (free - met)) & everything
        found = len(a) - free.bit_count()
        if found >= least:
            return True
        if found + len(b) - at - STEP < least:
            return False
    return False


def prefix_like(short: str, long: str) -> bool:
    """short nearly opens long: 4 characters or more, a fifth of them off at most, 4 equal in a row."""
    n = len(short)
    if n < 4 or len(long) < n:
        return False
    same = "".join("=" if x == y else "." for x, y in zip(short, long))
    return same.count(".") <= max(1, int(n * 0.2)) and "====" in same


def subsequence_like(short: str, long: str) -> bool:
    n = len(short)
    return n >= 3 and len(long) >= n and has_subsequence(short, long, n - int(n * 0.15))


def related(a: str, b: str) -> bool:
    """The costly tests of neighbouring cues a and b, both trimmed and not empty."""
    x, y = compare_key(a), compare_key(b)
    short, long = (x, y) if len(a) <= len(b) else (y, x)
    return prefix_like(short, long) or (len(a) <= len(b) and subsequence_like(x, y))


def typing_partial(short: str, long: str) -> bool:
    if not short or len(short) >= len(long):
        return False
    if len(short) <= 2:
        return long.startswith(short) or short[0] == long[0]
    return long.startswith(short) or alike(short, long[: len(short)], 0.7)


@F.pandas_udf(BooleanType())
def similar(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    """Is the sequence ratio of a and b ``least`` or more; null texts are like nothing."""
    return pd.Series([x is not None and y is not None and alike(x, y, t) for x, y, t in zip(a, b, least)], dtype="bool")


@F.pandas_udf(BooleanType())
def is_typing_partial(short: pd.Series, long: pd.Series) -> pd.Series:
    """Is short a text caught while long was being typed."""
    return pd.Series([bool(x and y) and typing_partial(x, y) for x, y in zip(short, long)], dtype="bool")


@F.pandas_udf(StringType())
def likeness(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    """By which of the costly tests a and b are alike: ratio or related; else null."""
    return pd.Series(["ratio" if alike(x, y, t) else "related" if related(x, y) else None for x, y, t in zip(a, b, least)], dtype="object")


@F.pandas_udf(BooleanType())
def related_to(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([related(x, y) for x, y in zip(a, b)], dtype="bool")
