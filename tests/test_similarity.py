"""Neighbouring texts by subsequence, whatever their length."""

import random

from cuegrid.functions.similarity import has_subsequence, related, subsequence_like
from cuegrid.operators import cues


def longest(a, b):
    """Length of the longest common subsequence, by the whole table."""
    row = [0] * (len(b) + 1)
    for x in a:
        above, row = row, [0]
        for j, y in enumerate(b):
            row.append(above[j] + 1 if x == y else max(above[j + 1], row[j]))
    return row[-1]


def misread(rng, text, off):
    """A character before, others in place of a share of the rest: too much is shifted for a like beginning."""
    return "~" + "".join(rng.choice("xyz") if rng.random() < off else c for c in text)


def test_subsequences_are_those_of_the_table():
    rng = random.Random(8)
    for k in range(600):
        letters = "abcdeあい。"[: rng.choice([2, 4, 8])]
        a, b = ("".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 3, 9, 30, 60]))) for _ in "ab")
        b = misread(rng, a, 0.1) + rng.choice(["", b]) if k % 3 == 0 else b
        n = longest(a, b)
        for least in (n - 1, n, n + 1, len(a)):
            assert has_subsequence(a, b, least) == (n >= least), (a, b, least)


def test_texts_of_any_length_are_compared():
    rng = random.Random(9)
    for size in (600, 2300):
        a = "".join(rng.choice("abcdefghij") for _ in range(size))
        for off in (0.05, 0.14, 0.16, 0.5):
            b = misread(rng, a, off)
            assert subsequence_like(a, b) == (longest(a, b) >= size - int(size * 0.15)), (size, off)


def test_long_cues_are_joined_as_short_ones_are(spark):
    rng = random.Random(10)
    first = {size: "".join(rng.choice("abcdefghij") for _ in range(size)) for size in (60, 3000, 40_000)}
    then = {size: misread(rng, text, 0.05) for size, text in first.items()}
    texts = [(size, f"1\n00:00:01,000 --> 00:00:02,000\n{first[size]}\n\n2\n00:00:03,000 --> 00:00:04,000\n{then[size]}\n") for size in first]
    got = {r.item_id: (r.seg_no, r.start_s, r.end_s, r.text) for r in cues.import_cues(spark.createDataFrame(texts, "file_id int, text string"), with_layout=True).collect()}
    assert got == {size: (0, 1.0, 4.0, then[size]) for size in first}
    for size in first:
        assert related(first[size], then[size])
        assert cues.smart_join(first[size], then[size], "\n") == then[size]
