"""Segments against the reference's rule written out plainly, on typed and misread texts."""

import random
import re
import unicodedata
from difflib import SequenceMatcher

import pytest

from cuegrid.operators import chunks, segments

#: Neighbouring turns of the grown tables that begin alike: the rule joins them, equal beginnings alone would not.
BEGIN_ALIKE = [
    ("Towithtionthan.", "Thonthtionththaterreor."),
    ("Nderththnt.Thewhedthorblend,andtheernt,", "Nderththnt.Thewhed."),
    ("Thhaoureinghainonoureanblethrewhininwheser.", "Thhaoureinghainonoureanblethrewhouand."),
]


def plain_segments(rows, frame_dur, threshold=0.85):
    """Segments [start, end, text] of rows (time, text) in order, one step of the rule after the other."""
    near = frame_dur * 1.5

    def ratio(a, b):
        return SequenceMatcher(None, a, b).ratio()

    def partial(short, long):
        if not short or len(short) >= len(long):
            return False
        if len(short) <= 2:
            return short[0] == long[0]
        return long.startswith(short) or ratio(short, long[: len(short)]) >= 0.7

    first, full, out = [], [], []
    for t, raw in rows:
        text = "".join(unicodedata.normalize("NFKC", raw).split())
        cur = first[-1] if first else None
        if not text:
            continue
        if cur and t <= cur[1] + near and (text.startswith(cur[2]) or ratio(cur[2], text) >= threshold):
            cur[1], cur[2] = t + frame_dur, max(cur[2], text, key=len)
        else:
            first.append([t, t + frame_dur, text])
    for s in first:
        cur = full[-1] if full and s[0] <= full[-1][1] + near else None
        if cur and partial(cur[2], s[2]):
            cur[1:] = s[1:]
        elif cur and partial(s[2], cur[2]):
            cur[1] = max(cur[1], s[1])
        else:
            full.append(s)
    for s in full:
        cur = out[-1] if out and s[0] <= out[-1][1] + near else None
        if cur and len(re.findall("[「『]", cur[2])) > len(re.findall("[」』]", cur[2])) and not re.search("[「『]", s[2]) and not s[2].endswith("。"):
            cur[1:] = [max(cur[1], s[1]), cur[2] + s[2]]
        else:
            out.append(s)
    return out


def typed(rng, text):
    """Frames of a text being typed, some characters misread."""
    for k in sorted(rng.sample(range(1, len(text) + 1), min(len(text), rng.randint(1, 4)))):
        yield "".join(rng.choice("xy ｱ「") if rng.random() < 0.08 else c for c in text[:k])


def observed(rng, frames):
    """Numbers and times of the frames of one item; some follow a gap."""
    t = 0.0
    for k in range(frames):
        t += rng.choice([0.5, 0.5, 0.5, 1.0, 1.25, 1.5, 3.0])
        yield k, t


@pytest.mark.parametrize("size", [5, 20_000])
def test_segments_are_the_rule(spark, monkeypatch, size):
    monkeypatch.setattr(chunks.fold_in_chunks, "__defaults__", (size,))
    rng = random.Random(5)
    pool = ["".join(rng.choice("abcdeあい。」") for _ in range(n)) for n in (1, 2, 3, 7, 15, 40, 260)]
    pool += [p[: len(p) // 2] + "".join(rng.choice("abあ") for _ in range(len(p) // 3)) for p in pool]
    data = []
    for i in range(20):
        texts = [x for _ in range(25) for x in [*typed(rng, rng.choice(pool)), *([""] if rng.random() < 0.3 else [])]]
        data += [(i, k, t, x) for (k, t), x in zip(observed(rng, len(texts)), texts)]
    df = spark.createDataFrame(data, "item_id int, frame_idx int, t_s double, text string").repartition(4)
    got = {}
    for r in segments.build_segments(df, 0.5).orderBy("item_id", "seg_no").collect():
        got.setdefault(r.item_id, []).append([r.start_s, r.end_s, r.text])
    for i in range(20):
        assert got[i] == plain_segments([(t, x) for n, _, t, x in data if n == i], 0.5), i


def test_turns_that_begin_alike_are_one_segment(spark):
    data = [(i, k, k * 2.0, text) for i, pair in enumerate(BEGIN_ALIKE) for k, text in enumerate(pair)]
    df = spark.createDataFrame(data, "item_id int, frame_idx int, t_s double, text string")
    got = sorted((r.item_id, r.start_s, r.end_s, r.text) for r in segments.build_segments(df, 1.0).collect())
    assert got == [(i, 0.0, 3.0, max(pair, key=len)) for i, pair in enumerate(BEGIN_ALIKE)]
