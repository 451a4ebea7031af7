"""Operator 2 against a plain recursive evaluation."""

import math
import random
import re
import zlib
from collections import Counter

import pytest

from cuegrid.llm import katz


def tokens(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def grams(w, k):
    """Every token with its k - 1 predecessors."""
    padded = ["<s>"] * 2 + w
    return [tuple(padded[i - k + 1 : i + 1]) for i in range(2, len(padded))]


class Plain:
    """Katz of order three, written as its recursion."""

    def __init__(self, docs):
        self.count = {k: Counter() for k in (1, 2, 3)}
        for i, t in docs:
            if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
                for k, c in self.count.items():
                    c.update(grams(tokens(t), k))
        self.n = sum(self.count[1].values())
        self.after = {}
        for k in (2, 3):
            for g in self.count[k]:
                self.after.setdefault(g[:-1], []).append(g[-1])
        self.met = {h: sum(self.count[len(h) + 1][(*h, w)] for w in ws) for h, ws in self.after.items()}
        self.d = {k: katz.discounts([sum(v == r for v in c.values()) for r in range(katz.CUTOFF + 2)]) for k, c in self.count.items()}
        self.unknown = sum(c * (1 - self.d[1][c]) for c in self.count[1].values() if c <= katz.CUTOFF) / self.n
        assert self.unknown > 0

    def kept(self, g):
        r, d = self.count[len(g)][g], self.d[len(g)]
        return r * d[r] if r <= katz.CUTOFF else r - (0 if len(g) == 1 else katz.CUTOFF * (1 - d[katz.CUTOFF]))

    def p(self, g):
        if len(g) == 1:
            return self.kept(g) / self.n if self.count[1][g] else self.unknown
        if self.count[len(g)][g]:
            return self.kept(g) / self.met[g[:-1]]
        return self.weight(g[:-1]) * self.p(g[1:])

    def weight(self, h):
        if h not in self.after:
            return 1.0
        left = 1 - sum(self.kept((*h, w)) for w in self.after[h]) / self.met[h]
        return left / (1 - sum(self.p((*h[1:], w)) for w in self.after[h]))

    def score(self, t):
        return sum(math.log10(self.p(g)) for g in grams(tokens(t), 3))


def made(n=120):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choice(words) if rng.random() < 0.6 else f"r{rng.randint(0, 400)}" for _ in range(rng.randint(0, 80)))) for i in range(n)]
    docs += [(1000, None), (1001, ""), (None, "w1 w2 null id"), (None, "another text without an id"), (1002, "Of THE w1\nw1\tw1"), (1003, "wholly unheard of words here")]
    docs += [(1004, "w1 w2 w3 r999")] * 2 + [(1005, "one text of an id"), (1005, "and another, longer text of the same id")]
    # Phrases that always go on alike: nothing of their histories is discounted by Good-Turing.
    docs += [(2000 + i, "alpha beta gamma delta " + "x y " * (i % 3)) for i in range(40)] + [(3000 + i, "alpha beta w5 and beta gamma w7 w8") for i in range(9)]
    return docs


def check(rows, docs):
    plain = Plain(docs)
    v = len(plain.count[1])
    assert len(rows) == len(docs)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    want = []
    for i, t in docs:
        w = tokens(t)
        base = sum(math.log10((plain.count[1][x,] + 1) / (plain.n + v + 1)) for x in w)
        want.append((i, len(w), sum(plain.count[1][x,] > 0 for x in w), base, plain.score(t)))
    got = [(r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in rows]
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert a[:3] == b[:3]
        assert a[3:] == pytest.approx(b[3:], rel=1e-9, abs=1e-9)
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2) and r.train_tokens == plain.n
        assert math.isfinite(r.score) and r.score < 0
    return plain


@pytest.mark.parametrize("bucket, chunk", [(1_000_000, 600_000), (400, 300), (60, 100)])
def test_katz_against_plain_evaluation(spark, bucket, chunk):
    docs = made()
    df = spark.createDataFrame([(*d, "x", 1.0) for d in docs], "doc_id long, text string, w string, score double")
    plain = check(katz.katz_scores(df, bucket, chunk).collect(), docs)
    outcomes = [*(g[0] for g in plain.count[1]), "an unknown token"]
    for h in [("<s>", "<s>"), ("<s>", "w1"), ("w1", "w2"), ("alpha", "beta"), ("beta", "gamma"), ("r7", "never met"), ("never", "met"), ("w1",), ("alpha",)]:
        assert sum(plain.p((*h, w)) for w in outcomes) == pytest.approx(1.0)
    assert plain.weight(("alpha", "beta")) > 0


def test_katz_query_and_base(spark, sf):
    from cuegrid.llm.queries import QUERIES

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = QUERIES["op2_katz"](spark, sf).collect()
    check(rows, docs)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_katz_scores_of_a_larger_table_are_finite(spark):
    from cuegrid.llm.queries import QUERIES

    rows = QUERIES["op2_katz"](spark, "/root/testdata/sf0.1").select("held_out", "score", "base_score").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 10_000 and all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_katz_of_an_empty_table_and_text_ids(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert katz.katz_scores(df).count() == 0
    df = spark.createDataFrame([("a", "x y"), (None, None)], "doc_id string, text string")
    assert {r.doc_id for r in katz.katz_scores(df).collect()} == {"a", None}


def test_packed_columns():
    import numpy as np

    a, b, c = np.array([0, 300, 1 << 40]), np.array([1.5, -2.0, 0.0]), np.zeros(3, np.int64)
    assert [x.tolist() for x in katz.unpack(katz.pack(a, b, c), 3)] == [a.tolist(), b.tolist(), c.tolist()]


def test_discounts():
    d = katz.discounts([0, 1000, 400, 220, 140, 100, 75, 60, 50])
    assert ((d[1:] > 0) & (d[1:] < 1)).all() and d[1] < d[7]
    assert katz.discounts([0, 5, 0, 0, 0, 0, 0, 0, 0])[1] == 0.5
