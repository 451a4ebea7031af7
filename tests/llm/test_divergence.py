"""Operator 13 against plain counting with whole numbers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from cuegrid.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def plain(rows, min_docs):
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        found = Counter(lower(t) for t in TERM.findall(text or ""))
        counts[lang or "", source or ""] += found
        docs[lang or ""].update(found.keys())
    out = []
    by_lang = defaultdict(list)
    for lang, source in counts:
        by_lang[lang].append(source)
    for lang, sources in by_lang.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        total = Counter()
        for s in sources:
            total += counts[lang, s]

        def p(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        f = lambda a, b: (a - b) ** 2 // (a + b)
        of = {s: p(counts[lang, s]) for s in sources}
        q = p(total)
        for s in sources:
            pairs = sorted(((-sum(f(of[s][t], of[o][t]) for t in kept), o.encode(), o) for o in sources if o != s))
            out += [(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(pairs)]
            terms = sorted((-f(of[s][t], q[t]), t.encode(), t) for t in kept if counts[lang, s][t] and of[s][t] > q[t])
            out += [(lang, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(terms[:10])]
    return sorted(out)


def corpus(seed, n, sources):
    rng = random.Random(seed)
    words = ["Été", "été", "ÉTÉ", "straße", "a", "B", "b", "日本語", "x1y", "don't", "\x7fz", "naïve"] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    rows = [(rng.choice(["en", "de", None, ""]), rng.choice(sources), " ".join(rng.choices(words, k=rng.randint(0, 30)))) for _ in range(n)]
    return rows + [("en", "lonely", None), ("zz", "a", "12 34"), ("zz", "b", ""), ("one", None, "x " * 20), rows[0], rows[0], ("en", "s1", "long Word " * 40_000)]


@pytest.mark.parametrize("tile,block", [(256, 8192), (2, 7)])
def test_audit_equals_plain_counts(spark, monkeypatch, tile, block):
    monkeypatch.setattr(divergence, "TILE", tile)
    rows = corpus(tile, 250, ["s1", "s2", "S1", "é", None, "", "s10"])
    df = spark.createDataFrame([(k % 5, *r, 1, "x", 2) for k, r in enumerate(rows)], "doc_id long, lang string, source string, text string, term int, docs string, n long").repartition(3)
    for min_docs in (1, 4):
        got = sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in divergence.audit(df, min_docs, block).collect())
        assert got == plain(rows, min_docs)
    assert divergence.audit(df.limit(0)).count() == 0


def test_runs_give_what_columns_give():
    rng = np.random.default_rng(5)
    for _ in range(50):
        n = int(rng.integers(1, 40))
        x, y = (rng.integers(0, 3, n) * 10**8 + 1 for _ in "ab")
        runs = lambda v: (lambda at: (at, v[at]))(np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])))
        assert divergence.divergence(runs(x), runs(y), n) == int(((x - y) ** 2 // (x + y)).sum())


def test_shares_of_large_counts_are_whole():
    n = np.array([0, 9 * 10**9 + 7, 10**15])
    assert divergence.shares(n, 10**16 + 3).tolist() == [1 + 10**9 * (int(x) + 2) // (10**16 + 3) for x in n]


def test_flushed_counts_add_up(spark, monkeypatch):
    rows = corpus(9, 200, ["s1", "s2"])
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(2)
    want = sorted(map(tuple, divergence.term_counts(df).groupBy("lang", "source", "term").agg({"n": "sum", "docs": "sum"}).collect()), key=str)
    monkeypatch.setattr(divergence, "HELD", 5)
    assert sorted(map(tuple, divergence.term_counts(df).groupBy("lang", "source", "term").agg({"n": "sum", "docs": "sum"}).collect()), key=str) == want
