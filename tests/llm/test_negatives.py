"""Operator 11 against all inner products."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuegrid.llm import negatives

KIND = "vec_id long, embedding array<float>, label int, page int, key string, q int, home long"


def plain(rows, least_size=0):
    fit = []
    for i, x, label in rows:
        if i is not None and label is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            fit.append((i, label, [math.floor(256 * float(np.float32(c))) for c in x]))
    asked = {}
    for i, label, q in sorted(fit):
        if i % 50 == 0:
            asked.setdefault(i, (label, q))
    out = []
    for a, (label, q) in asked.items():
        scored = [(sum(s * t for s, t in zip(q, r)), i, other) for i, other, r in fit if i != a]
        for ps, p in sorted(((s, i) for s, i, o in scored if o == label), key=lambda r: (-r[0], r[1]))[:5]:
            near = sorted(((s, i) for s, i, o in scored if o != label and 50 * ps <= 100 * s <= 95 * ps), key=lambda r: (-r[0], r[1]))[:3]
            out += [(a, p, k + 1, i, ps, s) for k, (s, i) in enumerate(near)]
    return sorted(out)


def corpus(seed, n, dims, big=1.0):
    rng = random.Random(seed)
    centre = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(4)]
    rows = []
    for k in range(n):
        c = centre[rng.randrange(4)]
        x = [big * (0.3 * v + 0.2 * rng.gauss(0, 1)) for v in c]
        rows.append((k * 5 - 100, x if rng.random() < 0.9 else [float(round(v)) for v in x], rng.choice([0, 0, 1, 2, None])))
    same = [big * 0.5] * dims
    rows += [(10_000 + k, same, k % 2) for k in range(80)] + [(rows[3][0], rows[4][1], 1), rows[5], rows[5], (20_000, [0.0] * dims, 0), (20_050, [-v for v in same], 0)]
    rows += [(None, same, 0), (1, None, 0), (2, [None] * dims, 0), (3, [float("nan")] * dims, 0), (4, [float("inf")] + same[1:], 0), (5, same, None), (6, [], 1), (7, same[:2], 1), (30_000, same[:3], 0)]
    return rows


@pytest.mark.parametrize("page,leaf,group,block,big", [(2048, 64, 32, 16384, 1.0), (16, 4, 2, 3, 1.0), (32, 8, 1, 7, 3e6)])
def test_negatives_equal_all_products(spark, monkeypatch, page, leaf, group, block, big):
    rows = corpus(page, 300, 6, big)
    df = spark.createDataFrame([(*r, 1, "k", 2, 3) for r in rows], KIND).repartition(3)
    monkeypatch.setattr(negatives.search, "__defaults__", (group, block))
    monkeypatch.setattr(negatives.Tree.__init__, "__defaults__", (leaf, 2))
    got = sorted(map(tuple, negatives.hard_negatives(df, page=page).collect()))
    # A repeated row that is the positive of two ranks gives the same rows twice.
    assert got == plain(rows)
    assert len(got) > 100


def test_small_and_empty_tables(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 1, 1, "k", 2, 3), (1, [0.9, 0.1], 1, 1, "k", 2, 3), (2, [0.8, 0.0], 2, 1, "k", 2, 3)], KIND)
    assert [tuple(r) for r in negatives.hard_negatives(df).collect()] == [(0, 1, 1, 2, 230 * 256, 204 * 256)]
    assert negatives.hard_negatives(df.limit(0)).count() == 0
    assert negatives.hard_negatives(df, F.lit(False)).count() == 0


def test_intervals_hold_every_product_and_prune(monkeypatch):
    rng = np.random.default_rng(1)
    v = np.sort(rng.integers(-200, 200, (500, 1)), axis=0) + rng.integers(-3, 4, (500, 5))
    tree = negatives.Tree(np.arange(500), np.zeros(500, int), v.astype(float), 16, 4)
    q = rng.integers(-50, 50, (20, 5)).astype(float)
    least, most = tree.intervals(q, *tree.levels[0])
    for n, rows in enumerate(tree.rows):
        s = tree.vectors[rows] @ q.T
        assert (s >= least[:, n]).all() and (s <= most[:, n]).all()
    none = np.full(20, 2**62)
    reach = tree.reachable(q, np.arange(20), np.full(20, 8000.0), np.full(20, 9000.0))
    assert np.isneginf(reach).mean() > 0.5
    got = tree.search(q, np.full(20, -1), np.zeros(20, int), np.arange(20), np.full(20, -np.inf), np.full(20, np.inf), none, True, 3)
    for i in range(20):
        assert got[i] == sorted(zip((-(v @ q[i])).astype(int).tolist(), range(500)))[:3]
