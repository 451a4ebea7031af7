"""Operators 3, 5 and 7 and the pipeline against brute force and held-out labels."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuegrid.llm import classifier, line_dedup, topk


def full_lines(t):
    return [x.strip(" \t\n\x0b\x0c\r") for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]


def brute_removed(docs, min_words):
    """Lines under runs of min_words that an earlier place holds. docs: list of (id, text) by id."""
    out = {}
    earlier = []
    for k, t in docs:
        own = full_lines(t)
        gone = set()
        for old in [*earlier, own]:
            for d in range(-len(old), len(own)):
                if old is own and d <= 0:
                    continue
                i = max(0, d)
                while i < min(len(own), len(old) + d):
                    j = i
                    while j < min(len(own), len(old) + d) and own[j] == old[j - d]:
                        j += 1
                    if j > i and sum(len(x.split()) for x in own[i:j]) >= min_words:
                        gone |= set(range(i, j))
                    i = j + 1
        out[k] = gone
        earlier.append(own)
    return out


def made_docs(rng, n):
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6)))
    line = lambda: " ".join(word() for _ in range(rng.randint(3, 20)))
    passages = [[line() for _ in range(rng.randint(1, 5))] for _ in range(6)]
    docs = []
    for i in range(n):
        lines = []
        for _ in range(rng.randint(1, 6)):
            lines += rng.choice(passages) if rng.random() < 0.4 else [line(), ""]
        docs.append((i, "\n".join(lines)))
    return docs


def test_line_dedup_against_brute_force(spark):
    docs = made_docs(random.Random(1), 60)
    wanted = brute_removed(docs, 20)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    runs = {r._doc: {k for x in r.runs for k in range(x.start, x.end)} for r in line_dedup.repeated_runs(df, 20).collect()}
    assert {k: runs.get(k, set()) for k, _ in docs} == wanted
    # The first copy of every line stays.
    left = Counter(x for r in line_dedup.dedup_lines(df, 20).collect() for x in full_lines(r.text))
    assert set(left) == {x for _, t in docs for x in full_lines(t)}


def test_line_dedup_misses_nothing(spark):
    for seed in (1, 7):
        docs = made_docs(random.Random(seed), 60)
        df = spark.createDataFrame(docs, "doc_id long, text string")
        runs = {r._doc: {k for x in r.runs for k in range(x.start, x.end)} for r in line_dedup.repeated_runs(df, 20).collect()}
        assert {k: runs.get(k, set()) for k, _ in docs} == brute_removed(docs, 20)


def test_line_dedup_finds_a_run_whose_lines_came_first_elsewhere(spark):
    words = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    passage = [words("a", 20), words("b", 20), words("c", 20)]
    docs = [(i, f"{x}\n{words(f'd{i}', 5)}") for i, x in enumerate(passage)]  # each line alone, before another text
    docs += [(5, "\n".join(passage)), (9, "\n".join([*passage, words("e", 5)]))]
    # A window of 50 words in an earlier place, and a shorter line that follows it later only.
    docs += [(20, words("f", 60)), (21, words("f", 60) + "\nend of it"), (22, words("f", 60) + "\nend of it")]
    got = {r.row.doc_id: r.removed for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {k: v for k, v in got.items() if v} == {9: 3, 21: 1, 22: 2}


def test_line_dedup_finds_every_passage_with_one_earlier_copy(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    line = lambda n: " ".join(word() for _ in range(n))
    shapes = [[60], [51, 3], [10] * 6, [1] * 55, [30, 30]]
    docs, wanted = [], {}
    for i, shape in enumerate(shapes):
        passage = [line(n) for n in shape]
        docs.append((i, "\n".join([line(5), *passage, line(9)])))
        docs.append((100 + i, "\n".join([line(7), line(8), *passage, "", line(4)])))
        wanted[100 + i] = len(passage)
    short = line(49)
    docs += [(200, short), (201, short)]
    got = {r.row.doc_id: r.removed for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {k: v for k, v in got.items() if v} == wanted


def test_winnow_picks_the_last_least_of_every_window():
    rng = np.random.default_rng(3)
    for _ in range(200):
        h, w = rng.integers(0, 6, 30), rng.integers(1, 30, 30).astype(np.int32)
        picks = set()
        for i in range(30):
            j = i
            while j < 30 and w[i : j + 1].sum() < 50:
                j += 1
            if j < 30:
                picks.add(max(range(i, j + 1), key=lambda k: (-h[k], k)))
        assert sorted(picks) == sorted(set(line_dedup.winnow(h, w)))


def test_line_dedup_odd_rows(spark):
    same = " ".join(f"w{i}" for i in range(60))
    rows = [(None, same, 0, "x"), (1, same, 0, "x"), (1, same, 0, "x"), (1, "other\n" + same, 0, "x"), (2, None, 0, "x"), (3, "", 0, "x"), (4, "a\n" + same + "\n\n" + same, 0, None)]
    df = spark.createDataFrame([(*r, "own", i) for i, r in enumerate(rows)], "doc_id long, text string, n_chars long, words string, runs string, _doc int")
    got = line_dedup.shortened(df).collect()
    assert all(r.runs == "own" and r.n_chars == (None if r.text is None else len(r.text)) for r in got) and sorted(r._doc for r in got) == list(range(len(rows)))
    assert len(got) == len(rows)
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted([("None", same), ("1", ""), ("1", ""), ("1", "other"), ("2", "None"), ("3", ""), ("4", "a\n")])
    assert line_dedup.shortened(df.limit(0)).count() == 0
    named = spark.createDataFrame([("b", same), ("a", same), (None, "x")], "doc_id string, text string")
    assert sorted(len(r.text) for r in line_dedup.shortened(named).collect()) == [0, 1, len(same)]


def brute_topk(vectors, k=5):
    """vectors: list of (id, list or None); whole inner products."""
    good = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for qid, q in good:
        if qid % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in good if i != qid)[:k]
            out[qid] = [(r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return out


def collected(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


def test_topk_query(spark, sf):
    from cuegrid.llm.queries import QUERIES

    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert collected(QUERIES["op5_topk"](spark, sf)) == brute_topk(vectors)


def test_topk_of_uneven_lengths_ties_and_odd_rows(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, (rng.normal(size=8) * 10.0 ** rng.integers(-2, 2)).astype(np.float32).tolist()) for i in range(600)]
    vectors += [(600 + i, vectors[50][1]) for i in range(40)]
    vectors += [(700, None), (701, [None] * 8), (702, [float("nan")] * 8), (703, [float("inf")] * 8), (704, [0.0] * 8), (705, []), (750, [0.0] * 8), (800, [-1.0] * 8)]
    df = spark.createDataFrame([(i, v, -1) for i, v in vectors], "vec_id long, embedding array<float>, score int")
    wanted = brute_topk(vectors)
    assert collected(topk.top_k(df, block=32)) == wanted
    assert collected(topk.top_k(df)) == wanted
    assert topk.top_k(df.limit(0)).count() == 0
    few = topk.top_k(df.filter("vec_id IN (0, 1, 2)"))
    assert few.count() == 2


def test_topk_candidates_hold_all_that_reach_the_limit():
    rng = np.random.default_rng(5)
    for _ in range(100):
        v = np.floor(256 * rng.normal(size=(200, 6)) * rng.uniform(0.2, 1.5, (200, 1)))
        norms = np.linalg.norm(v, axis=1)
        order = np.argsort(-norms)
        v, norms = v[order], norms[order]
        q = np.floor(256 * rng.normal(size=6))
        least = np.sort(v @ q)[-5]
        at = set(topk.candidates(norms, v, v / norms[:, None], q, float(np.linalg.norm(q)), float(least)).tolist())
        assert set(np.flatnonzero(v @ q >= least).tolist()) <= at


def test_classifier_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    known = labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(4)) != 0)
    judged = classifier.classify(docs, known).select("row.doc_id", "kept")
    (r,) = (
        judged.join(labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0), "doc_id")
        .agg(
            F.avg(F.when((F.col("quality") == 1) & (F.col("toxic") == 0), F.col("kept").cast("int"))).alias("clean_kept"),
            F.avg(F.when(F.col("toxic") == 1, F.col("kept").cast("int"))).alias("toxic_kept"),
            F.avg(F.when(F.col("quality") == 0, F.col("kept").cast("int"))).alias("junk_kept"),
        )
        .collect()
    )
    assert r.clean_kept >= 0.98 and r.toxic_kept <= 0.05 and r.junk_kept <= 0.05, r


def test_classifier_odd_rows(spark):
    rows = [(i, f"good p{i} words q{i} here", "en", "a") for i in range(40)] + [(100 + i, f"bad r{i} junk s{i} here", "en", "b") for i in range(40)]
    rows += [(None, None, None, None), (500, "", None, "a"), (1, "good words", "en", "a"), (501, "bad junk", None, None)]
    docs = spark.createDataFrame([(*r, "own", 0.5, i) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, kept string, evidence double, _n int")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(100 + i, 0, i % 2) for i in range(40)] + [(None, 1, 1), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = classifier.classify(docs, labels).collect()
    assert len(got) == len(rows)
    kept = {r.row.doc_id: r.kept for r in got}
    assert all(r.row.kept == "own" and r.row.evidence == 0.5 for r in got) and sorted(r.row._n for r in got) == list(range(len(rows)))
    assert all(kept[i] for i in range(40)) and not any(kept[100 + i] for i in range(40)) and not kept[501]
    assert all(r.kept for r in classifier.classify(docs, labels.limit(0)).collect())
    assert classifier.classify(docs.limit(0), labels).count() == 0


def test_classifier_learns_from_one_of_each_set_of_copies(spark):
    long = " ".join(f"w{k}" for k in range(200))
    rows = [(i, long + (f" tail{i}" if i % 2 else "")) for i in range(30)] + [(100 + i, f"a{i} b{i} c{i} d{i} e{i}") for i in range(10)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    sample = classifier.labelled_sample(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    assert 10 < sample.count() <= 13


def test_site_rates_shrink_sparse_hosts_more(spark):
    rows = [("big", "p", 3.0)] * 200 + [("small", "p", 3.0)] * 2 + [(f"h{i}", "p", -3.0) for i in range(100) for _ in range(5)]
    df = spark.createDataFrame(rows, "_host string, _path string, evidence double")
    rate = {r._host: r._host_rate for r in classifier.site_rates(df, 0.0).collect()}
    assert rate["big"] > rate["small"] > rate["h0"]


def plain_posteriors(docs, sample):
    """doc: evidence, host rate, path rate and posterior, in plain Python from the texts and labels of the sample."""
    seen = {True: Counter(), False: Counter()}
    n = Counter(bad for _, bad in sample)
    for text, bad in sample:
        seen[bad].update(set(classifier.features(text)))
    odds = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    prior, z = n[True] / (n[True] + n[False]), classifier.ERRORS
    weights = {}
    for f in seen[True] | seen[False]:
        k, m = seen[True][f], seen[True][f] + seen[False][f]
        if m >= classifier.MIN_DOCS:
            half = z * math.sqrt(k * (m - k) / m + z * z / 4)
            low, high = (k + z * z / 2 - half) / (m + z * z), (k + z * z / 2 + half) / (m + z * z)
            w = odds(low if low > prior else high if high < prior else prior) - odds(prior)
            if abs(w) > 0.1:
                weights[f] = w
    start = math.log(n[True] / n[False])
    logistic = lambda x: 1 / (1 + math.exp(-x))
    evidence = {}
    for k, text, _, _ in docs:
        found = sorted((weights[f] for f in classifier.features(text or "") if f in weights), reverse=True)
        evidence[k] = sum(w * 0.6**i for i, w in enumerate(w for w in found if w > 0)) + max(classifier.MOST_GOOD, sum(w for w in found if w < 0))
    own = {k: logistic(e + start) for k, e in evidence.items()}
    hosts, paths = {}, {}
    for k, _, host, path in docs:
        hosts.setdefault(host, []).append(own[k])
        paths.setdefault((host, path), []).append(own[k])
    rate = sum(own.values()) / len(own)
    between = sum(len(h) * (sum(h) / len(h) - rate) ** 2 for h in hosts.values()) / len(own) - len(hosts) * rate * (1 - rate) / len(own)
    strength = max(1.0, min(1e6, rate * (1 - rate) / max(between, 1e-9) - 1))
    out = {}
    for k, _, host, path in docs:
        host_rate = (sum(hosts[host]) + strength * rate) / (len(hosts[host]) + strength)
        p = paths[host, path]
        path_rate = (sum(p) - own[k] + strength * host_rate) / (len(p) - 1 + strength)
        out[k] = (evidence[k], host_rate, path_rate, logistic(evidence[k] + odds(path_rate)))
    return out


def test_posteriors_equal_a_plain_model(spark):
    rng = random.Random(21)
    words = [f"w{k}" for k in range(40)]
    docs, labels = [], []
    for k in range(240):
        bad = rng.random() < (0.6 if k % 3 == 0 else 0.1)
        text = " ".join(rng.choices(words, k=rng.randint(5, 60)) + (["spam buy now"] * rng.randint(1, 4) if bad else []))
        docs.append((k, None if k == 7 else text, f"h{k % 3}" if k % 11 else None, rng.choice(["a", "b", None])))
        if k % 2:
            labels.append((k, 0 if bad else 1, 0))
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    sample = [(r.text, bool(r.bad)) for r in classifier.labelled_sample(df.select("doc_id", "text"), known, 10_000).collect()]
    want = plain_posteriors(docs, sample)
    got = {r.row.doc_id: (r.evidence, r.host_rate, r.path_rate, r.posterior) for r in classifier.classify(df, known, sample=10_000).collect()}
    assert set(got) == set(want)
    for k, row in want.items():
        assert got[k] == pytest.approx(row, rel=1e-9, abs=1e-9), k
    assert max(r[3] for r in want.values()) > 0.5 > min(r[3] for r in want.values())


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, sf)
        assert at.columns == docs.columns, name
        assert at.filter("n_chars <> length(text)").count() == 0
    ids = {r.doc_id for r in at.select("doc_id").collect()}
    packed = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in packed} == ids
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    bad = [i for i, r in labels.items() if r.toxic or not r.quality]
    assert sum(i in ids for i in bad) <= 0.25 * len(bad)
