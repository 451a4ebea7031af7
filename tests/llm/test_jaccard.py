"""The near-copy stage of the pipeline against brute force over five-word shingles."""

import random

import corpus_pipeline
from cuegrid.llm import jaccard


def sets(t):
    w = (t or "").lower().split()
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_kept(docs, least=0.8):
    known = [(k, sets(t)) for k, t in docs]
    root = {k: k for k, _ in docs}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, (a, x) in enumerate(known):
        for b, y in known[:i]:
            if x and y and len(x & y) / len(x | y) >= least:
                p, q = top(a), top(b)
                root[max(p, q)] = min(p, q)
    return sorted(k for k in root if top(k) == k)


def test_stage_drops_near_copies_at_four_fifths(spark, sf):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    docs = []
    for _ in range(12):
        w = [word() for _ in range(rng.choice([4, 30, 120, 400]))]
        docs.append(" ".join(w))
        for changes in (1, 1, 2, 3, 5, 8):
            x = list(w)
            for k in rng.sample(range(len(x)), min(changes, len(x))):
                x[k] = word()
            docs.append(" ".join(x))
            w = x if rng.random() < 0.3 else w  # chains
    docs += [docs[0].upper(), None, None, "", " \n"]
    docs = list(enumerate(docs))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    kept = corpus_pipeline.near_deduplication(spark, df, sf)
    assert sorted(r.doc_id for r in kept.collect()) == brute_kept(docs)
    assert corpus_pipeline.near_deduplication(spark, df.limit(0), sf).count() == 0


def loose_copies(n, seed):
    """Copies of one text that keep between half and nearly all of its words, about the threshold of each other."""
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(150)]
    docs = []
    for d in range(n):
        w = list(base)
        for k in rng.sample(range(150), rng.choice([0, 1, 1, 2, 2, 3, 4, 6, 10])):
            w[k] = f"x{d}_{k}"
        docs.append(" ".join(w))
    return list(enumerate(docs))


def test_loose_copies_and_frequent_passages_against_brute_force(spark):
    docs = loose_copies(120, 8)
    passage = " ".join(f"p{k}" for k in range(60))
    docs += [(1000 + d, passage + " " + " ".join(f"y{d}_{k}" for k in range(5 + d))) for d in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(r.doc_id for r in jaccard.representatives(df).collect()) == brute_kept(docs)


def test_prefix_pairs_hold_all_that_is_linked_in_blocks_too(spark):
    docs = loose_copies(60, 9)
    nodes = jaccard.marked(spark.createDataFrame(docs, "doc_id long, text string")).cache()
    apart = nodes.selectExpr("node", "size", "node AS root").distinct()
    held = jaccard.shingle_sets(apart, nodes).cache()
    listed = jaccard.prefixes(apart, held, 0.8).cache()
    text = {r.node: sets(r.text) for r in nodes.collect()}
    linked = {(a, b) for a in text for b in text if a > b and len(text[a] & text[b]) / len(text[a] | text[b]) >= 0.8}
    for block in (7, 256):
        found = {tuple(r) for r in jaccard.prefix_pairs(listed, held, 0.8, block).collect()}
        assert linked <= found and len(found) < 1.3 * len(linked) + 20
        assert {tuple(r) for r in jaccard.verified(jaccard.prefix_pairs(listed, held, 0.8, block), nodes).collect()} == linked


def test_what_is_moved_grows_with_the_length_of_texts(spark):
    rng = random.Random(10)
    moved = {}
    for n in (1000, 8000):
        base = [f"w{k}" for k in range(n)]
        docs = []
        for d in range(8):
            w = list(base)
            for k in rng.sample(range(n), n // 50):
                w[k] = f"x{d}_{k}"
            docs.append((d, " ".join(w)))
        nodes = jaccard.marked(spark.createDataFrame(docs, "doc_id long, text string"))
        apart = nodes.selectExpr("node", "size", "node AS root")
        held = jaccard.shingle_sets(apart, nodes).cache()
        lists = jaccard.prefix_lists(jaccard.prefixes(apart, held, 0.8), held)
        moved[n] = lists.selectExpr("sum(aggregate(members, 0L, (s, m) -> s + length(m.sketch) + 24)) AS n").first().n
    assert moved[1000] > 0 and moved[8000] < 9 * moved[1000]


def test_a_very_long_text_and_its_copy(spark):
    w = [f"w{k % 9000}x{k % 7}" for k in range(60_000)]
    other = list(w)
    for k in range(0, 60_000, 900):
        other[k] = "other"
    docs = [(3, " ".join(w)), (5, " ".join(other)), (7, " ".join(reversed(w)))]
    assert sorted(r.doc_id for r in jaccard.representatives(spark.createDataFrame(docs, "doc_id long, text string")).collect()) == brute_kept(docs) == [3, 7]
