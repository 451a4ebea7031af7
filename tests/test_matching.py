"""Long lists in slices give what one automaton gives; texts of any length in linear time."""

import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cuegrid.functions import matching
from cuegrid.functions import text as T
from cuegrid.operators import jobs, masks, memo
from cuegrid.operators.segments import split_sentences


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(12)
    text = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    texts = spark.createDataFrame([(k % 3, k, text(rng.choice([0, 5, 40, 120]))) for k in range(60)] + [(0, 99, None)], "item_id int, pos int, text string")
    words = spark.createDataFrame([(text(rng.randint(1, 5)),) for _ in range(40)] + [("",), ("abc",), ("abc",)], "word string")
    return texts, words


def both(monkeypatch, run):
    whole = run()
    monkeypatch.setattr(matching, "MOST_WORDS", 3)
    assert run() == whole
    return whole


def test_slices_are_in_order_and_whole(spark, data):
    words = data[1].groupBy("word").agg(F.min("word").alias("rank"))
    parts = list(matching.in_slices(words, ["rank", "word"], 4))
    flat = [r.word for p in parts for r in p]
    assert flat == sorted({r.word for r in words.collect()}) and all(len(p) <= 4 for p in parts)
    assert list(matching.in_slices(words.limit(0), ["rank", "word"], 4)) == [[]]


def test_words_rules_and_terms_by_slices(spark, data, monkeypatch):
    texts, words = data
    with monkeypatch.context() as m:
        got = both(m, lambda: sorted(map(tuple, masks.find_words(texts, words).collect())))
    known = {r.word for r in words.collect()} - {""}
    want = []
    for item, pos, t in texts.collect():
        i = 0
        while t and i < len(t):
            best = max((w for w in known if t.startswith(w, i)), key=len, default="")
            if best:
                want.append((item, pos, i, best))
            i += len(best) or 1
    assert got == sorted(want)
    with monkeypatch.context() as m:
        risky = both(m, lambda: {r.pos: r.risky for r in memo.split_risky(texts, words.select(F.col("word").alias("term"))).collect()})
    assert risky == {r.pos: any(w in (r.text or "") for w in known) for r in texts.collect()}
    rules = spark.createDataFrame([(w, (k * 7) % 41, f"v{k}") for k, w in enumerate(sorted(known))], "key string, rank int, value string")
    items = texts.select(F.col("pos").alias("item_id"), F.col("text").alias("tags"))
    with monkeypatch.context() as m:
        hits = both(m, lambda: {r.item_id: r.value for r in memo.rule_lookup(items, rules).collect()})
    order = sorted((r["rank"], r.key, r.value) for r in rules.collect())
    assert hits == {r.pos: next(v for _, w, v in order if w in r.text) for r in texts.collect() if any(w in (r.text or "") for w in known)}
    terms = words.distinct().withColumnRenamed("word", "term").withColumn("replacement", F.concat(F.lit("ab"), F.length("term").cast("string")))
    with monkeypatch.context() as m:
        done = both(m, lambda: {r.pos: r.o for r in jobs.with_terms(texts, terms, "text", "o").collect()})
    listed = sorted(((r.term, r.replacement) for r in terms.collect() if r.term), key=lambda t: (-len(t[0]), t[0]))
    for r in texts.collect():
        t = r.text
        for term, new in listed:
            t = t and t.replace(term, f"⟦{new}⟧")
        assert done[r.pos] == t


def plain_quotes(text):
    out, opens = [], {'"': True, "'": True}
    word = lambda c: bool(c) and not c.isspace() and c not in "，。、！？：；…—·,.!?;:~()（）[]{}「」『』\"'"
    for i, c in enumerate(text):
        if c in opens:
            p, n = word(text[i - 1 : i] if i else ""), word(text[i + 1 : i + 2])
            o = False if p and not n else True if n and not p else opens[c]
            opens[c] = not o
            c = {'"': "「」", "'": "『』"}[c][not o]
        out.append({"“": "「", "”": "」", "‘": "『", "’": "』"}.get(c, c))
    return "".join(out)


def test_quotes_in_linear_time(spark):
    rng = random.Random(13)
    texts = ["".join(rng.choice("ab \"'“”‘’。!字") for _ in range(rng.randint(0, 40))) for _ in range(400)] + ["\"a' b" * 200_000]
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None])], "k int, t string").repartition(2)
    began = time.time()
    got = {r.k: r.o for r in df.select("k", T.unify_quotes(F.col("t")).alias("o")).collect()}
    assert time.time() - began < 20
    assert [got[k] for k in range(len(texts))] == [plain_quotes(t) for t in texts] and got[len(texts)] is None


def test_sentences_of_a_long_quote_in_linear_time():
    assert split_sentences("「あ。い「う。え」") == ["「あ。", "い「う。え」"]
    began = time.time()
    assert len(split_sentences("「" + "あ。" * 200_000 + "」")) == 1
    assert time.time() - began < 5


def test_line_boxes_take_the_next_free_one():
    rng = random.Random(14)
    for _ in range(200):
        caps = sorted(rng.randint(1, 12) for _ in range(rng.randint(0, 8)))
        lines = [rng.randint(1, 12) for _ in range(rng.randint(0, 8))]
        taken, want = set(), []
        for n in lines:
            k = next((k for k, c in enumerate(caps) if k not in taken and n <= c <= 1.6 * n), None)
            want.append(k)
            taken.add(k)
        assert masks.free_boxes(lines, caps) == want
    assert masks.free_boxes([5] * 3, [5] * 100_000) == [0, 1, 2]


def test_near_pairs_are_the_plain_rule(spark):
    from cuegrid.functions.similarity import alike, related

    rng = random.Random(15)
    pool = ["", "拓也が来た", "拓也が来た。走る", "全然違う文章だ", "全然違う文だ", "ab", "abcdefgh", "abcdxfgh", "xbcdefgh"]
    data = [(f"i{i}", k * 2, rng.choice(pool)) for i in range(6) for k in range(25)]
    got = {(r.item_id, r.a, r.b): r.by for r in jobs.near_pairs(spark.createDataFrame(data, "item_id string, pos int, text string"), 3, 0.8).collect()}
    want = {}
    for i, (item, a, x) in enumerate(data):
        for other, b, y in data[i + 1 : i + 4]:
            if other == item and x and y:
                by = "prefix" if x.startswith(y) or y.startswith(x) else "ratio" if alike(x, y, 0.8) else "related" if related(x, y) else None
                want |= {(item, a, b): by} if by else {}
    assert got == want


def test_sentences_are_made_for_a_few_rows_at_a_time():
    from cuegrid.operators.segments import sentences_of

    texts = pd.Series(["a。b", None, "c"] * 400)
    parts = list(sentences_of.func(iter([texts, texts[:0]])))
    assert max(map(len, parts)) <= 256 and [list(x) if x else x for p in parts for x in p] == [["a。", "b"], None, ["c"]] * 400


def test_the_automaton_is_looked_up_once_a_batch(spark, monkeypatch):
    calls, found = [], matching._automaton
    monkeypatch.setattr(matching, "_automaton", lambda words: calls.append(1) or found(words))
    of = matching.Words(spark, ("ab", "b")).udf(matching.any_hit, "boolean")
    assert of.func(pd.Series(["xab", None, "c"] * 50)).tolist() == [True, False, False] * 50
    assert len(calls) == 1
