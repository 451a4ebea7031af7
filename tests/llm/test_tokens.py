"""Operators 1, 4 and 6 against the libraries called on each whole text."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cuegrid.llm import bpe, packing, token_counts
from cuegrid.llm.chunk_codec import ChunkCodec

ODD = [
    None,
    "",
    " ",
    "a",
    "  two  spaces \n\n and\ttabs \r\n end  ",
    "word " * 5000,
    "x" * 3000,
    "it's we'll ''s 12ab34 +-*/ 　  nbsp  <|endoftext|> tail ",
    "日本語の文章と русский текст, naïve façade \U0001f600\U0001f600 " * 40,
    "a\x85b \x1c c  d  é é",
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "x", -1) for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens long")


def test_bpe_equals_library_and_decodes_to_the_text(odd):
    enc = bpe.encoding(bpe.MULTI_RANKS)
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(odd, piece_chars=50)).collect()}
    for i, t in enumerate(ODD):
        assert got[i].ids == enc.encode_ordinary(t or "")
        assert bytes(got[i].bytes) == (t or "").encode()


def test_bpe_cuts_only_where_matches_end():
    enc = bpe.encoding(bpe.MULTI_RANKS)
    rng = np.random.default_rng(1)
    for _ in range(300):
        t = "".join(rng.choice(list("ab1 \n'sé .　日"), 60))
        assert bpe.encode_text(enc, t, 7) == enc.encode_ordinary(t)


def test_bpe_query(spark, sf):
    from cuegrid.llm.queries import QUERIES

    enc = bpe.encoding(bpe.MULTI_RANKS)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op1_bpe"](spark, sf).collect():
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_chunk_codec_equals_library():
    path = packing.BYTE_BPE
    whole, chunks = Tokenizer.from_file(path), ChunkCodec(path, packing.BYTE_RANKS, memory=3)
    rng = np.random.default_rng(2)
    texts = [t or "" for t in ODD] + ["".join(rng.choice(list("ab1  \n'é.　"), 40)) for _ in range(200)]
    for k in range(0, len(texts), 7):
        for t, raw in zip(texts[k : k + 7], chunks.encode(texts[k : k + 7])):
            assert np.frombuffer(raw, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


def check_packing(rows, wanted, capacity):
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(wanted)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_whole_table(spark, sf):
    from cuegrid.llm.queries import QUERIES

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted, total = [], 0
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = np.array(tok.encode(r.text, add_special_tokens=False).ids + [2], "<u4")
        total += len(ids)
        stops = list(range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024))
        for k, (a, b) in enumerate(zip([0, *stops], stops)):
            wanted.append((r.doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    n = check_packing(QUERIES["op4_packing"](spark, sf).collect(), wanted, 1024)
    assert n <= -(-total // 1024) * 1.02 + 1


def test_packing_of_many_shards_and_rounds(spark):
    rng = np.random.default_rng(3)
    rows = [(i % 900, i, 0, int(n), 0) for i, n in enumerate(rng.integers(1, 101, 1000))]
    df = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    n = check_packing(packing.pack(df, capacity=100, shard=100, rounds=3).collect(), rows, 100)
    assert n <= sum(r[3] for r in rows) / 100 * 1.06 + 1


def test_packing_odd_rows(spark, odd):
    assert {r.doc_id for r in packing.pack(packing.pieces(odd)).collect()} == set(range(len(ODD)))
    assert packing.pack(packing.pieces(odd.filter("doc_id < 0"))).count() == 0
    nulls = spark.createDataFrame([(None, None), (None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    assert packing.pack(packing.pieces(nulls)).count() == 4


def test_local_search_never_adds_bins_and_keeps_items():
    rng = np.random.default_rng(4)
    for _ in range(50):
        lengths = rng.integers(1, 60, 80).tolist()
        first = packing.best_fit(lengths, 100)
        after = packing.local_search([list(b) for b in first], lengths, 100)
        assert sorted(i for b in after for i in b) == list(range(80))
        assert all(sum(lengths[i] for i in b) <= 100 for b in after)
        assert len(after) <= len(first)
        assert sum(sum(lengths[i] for i in b) ** 2 for b in after) >= sum(sum(lengths[i] for i in b) ** 2 for b in first)


def test_local_search_exchanges_empty_a_bin():
    # 70+25, 60+35 and 5+5: one for one and moves fill the first two.
    lengths = [70, 25, 60, 35, 5, 5]
    assert len(packing.local_search([[0, 1], [2, 3], [4, 5]], lengths, 100)) == 2


def test_histogram_against_brute_force(spark, odd):
    lengths = [3, 3, 5, 0, 2000, 1024, 5, 5]
    hist = token_counts.length_histogram(spark.createDataFrame([(n,) for n in lengths], "n_tokens long"))
    for r in hist.collect():
        L = r.n_tokens
        assert r.n_docs == lengths.count(L)
        assert r.docs_at_least == sum(n >= L for n in lengths)
        assert r.tokens_at_least == sum(n for n in lengths if n >= L)
        assert r.tokens_truncated == sum(min(n, L) for n in lengths)
        assert r.docs_share_below == pytest.approx(sum(n < L for n in lengths) / len(lengths))
    limits = spark.createDataFrame([(4,), (4,), (1500,)], "context long")
    got = {r.context: (r.docs_cut, r.tokens_kept) for r in token_counts.at_limits(hist, limits).collect()}
    assert got == {c: (sum(n > c for n in lengths), sum(min(n, c) for n in lengths)) for c in (4, 1500)}
    for q, want in ((0.5, 5), (0.1, 0), (1.0, 2000)):
        assert token_counts.quantile(hist, q).first().n_tokens == want
    assert token_counts.length_histogram(token_counts.encoded_lengths(odd.limit(0))).count() == 0
    assert token_counts.encoded_lengths(odd).filter("doc_id = 0").first().n_tokens == 0
