"""Operator 2: Katz backoff scores of whole texts, of order three.

Tokens are the words of a text (A-Z in lower case) and an end. A token's probability after its
two predecessors (the start stands twice before a text) is its discounted share of what
followed them in training. An unseen triple backs off to the pair, an unseen pair to the token,
and unknown tokens, as one class, to what the discounts of single tokens left. Discounts are
Good-Turing's for counts up to ``CUTOFF``; larger counts give up as much of a count as those at
the cutoff do, so that every history leaves something to tokens that never followed it. A
history's backoff weight is what its discounts left over what its followers leave of the lower
order: its probabilities sum to one, and no score is infinite.

Texts are tokenised once, into a table of numbered chunks; tokens are numbered by their counts,
so the steps of the counts tell every token's own. Occurrences, as packed columns, lie in
buckets by the hash of the token and its predecessor, about ``BUCKET`` of them each: a bucket
knows the counts of its triples and pairs. Histories lie in buckets by their own hash, where
their weights are formed and the backed-off tokens of held-out texts ask for them.
Pairs met more often than half a bucket are dealt by the triple, and such triples at random;
their counts (at most twice the tokens over a bucket, or ``MOST_HOT``) are broadcast.

The model is the tables of tokens, occurrences and weights. Null text counts as empty: the end
alone. Every row is scored by itself, those of null or repeated ids too; null ids are trained
on. A very long text is whole in one chunk. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cuegrid.llm.common import discard, slices, texts, written

CUTOFF = 7
#: Tokens of a bucket, about.
BUCKET = 1_000_000
#: Tokens of a chunk of documents, about.
CHUNK = 600_000
#: Pairs, and triples, broadcast at most.
MOST_HOT = 2_000_000
#: Occurrences, and then histories, are dealt out in so many goes, which bounds the disk that one shuffle takes.
GOES = 2
START, UNKNOWN, FIRST = 0, 1, 2
_END = b"\n"  # no word holds it
_hash = xxhash.xxh64_intdigest


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


# ---- packed columns


def pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length: whole numbers from 0 on by their bytes, each byte of all rows
    together, which compresses sorted columns well; doubles as they are."""
    n, head, body = len(columns[0]), [], []
    for c in columns:
        if c.dtype.kind == "f":
            head.append(255)
            body.append(c.astype("<f8").tobytes())
        else:
            width = (int(c.max()).bit_length() + 7) // 8 if n else 0
            head.append(width)
            body.append(np.ascontiguousarray(c.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
    return zstandard.compress(np.int64(n).tobytes() + bytes(head) + b"".join(body), 1)


def unpack(blob: bytes, n_columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
    n, at, out = int(raw[:8].view("<i8")[0]), 8 + n_columns, []
    for width in raw[8:at].tolist():
        if width == 255:
            out.append(np.frombuffer(raw[at : at + 8 * n].tobytes(), "<f8"))
            at += 8 * n
        else:
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :width] = raw[at : at + width * n].reshape(width, n).T
            out.append(wide.view("<i8").ravel())
            at += width * n
    return out


def unpack_all(blobs, n_columns: int) -> list[np.ndarray]:
    parts = [unpack(b.as_py(), n_columns) for b in blobs]
    return [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * n_columns


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal numbers stay equal, others spread over all bits."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def key_of(*parts: np.ndarray) -> np.ndarray:
    """One 64-bit hash of the numbers in a row."""
    key = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        key = mix(key + p.astype(np.uint64) + np.uint64(1))
    return key


def _cut(groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal numbers."""
    edges = np.flatnonzero(np.diff(groups)) + 1
    return np.concatenate([[0], edges]).astype(np.int64)[: len(groups)], np.concatenate([edges, [len(groups)]]).astype(np.int64)[: max(1, len(groups))]


def _dealt(bucket: np.ndarray, *columns: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Rows cut by bucket, each bucket's in the order given, packed."""
    if not len(bucket):
        return [], []
    # Small whole numbers are sorted by radix.
    order = np.argsort(bucket.astype(np.uint16) if bucket.max() < 1 << 16 else bucket, kind="stable")
    columns = [c[order] for c in columns]
    starts, ends = _cut(bucket[order])
    return bucket[order][starts].tolist(), [pack(*(c[s:e] for c in columns)) for s, e in zip(starts.tolist(), ends.tolist())]


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where rows in order differ from those before."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)]))


def _sorted_places(*columns: np.ndarray) -> np.ndarray:
    """The order by the columns, the first counting most."""
    if len(columns) > 1 and len(columns[0]) and max(int(columns[0].max()), int(columns[1].max())) < 1 << 31:
        columns = (columns[0] << 32 | columns[1], *columns[2:])
    return np.lexsort(columns[::-1]) if len(columns) > 1 else np.argsort(columns[0], kind="stable")


# ---- chunks of documents


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _chunks(docs: DataFrame, limit: int) -> DataFrame:
    """One row per chunk: its number, ids, sizes and training flags of its documents, tokens as places among its words, hashes and training counts of these."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, arrow = TaskContext.get().partitionId() << 24, None

        def flush():
            token = np.concatenate(tokens)
            words = np.fromiter(map(_hash, numbers), np.uint64, len(numbers)).view(np.int64)
            own = np.bincount(token[np.repeat(train, sizes)], minlength=len(words))
            cols = [pa.array([number]), pa.array([ids], pa.list_(arrow)), pa.array([train], pa.list_(pa.bool_())), pa.array([pack(np.array(sizes), np.array(train, np.int64))]), pa.array([pack(token)])]
            cols += [pa.ListArray.from_arrays([0, len(words)], pa.array(x)) for x in (words, own)]
            return pa.RecordBatch.from_arrays(cols, names=["chunk", "ids", "train", "sizes", "tokens", "words", "own"])

        numbers, ids, train, sizes, tokens, total = _Numbers(), [], [], [], [], 0
        for b in slices(batches, 64):
            arrow = b.schema.field("doc_id").type
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"]):
                w = text.as_py().encode().lower().split()
                w.append(_END)
                tokens.append(np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)))
                ids.append(doc)
                train.append(not held_out(doc))
                sizes.append(len(w))
                total += len(w)
                if total >= limit:
                    yield flush()
                    numbers, ids, train, sizes, tokens, total = _Numbers(), [], [], [], [], 0
                    number += 1
        if ids:
            yield flush()

    return texts(docs).mapInArrow(run, f"chunk long, ids array<{kind}>, train array<boolean>, sizes binary, tokens binary, words array<long>, own array<long>")


# ---- probabilities


def discounts(n: list[int]) -> np.ndarray:
    """Factors for counts 0 to CUTOFF from the numbers n[r] of types met r times (r to CUTOFF + 1).

    Good-Turing's as Katz has them; where the numbers do not support these, half a count is taken off.
    """
    d = np.ones(CUTOFF + 1)
    r = np.arange(1, CUTOFF + 1)
    plain = (r - 0.5) / r
    n = np.asarray(n, float)
    if (n[1 : CUTOFF + 2] > 0).all():
        rest = (CUTOFF + 1) * n[CUTOFF + 1] / n[1]
        turing = ((r + 1) * n[2 : CUTOFF + 2] / n[1 : CUTOFF + 1] / r - rest) / (1 - rest) if rest < 1 else np.zeros(CUTOFF)
        plain = turing if ((turing > 0) & (turing < 1)).all() else plain
    d[1:] = plain
    return d


def taken_off(count: np.ndarray, d: np.ndarray) -> np.ndarray:
    """How much of a count the discount takes: beyond the cutoff as much as at it."""
    return np.where(count <= CUTOFF, count * (1 - d[np.where(count <= CUTOFF, count, 0)]), CUTOFF * (1 - d[CUTOFF]))


@dataclass
class Tokens:
    """Single tokens. A token of number i was met counts[k] times, k the last step with firsts[k] <= i."""

    firsts: np.ndarray
    counts: np.ndarray
    total: int
    distinct: int
    train_docs: int
    d: np.ndarray
    share: float  # of the mass that known tokens keep
    unknown: float
    end: int  # the number of the end

    def count(self, ids: np.ndarray) -> np.ndarray:
        """How often each token was met in training, or followed by another: the start stands before every text."""
        known = self.counts[np.maximum(0, np.searchsorted(self.firsts, ids, side="right") - 1)] if len(self.firsts) else np.zeros(len(ids), np.int64)
        return np.where(ids >= FIRST, known, np.where(ids == START, self.train_docs, 0))

    def single(self, ids: np.ndarray) -> np.ndarray:
        c = self.count(ids)
        kept = c * self.d[np.where(c <= CUTOFF, c, 0)]
        return np.where(ids >= FIRST, self.share * kept / max(1, self.total), self.unknown)


@dataclass
class Frequent:
    """Counts of the pairs, and triples, too frequent for a bucket; keys are sorted hashes."""

    pairs: tuple[np.ndarray, np.ndarray]
    triples: tuple[np.ndarray, np.ndarray]

    @staticmethod
    def counts(known: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
        """The count of each key, 0 for those that are not frequent."""
        if not len(known[0]):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(known[0], keys), len(known[0]) - 1)
        return np.where(known[0][at] == keys, known[1][at], 0)

    def bucket(self, u, v, w, buckets: int) -> np.ndarray:
        pair = key_of(v, w)
        if len(self.pairs[0]):
            at = np.flatnonzero(self.counts(self.pairs, pair) > 0)
            triple = key_of(u[at], v[at], w[at])
            hot = self.counts(self.triples, triple) > 0
            pair[at] = np.where(hot, mix(np.arange(len(at))), triple)
        return (pair % np.uint64(buckets)).astype(np.int64)


def _grams(sizes: np.ndarray, w: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The two predecessors of each token, the farther first."""
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    v = np.concatenate([[start], w[:-1]])
    v[first] = start
    u = np.concatenate([[start], v[:-1]])
    u[first] = start
    return u, v


@contextmanager
def _shuffles_end(spark: SparkSession):
    """Shuffle files go with the query that wrote them: each step's result is a table."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


# ---- training


@dataclass
class Model:
    tokens: Tokens
    frequent: object  # broadcast of Frequent
    buckets: int
    vocabulary: DataFrame  # w (hash), c, id
    occurrences: DataFrame  # bucket, blob of (v, w, u, chunk, 2 * place + training)
    about: DataFrame  # chunk, ids, train, n_tokens, n_known, base
    d2: np.ndarray
    d3: np.ndarray


def _vocabulary(chunks: DataFrame) -> DataFrame:
    """w, c, id: the training tokens, numbered from the most frequent on."""
    own = chunks.select(F.explode(F.arrays_zip("words", "own")).alias("x")).filter("x.own > 0")
    words = own.groupBy(F.col("x.words").alias("w")).agg(F.sum("x.own").alias("c"))
    ranked = written(words.orderBy(F.desc("c"), "w").withColumn("_at", F.monotonically_increasing_id()), "ranked")
    parts = ranked.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count("*").alias("_n")).orderBy("_part").collect()
    # One entry per partition of the sort.
    before = np.concatenate([[0], np.cumsum([p._n for p in parts])]).tolist()
    if not parts:
        return ranked.withColumnRenamed("_at", "id")
    offsets = F.create_map(*[F.lit(x) for p, first in zip(parts, before) for x in (p._part, first)])
    return ranked.select("w", "c", (F.expr("_at & 8589934591") + offsets[F.shiftright("_at", 33)] + FIRST).alias("id"))


def _tokens(words: DataFrame, train_docs: int) -> Tokens:
    # As many rows as there are different counts: at most the root of twice the tokens.
    steps = words.groupBy("c").agg(F.min("id").alias("first"), F.count("*").alias("n")).toArrow()
    counts, firsts, n = (steps[x].to_numpy() for x in ("c", "first", "n"))
    order = np.argsort(firsts)
    met = dict(zip(counts.tolist(), n.tolist()))
    total, distinct = int((counts * n).sum()), int(n.sum())
    d = discounts([0, *(met.get(r, 0) for r in range(1, CUTOFF + 2))])
    left = sum(met.get(r, 0) * r * (1 - d[r]) for r in range(1, CUTOFF + 1)) / max(1, total)
    # With no rare token at all half a token's share is left to unknown ones.
    unknown, share = (left, 1.0) if left > 0 else (0.5 / (total + 1), 1 - 0.5 / (total + 1))
    end = words.filter(F.col("w") == int(np.uint64(_hash(_END)).view(np.int64))).select("id").first()
    return Tokens(firsts[order], counts[order], total, distinct, train_docs, d, share, unknown, end[0] if end else UNKNOWN)


def _numbered(chunks: DataFrame, words: DataFrame, tokens) -> DataFrame:
    """chunk, ids, train, sizes, tokens, numbers: chunks whose tokens are places among the sorted numbers of their words; with n_tokens, n_known, base of each document."""
    own = chunks.select("chunk", F.posexplode("words").alias("k", "w"))
    known = own.join(words.select("w", "id"), "w", "left").groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("k", F.coalesce("id", F.lit(UNKNOWN)).alias("id")))).alias("known"))

    def run(batches):
        t = tokens.value
        for b in slices(batches, 1):
            of, (at,), (sizes, train) = b["known"].flatten().field("id").to_numpy(), unpack(b["tokens"][0].as_py(), 1), unpack(b["sizes"][0].as_py(), 2)
            numbers, place = np.unique(of, return_inverse=True)
            at = place[at]
            c = t.count(numbers)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            base = np.log10((c + 1) / (t.total + t.distinct + 1))
            sums = sizes, np.bincount(doc, c[at] > 0, len(sizes)).astype(np.int64), np.bincount(doc, base[at], len(sizes))
            yield pa.RecordBatch.from_arrays(
                [b["chunk"], b["ids"], b["train"], b["sizes"], pa.array([pack(at)]), pa.array([pack(numbers)]), *(pa.ListArray.from_arrays([0, len(x)], pa.array(x)) for x in sums)],
                names=["chunk", "ids", "train", "sizes", "tokens", "numbers", "n_tokens", "n_known", "base"],
            )

    joined = chunks.drop("words", "own").join(known.select("chunk", F.transform("known", lambda x: F.struct(x["id"].alias("id"))).alias("known")), "chunk")
    ids = chunks.schema["ids"].dataType.simpleString()
    return joined.mapInArrow(run, f"chunk long, ids {ids}, train array<boolean>, sizes binary, tokens binary, numbers binary, n_tokens array<long>, n_known array<long>, base array<double>")


def _read(batches) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """chunk, sizes, train of documents, numbers of words, places of tokens among them."""
    for b in batches:
        for chunk, sizes, at, numbers in zip(b["chunk"].to_pylist(), b["sizes"], b["tokens"], b["numbers"]):
            sizes, train = unpack(sizes.as_py(), 2)
            yield chunk, sizes, train, unpack(numbers.as_py(), 1)[0], unpack(at.as_py(), 1)[0]


def _frequent(numbered: DataFrame, tokens, least: int) -> tuple[Frequent, list[np.ndarray], list[np.ndarray]]:
    """The pairs and triples met more than ``least`` times in training, and their tokens with counts.
    A pair is so frequent only if both tokens are, a triple only if both pairs are."""

    def counted(hot_pairs) -> pa.Table:
        def run(batches):
            t = tokens.value
            for _, sizes, train, numbers, at in _read(batches):
                w = numbers[at]
                u, v = _grams(sizes, w, START)
                keep = np.repeat(train == 1, sizes)
                hot = np.concatenate([t.count(numbers) > least, [t.train_docs > least]])
                _, before = _grams(sizes, at, len(numbers))
                keep &= hot[at] & hot[before]
                u, v, w = u[keep], v[keep], w[keep]
                if hot_pairs is None:
                    u = np.zeros_like(u)
                else:
                    known = hot_pairs.value
                    keep = Frequent.counts(known, key_of(v, w)) > 0
                    keep &= (Frequent.counts(known, key_of(u, v)) > 0) | (v == START)
                    u, v, w = u[keep], v[keep], w[keep]
                rows, n = np.unique(np.stack([u, v, w]), axis=1, return_counts=True) if len(w) else (np.zeros((3, 0), np.int64), np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([*map(pa.array, rows), pa.array(n)], names=["u", "v", "w", "n"])

        counts = numbered.select("chunk", "sizes", "tokens", "numbers").mapInArrow(run, "u long, v long, w long, n long")
        return counts.groupBy("u", "v", "w").agg(F.sum("n").alias("n")).filter(F.col("n") > least).toArrow()

    none = [np.zeros(0, np.int64)] * 4
    t = tokens.value
    if max(int(t.counts.max(initial=0)), t.train_docs) <= least:
        return Frequent((none[0].view(np.uint64), none[0]), (none[0].view(np.uint64), none[0])), none, none

    def by_key(rows: pa.Table, names: tuple[str, ...]):
        cols = [rows[x].to_numpy() for x in ("u", "v", "w", "n")]
        key = key_of(*(rows[x].to_numpy() for x in names))
        order = np.argsort(key)
        return (key[order], cols[3][order]), cols

    pairs, pair_rows = by_key(counted(None), ("v", "w"))
    if not len(pairs[0]):
        return Frequent(pairs, (none[0].view(np.uint64), none[0])), none, none
    triples, triple_rows = by_key(counted(numbered.sparkSession.sparkContext.broadcast(pairs)), ("u", "v", "w"))
    return Frequent(pairs, triples), pair_rows, triple_rows


def _occurrences(numbered: DataFrame, frequent, buckets: int, go: int, goes: int) -> DataFrame:
    """bucket, blob, spread2, spread3: the occurrences of every goes-th bucket from ``go`` on, and how many of its pairs and triples were met how often."""

    def read(batches):
        for chunk, sizes, train, numbers, at in _read(batches):
            if not len(at):
                continue
            w = numbers[at]
            u, v = _grams(sizes, w, START)
            bucket = frequent.value.bucket(u, v, w, buckets)
            place = np.repeat(2 * np.arange(len(sizes)) + train, sizes)
            mine = np.flatnonzero(bucket % goes == go)
            order = mine[_sorted_places(v[mine], w[mine])]
            keys, blobs = _dealt(bucket[order], v[order], w[order], u[order], np.full(len(order), chunk), place[order])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    def count(key: tuple, table: pa.Table) -> pa.Table:
        v, w, u, chunk, place = unpack_all(table["blob"], 5)
        order = _sorted_places(v, w, u)
        v, w, u, chunk, place = (x[order] for x in (v, w, u, chunk, place))
        _, _, c2, c3 = _counts(v, w, u, place, None)
        f = frequent.value
        pairs, triples = _runs(v, w), _runs(v, w, u)
        c2 = c2[f.counts(f.pairs, key_of(v[pairs], w[pairs])) == 0]
        c3 = c3[f.counts(f.triples, key_of(u[triples], v[triples], w[triples])) == 0]
        spread = [[np.bincount(np.minimum(c, CUTOFF + 2), minlength=CUTOFF + 3)[: CUTOFF + 2].tolist()] for c in (c2, c3)]
        return pa.table({"bucket": [key[0].as_py()], "blob": pa.array([pack(v, w, u, chunk, place)], pa.binary()), "spread2": pa.array(spread[0], pa.list_(pa.int64())), "spread3": pa.array(spread[1], pa.list_(pa.int64()))})

    dealt = numbered.select("chunk", "sizes", "tokens", "numbers").mapInArrow(read, "bucket long, blob binary")
    return _by_key(dealt, buckets, "bucket").applyInArrow(count, "bucket long, blob binary, spread2 array<long>, spread3 array<long>")


def _by_key(rows: DataFrame, buckets: int, *keys: str):
    """Rows grouped by keys, over as many tasks as there are buckets: their work is Python's, which their bytes do not tell."""
    return rows.repartition(min(2 * buckets, 20_000), *keys).groupBy(*keys)


def _counts(v, w, u, place, f: Frequent | None):
    """Starts of pairs and of triples among sorted occurrences, and how often each was met in training."""
    pairs, triples = _runs(v, w), _runs(v, w, u)
    if not len(v):
        return pairs, triples, pairs, pairs
    train = place & 1
    c2, c3 = np.add.reduceat(train, pairs), np.add.reduceat(train, triples)
    if f is not None and len(f.pairs[0]):
        hot = f.counts(f.pairs, key_of(v[pairs], w[pairs]))
        c2 = np.where(hot > 0, hot, c2)
        hot = f.counts(f.triples, key_of(u[triples], v[triples], w[triples]))
        c3 = np.where(hot > 0, hot, c3)
    return pairs, triples, c2, c3


def fit(docs: DataFrame, bucket: int = BUCKET, chunk: int = CHUNK) -> tuple[Model, list]:
    """Learn from the documents that are not held out. docs: doc_id, text."""
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    with _shuffles_end(spark):
        chunks = written(_chunks(docs, chunk), "chunks")
        words = _vocabulary(chunks)
        train_docs = chunks.select(F.sum(F.size(F.filter("train", lambda x: x)))).first()[0] or 0
        tokens = _tokens(words, train_docs)
        shared = sc.broadcast(tokens)
        numbered = written(_numbered(chunks, words, shared), "numbered")
        discard(chunks)
        about = written(numbered.select("chunk", "ids", "train", "n_tokens", "n_known", "base"), "about")
        frequent, pairs, triples = _frequent(numbered, shared, max(bucket // 2, CUTOFF + 1, tokens.total // MOST_HOT))
        known = sc.broadcast(frequent)
        buckets = max(1, -(-tokens.total // bucket))
        goes = min(GOES, buckets)
        parts = [written(_occurrences(numbered, known, buckets, k, goes), "occurrences") for k in range(goes)]
        discard(numbered)
        stored = parts[0]
        for p in parts[1:]:
            stored = stored.unionByName(p)
        low = {}
        for name in ("spread2", "spread3"):
            rows = stored.select(F.posexplode(name).alias("r", "n")).groupBy("r").agg(F.sum("n").alias("n")).collect()
            low[name] = discounts([{x.r: x.n for x in rows}.get(r, 0) for r in range(CUTOFF + 2)])
    model = Model(tokens, known, buckets, words, stored.select("bucket", "blob"), about, low["spread2"], low["spread3"])
    return model, [pairs, triples]


# ---- scoring

_ROWS = "kind int, key long, blob binary"
_SUMS, _HISTORY, _ASKED, _WEIGHTS = range(4)


def _row_batch(kind: int, keys, blobs) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(keys), pa.int32()), pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], names=["kind", "key", "blob"])


def _sums(chunk: np.ndarray, place: np.ndarray, value: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Values added up by document, as (place, sum) of each chunk."""
    order = _sorted_places(chunk, place)
    chunk, place, value = chunk[order], place[order], value[order]
    at = _runs(chunk, place)
    if not len(at):
        return [], []
    total, chunk, place = np.add.reduceat(value, at), chunk[at], place[at]
    starts, ends = _cut(chunk)
    return chunk[starts].tolist(), [pack(place[s:e], total[s:e]) for s, e in zip(starts.tolist(), ends.tolist())]


def _bucket(a: np.ndarray, v: np.ndarray, buckets: int) -> np.ndarray:
    return (key_of(a, v) % np.uint64(buckets)).astype(np.int64)


def _histories(a, v, n, left, lower, buckets: int, go: int, goes: int) -> tuple[list[int], list[bytes]]:
    """Histories with what was met after them, what discounts left of it and the followers' lower-order shares, added up; a: the farther token plus one, or 0."""
    mine = np.flatnonzero(_bucket(a, v, buckets) % goes == go)
    order = mine[_sorted_places(v[mine], a[mine])]
    a, v, n, left, lower = (x[order] for x in (a, v, n, left, lower))
    at = _runs(v, a)
    if not len(at):
        return [], []
    n, left, lower = (np.add.reduceat(x, at) for x in (n, left, lower))
    a, v = a[at], v[at]
    return _dealt(_bucket(a, v, buckets), v, a, n, left, lower)


def _backed(t: Tokens, v, w, c2, d2) -> np.ndarray:
    """The discounted share of seen pairs."""
    return (c2 - taken_off(c2, d2)) / np.maximum(1, t.count(v))


def _evaluate(model: Model, tokens, go: int, goes: int):
    """Rows for the histories of every goes-th bucket from ``go`` on; the first go has the sums of documents as well."""
    frequent, buckets, d2, d3 = model.frequent, model.buckets, model.d2, model.d3

    def run(batches):
        t, f = tokens.value, frequent.value
        for b in slices(batches, 1):
            v, w, u, chunk, place = unpack(b["blob"][0].as_py(), 5)
            pairs, triples, c2, c3 = _counts(v, w, u, place, f)
            of_pair = np.searchsorted(pairs, triples, side="right") - 1  # the pair of each triple
            v3, w3, u3, pair2 = v[triples], w[triples], u[triples], c2[of_pair]
            v2, w2 = v[pairs], w[pairs]
            p2 = _backed(t, v2, w2, c2, d2)
            seen, pair = c3 > 0, pair2 > 0
            size = np.diff(np.concatenate([triples, [len(v)]]))
            if go == 0:
                # What a triple adds to its texts: its own term, or the pair's, or the token's; and the
                # number of times that the history (v, w) of the next token was met, as its denominator.
                log = np.zeros(len(triples))
                log[seen] = np.log10(c3[seen] - taken_off(c3[seen], d3))
                log[~seen & pair] = np.log10(p2[of_pair[~seen & pair]])
                log[~pair] = np.log10(t.single(w3[~pair]))
                again = pair & (w3 != t.end)
                log[again] -= np.log10(pair2[again])
                if t.train_docs:
                    log[v3 == START] -= np.log10(t.train_docs)
                yield _row_batch(_SUMS, *_sums(chunk, place >> 1, np.repeat(log, size)))
            # Tokens that back off ask for the weights of the histories they pass.
            asks3, asks2 = np.repeat(~seen, size), np.repeat(~pair, size)
            a = np.concatenate([u[asks3] + 1, np.zeros(int(asks2.sum()), np.int64)])
            asked = np.concatenate([v[asks3], v[asks2]])
            at = np.concatenate([chunk[asks3], chunk[asks2]]), np.concatenate([place[asks3], place[asks2]]) >> 1
            mine = np.flatnonzero(_bucket(a, asked, buckets) % goes == go)
            order = mine[_sorted_places(asked[mine], a[mine])]
            yield _row_batch(_ASKED, *_dealt(_bucket(a[order], asked[order], buckets), asked[order], a[order], at[0][order], at[1][order]))
            own3, own2 = seen, c2 > 0
            if len(f.pairs[0]):  # frequent ones are added once, by the driver
                own3 = seen & (f.counts(f.triples, key_of(u3, v3, w3)) == 0)
                own2 = own2 & (f.counts(f.pairs, key_of(v2, w2)) == 0)
            yield _row_batch(
                _HISTORY,
                *_histories(
                    np.concatenate([u3[own3] + 1, np.zeros(int(own2.sum()), np.int64)]),
                    np.concatenate([v3[own3], v2[own2]]),
                    np.concatenate([c3[own3], c2[own2]]),
                    np.concatenate([taken_off(c3[own3], d3), taken_off(c2[own2], d2)]),
                    np.concatenate([p2[of_pair[own3]], t.single(w2[own2])]),
                    buckets,
                    go,
                    goes,
                ),
            )

    return run


def _frequent_histories(model: Model, pairs: list[np.ndarray], triples: list[np.ndarray], go: int, goes: int) -> list[tuple[int, int, bytes]]:
    """What the frequent pairs and triples add to their histories; bounded as they are."""
    t, f = model.tokens, model.frequent.value
    _, v2, w2, c2 = pairs
    u3, v3, w3, c3 = triples
    p3 = _backed(t, v3, w3, f.counts(f.pairs, key_of(v3, w3)), model.d2)
    keys, blobs = _histories(
        np.concatenate([u3 + 1, np.zeros(len(v2), np.int64)]), np.concatenate([v3, v2]), np.concatenate([c3, c2]),
        np.concatenate([taken_off(c3, model.d3), taken_off(c2, model.d2)]), np.concatenate([p3, t.single(w2)]), model.buckets, go, goes,
    )
    return [(_HISTORY, k, bytearray(b)) for k, b in zip(keys, blobs)]


def weigh(blobs, asked) -> tuple[list[np.ndarray], list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """v, a and the log of the backoff weight of each history (for pairs times their count, which their
    tokens were divided by), and the chunk, place and log weight of every token that asks."""
    v, a, n, left, lower = unpack_all(blobs, 5)
    order = _sorted_places(v, a)
    v, a, n, left, lower = (x[order] for x in (v, a, n, left, lower))
    at = _runs(v, a)
    if len(at):
        v, a = v[at], a[at]
        n, left, lower = (np.add.reduceat(x, at) for x in (n, left, lower))
    log = np.log10(left / np.maximum(1 - lower, 1e-15)) - np.where(a == 0, np.log10(np.maximum(n, 1)), 0.0)
    answers = []
    if len(asked):
        qv, qa, chunk, place = unpack_all(asked, 4)
        both = np.concatenate([v, qv]), np.concatenate([a, qa]), np.concatenate([np.zeros(len(v), np.int64), np.ones(len(qv), np.int64)])
        order = _sorted_places(*both)
        own = order < len(v)
        last = np.maximum.accumulate(np.where(own, order, -1))  # the history that each row follows
        rows, last = order[~own] - len(v), last[~own]
        same = (last >= 0) & (v[np.maximum(last, 0)] == qv[rows]) & (a[np.maximum(last, 0)] == qa[rows]) if len(v) else np.zeros(len(rows), bool)
        rows = rows[same]
        answers.append((chunk[rows], place[rows], log[last[same]]))
    return [v, a, log], answers


def score(model: Model, frequent_rows: list) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text that was read."""
    spark = model.occurrences.sparkSession
    shared = spark.sparkContext.broadcast(model.tokens)

    def gathered(key: tuple, table: pa.Table) -> pa.Table:
        kind, number = key[0].as_py(), key[1].as_py()
        if kind == _SUMS:
            place, total = unpack_all(table["blob"], 2)
            return pa.Table.from_batches([_row_batch(_SUMS, *_sums(np.full(len(place), number), place, total))])
        what = table["what"].to_numpy()
        stored, answers = weigh(table["blob"].filter(pa.array(what == _HISTORY)), table["blob"].filter(pa.array(what == _ASKED)))
        out = [_row_batch(_WEIGHTS, [number], [pack(*stored)])]
        out += [_row_batch(_SUMS, *_sums(*a)) for a in answers]
        return pa.Table.from_batches(out)

    def whole(key: tuple, about: pa.Table, sums: pa.Table) -> pa.Table:
        place, total = unpack_all(sums["blob"], 2)
        score = np.bincount(place, total, len(about["ids"][0]))
        flat = lambda name: about[name].combine_chunks().flatten()
        return pa.table({"doc_id": flat("ids"), "held_out": pa.compute.invert(flat("train")), "n_tokens": flat("n_tokens"), "n_known": flat("n_known"), "base_score": flat("base"), "score": score})

    goes, found = min(GOES, model.buckets), None
    with _shuffles_end(spark):
        for go in range(goes):
            rows = model.occurrences.mapInArrow(_evaluate(model, shared, go, goes), _ROWS)
            if extra := _frequent_histories(model, *frequent_rows, go, goes):
                rows = rows.unionByName(spark.createDataFrame(extra, _ROWS))
            # Histories and those that ask for them meet; sums of documents stay apart.
            rows = rows.select(F.when(F.col("kind") == _SUMS, _SUMS).otherwise(_HISTORY).alias("kind"), "key", F.col("kind").alias("what"), "blob")
            part = written(_by_key(rows, model.buckets, "kind", "key").applyInArrow(gathered, _ROWS), "weights")
            found = found.unionByName(part) if found is not None else part
    discard(model.occurrences)
    sums = found.filter(F.col("kind") == _SUMS).select(F.col("key").alias("chunk"), "blob")
    fields: StructType = model.about.schema
    kind = fields["ids"].dataType.elementType.simpleString()
    out = model.about.groupBy("chunk").cogroup(sums.groupBy("chunk")).applyInArrow(whole, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens.total).cast("long").alias("train_tokens"), "base_score", "score")


def katz_scores(docs: DataFrame, bucket: int = BUCKET, chunk: int = CHUNK) -> DataFrame:
    """Learn from the documents that are not held out, and score every one."""
    return score(*fit(docs, bucket, chunk))
