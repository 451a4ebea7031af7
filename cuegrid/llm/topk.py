"""Operator 5: exact top-k by inner product over norm buckets.

Vectors are grouped by length (each bucket spans a factor of ``ratio``) and cut into blocks. The
longest vectors give every query a first threshold. Then every block is read once by each set of
``QUERIES`` queries: groups of blocks meet sets of queries, so that a vector moves once a set and a
query once a group. In a block, the threshold over the product of the query's and the block's
greatest length is the local cosine threshold: above 1 the block is passed over; if it is high,
vectors are pruned by their coordinates (those on which the query has most weight must lie within
the range that a vector of that cosine can have); else by length alone. Survivors are verified by
the exact product.

Vectors null, or holding null or non-finite components, take no part; of vectors of different
size, the missing components count as zero. Null ids take no part. Repeated rows count each,
and are never a query's own row if the id differs. Ties go to the smaller id. An empty table
gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuegrid.llm.common import written

SCALE = 256
K = 5
BLOCK = 1024
#: Queries of a set and blocks of a group at most: what a task holds.
QUERIES, GROUP = 16384, 32
RATIO = 1.05
#: Vectors of the longest buckets that give the first thresholds, at least.
SEED = 512
#: From this local cosine on, coordinates prune better than length.
COORDINATES_FROM = 0.3
FOCUS = 4
_SLACK = 1e-9


def quantised(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, q (floor of scale times each component, in double) and norm, of the rows that take part."""
    x = F.col("embedding")
    fit = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    q = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    rows = embeddings.filter(F.col("vec_id").isNotNull() & x.isNotNull() & F.coalesce(fit, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), q.alias("q"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("q", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))))


def _blocks(rows: DataFrame, bucket: str, size: int, salt: str) -> DataFrame:
    """One row per block: its bucket, number, greatest norm, ids and vectors; none holds much more than ``size``."""
    counts = rows.groupBy(bucket).agg(F.ceil(F.count("*") / size).alias("_parts"))
    placed = rows.join(counts, bucket).withColumn("_part", F.pmod(F.xxhash64("vec_id", F.lit(salt)), "_parts"))
    return placed.groupBy(bucket, "_part").agg(F.max("norm").alias("top"), F.collect_list(F.struct("norm", "vec_id", "q")).alias("rows"))


def _filled(q: pa.ListArray, width: int = 0) -> np.ndarray:
    """Vectors as rows of doubles, which hold these whole numbers, filled up with zeros."""
    sizes = np.asarray(q.value_lengths())
    out = np.zeros((len(q), max(width, int(sizes.max(initial=0)))))
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = q.flatten().to_numpy()
    return out


def _matrix(rows: pa.ListScalar, width: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, norms and vectors of a block, longest first."""
    s = rows.values
    ids, norms = s.field("vec_id").to_numpy(), s.field("norm").to_numpy()
    order = np.lexsort((ids, -norms))
    return ids[order], norms[order], _filled(s.field("q"), width)[order]


def _exact(vectors: np.ndarray, query: np.ndarray, bound: float) -> np.ndarray:
    """Whole inner products; below 2**53 doubles hold every partial sum."""
    if bound < 2.0**53:
        return vectors @ query
    return np.array([sum(int(a) * int(b) for a, b in zip(v, query)) for v in vectors], object)


def candidates(norms: np.ndarray, vectors: np.ndarray, units: np.ndarray, query: np.ndarray, length: float, least: float) -> np.ndarray:
    """Places of a block (longest first) that may reach ``least``, by length or by coordinates."""
    if not len(norms) or not length:
        return np.arange(len(norms)) if least <= 0 else np.arange(0)
    cosine = least / (length * norms[0]) if norms[0] else (1.0 if least > 0 else -1.0)
    if cosine > 1 + _SLACK:
        return np.arange(0)
    # Length: the product is the length at most. It prunes only for thresholds above zero.
    n = int(np.searchsorted(-norms, -(least / length) * (1 - _SLACK), side="right")) if least > 0 else len(norms)
    if cosine < COORDINATES_FROM:
        return np.arange(n)
    unit = query / length
    focus = np.argsort(-np.abs(unit))[:FOCUS]
    rest = np.sqrt(np.maximum(0, 1 - unit[focus] ** 2) * max(0.0, 1 - cosine**2))
    low, high = unit[focus] * cosine - rest, unit[focus] * cosine + rest
    low, high = np.where(unit[focus] <= -cosine, -1, low), np.where(unit[focus] >= cosine, 1, high)
    near = (units[:n, focus] >= low - _SLACK) & (units[:n, focus] <= high + _SLACK)
    return np.flatnonzero(near.all(axis=1))


def _searched(k: int):
    """The function of a group of blocks and a set of queries: the k best of each block that reach the query's threshold."""

    def run(blocks: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if blocks.num_rows and asked.num_rows:
            qids, lengths, least = asked["vec_id"].to_pylist(), asked["norm"].to_pylist(), asked["least"].to_pylist()
            qs = _filled(asked["q"].combine_chunks())
            for rows, top in zip(blocks["rows"], blocks["top"].to_pylist()):
                needed = [i for i, n in enumerate(least) if n is None or lengths[i] * top * (1 + _SLACK) >= n]
                if not needed:
                    continue
                ids, norms, vectors = _matrix(rows, qs.shape[1])
                units = vectors / np.maximum(norms, 1e-300)[:, None]
                queries = np.pad(qs, ((0, 0), (0, vectors.shape[1] - qs.shape[1])))
                for i in needed:
                    at = np.arange(len(ids)) if least[i] is None else candidates(norms, vectors, units, queries[i], lengths[i], float(least[i]))
                    at = at[ids[at] != qids[i]]
                    if len(at):
                        score = _exact(vectors[at], queries[i], lengths[i] * norms[0])
                        best = np.lexsort((ids[at], -score))[:k]
                        out += [(qids[i], int(ids[at[j]]), int(score[j])) for j in best if least[i] is None or score[j] >= least[i]]
        cols = list(zip(*out)) or [()] * 3
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    return run


def _best(scored: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def top_k(embeddings: DataFrame, is_query=None, k: int = K, block: int = BLOCK, ratio: float = RATIO, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k greatest inner products of each query row with all other rows."""
    is_query = F.col("vec_id") % 50 == 0 if is_query is None else is_query
    rows = quantised(embeddings, scale)
    bucket = F.when(F.col("norm") > 0, F.floor(F.log("norm") / float(np.log(ratio)))).otherwise(F.lit(-1)).cast("long")
    stored = written(_blocks(rows.withColumn("bucket", bucket), "bucket", block, "rows"), "vector-blocks")
    asked = written(rows.filter(is_query), "queries")
    # Buckets are as many as lengths have factors of ``ratio``: some thousands at most.
    sizes = stored.groupBy("bucket").agg(F.sum(F.size("rows")).alias("n"))
    reached = F.sum("n").over(Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1))
    longest = F.broadcast(sizes.withColumn("_before", F.coalesce(reached, F.lit(0))).filter(F.col("_before") < SEED).select("bucket"))
    seeds = stored.filter("_part = 0").join(longest, "bucket", "left_semi")
    seeded = written(_best(_run(seeds, asked.withColumn("least", F.lit(None).cast("long")), k), k), "seeded")
    lasts = seeded.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
    others = stored.filter("_part > 0").unionByName(stored.filter("_part = 0").join(longest, "bucket", "left_anti"))
    more = _run(others, asked.join(lasts.distinct(), "vec_id", "left"), k)
    return _best(seeded.select("query_id", "vec_id", "score").unionByName(more), k).select("query_id", "rank", "vec_id", "score")


def _run(blocks: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: every block against every query (vec_id, q, norm, least), in groups of blocks and sets of queries."""
    n = blocks.count()
    groups = max(1, min(n, max(math.ceil(n / GROUP), 2 * blocks.sparkSession.sparkContext.defaultParallelism)))
    sets = max(1, math.ceil(asked.count() / QUERIES))
    numbers = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = blocks.select("top", "rows", F.pmod(F.xxhash64("bucket", "_part"), F.lit(groups)).cast("int").alias("group")).withColumn("set", numbers(sets))
    right = asked.select("vec_id", "norm", "q", "least", F.pmod(F.xxhash64("vec_id"), F.lit(sets)).cast("int").alias("set")).withColumn("group", numbers(groups))
    return left.groupBy("group", "set").cogroup(right.groupBy("group", "set")).applyInArrow(_searched(k), "query_id long, vec_id long, score long")
