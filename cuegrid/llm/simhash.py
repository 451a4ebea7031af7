"""Operator 10: near-duplicates by SimHash fingerprints and tables of pivot distances.

Distances of every distinct fingerprint to 37 reference fingerprints (pivots) are tabled: one
base pivot, and for each of six ranges of bits six pivots that differ from the base within the
range alone. A pair at distance d differs by at most d in every coordinate. As at most three
ranges hold the three bits in which linked fingerprints may differ, their coordinates, taken
relative to the base, agree in three ranges at least: pairs are sought among fingerprints that
agree there (20 choices of three ranges), those with a coordinate differing by more than three
are discarded, and the survivors are verified by their full distance. Cells of many
fingerprints are cut into blocks, whose pairs are searched by as many tasks; a task reports
the links that join its fingerprints, not all pairs.

Null and empty texts, and those without words, have fingerprint zero and link like any other.
Repeated rows share a fingerprint. Null ids stay, and never name a component. An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuegrid.llm.common import slices, texts, written
from cuegrid.llm.components import components

SHINGLE = 3
SEED = 42
DISTANCE = 3
BLOCK = 2048
RANGES = 6
PIVOTS_PER_RANGE = 6
_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def hashes(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """The hash of every window of ``shingle`` words, repeats included; of the whole text if shorter, none without words."""
    w = text.encode().lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    s = [b" ".join(w)] if len(w) < shingle else map(b" ".join, zip(*(w[k:] for k in range(shingle))))
    return np.fromiter(map(_hash, s), np.uint64)


def majority(h: np.ndarray) -> int:
    """The number whose bits are set in over half of the hashes; zero for none."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 65536):
        ones += np.unpackbits(h[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    return majority(hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp: the fingerprint of each whole text as a signed 64-bit number."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b["text"]], np.uint64)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return texts(docs).mapInArrow(run, f"doc_id {kind}, fp long")


def pivots() -> tuple[int, list[list[int]]]:
    """The base pivot and those of each range, by a fixed rule: about half the bits of the range differ."""
    rng = np.random.default_rng(10)
    base = int(rng.integers(0, 1 << 63)) << 1 | 1
    out, at = [], 0
    for r in range(RANGES):
        width = 64 // RANGES + (r < 64 % RANGES)
        own = []
        for _ in range(PIVOTS_PER_RANGE):
            mask = sum(1 << int(at + k) for k in rng.permutation(width)[: width // 2])
            own.append(base ^ mask)
        out.append(own)
        at += width
    return base, out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _cells(fp: Column) -> Column:
    """For every three ranges, a key of the coordinates there relative to the base pivot."""
    base, ranged = pivots()
    to = lambda p: F.bit_count(fp.bitwiseXOR(F.lit(_signed(p))))
    signatures = [F.xxhash64(F.lit(r), *[to(p) - to(base) for p in own]) for r, own in enumerate(ranged)]
    return F.transform(F.array(F.array(*signatures)), lambda s: F.array(*[F.xxhash64(s[a], s[b], s[c]) for a, b, c in combinations(range(RANGES), RANGES - DISTANCE)]))[0]


def linked(fps: np.ndarray, table: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of positions at most ``distance`` apart: discard by coordinates, then verify."""
    order = np.argsort(table[0], kind="stable")
    table, sorted_fps = table[:, order], fps[order]
    ends = np.searchsorted(table[0], table[0].astype(np.int64) + distance, side="right")
    found = []
    step = max(1, 1_000_000 // max(1, len(fps)))
    for k in range(0, len(fps), step):
        rows = np.arange(k, min(k + step, len(fps)))
        n = ends[rows] - rows - 1
        i = np.repeat(rows, n)
        j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + i + 1
        for coordinate in table[1:]:
            if len(i) < 64:
                break
            near = np.abs(coordinate[i].astype(np.int16) - coordinate[j]) <= distance
            i, j = i[near], j[near]
        near = np.bitwise_count(sorted_fps[i] ^ sorted_fps[j]) <= distance
        found.append((order[i[near]], order[j[near]]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[list[int], list[int]]:
    """Of the links i-j, those that join two parts not joined before."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    left, right = [], []
    for a, b in zip(i.tolist(), j.tolist()):
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            left.append(a)
            right.append(b)
    return left, right


def links(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """a, b: links of distinct fingerprints ``fp`` that join all which are linked, directly or not."""
    cells = prints.select("fp", F.explode(_cells(F.col("fp"))).alias("cell"))
    counts = cells.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1")
    placed = cells.join(counts, "cell").withColumn("_blocks", F.ceil(F.col("n") / block)).withColumn("_block", F.pmod(F.xxhash64("fp", "cell"), "_blocks"))
    pairs = placed.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    lists = pairs.groupBy("cell", F.least("_block", "_other").alias("_i"), F.greatest("_block", "_other").alias("_j")).agg(F.collect_list("fp").alias("fps"))
    base, ranged = pivots()
    all_pivots = np.array([base, *(p for own in ranged for p in own)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = [], []
            column = b["fps"]
            flat, ends = column.flatten().to_numpy().view(np.uint64), np.asarray(column.offsets)
            ends = ends - ends[0]
            size = np.diff(ends)
            two = ends[:-1][size == 2]
            x, y = flat[two], flat[two + 1]
            near = np.bitwise_count(x ^ y) <= DISTANCE
            left.append(x[near])
            right.append(y[near])
            for k in np.flatnonzero(size > 2):
                fps = flat[ends[k] : ends[k + 1]]
                i, j = linked(fps, np.bitwise_count(fps[None, :] ^ all_pivots[:, None]))
                i, j = _forest(len(fps), i, j)
                left.append(fps[i])
                right.append(fps[j])
            a, c = (np.concatenate(v).view(np.int64) for v in (left, right))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c)], names=["a", "b"])

    return lists.select("fps").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id: the least id of the documents reachable by links."""
    marked = written(fingerprints(docs, shingle), "fingerprints")
    prints = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints")
    roots = components(links(prints.select("fp")))
    rooted = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """docs without the documents whose near-duplicate group has one of a smaller id.

    Documents with a null id stay. Of rows that repeat an id, all stay or go together.
    """
    groups = near_duplicates(docs, shingle)
    gone = groups.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
