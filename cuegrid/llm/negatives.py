"""Operator 11: hard negatives in score windows, by best-first search of STR-packed R-trees.

Vectors are packed sort-tile-recursive: Spark ranges them into slabs by the coordinate of most
spread, sorts each slab by the next ones and cuts it into pages; a page is packed the same way into
an R-tree of leaves. A node's box gives an interval of inner products with an anchor, coordinate by
coordinate. Boxes whose interval lies outside the score window are passed over from the root down;
the leaves left wait in a queue for each window, the greatest reachable score first, and the search
ends where the next is strictly below the k-th score found. The page that holds an anchor is
searched first and gives its thresholds for all others. Then every page meets every block of anchors
once, in groups of pages and blocks of bounded size.

The first search of each anchor is for its best rows of the same label, the positives; their scores
give the windows of the second, for rows of another label. Rows with a null id or label, a null
vector, or a component null or not finite take no part; vectors of different size are filled up
with zeros. Ties go to the smaller id. Repeated rows are candidates each, but never of an anchor of
their own id; rows that repeat an anchor's id are one anchor, that of the least label and vector.
A positive of negative score has no window, one of score zero takes negatives of score zero.
Other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuegrid.llm.common import written

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: Rows of a page and of a leaf, children of a node, and coordinates that a page is sorted by.
PAGE, LEAF, FAN, SORTED_BY = 2048, 64, 8, 3
#: Pages of a group and anchors of a block at most: what a task holds.
GROUP, BLOCK = 32, 16384


def quantised(embeddings: DataFrame, asked: Column, scale: int = SCALE) -> DataFrame:
    """vec_id, label, q (whole components) and asked of the rows that take part."""
    x = F.col("embedding")
    fit = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    q = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    rows = embeddings.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fit, F.lit(False)))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), q.alias("q"), F.coalesce(asked, F.lit(False)).alias("asked"))


# ---- pages


def _packed(vectors: np.ndarray) -> tuple[bytes, str]:
    kind = next(t for t in ("int8", "int16", "int32", "int64") if t == "int64" or not vectors.size or (np.iinfo(t).min <= vectors.min() and vectors.max() <= np.iinfo(t).max))
    return vectors.astype(kind).tobytes(), kind


def _matrix(q: pa.ListArray) -> np.ndarray:
    """The vectors of a column as rows, filled up with zeros."""
    sizes = np.asarray(q.value_lengths())
    out = np.zeros((len(q), max(1, int(sizes.max(initial=0)))), np.int64)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = q.flatten().to_numpy(zero_copy_only=False)
    return out


PAGES = "page long, slab int, nth int, n int, ids binary, labels binary, asked binary, vectors binary, kind string"


def pages(rows: DataFrame, page: int = PAGE) -> DataFrame:
    """The rows in pages of ``page`` neighbours: slabs by one coordinate, in each of them by the next."""
    spread = rows.select(F.posexplode("q").alias("i", "x")).groupBy("i").agg(F.var_pop("x").alias("v")).orderBy(F.desc("v"), "i").limit(SORTED_BY).collect()
    at = [F.coalesce(F.get("q", F.lit(r.i)), F.lit(0)) for r in spread] or [F.lit(0)]
    slabs = max(1, math.ceil(math.sqrt(rows.count() / page)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slab, nth, waiting, n = TaskContext.get().partitionId(), 0, [], 0

        def cut(t: pa.Table) -> pa.RecordBatch:
            vectors, kind = _packed(_matrix(t["q"].combine_chunks()))
            packed = [t["vec_id"].to_numpy().astype("int64").tobytes(), t["label"].to_numpy().astype("int32").tobytes(), t["asked"].to_numpy().astype("bool").tobytes(), vectors]
            columns = [pa.array([(slab << 32) + nth], pa.int64()), pa.array([slab], pa.int32()), pa.array([nth], pa.int32()), pa.array([t.num_rows], pa.int32()), *[pa.array([p], pa.binary()) for p in packed], pa.array([kind])]
            return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in PAGES.split(", ")])

        for b in batches:
            waiting.append(b)
            n += b.num_rows
            while n >= page:
                t = pa.Table.from_batches(waiting)
                yield cut(t.slice(0, page))
                nth, n = nth + 1, n - page
                waiting = t.slice(page).to_batches()
        if n:
            yield cut(pa.Table.from_batches(waiting))

    # The hash parts rows of equal coordinate, however many they are.
    ranged = rows.repartitionByRange(slabs, at[0], F.xxhash64("vec_id"))
    return ranged.sortWithinPartitions(*at[1:], "vec_id").mapInArrow(run, PAGES)


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, labels, asked and vectors of a page."""
    vectors = np.frombuffer(row["vectors"], row["kind"]).reshape(row["n"], -1)
    return np.frombuffer(row["ids"], "int64"), np.frombuffer(row["labels"], "int32"), np.frombuffer(row["asked"], "bool"), vectors


def anchors(stored: DataFrame) -> DataFrame:
    """anchor_id, label, q and home (their page) of the rows asked for, one an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ids, labels, asked, vectors = _opened(row)
                q = pa.array(vectors[asked].astype(np.int64).tolist(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(ids[asked]), pa.array(labels[asked]), q, pa.array([row["page"]] * int(asked.sum()), pa.int64())], names=["anchor_id", "label", "q", "home"])

    rows = stored.mapInArrow(run, "anchor_id long, label int, q array<long>, home long")
    return rows.groupBy("anchor_id").agg(F.min(F.struct("label", "q", "home")).alias("a")).select("anchor_id", "a.*")


# ---- the tree of a page


def tiled(vectors: np.ndarray, leaf: int, dims: list[int]) -> np.ndarray:
    """The order of the rows that packs them sort-tile-recursive into leaves of ``leaf``."""

    def tile(rows: np.ndarray, dims: list[int]) -> np.ndarray:
        if len(rows) <= leaf or not dims:
            return rows
        rows = rows[np.argsort(vectors[rows, dims[0]], kind="stable")]
        slices = math.ceil(math.ceil(len(rows) / leaf) ** (1 / len(dims)))
        size = leaf * math.ceil(math.ceil(len(rows) / leaf) / slices)
        return np.concatenate([tile(rows[k : k + size], dims[1:]) for k in range(0, len(rows), size)])

    return tile(np.arange(len(vectors)), dims)


class Tree:
    """An R-tree of the rows of a page: levels of boxes from the leaves up to the root, ``fan`` children a node."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, leaf: int = LEAF, fan: int = FAN):
        dims = np.argsort(-vectors.astype(float).var(axis=0), kind="stable")[:SORTED_BY].tolist()
        order = tiled(vectors, leaf, dims)
        self.ids, self.labels, self.vectors, self.fan = ids[order], labels[order], vectors[order], fan
        starts = np.arange(0, len(order), leaf)
        self.rows = [slice(s, min(s + leaf, len(order))) for s in starts]
        self.levels = [(np.minimum.reduceat(self.vectors, starts, axis=0), np.maximum.reduceat(self.vectors, starts, axis=0))]
        while len(self.levels[-1][0]) > 1:
            low, high = self.levels[-1]
            starts = np.arange(0, len(low), fan)
            self.levels.append((np.minimum.reduceat(low, starts, axis=0), np.maximum.reduceat(high, starts, axis=0)))

    @staticmethod
    def intervals(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest inner product that each query can have in each box, coordinate by coordinate."""
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        return up @ low.T + down @ high.T, up @ high.T + down @ low.T

    def reachable(self, queries: np.ndarray, of: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For each window (the query it is of, its bounds) and leaf the greatest score there that the window
        allows; minus infinity if the leaf, or a node above it, lies outside the window."""
        alive = np.ones((len(of), 1), bool)
        for boxes in reversed(self.levels):
            n = len(boxes[0])
            alive = np.repeat(alive, self.fan, axis=1)[:, :n] if n > 1 else alive
            least, most = self.intervals(queries, *boxes)
            alive &= (least[of] <= high[:, None]) & (most[of] >= low[:, None])
        return np.where(alive, np.minimum(most[of], high[:, None]), -np.inf)

    def search(self, queries: np.ndarray, own_ids: np.ndarray, own_labels: np.ndarray, of: np.ndarray, low: np.ndarray, high: np.ndarray, ties: np.ndarray, same: bool, k: int) -> list[list[tuple[int, int]]]:
        """For each window the (-score, id) of the k best rows of the same (or another) label.

        Every window has a queue of leaves, the greatest reachable score first. All windows take their
        next leaf together, and the windows of one leaf are scored as one product. A window ends where
        its next leaf is strictly below its k-th score. Of rows of score ``low`` only those of an id below
        ``ties`` count.
        """
        reach = self.reachable(queries, of, low, high)
        queue = np.argsort(-reach, axis=1, kind="stable")
        floor, found = low.copy(), [[] for _ in of]
        active = np.arange(len(of))
        for step in range(queue.shape[1]):
            leaf = queue[active, step]
            bound = reach[active, leaf]
            going = (bound >= floor[active]) & (bound > -np.inf)
            active, leaf = active[going], leaf[going]
            if not len(active):
                break
            by_leaf = np.argsort(leaf, kind="stable")
            cuts = np.flatnonzero(np.diff(leaf[by_leaf])) + 1
            for group in np.split(by_leaf, cuts):
                w, rows = active[group], self.rows[leaf[group[0]]]
                scores = (self.vectors[rows] @ queries[of[w]].T).T
                fit = (self.labels[rows][None, :] == own_labels[of[w]][:, None]) == same
                fit &= (scores >= floor[w][:, None]) & (scores <= high[w][:, None]) & (self.ids[rows][None, :] != own_ids[of[w]][:, None])
                fit &= (scores > low[w][:, None]) | (self.ids[rows][None, :] < ties[w][:, None])
                at, row = np.nonzero(fit)
                for i, score, id_ in zip(w[at].tolist(), scores[at, row].tolist(), self.ids[rows][row].tolist()):
                    found[i].append((-int(score), id_))
                for i in np.unique(w[at]).tolist():
                    found[i] = sorted(found[i])[:k]
                    if len(found[i]) == k:
                        floor[i] = max(floor[i], -found[i][-1][0])
        return found


def _exact(vectors: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles where these hold every sum of products, else as whole numbers of Python."""
    bound = float(np.abs(vectors.astype(float)).max(initial=0)) * float(np.abs(queries.astype(float)).max(initial=0)) * vectors.shape[1]
    kind = float if bound < 2.0**53 else object
    return vectors.astype(kind), queries.astype(kind)


def _filled(m: np.ndarray, width: int) -> np.ndarray:
    return np.pad(m, ((0, 0), (0, width - m.shape[1]))) if m.shape[1] < width else m


MOST_ID = np.iinfo(np.int64).max
_FOUND = "anchor_id long, key int, vec_id long, score long"


def _searched(same: bool, k: int, at_home: bool):
    """The function of pages and anchors with their windows: the best rows of each window on each page."""

    def bounds(xs: list, none: float, kind: type) -> np.ndarray:
        # Doubles where they hold the products; whole numbers of Python (and infinities) where not.
        return np.array([none if x is None else x for x in xs], kind)

    def run(pages_: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if pages_.num_rows and asked.num_rows:
            q, home = _matrix(asked["q"].combine_chunks()), asked["home"].to_numpy()
            own_ids, own_labels = asked["anchor_id"].to_numpy(), asked["label"].to_numpy()
            windows = asked["windows"].to_pylist()
            for row in pages_.to_pylist():
                ids, labels, _, vectors = _opened(row)
                here = np.flatnonzero((home == row["page"]) == at_home)
                each = [(n, w) for n, i in enumerate(here.tolist()) for w in windows[i]]
                if not each:
                    continue
                width = max(vectors.shape[1], q.shape[1])
                vectors, queries = _exact(_filled(vectors, width), _filled(q[here], width))
                of = np.array([n for n, _ in each])
                low, high = bounds([w["low"] for _, w in each], -math.inf, vectors.dtype), bounds([w["high"] for _, w in each], math.inf, vectors.dtype)
                ties = np.array([MOST_ID if w["tie"] is None else w["tie"] for _, w in each], np.int64)
                found = Tree(ids, labels, vectors).search(queries, own_ids[here], own_labels[here], of, low, high, ties, same, k)
                out += [(own_ids[here[n]], w["key"], id_, -score) for (n, w), rows in zip(each, found) for score, id_ in rows]
        columns = list(zip(*out)) or [()] * 4
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["anchor_id", "key", "vec_id", "score"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("anchor_id", "key").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def search(stored: DataFrame, asked: DataFrame, same: bool, k: int, group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """anchor_id, key, rank, vec_id, score: the k best rows of the same (or another) label in each window of
    each anchor. asked: anchor_id, label, q, home and windows, an array of (key, low, high), null for no bound.

    The k-th row at home raises the low bound elsewhere; rows of its score count there if their id is below its own.
    """
    no_tie = F.transform("windows", lambda w: w.withField("tie", F.lit(None).cast("long")))
    asked = asked.withColumn("windows", no_tie)
    at_home = stored.withColumn("home", F.col("page")).groupBy("home").cogroup(asked.groupBy("home")).applyInArrow(_searched(same, k, True), _FOUND)
    first = written(_best(at_home, k), "at-home")
    kth = first.filter(F.col("rank") == k).select("anchor_id", "key", F.col("score").alias("kth"), F.col("vec_id").alias("tie"))
    each = asked.select("anchor_id", F.explode("windows").alias("w")).select("anchor_id", "w.key", "w.low", "w.high").join(kth, ["anchor_id", "key"], "left")
    raised = each.groupBy("anchor_id").agg(F.collect_list(F.struct("key", F.greatest("low", "kth").alias("low"), "high", "tie")).alias("windows"))
    sizes = stored.agg(F.count("*").alias("pages"), F.max("nth").alias("nth")).first()
    # No more groups than pages; enough of them for every core, and for what a task may hold.
    groups = max(1, min(sizes.pages, max(math.ceil(sizes.pages / group), 2 * stored.sparkSession.sparkContext.defaultParallelism)))
    blocks = max(1, math.ceil(asked.count() / block))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = stored.withColumn("group", ((F.col("slab").cast("long") * ((sizes.nth or 0) + 1) + F.col("nth")) % groups).cast("int")).withColumn("block", numbers(blocks))
    right = asked.drop("windows").join(raised, "anchor_id").withColumn("block", F.pmod(F.xxhash64("anchor_id"), F.lit(blocks)).cast("int")).withColumn("group", numbers(groups))
    others = left.groupBy("group", "block").cogroup(right.groupBy("group", "block")).applyInArrow(_searched(same, k, False), _FOUND)
    return _best(first.drop("rank").unionByName(others), k).select("anchor_id", "key", "rank", "vec_id", "score")


def windows_of(positives: DataFrame) -> DataFrame:
    """anchor_id and windows: scores of half to 95 hundredths of each positive's."""
    s = F.col("score")
    high = F.call_function("div", s.cast("decimal(38,0)") * F.lit(19).cast("decimal(2,0)"), F.lit(20).cast("decimal(2,0)"))
    window = F.struct("key", (-F.shiftright(-s, 1)).alias("low"), high.alias("high"))
    return positives.filter(s >= 0).groupBy("anchor_id").agg(F.collect_list(window).alias("windows"))


def hard_negatives(embeddings: DataFrame, asked: Column | None = None, page: int = PAGE, scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    asked = F.col("vec_id") % 50 == 0 if asked is None else asked
    rows = written(quantised(embeddings, asked, scale), "vectors")
    stored = written(pages(rows, page), "pages")
    query = written(anchors(stored), "anchors")
    open_ = F.array(F.struct(F.lit(0).alias("key"), F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("high")))
    best = search(stored, query.withColumn("windows", open_), True, POSITIVES)
    positives = written(best.select("anchor_id", F.col("rank").alias("key"), F.col("vec_id").alias("positive_id"), "score"), "positives")
    found = search(stored, written(query.join(windows_of(positives), "anchor_id"), "windows"), False, NEGATIVES)
    named = found.select("anchor_id", "key", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(positives, ["anchor_id", "key"])
    return named.select("anchor_id", "positive_id", "rank", "negative_id", F.col("score").alias("positive_score"), "negative_score")


def relabelled(embeddings: DataFrame) -> DataFrame:
    """The labels of the query's contract: where the id is divisible by 7, the next of ten."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return embeddings.select("vec_id", "embedding", moved.alias("label"))
