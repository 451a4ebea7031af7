"""Near copies by the Jaccard similarity of five-word shingles, as the pipeline links documents.

Operator 10 comes first: SimHash fingerprints of the five-word shingles, linked at 3 bits by its
tables of pivot distances, name candidates among close copies. At a similarity of 0.8 fingerprints
of 64 bits differ by about 10 bits and by up to 20, where pivots discard next to nothing; so the
candidates for what is not connected then come from min-hashes: 24 bands of four, which a pair of
similarity 0.8 shares with a chance of 1 - 3e-6, a closer one with more. Every candidate pair, of
either kind, is verified on the whole shingle sets. Texts of the same set of shingles are one node.
First each node of a band is held against one leader, another in each band, so that a large group
of near copies costs about a comparison a band and member. Nodes of bands that this leaves apart
meet by prefixes: with the shingles of a set in the order of how many such nodes hold them, rarest
first, two sets of that similarity share one of the first fifth of each, and where the first shared
one stands bounds what they can share in all. What many texts hold (a frequent passage, the common
part of loose copies) stands last and makes no pairs. A list of a shingle has ids, places and a
sketch of parities of constant size, whose differing bits bound how far two sets differ; neither
bound loses a pair. The pairs left are rows, verified like the others. Lists are cut into blocks,
whose pairs are searched by as many tasks.

Null and empty texts, and those without words, have no shingles and are linked to nothing. Texts
under five words are one shingle; texts of any length are compared by all their shingles. Repeated
rows are one node. Null ids never name a group. An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuegrid.llm import simhash
from cuegrid.llm.common import slices, texts, written
from cuegrid.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 24
ROWS = 4
#: Bits of a sketch of parities. It parts sets of some thousand shingles; longer ones are parted by places and by themselves.
SKETCH = 2048
#: Nodes of a shingle's list that a task holds against as many others.
BLOCK = 256
_rng = np.random.default_rng(11)
_MIX = _rng.integers(0, 1 << 63, BANDS * ROWS).astype(np.uint64)
_ODD = _rng.integers(0, 1 << 63, BANDS * ROWS).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of the text's windows of ``shingle`` words, in order."""
    return np.unique(simhash.hashes(text, shingle))


def bands(h: np.ndarray) -> list[int]:
    """A hash of the four min-hashes of every band."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for k in range(0, len(h), 4096):
        least = np.minimum(least, ((h[k : k + 4096, None] ^ _MIX) * _ODD).min(axis=0))
    return [xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(least.reshape(BANDS, ROWS))]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if both else 0.0


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, text, node (the set of shingles, null without words), size of the set, fp (SimHash), bands."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [simhash.hashes(t.as_py(), SHINGLE) for t in b["text"]]
            fp = np.array([simhash.majority(h) for h in found], np.uint64).view(np.int64)
            sets = [np.unique(h) for h in found]
            node = [np.uint64(xxhash.xxh64_intdigest(h.tobytes())).view(np.int64).item() if len(h) else None for h in sets]
            keys = [np.array(bands(h) if len(h) else [], np.uint64).view(np.int64) for h in sets]
            columns = [b["doc_id"], b["text"], pa.array(node, pa.int64()), pa.array(list(map(len, sets)), pa.int32()), pa.array(fp), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "node", "size", "fp", "bands"])

    return texts(docs).mapInArrow(run, f"doc_id {kind}, text string, node long, size int, fp long, bands array<long>")


def text_of(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, text: one text of each node asked for."""
    return nodes.select("node", "text").join(asked.select("node"), "node", "left_semi").groupBy("node").agg(F.min("text").alias("text"))


def verified(pairs: DataFrame, nodes: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets have a similarity of ``least`` or more."""
    asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    text = text_of(asked, nodes)
    both = pairs.join(text.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(text.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices([b], 64):
                sets: dict[int, np.ndarray] = {}
                keep = []
                for a, c, x, y in zip(part["a"].to_pylist(), part["b"].to_pylist(), part["x"], part["y"]):
                    for node, t in ((a, x), (c, y)):
                        if node not in sets:
                            sets[node] = shingles(t.as_py())
                    keep.append(similarity(sets[a], sets[c]) >= least)
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _comparable(x: str, y: str, least: float):
    """Sets of these sizes can be as similar as that."""
    return F.least(x, y) >= F.lit(least) * F.greatest(x, y)


def close_pairs(one: DataFrame, least: float) -> DataFrame:
    """a, b: nodes whose fingerprints operator 10 links, by a leader of each fingerprint; to be verified."""
    prints = written(one.groupBy("fp").agg(F.min("node").alias("leader"), F.min_by("size", "node").alias("leader_size"), F.count("*").alias("_n")), "prints")
    same = one.join(prints.filter("_n > 1"), "fp").filter("node <> leader").select("node", "size", "leader", "leader_size")
    side = lambda x: prints.select(F.col("fp").alias(x), "leader", "leader_size")
    linked = simhash.links(prints.select("fp")).join(side("a"), "a").select("b", F.col("leader").alias("node"), F.col("leader_size").alias("size"))
    pairs = same.unionByName(linked.join(side("b"), "b").select("node", "size", "leader", "leader_size"))
    return pairs.filter(_comparable("size", "leader_size", least)).select(F.greatest("node", "leader").alias("a"), F.least("node", "leader").alias("b")).distinct()


def sketch(h: np.ndarray, bits: int = SKETCH) -> bytes:
    """The parities of how many of the hashes fall on each of so many bits."""
    return np.packbits(np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def shingle_sets(apart: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, shingles and sketch: the set of each node, and its parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            held = [shingles(t.as_py()) for t in b["text"]]
            columns = [b["node"], pa.array([h.view(np.int64) for h in held], pa.list_(pa.int64())), pa.array([sketch(h) for h in held], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "shingles", "sketch"])

    return text_of(apart, nodes).mapInArrow(run, "node long, shingles array<long>, sketch binary")


def prefixes(apart: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """shingle, node, root, size, place: the shared ones among the first shingles of each set, rarest first, and their places in it."""
    held = sets.select("node", F.explode("shingles").alias("shingle"))
    shared = held.join(held.groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 1"), "shingle")
    rare = shared.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("shared")).join(apart, "node")
    # Shingles of one node alone come first and take up places; a place past the prefix can begin no such pair.
    alone = F.col("size") - F.size("shared")
    length = F.floor(F.lit(1 - least + 1e-9) * F.col("size")).cast("int") + 1 - alone
    placed = rare.filter(length > 0).select("node", "root", "size", alone.alias("alone"), F.posexplode(F.slice("shared", F.lit(1), length)).alias("k", "s"))
    return placed.select("s.shingle", "node", "root", "size", (F.col("alone") + F.col("k")).alias("place"))


def prefix_lists(listed: DataFrame, sketches: DataFrame, block: int = BLOCK) -> DataFrame:
    """members (node, root, size, place, sketch): the lists of the shingles, cut into blocks that meet two by two.

    A node is in as many lists as its prefix is long, with a sketch of constant size in each, so
    that what is moved grows with the length of its text.
    """
    counts = listed.groupBy("shingle").agg(F.count("*").alias("_n"), F.min("root").alias("_r"), F.max("root").alias("_s")).filter("_r <> _s").select("shingle", F.ceil(F.col("_n") / block).alias("_blocks"))
    placed = listed.join(counts, "shingle").join(sketches.select("node", "sketch"), "node").withColumn("_block", F.pmod(F.xxhash64("node", "shingle"), "_blocks"))
    both = placed.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    lists = both.groupBy("shingle", F.least("_block", "_other").alias("_i"), F.greatest("_block", "_other").alias("_j"))
    return lists.agg(F.collect_list(F.struct("node", "root", "size", "place", "sketch")).alias("members")).select("members")


def prefix_pairs(listed: DataFrame, sketches: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """a, b: nodes of different roots that may be as similar as that; no others are left out.

    They share a shingle at places that leave room for it, and their parities differ in no more bits
    than their sets may differ in shingles: every bit that differs is a shingle of one set alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            flat = b["members"].flatten()
            node, root, size, place = (flat.field(c).to_numpy() for c in ("node", "root", "size", "place"))
            bits = np.frombuffer(b"".join(flat.field("sketch").to_pylist()), np.uint64).reshape(len(node), -1)
            ends = np.append(0, np.cumsum(np.asarray(b["members"].value_lengths())))
            two = ends[:-1][np.diff(ends) == 2]
            candidates = [(two, two + 1)]
            for k in np.flatnonzero(np.diff(ends) > 2):
                for i in range(ends[k], ends[k + 1] - 1, 512):
                    x, y = np.meshgrid(np.arange(i, min(i + 512, ends[k + 1])), np.arange(i + 1, ends[k + 1]), indexing="ij")
                    later = y > x
                    candidates.append((x[later], y[later]))
            found = [np.empty((0, 2), np.int64)]
            for x, y in candidates:
                together = size[x] + size[y]
                room = (np.minimum(size[x] - place[x], size[y] - place[y]) >= least / (1 + least) * together - 1e-6) & (root[x] != root[y])
                x, y, together = x[room], y[room], together[room]
                for i in range(0, len(x), 16384):
                    p, q = x[i : i + 16384], y[i : i + 16384]
                    apart = np.bitwise_count(bits[p] ^ bits[q]).sum(axis=1, dtype=np.int64)
                    close = apart <= (1 - least) / (1 + least) * together[i : i + 16384] + 1e-6
                    found.append(np.sort(np.stack([node[p[close]], node[q[close]]], axis=1), axis=1))
            pairs = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 1]), pa.array(pairs[:, 0])], names=["a", "b"])

    return prefix_lists(listed, sketches, block).mapInArrow(run, "a long, b long").distinct()


def links(nodes: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """a, b: verified links that join all nodes which links join, directly or not."""
    one = written(nodes.filter("node IS NOT NULL").select("node", "size", "fp", "bands").dropDuplicates(["node"]), "one")
    close = written(verified(close_pairs(one.select("node", "size", "fp"), least), nodes, least), "close")
    known = written(components(close).distinct(), "known")
    in_band = written(one.select("node", "size", F.explode("bands").alias("band")), "bands")
    leader = in_band.groupBy("band").agg(F.min(F.struct(F.xxhash64("node", "band").alias("h"), "node", "size")).alias("l"), F.count("*").alias("_n")).filter("_n > 1")
    led = in_band.join(leader, "band").filter(F.col("node") != F.col("l.node"))
    first = led.filter(_comparable("size", "l.size", least)).select(F.greatest("node", "l.node").alias("a"), F.least("node", "l.node").alias("b")).distinct()
    root = lambda x: known.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
    first = written(first.join(root("a"), "a", "left").join(root("b"), "b", "left").filter("NOT coalesce(root_a, a) <=> coalesce(root_b, b)").select("a", "b"), "first")
    near = written(close.unionByName(verified(first, nodes, least)), "links")
    # Nodes of a band that the leaders left apart.
    rooted = in_band.join(leader.select("band"), "band").join(components(near).distinct(), "node", "left").select("band", "node", "size", F.coalesce("root", "node").alias("root"))
    bands_apart = rooted.groupBy("band").agg(F.min("root").alias("_r"), F.max("root").alias("_s")).filter("_r <> _s").select("band")
    apart = written(rooted.join(bands_apart, "band").select("node", "size", "root").distinct(), "apart")
    sets = written(shingle_sets(apart, nodes), "sets")
    listed = written(prefixes(apart, sets, least), "prefixes")
    last = written(prefix_pairs(listed, sets, least), "last")
    return near.unionByName(verified(last, nodes, least))


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, node, component_id: the least id of the documents reachable by links; null without words."""
    nodes = written(marked(docs), "nodes")
    roots = components(links(nodes, least)).distinct()
    first = nodes.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first"))
    rooted = written(first.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")), "rooted")
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("node", "component_id")
    return nodes.select("doc_id", "node").join(named, "node", "left").select("doc_id", "node", "component_id")


def representatives(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """docs without the documents whose group of near copies has one of a smaller id.

    Documents with a null id or a text without words stay. Of rows that repeat an id, all stay or go together.
    """
    groups = near_duplicates(docs, least)
    gone = groups.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
