"""Intervals, boxes, tracks and word masks.

Range joins cut every interval into the buckets of time it covers and join on item and bucket.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from cuegrid.functions.boxes import box, iou, overlap, span_box
from cuegrid.functions.matching import Words, any_hit, finder, longest_at, longest_hits, uncovered, word_slices
from cuegrid.functions.times import sample_times
from cuegrid.operators.chunks import fold_in_chunks
from cuegrid.sources.storage import discard, written

BUCKET_S = 10.0
MERGE_GAP_S = 1.0
SAME_PLACE = 0.5
#: Live masks that are looked through without the grid.
FEW = 40
#: Nodes that a task holds before it hands its sets on.
HELD = 1_000_000
#: A track's box may cover this share of the frame.
MOST_OF_FRAME = 0.58


def stab(times: DataFrame, intervals: DataFrame, bucket: float = BUCKET_S, half_open: bool = False) -> DataFrame:
    """Rows of times (item_id, t_s) joined to the intervals (item_id, start_s, end_s) that hold t_s."""
    points = times.withColumn("_bucket", F.floor(F.col("t_s") / bucket))
    covered = F.sequence(F.floor(F.col("start_s") / bucket), F.floor(F.greatest("start_s", "end_s") / bucket))
    ranges = intervals.withColumn("_bucket", F.explode(covered))
    before_end = F.col("t_s") < F.col("end_s") if half_open else F.col("t_s") <= F.col("end_s")
    return points.join(ranges, ["item_id", "_bucket"]).filter((F.col("t_s") >= F.col("start_s")) & before_end).drop("_bucket")


def active_masks(times: DataFrame, masks: DataFrame) -> DataFrame:
    return stab(times, masks.filter("effect NOT IN ('mute', 'cut')"))


def volume_at(times: DataFrame, masks: DataFrame) -> DataFrame:
    """item_id, t_s, volume: the product of all covering factors, 1 if none."""
    found = stab(times.select("item_id", "t_s").distinct(), masks).groupBy("item_id", "t_s").agg(F.product("vol").alias("volume"))
    return times.select("item_id", "t_s").distinct().join(found, ["item_id", "t_s"], "left").select("item_id", "t_s", F.coalesce("volume", F.lit(1.0)).alias("volume"))


def cut(times: DataFrame, masks: DataFrame, rate: float) -> DataFrame:
    """The times outside all cuts, with new_t_s counted on from 0 at ``rate`` a second."""
    inside = stab(times, masks.filter("effect = 'cut'")).select("item_id", "t_s").distinct()
    left = times.join(inside, ["item_id", "t_s"], "left_anti")
    return left.withColumn("new_t_s", (F.row_number().over(Window.partitionBy("item_id").orderBy("t_s")) - 1) / rate)


def cue_at(times: DataFrame, cues: DataFrame) -> DataFrame:
    """item_id, t_s, pos, text of the cue that holds t_s; where cues touch, the later one."""
    found = stab(times.select("item_id", "t_s").distinct(), cues.select("item_id", "pos", "start_s", "end_s", "text"))
    return found.groupBy("item_id", "t_s").agg(F.max("pos").alias("pos"), F.max_by("text", "pos").alias("text"))


def track_edges(boxes: DataFrame, least: float = 0.3) -> DataFrame:
    """a, b: boxes of consecutive frames of an item that overlap enough."""
    prev = boxes.select("item_id", (F.col("frame_idx") + 1).alias("frame_idx"), F.col("box_id").alias("b"), *[F.col(k).alias(f"p{k}") for k in "xywh"])
    met = boxes.join(prev, ["item_id", "frame_idx"])
    return met.filter(iou(box(), box("p")) >= least).select("item_id", F.col("box_id").alias("a"), "b")


def box_recall(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """item_id, seconds, hit_share, half_share: truth seconds met at all, and with half their area."""
    seconds = truth.select("item_id", F.monotonically_increasing_id().alias("_id"), *[F.col(k).alias(f"t{k}") for k in "xywh"], F.explode(F.sequence(F.ceil("start_s"), F.ceil("end_s") - 1)).alias("_s")).withColumn("t_s", F.col("_s").cast("double"))
    met = stab(seconds, pred.select("item_id", "start_s", "end_s", *"xywh"), half_open=True)
    area = met.groupBy("item_id", "_id", "t_s").agg(F.sum(overlap(box(), box("t"))).alias("_area"))
    share = F.coalesce("_area", F.lit(0)) / (F.col("tw") * F.col("th"))
    best = seconds.join(area, ["item_id", "_id", "t_s"], "left").groupBy("item_id", "t_s").agg(F.max(share).alias("_share"))
    return best.groupBy("item_id").agg(F.count("*").alias("seconds"), F.avg((F.col("_share") > 0).cast("double")).alias("hit_share"), F.avg((F.col("_share") >= 0.5).cast("double")).alias("half_share"))


def _rect_iou(a: tuple, b: tuple) -> float:
    side = lambda p, n, q, m: max(0, min(p + n, q + m) - max(p, q))
    inter = side(a[0], a[2], b[0], b[2]) * side(a[1], a[3], b[1], b[3])
    union = a[2] * a[3] + b[2] * b[3] - inter
    return inter / union if inter and union else 0.0


class _Live:
    """The kept masks that later ones can still join, by the size and the place of their boxes.

    Boxes that share half of their union differ in each side by a factor of two at most and in their
    centres by half the smaller side, so they are in the same class of sizes or the next, and in the
    same cell of such a size or the next.
    """

    def __init__(self, kept: list[list]):
        self.kept = {n: m for n, m in enumerate(kept)}
        self.next = len(kept)
        self.cells: dict[tuple, list[int]] = {}
        for n, m in self.kept.items():
            self._place(n, m)

    @staticmethod
    def _classes(m: list) -> tuple[int, int]:
        return int(m[4]).bit_length(), int(m[5]).bit_length()

    def _at(self, m: list, a: int, b: int) -> tuple[int, int]:
        return (2 * m[2] + m[4]) >> (a + 1), (2 * m[3] + m[5]) >> (b + 1)

    def _place(self, n: int, m: list) -> None:
        a, b = self._classes(m)
        self.cells.setdefault((a, b, *self._at(m, a, b)), []).append(n)

    def add(self, m: list) -> None:
        self.kept[self.next] = m
        self._place(self.next, m)
        self.next += 1

    def first_near(self, m: list) -> list | None:
        """The earliest kept mask of the place of m, no more than the gap before it; few are looked through in order."""
        fits = lambda o: m[0] - o[1] <= MERGE_GAP_S and _rect_iou(o[2:6], m[2:6]) >= SAME_PLACE
        if len(self.kept) <= FEW:
            return next((o for o in self.kept.values() if fits(o)), None)
        best, (p, q) = None, self._classes(m)
        for a in (p - 1, p, p + 1):
            for b in (q - 1, q, q + 1):
                if a < 0 or b < 0:
                    continue
                x, y = self._at(m, a, b)
                for cell in ((a, b, x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                    for n in self.cells.get(cell, ()):
                        if (best is None or n < best) and fits(self.kept[n]):
                            best = n
        return None if best is None else self.kept[best]

    def leave(self, now: float) -> list[list]:
        """Take out the masks that end more than the gap before ``now``."""
        gone = [n for n, m in self.kept.items() if now - m[1] > MERGE_GAP_S]
        out = [self.kept.pop(n) for n in gone]
        for n, m in zip(gone, out):
            a, b = self._classes(m)
            self.cells[(a, b, *self._at(m, a, b))].remove(n)
        return out


def _merge_live(state: list | None, rows: Iterator[tuple]) -> tuple[list[tuple], list]:
    live, closed, at_most = _Live(state or []), [], 0
    for row in rows:
        # What has ended leaves when the live ones have doubled, so that leaving costs little a row.
        if len(live.kept) > 2 * at_most + 64:
            closed += map(tuple, live.leave(row[0]))
            at_most = len(live.kept)
        o = live.first_near(row)
        if o is None:
            live.add(list(row))
        else:
            o[1] = max(o[1], row[1])
    return closed + [tuple(m) for m in live.leave(row[0])], list(live.kept.values())


_MASK = "start_s double, end_s double, x int, y int, w int, h int, effect string, vol double"


def merge_masks(masks: DataFrame) -> DataFrame:
    """Masks of one place and at most a second apart become one, which keeps the first box.

    In the order of time each mask joins the earliest kept one that it fits, which may have grown by
    others before. Items are folded in chunks; the state are the masks still in reach. Candidates
    are found by a grid over the sizes and places of their boxes.
    """
    names = [c.split()[0] for c in _MASK.split(", ")]
    rows = masks.select("item_id", *[F.col(n).cast(t).alias(n) for n, t in (c.split() for c in _MASK.split(", "))])
    # A mask equal to the one before joins what that one joined, or that one, and changes nothing; one that covers nothing joins none.
    times = F.expr("IF(w > 0 AND h > 0 AND end_s >= start_s, 1L, n)")
    rows = rows.groupBy("item_id", *names).agg(F.count("*").alias("n")).withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), times))).drop("n", "_k")
    return fold_in_chunks(rows, ["item_id"], names, _merge_live, lambda state: [tuple(m) for m in state or []], _MASK)


def _roots(edges: DataFrame) -> DataFrame:
    """node and root: the edges of a task joined into sets, each node with the least of its set; the least has a row too.

    A task hands its sets on when it holds ``HELD`` nodes, so a node may come again with another root.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(n: int) -> int:
            top = up.setdefault(n, n)
            while (above := up[top]) != top:
                up[top] = up[above]
                top = up[top]
            up[n] = top
            return top

        def rows() -> pa.RecordBatch:
            nodes = list(up)
            tops = [root(n) for n in nodes]
            up.clear()
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(tops, pa.int64())], names=["node", "root"])

        for b in batches:
            for a, z in zip(b["a"].to_pylist(), b["b"].to_pylist()):
                p, q = root(a), root(z)
                if p < q:
                    up[q] = p
                elif q < p:
                    up[p] = q
            if len(up) >= HELD:
                yield rows()
        if up:
            yield rows()

    return edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).mapInArrow(run, "node long, root long")


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """box_id, track: the least box id of each connected component.

    Edges are ranged over the tasks by item (if they have one) and end, and each task joins its own; of
    that, a row a node is left. Where a node has several roots, these are linked, and stars of the links
    are contracted: mostly few, as only items on the edge of a range are in several tasks.
    """
    by = ["item_id", "a"] if "item_id" in edges.columns else ["a"]
    edges = written(edges.select(*by, "b").filter("a IS NOT NULL AND b IS NOT NULL"), "edges")
    roots = written(_roots(edges.repartitionByRange(*by)), "roots")
    discard(edges)
    first = written(roots.groupBy("node").agg(F.min("root").alias("root"), F.max("root").alias("_most")), "first-roots")
    torn = first.filter("root < _most").select("node", F.col("root").alias("a"))
    links = written(roots.join(torn, "node").filter("root <> a").select("a", F.col("root").alias("b")), "links")
    discard(roots)
    found = first.select("node", F.col("root").alias("track"))
    if not links.isEmpty():
        stars = contracted(links)
        found = first.join(stars, first["root"] == stars["hi"], "left").select("node", F.coalesce("track", "root").alias("track"))
    ids = nodes.select("box_id").distinct()
    return ids.join(found, ids["box_id"] == found["node"], "left").select("box_id", F.coalesce("track", "box_id").alias("track"))


def contracted(edges: DataFrame) -> DataFrame:
    """hi, track: of each node of the edges (a, b) but the least of a component, that least.

    Stars are contracted until no edge changes: every box tells its greater neighbours of the
    least one it knows, then its smaller ones; both rounds keep components and shrink their depth,
    and the edges left are those of each box to the least of its component.
    """
    pairs = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi <> lo").distinct()
    pairs = written(pairs, "edges")
    digest = None
    while True:
        both = pairs.union(pairs.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.least(F.min("lo"), F.col("hi")).alias("_m"))
        # The large star: greater neighbours go to the least of the neighbourhood.
        large = both.join(least, "hi").filter("lo > hi").select(F.col("lo").alias("hi"), F.col("_m").alias("lo")).filter("hi <> lo").distinct()
        # The small star: the others, and the box itself, go to the least smaller neighbour.
        low = large.groupBy("hi").agg(F.min("lo").alias("_m"))
        small = large.join(low, "hi").select(F.explode(F.array("hi", "lo")).alias("hi"), F.col("_m").alias("lo")).filter("hi <> lo").distinct()
        before, pairs = pairs, written(small, "edges")
        discard(before)
        now = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("s")).first()
        if now == digest:
            break
        digest = now
    return pairs.groupBy("hi").agg(F.min("lo").alias("track"))


def merge_tracks(boxes: DataFrame, edges: DataFrame, step_s: float, width: int, height: int, effect: str = "blur:20") -> DataFrame:
    """Masks of tracked boxes: the running union of a component's boxes in time, begun anew where it
    would cover too much of the frame; unions too large from the start are dropped.

    A component is folded in chunks of its boxes, so that it may be of any length.
    """
    limit = MOST_OF_FRAME * width * height

    def grow(state: list | None, rows: Iterator[tuple]) -> tuple[list[tuple], list]:
        closed = []
        for frame, _, x0, y0, x1, y1 in rows:
            if state is not None:
                a, b, c, d = min(state[0], x0), min(state[1], y0), max(state[2], x1), max(state[3], y1)
                if (c - a) * (d - b) <= limit:
                    state = [a, b, c, d, state[4], frame]
                    continue
                closed.append(tuple(state))
            state = [x0, y0, x1, y1, frame, frame]
        return closed, state

    def last(state: list | None) -> list[tuple]:
        return [tuple(state)] if state and (state[2] - state[0]) * (state[3] - state[1]) <= limit else []

    c = lambda k: F.col(k).cast("long")
    placed = boxes.join(components(edges, boxes), "box_id").select("item_id", "track", c("frame_idx").alias("frame_idx"), "box_id", c("x").alias("x0"), c("y").alias("y0"), (c("x") + c("w")).alias("x1"), (c("y") + c("h")).alias("y1"))
    r = fold_in_chunks(placed, ["item_id", "track"], ["frame_idx", "box_id"], grow, last, "x0 long, y0 long, x1 long, y1 long, first long, last long")
    return r.select("item_id", (r["first"] * step_s).alias("start_s"), ((r["last"] + 1) * step_s).alias("end_s"), r["x0"].alias("x"), r["y0"].alias("y"), (r["x1"] - r["x0"]).alias("w"), (r["y1"] - r["y0"]).alias("h"), F.lit(effect).alias("effect"), F.lit(1.0).alias("vol"))


def _hits(texts: DataFrame, words: Words, of) -> DataFrame:
    """item_id, pos, start, word: what ``of`` makes of the hits of a slice of words in each text."""
    shared = words.shared
    kinds = {c: texts.schema[c].dataType.simpleString() for c in ("item_id", "pos")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = finder(shared.value)
        for b in batches:
            of_row, starts, found = [], [], []
            for k, text in enumerate(b["text"].to_pylist()):
                for start, word in of(hits(text)):
                    of_row.append(k)
                    starts.append(start)
                    found.append(word)
            at = pa.array(of_row, pa.int32())
            yield pa.RecordBatch.from_arrays([b["item_id"].take(at), b["pos"].take(at), pa.array(starts, pa.int32()), pa.array(found, pa.string())], names=["item_id", "pos", "start", "word"])

    return texts.select("item_id", "pos", "text").mapInArrow(run, f"item_id {kinds['item_id']}, pos {kinds['pos']}, start int, word string")


@F.pandas_udf(ArrayType(StructType([StructField("start", IntegerType()), StructField("word", StringType())])))
def _uncovered(hits: pd.Series) -> pd.Series:
    return pd.Series([uncovered([(h["start"], h["word"]) for h in own]) for own in hits], dtype="object")


def find_words(texts: DataFrame, words: DataFrame) -> DataFrame:
    """item_id, pos, start, word: exact hits, the longest at a place, none inside an earlier one.

    With several slices of words, the longest hit of every place is taken over all of them first.
    """
    return _found(texts, list(word_slices(words, "word")))


def _found(texts: DataFrame, slices: list[Words]) -> DataFrame:
    if len(slices) == 1:
        return _hits(texts, slices[0], longest_hits)
    each = reduce(DataFrame.unionByName, [_hits(texts, s, longest_at) for s in slices])
    longest = each.groupBy("item_id", "pos", "start").agg(F.max_by("word", F.char_length("word")).alias("word"))
    listed = longest.groupBy("item_id", "pos").agg(F.array_sort(F.collect_list(F.struct("start", "word"))).alias("ks"))
    return listed.select("item_id", "pos", F.explode(_uncovered("ks")).alias("k")).select("item_id", "pos", "k.start", "k.word")


def free_boxes(lines: list[int], caps: list[int]) -> list[int | None]:
    """For lines of so many characters, in order, the first free of the boxes (sorted by capacity) that
    holds n to 1.6 n. Each box knows the next that may be free, so that taken ones are passed over at once."""
    after = list(range(len(caps) + 1))

    def free(k: int) -> int:
        while after[k] != k:
            after[k] = after[after[k]]
            k = after[k]
        return k

    out: list[int | None] = []
    for n in lines:
        k = free(bisect_left(caps, n))
        found = k < len(caps) and caps[k] <= 1.6 * n
        out.append(k if found else None)
        if found:
            after[k] = k + 1
    return out


@F.pandas_udf(ArrayType(IntegerType()))
def _free_boxes(lines: pd.Series, caps: pd.Series) -> pd.Series:
    return pd.Series([free_boxes(list(n), list(c)) for n, c in zip(lines, caps)], dtype="object")


def lines_to_boxes(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """lines (item_id, t_s, line_no, line) each with one box (box_no, x, y, w, h) of its frame that
    holds n to 1.6 n characters, the smallest free one first; lines without a box are left out.

    The lines of a frame come in order and take its boxes in the order of capacity and number; the
    two lists meet once, and no option is listed. Frames without lines or boxes give no rows.
    """
    n = F.char_length(F.regexp_replace("line", r"\s+", ""))
    cap = F.rint(F.col("w") / (0.9 * F.greatest("h", F.lit(1)))).cast("int")
    said = lines.select("item_id", "t_s", F.struct("line_no", "line", n.cast("int").alias("n")).alias("l")).filter("l.n > 0").groupBy("item_id", "t_s").agg(F.array_sort(F.collect_list("l")).alias("ls"))
    held = boxes.select("item_id", "t_s", F.struct(cap.alias("cap"), "box_no", *"xywh").alias("b")).groupBy("item_id", "t_s").agg(F.array_sort(F.collect_list("b")).alias("bs"))
    met = said.join(held, ["item_id", "t_s"])
    taken = met.withColumn("k", _free_boxes(F.transform("ls", lambda x: x["n"]), F.transform("bs", lambda x: x["cap"])))
    pairs = taken.select("item_id", "t_s", "bs", F.explode(F.arrays_zip("ls", "k")).alias("p")).filter("p.k IS NOT NULL")
    return pairs.select("item_id", "t_s", "p.ls.line_no", "p.ls.line", F.get("bs", F.col("p.k")).alias("b")).select("item_id", "t_s", "line_no", "line", "b.box_no", *[f"b.{k}" for k in "xywh"])


def word_masks(segments: DataFrame, words: DataFrame, line_boxes: DataFrame, items: DataFrame, pad: float = 0.5, effect: str = "blur:20") -> DataFrame:
    """Masks over the words' boxes at the sample times of the segments that hold them.

    line_boxes: item_id, t_s, box_no, x, y, w, h, line (null where only the box is known);
    items: item_id, width, height, duration. Known lines serve first; only times without any
    are matched by capacity.
    """
    slices = list(word_slices(words, "word"))
    told = reduce(lambda a, b: a | b, [F.coalesce(s.udf(any_hit, "boolean")("text"), F.lit(False)) for s in slices])
    at = segments.filter(told).select("item_id", "start_s", "end_s", "text", F.explode(sample_times(F.col("start_s"), F.col("end_s"))).alias("t_s"))
    known = at.select("item_id", "t_s").join(line_boxes.filter("line IS NOT NULL"), ["item_id", "t_s"])
    bare = line_boxes.filter("line IS NULL").drop("line").join(known.select("item_id", "t_s").distinct(), ["item_id", "t_s"], "left_anti")
    said = at.select("item_id", "t_s", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    matched = lines_to_boxes(said, bare)
    columns = ["item_id", "t_s", "x", "y", "w", "h", "line"]
    lines = known.select(*columns).unionByName(matched.select(*columns))
    # The times of a segment mostly show one line at one place: it is read once, and its hits carry the numbers of its place.
    spans = at.select("item_id", "t_s", "start_s", "end_s").distinct()
    shown = lines.join(spans, ["item_id", "t_s"]).drop("t_s").distinct().join(items, "item_id")
    place = F.struct("start_s", "end_s", "x", "y", "w", "h", "width", "height", "duration", F.char_length("line").alias("n"))
    found = _found(shown.select("item_id", place.alias("pos"), F.col("line").alias("text")), slices)
    rows = found.select("item_id", "pos.*", "start", F.char_length("word").alias("length"))
    x, w, h = span_box(F.col("x"), F.col("w"), F.col("h"), F.col("n"), F.col("start"), F.col("length"))
    rows = rows.select(
        "item_id",
        F.greatest(F.col("start_s") - pad, F.lit(0.0)).alias("start_s"),
        F.least(F.col("end_s") + pad, "duration").alias("end_s"),
        F.greatest(F.lit(0), F.least(x, F.col("width") - 3)).alias("x"),
        F.greatest(F.lit(0), F.least(F.col("y"), F.col("height") - 3)).alias("y"),
        w.alias("_w"),
        h.alias("_h"),
        "width",
        "height",
    )
    clamped = rows.select("item_id", "start_s", "end_s", *[F.col(k).cast("int").alias(k) for k in "xy"], F.least("_w", F.col("width") - F.col("x")).cast("int").alias("w"), F.least("_h", F.col("height") - F.col("y")).cast("int").alias("h"), F.lit(effect).alias("effect"), F.lit(1.0).alias("vol"))
    return merge_masks(clamped)
