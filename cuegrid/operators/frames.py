"""Signatures, key-frame spans, static features, bands."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuegrid.operators.chunks import fold_in_chunks
from cuegrid.sources.storage import written


def _in_item():
    return Window.partitionBy("item_id").orderBy("frame_idx")


def seq_diff(frame_sig: DataFrame) -> DataFrame:
    """item_id, frame_idx, diff: mean absolute difference from the row before; the first has infinity."""
    prev = F.lag("sig").over(_in_item())
    rows = frame_sig.withColumn("_prev", prev)
    total = F.aggregate(F.zip_with("sig", "_prev", lambda a, b: F.abs(a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return rows.select("item_id", "frame_idx", F.when(F.col("_prev").isNull(), float("inf")).otherwise(total / F.size("sig")).alias("diff"))


def _overlap(prev: str, cur: str) -> dict:
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    n = lambda c: F.size(F.filter(c, lambda x: x > 0))
    base = add(F.transform(prev, lambda x: x.cast("double"))) / F.size(prev)
    removed = add(F.zip_with(prev, cur, lambda a, b: F.greatest(a.cast("double") - b.cast("double"), F.lit(0.0)))) / F.size(prev)
    both = F.size(F.filter(F.zip_with(prev, cur, lambda a, b: F.least(a, b)), lambda x: x > 0))
    more = F.greatest(n(prev), n(cur))
    return {
        "base": base,
        "removed": F.when(base < 0.5, 0.0).otherwise(removed / base),
        "removed_abs": F.when(base < 0.5, 0.0).otherwise(removed),
        "overlap": F.when(more > 0, both / more).otherwise(0.0),
        "prev_pixels": n(prev),
    }


def seq_overlap(frame_sig: DataFrame) -> DataFrame:
    """removed (share and absolute), overlap and pixels before, against the row before; nothing before gives 0."""
    rows = frame_sig.withColumn("_prev", F.coalesce(F.lag("sig").over(_in_item()), F.transform("sig", lambda x: x * 0)))
    return rows.select("item_id", "frame_idx", *[c.alias(k) for k, c in _overlap("_prev", "sig").items() if k != "base"])


def spans(diffs: DataFrame, threshold: float, max_run: int = 10, replaced: DataFrame | None = None, settle_frames: int = 2) -> DataFrame:
    """item_id, span_no, start_idx, end_idx, key_idx.

    Changed frames run together; every max_run of them make a span, which ends before the next
    one starts. The key is the last frame before the next start, or the last of max_run. A changed
    frame of ``replaced`` (item_id, frame_idx), where one text replaced another, ends an open span
    and starts the next, whose run it does not count in; an open span outlives pauses of less than
    settle_frames. All but these frames follows from windows: they are folded by themselves.
    """
    place = (F.row_number().over(_in_item()) - 1).cast("long")
    rows = diffs.select("item_id", "frame_idx", (F.col("diff") >= threshold).alias("changed"), place.alias("i"))
    before = F.last(F.when(F.col("changed"), F.col("i")), ignorenulls=True).over(_in_item().rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("last", before)
    if replaced is None:
        rows = rows.withColumn("cut", F.lit(False))
    else:
        cuts = replaced.select("item_id", "frame_idx", F.lit(True).alias("_cut")).distinct()
        rows = rows.join(cuts, ["item_id", "frame_idx"], "left").withColumn("cut", F.col("changed") & F.coalesce("_cut", F.lit(False))).drop("_cut")
    gap = F.col("i") - F.col("last")
    # A run begins as after a closed span, unless a replacement begins it behind a short pause.
    fresh = F.col("changed") & ((gap > 1) | gap.isNull()) & ~(F.col("cut") & F.coalesce(gap <= settle_frames, F.lit(False)))
    rows = rows.withColumn("fresh", fresh).withColumn("base", F.when(F.col("fresh"), F.col("i") - 1))
    if replaced is not None:
        rows = rows.withColumn("stretch", F.sum(F.col("fresh").cast("int")).over(_in_item()))
        first = F.max("base").over(Window.partitionBy("item_id", "stretch"))
        asked = rows.withColumn("first", first).filter("cut AND NOT fresh").select("item_id", "stretch", "i", "last", "first")
        found = fold_in_chunks(asked, ["item_id", "stretch"], ["i"], _counting(max_run), lambda state: [], "i long, base long").select("item_id", "i", F.col("base").alias("_base"))
        rows = rows.join(found, ["item_id", "i"], "left").withColumn("base", F.coalesce("base", "_base"))
    # n: the changed frames counted since the last start; a replacement that starts a span counts none.
    rows = rows.withColumn("_n", F.when(F.col("changed"), F.col("i") - F.last("base", ignorenulls=True).over(_in_item())))
    begins = (F.col("_n") == 0) | (F.col("base") == F.col("i") - 1) | ((F.col("_n") > 1) & ((F.col("_n") - 1) % max_run == 0))
    rows = rows.withColumn("_span", F.sum(F.coalesce(begins, F.lit(False)).cast("int")).over(_in_item()))
    full = F.max(F.when((F.col("_n") > 0) & (F.col("_n") % max_run == 0), F.col("frame_idx")))
    out = rows.filter("_span > 0").groupBy("item_id", "_span").agg(F.min("frame_idx").alias("start_idx"), F.max("frame_idx").alias("end_idx"), full.alias("_full"))
    return out.select("item_id", (F.col("_span") - 1).cast("int").alias("span_no"), "start_idx", "end_idx", F.coalesce("_full", "end_idx").alias("key_idx"))


def _counting(max_run: int):
    """The fold of replacements (place, last changed place before, base of the stretch) to the base that each
    counts from: its own place if it ends an open span, the one before it if a full run had closed that span."""

    def fold(state: list | None, rows: Iterator[tuple]) -> tuple[list[tuple], list]:
        out, base = [], state[0] if state else None
        for i, last, first in rows:
            n = last - (first if base is None else base)
            base = i - 1 if n > 0 and n % max_run == 0 else i
            out.append((i, base))
        return out, [base]

    return fold


def replacements(frame_sig: DataFrame, least_pixels: int = 800) -> DataFrame:
    """item_id, frame_idx where one text replaced another: most strokes gone and little overlap."""
    gone = (F.col("removed") >= 0.5) & (F.col("removed_abs") >= 1.5) & (F.col("prev_pixels") >= least_pixels) & (F.col("overlap") < 0.35)
    return seq_overlap(frame_sig).filter(gone).select("item_id", "frame_idx")


def merge_spans(spans: DataFrame, frame_sig: DataFrame) -> DataFrame:
    """Spans whose key text still stands at the next key become one with it."""
    keyed = spans.join(frame_sig.select("item_id", F.col("frame_idx").alias("key_idx"), "sig"), ["item_id", "key_idx"], "left")
    w = Window.partitionBy("item_id").orderBy("span_no")
    rows = keyed.withColumn("_prev", F.lag("sig").over(w))
    o = _overlap("_prev", "sig")
    merged = F.coalesce((o["base"] >= 0.5) & ((o["removed"] < 0.2) | (o["overlap"] >= 0.5)), F.lit(False))
    rows = rows.withColumn("_new", 1 - merged.cast("int")).withColumn("_group", F.sum("_new").over(w))
    out = rows.groupBy("item_id", "_group").agg(F.min("start_idx").alias("start_idx"), F.max("end_idx").alias("end_idx"), F.max_by("key_idx", "span_no").alias("key_idx"))
    return out.select("item_id", (F.col("_group") - 1).alias("span_no"), "start_idx", "end_idx", "key_idx")


def strip_static(features: DataFrame, ratio: float = 0.8) -> DataFrame:
    """Rows (item_id, pos, feature) without the features that more than ``ratio`` of an item's rows have.
    Items of fewer than two rows stay whole."""
    # Rows go to their item and feature once. Counts of rows, one an item, are written, so that Spark knows how large they are.
    n = written(features.groupBy("item_id").agg(F.countDistinct("pos").alias("_n")).filter("_n >= 2"), "row-counts")
    w = Window.partitionBy("item_id", "feature")
    new = F.col("pos").isNotNull() & ~F.lag("pos").over(w.orderBy("pos")).eqNullSafe(F.col("pos"))
    rows = features.withColumn("_new", new.cast("int")).withColumn("_k", F.sum("_new").over(w)).join(n, "item_id", "left")
    common = F.col("feature").isNotNull() & F.col("_n").isNotNull() & (F.col("_k") > ratio * F.col("_n"))
    return rows.filter(~common).select(*features.columns)


def bands(profile: DataFrame, threshold: int, min_height: int = 4, max_height: int | None = None) -> DataFrame:
    """item_id, y0, y1: runs of rows (item_id, y, n) at the threshold or above, over gaps of one row."""
    w = Window.partitionBy("item_id").orderBy("y")
    loud = profile.filter(F.col("n") >= threshold).withColumn("_new", F.coalesce(F.col("y") - F.lag("y").over(w) > 2, F.lit(True)).cast("int"))
    out = loud.withColumn("_band", F.sum("_new").over(w)).groupBy("item_id", "_band").agg(F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"))
    height = F.col("y1") - F.col("y0")
    return out.filter((height >= min_height) & (F.lit(True) if max_height is None else height <= max_height)).select("item_id", "y0", "y1")


def pack_frames(frames: DataFrame, most: int = 15, limit: int = 3100, sep: int = 44) -> DataFrame:
    """frames (item_id, frame_idx, h) with batch_no: as many of a height as fit a long image."""
    step = F.greatest(F.lit(1), F.least(F.lit(most), F.floor((limit - sep) / (F.first("h").over(_in_item().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) + sep))))
    return frames.withColumn("batch_no", F.floor((F.row_number().over(_in_item()) - 1) / step))


def spans_to_frames(spans: DataFrame, fps: float = 1.0, offset: float = 0.0) -> DataFrame:
    rows = spans.select("item_id", "span_no", "key_idx", F.explode(F.sequence("start_idx", "end_idx")).alias("frame_idx"))
    return rows.withColumn("t_s", F.col("frame_idx") / fps + offset)


def savings(frames: DataFrame, keys: DataFrame) -> DataFrame:
    kept = keys.groupBy("item_id").agg(F.count("*").alias("kept"))
    return frames.groupBy("item_id").agg(F.count("*").alias("frames")).join(kept, "item_id", "left").select("item_id", "frames", F.coalesce("kept", F.lit(0)).alias("kept"), (1 - F.coalesce("kept", F.lit(0)) / F.col("frames")).alias("saved"))
