"""Loudness windows, thresholds, speech spans, time-line checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW_S = 0.25


def loudness_windows(loudness: DataFrame, size: float = WINDOW_S) -> DataFrame:
    """item_id, w, t_s, db: mean power of each window, back in dB."""
    rows = loudness.groupBy("item_id", F.floor(F.col("t_s") / size).alias("w")).agg((10 * F.log10(F.avg(F.pow(F.lit(10.0), F.col("db") / 10)))).alias("db"))
    return rows.select("item_id", "w", (F.col("w") * size).alias("t_s"), "db")


def otsu(windows: DataFrame, bins: int = 64) -> DataFrame:
    """item_id, th: the threshold between loud and quiet windows; null where the levels lie too close.

    The first greatest between-class variance (to six decimals) over equal bins, held within the 5th and 95th
    percentile (by nearest index) less 2 dB, and within 10 dB of the 95th where it stands out.
    """
    by = Window.partitionBy("item_id")
    ranked = windows.select("item_id", "db", (F.row_number().over(by.orderBy("db")) - 1).alias("_i"), F.count("*").over(by).alias("_n"), F.min("db").over(by).alias("_lo"), F.max("db").over(by).alias("_hi"))
    at = lambda p: F.max(F.when(F.col("_i") == F.least(F.col("_n") - 1, F.floor(F.col("_n") * F.lit(p))), F.col("db")))
    levels = ranked.groupBy("item_id").agg(at(0.05).alias("p05"), at(0.5).alias("p50"), at(0.95).alias("p95"), F.max("_n").alias("n"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
    width = F.when(F.col("_hi") > F.col("_lo"), (F.col("_hi") - F.col("_lo")) / bins).otherwise(1.0)
    binned = ranked.groupBy("item_id", "_lo", width.alias("_width"), F.least(F.lit(bins - 1), F.floor((F.col("db") - F.col("_lo")) / width)).alias("bin")).agg(F.count("*").alias("c"))
    mid = F.col("_lo") + (F.col("bin") + 0.5) * F.col("_width")
    run = by.orderBy("bin")
    sums = binned.select("item_id", "bin", "_lo", "_width", F.sum("c").over(run).alias("_wb"), F.sum(F.col("c") * mid).over(run).alias("_sb"), F.sum("c").over(by).alias("_all"), F.sum(F.col("c") * mid).over(by).alias("_sum"))
    wb, wf = F.col("_wb"), F.col("_all") - F.col("_wb")
    between = wb * wf * F.pow(F.col("_sb") / wb - (F.col("_sum") - F.col("_sb")) / wf, 2)
    best = sums.filter(wf > 0).groupBy("item_id").agg(F.max_by(F.col("_lo") + (F.col("bin") + 1) * F.col("_width"), F.struct(F.round(between, 6), -F.col("bin"))).alias("_best"))
    lo, hi = F.col("p05") + 2, F.col("p95") - 2
    th = F.least(F.greatest(F.coalesce("_best", (lo + hi) / 2), lo), hi)
    th = F.when(F.col("p95") - F.col("p50") > 4, F.greatest(th, F.col("p95") - 10)).otherwise(th)
    return levels.join(best, "item_id", "left").select("item_id", F.when(lo < hi, th).alias("th"))


def silence_cuts(windows: DataFrame, thresholds: DataFrame, hyst: float = 10.0, min_silence: float = 0.6) -> DataFrame:
    """item_id, start_s, end_s: quiet from below th - hyst to the next loud window; the last has no end and no least length."""
    w = Window.partitionBy("item_id").orderBy("t_s")
    rows = windows.join(thresholds.filter("th IS NOT NULL"), "item_id").withColumn("_loud", (F.col("db") >= F.col("th")).cast("int"))
    rows = rows.withColumn("_island", F.sum("_loud").over(w))
    islands = rows.groupBy("item_id", "_island").agg(F.min(F.when((F.col("_loud") == 0) & (F.col("db") < F.col("th") - hyst), F.col("t_s"))).alias("start_s"), F.min("t_s").alias("_first"))
    order = Window.partitionBy("item_id").orderBy("_island")
    cuts = islands.withColumn("end_s", F.lead("_first").over(order)).filter("start_s IS NOT NULL")
    return cuts.filter(F.col("end_s").isNull() | (F.col("end_s") - F.col("start_s") >= min_silence)).select("item_id", "start_s", "end_s")


def complement(cuts: DataFrame, bounds: DataFrame) -> DataFrame:
    """item_id, start_s, end_s: what the cuts leave of [t0, t1] of each item (cuts may overlap or stay open)."""
    w = Window.partitionBy("item_id").orderBy("start_s", "end_s")
    rows = cuts.join(bounds, "item_id").withColumn("end_s", F.coalesce("end_s", "t1"))
    reach = F.greatest(F.col("t0"), F.coalesce(F.max("end_s").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("t0")))
    before = rows.select("item_id", reach.alias("start_s"), F.least("start_s", "t1").alias("end_s"))
    tail = rows.groupBy("item_id").agg(F.max("end_s").alias("_end"))
    after = bounds.join(tail, "item_id", "left").select("item_id", F.greatest("t0", F.coalesce("_end", "t0")).alias("start_s"), F.col("t1").alias("end_s"))
    return before.unionByName(after).filter("start_s < end_s")


def speech_segments(windows: DataFrame, thresholds: DataFrame, hyst: float = 10.0, min_silence: float = 0.6, pad: float = 0.2, size: float = WINDOW_S) -> DataFrame:
    """item_id, start_s, end_s: what lies between silences, padded; 0.3 s at least; overlaps become one.
    Only an unmerged end is held to the item's end."""
    bounds = windows.join(thresholds.filter("th IS NOT NULL").select("item_id"), "item_id", "left_semi").groupBy("item_id").agg(F.min("t_s").alias("t0"), (F.max("t_s") + size).alias("t1"))
    spoken = complement(silence_cuts(windows, thresholds, hyst, min_silence), bounds).join(bounds, "item_id")
    rows = spoken.select("item_id", (F.col("start_s") - pad).alias("_s"), (F.col("end_s") + pad).alias("_e"), "t0", "t1").filter(F.col("_e") - F.col("_s") >= 0.3)
    # Starts and ends both grow, so each row meets at most the end of the row before; a first end is clamped.
    w = Window.partitionBy("item_id").orderBy("_s")
    fresh = F.coalesce(F.col("_s") > F.least(F.lag("_e").over(w), F.col("t1")), F.lit(True))
    rows = rows.withColumn("_new", fresh.cast("int")).withColumn("_island", F.sum("_new").over(w))
    out = rows.groupBy("item_id", "_island").agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"), F.count("*").alias("_n"), F.first("t0").alias("t0"), F.first("t1").alias("t1"))
    return out.select("item_id", F.greatest("_s", "t0").alias("start_s"), F.when(F.col("_n") == 1, F.least("_e", "t1")).otherwise(F.col("_e")).alias("end_s"))


def check_timeline(segments: DataFrame) -> DataFrame:
    """item_id, seg_no, start_s, problem: starts that do not grow, and first starts other than 0."""
    w = Window.partitionBy("item_id").orderBy("seg_no")
    before: Column = F.lag("start_s").over(w)
    problem = F.when(before.isNull() & (F.col("start_s") != 0), "first_not_zero").when(F.col("start_s") <= before, "not_increasing")
    return segments.select("item_id", "seg_no", "start_s", problem.alias("problem")).filter("problem IS NOT NULL")
