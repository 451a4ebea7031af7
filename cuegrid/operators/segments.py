"""Segments from frame observations, and sentences of segments."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from cuegrid.functions.similarity import alike, typing_partial
from cuegrid.functions.text import bad_target, few_rows, key_nfkc
from cuegrid.operators.chunks import fold_in_chunks

# Sentence ends, quotes, and the particles that continue a sentence after a quote.
ENDS, OPENS, CLOSES = "。！？!?", "「『", "」』"
CONTINUES = "とだでをはがにのもっなかやゆりし"


def folding(frame_dur: float, threshold: float):
    """The fold of runs (number, first time, last time, text) in order to segments (start, end, text), and its end.

    Alike or growing texts become one, the longest kept; texts caught while still being typed then
    join the full one. The state has a segment of either kind, still open.
    """
    near = frame_dur * 1.5

    def typed(cur: list | None, seg: list, closed: list[tuple]) -> list:
        close = cur is not None and seg[0] <= cur[1] + near
        if close and typing_partial(cur[2], seg[2]):
            return [cur[0], *seg[1:]]
        if close and typing_partial(seg[2], cur[2]):
            return [cur[0], max(cur[1], seg[1]), cur[2]]
        if cur is not None:
            closed.append(tuple(cur))
        return seg

    def fold(state: list | None, rows: Iterator[tuple]) -> tuple[list[tuple], list]:
        closed: list[tuple] = []
        now, full = state or (None, None)
        for _, t, last, text in rows:
            if now and t <= now[1] + near and (text.startswith(now[2]) or alike(now[2], text, threshold)):
                now = [now[0], last + frame_dur, max(now[2], text, key=len)]
            else:
                if now:
                    full = typed(full, now, closed)
                    if t > now[1] + near:
                        closed.append(tuple(full))
                        full = None
                now = [t, last + frame_dur, text]
        return closed, [now, full]

    def finish(state: list | None) -> list[tuple]:
        closed: list[tuple] = []
        now, full = state or (None, None)
        if now:
            full = typed(full, now, closed)
        return closed + ([tuple(full)] if full else [])

    return fold, finish


def fold_segments(rows: list[tuple[float, float, str]], frame_dur: float, threshold: float) -> list[list]:
    """Runs (first time, last time, text) in order to segments [start, end, text]."""
    fold, finish = folding(frame_dur, threshold)
    closed, state = fold(None, ((k, *r) for k, r in enumerate(rows)))
    return [list(s) for s in closed + finish(state)]


def islands(frame_obs: DataFrame, frame_dur: float) -> DataFrame:
    """Non-empty rows with normalised text and island: no merge crosses a gap of more than 2.5 frames.
    Equal neighbours are collapsed to one run (t_s, last_s, text)."""
    w = Window.partitionBy("item_id").orderBy("frame_idx")
    rows = frame_obs.withColumn("text", key_nfkc(F.col("text"))).filter("text <> ''")
    broken = F.coalesce(F.col("t_s") > (F.lag("t_s").over(w) + frame_dur) + frame_dur * 1.5, F.lit(True))
    rows = rows.withColumn("_broken", broken).withColumn("island", F.sum(F.col("_broken").cast("int")).over(w))
    fresh = F.col("_broken") | (F.lag("text").over(w) != F.col("text"))
    rows = rows.withColumn("_fresh", fresh).withColumn("run", F.sum(F.col("_fresh").cast("int")).over(w))
    return rows.groupBy("item_id", "island", "run").agg(F.min("t_s").alias("t_s"), F.max("t_s").alias("last_s"), F.first("text").alias("text"))


def build_segments(frame_obs: DataFrame, frame_dur: float, threshold: float = 0.85, quotes: bool = True) -> DataFrame:
    """item_id, seg_no, start_s, end_s, text of frame_obs (item_id, frame_idx, t_s, text). Long islands are folded in chunks."""
    runs = islands(frame_obs, frame_dur)
    # An island of one run is its segment; only longer ones need the fold.
    alone = Window.partitionBy("item_id", "island")
    runs = runs.withColumn("_n", F.count("*").over(alone))
    single = runs.filter("_n = 1").select("item_id", F.col("t_s").alias("start_s"), (F.col("last_s") + frame_dur).alias("end_s"), "text")
    rows = runs.filter("_n > 1").select("item_id", "island", "run", "t_s", "last_s", "text")
    folded = fold_in_chunks(rows, ["item_id", "island"], ["run"], *folding(frame_dur, threshold), "start_s double, end_s double, text string").drop("island")
    segs = single.unionByName(folded)
    w = Window.partitionBy("item_id").orderBy("start_s", "end_s")
    segs = segs.withColumn("seg_no", F.row_number().over(w) - 1)
    return merge_quotes(segs, frame_dur) if quotes else segs.select("item_id", "seg_no", "start_s", "end_s", "text")


def merge_quotes(segments: DataFrame, frame_dur: float) -> DataFrame:
    """Neighbours of one unclosed quotation become one segment, by windows alone."""
    w = Window.partitionBy("item_id").orderBy("seg_no")
    depth = F.regexp_count("text", F.lit("[「『]")) - F.regexp_count("text", F.lit("[」』]"))
    gap = F.coalesce(F.col("start_s") > F.lag("end_s").over(w) + frame_dur * 1.5, F.lit(True))
    hard = gap | F.col("text").rlike("[「『]") | F.col("text").endswith("。")
    rows = segments.withColumn("_depth", depth).withColumn("_hard", hard).withColumn("_island", F.sum(F.col("_hard").cast("int")).over(w))
    inside = Window.partitionBy("item_id", "_island").orderBy("seg_no")
    rows = rows.withColumn("_open", F.sum("_depth").over(inside))
    merged = F.coalesce(F.lag("_open").over(inside) > 0, F.lit(False)) & ~F.col("_hard")
    rows = rows.withColumn("_new", 1 - merged.cast("int")).withColumn("_group", F.sum("_new").over(w))
    out = rows.groupBy("item_id", "_group").agg(F.min("seg_no").alias("_at"), F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.array_sort(F.collect_list(F.struct("seg_no", "text"))).alias("_rows"))
    number = F.row_number().over(Window.partitionBy("item_id").orderBy("_at")) - 1
    return out.select("item_id", number.alias("seg_no"), "start_s", "end_s", F.array_join(F.transform("_rows", lambda r: r["text"]), "").alias("text"))


def split_sentences(text: str) -> list[str]:
    """Sentences of a text: ends count outside quotes; a quote closes a sentence unless a particle follows.

    An opening quote that nothing closes does not count. Inside a quote an end splits only if
    the next quotation mark opens, since then the closing one was lost.
    """
    last_close = max(map(text.rfind, CLOSES))
    marks = deque(i for i, c in enumerate(text) if c in OPENS + CLOSES)
    out, start, depth = [], 0, 0
    for i, c in enumerate(text):
        follow = text[i + 1 : i + 2]
        cut = False
        if marks and marks[0] <= i:
            marks.popleft()
        if c in OPENS:
            depth += i < last_close
        elif c in CLOSES:
            depth -= 1
            cut = depth <= 0 and not (follow and follow in CONTINUES)
        elif c in ENDS:
            if depth <= 0:
                cut = bool(follow) and follow not in ENDS + CLOSES
            else:
                cut = bool(marks) and text[marks[0]] in OPENS
            depth = 0 if cut else depth
        if cut:
            out.append(text[start : i + 1])
            start = i + 1
    return [s for s in [*out, text[start:]] if s.strip()]


@F.pandas_udf(ArrayType(StringType()))
def sentences_of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in few_rows(parts):
        yield s.map(lambda t: None if t is None else split_sentences(t))


def explode_sentences(texts: DataFrame) -> DataFrame:
    """The rows of texts with sent_no and sentence."""
    return texts.select("*", F.posexplode(sentences_of("text")).alias("sent_no", "sentence"))


def long_plan(items: DataFrame, memo: DataFrame) -> DataFrame:
    """sentence: those of all items that the memo lacks, each once, with the first place seen."""
    rows = explode_sentences(items).groupBy("sentence").agg(F.min(F.struct("item_id", "pos", "sent_no")).alias("first"))
    return rows.join(memo.select(F.col("src").alias("sentence")), "sentence", "left_anti").select("sentence", F.col("first.item_id").alias("first_item"))


def long_assemble(items: DataFrame, memo: DataFrame) -> DataFrame:
    """item_id, pos, tr: the targets of a text's sentences joined; those without one in [[ ]]."""
    known = memo.filter(~bad_target(F.col("dst"))).select(F.col("src").alias("sentence"), "dst")
    rows = explode_sentences(items).join(known, "sentence", "left")
    part = F.coalesce("dst", F.concat(F.lit("[["), F.col("sentence"), F.lit("]]")))
    listed = rows.groupBy("item_id", "pos").agg(F.array_sort(F.collect_list(F.struct("sent_no", part.alias("part")))).alias("_rows"))
    return listed.select("item_id", "pos", F.array_join(F.transform("_rows", lambda r: r["part"]), "").alias("tr"))


def expand_segments(segments: DataFrame, memo: DataFrame) -> DataFrame:
    """item_id, parent, sent_no, start_s, end_s, text, tr: sentences share the segment's span by characters.
    A segment whose own target is good stays whole if some sentence has none."""
    known = memo.filter(~bad_target(F.col("dst"))).select(F.col("src").alias("sentence"), "dst")
    rows = explode_sentences(segments.withColumnRenamed("seg_no", "parent")).join(known, "sentence", "left")
    w = Window.partitionBy("item_id", "parent")
    size = F.char_length("sentence")
    up_to = F.sum(size).over(w.orderBy("sent_no"))
    total, missing = F.sum(size).over(w), F.sum(F.col("dst").isNull().cast("int")).over(w)
    span = F.col("end_s") - F.col("start_s")
    rows = rows.select("*", (F.col("start_s") + span * (up_to - size) / total).alias("_s"), (F.col("start_s") + span * up_to / total).alias("_e"), ((missing > 0) & ~bad_target(F.col("tr"))).alias("_whole"))
    split = rows.filter("NOT _whole").select("item_id", "parent", "sent_no", F.round("_s", 3).alias("start_s"), F.round("_e", 3).alias("end_s"), F.col("sentence").alias("text"), F.col("dst").alias("tr"))
    whole = rows.filter("_whole AND sent_no = 0").select("item_id", "parent", "sent_no", "start_s", "end_s", "text", "tr")
    return split.unionByName(whole)


def collapse_segments(sentences: DataFrame) -> DataFrame:
    """Sentence rows back to whole segments; unfinished targets are skipped."""
    good = F.when(~bad_target(F.col("tr")), F.col("tr"))
    row = F.struct("sent_no", "text", good.alias("tr"))
    listed = sentences.groupBy("item_id", "parent").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.array_sort(F.collect_list(row)).alias("_rows"))
    return listed.select("item_id", F.col("parent").alias("seg_no"), "start_s", "end_s", F.array_join(F.transform("_rows", lambda r: r["text"]), "").alias("text"), F.array_join(F.transform("_rows", lambda r: r["tr"]), "").alias("tr"))
