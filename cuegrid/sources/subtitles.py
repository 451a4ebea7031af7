"""Subtitle files: charset and format detection, scans of SRT, ASS and TXT, and the sinks.

Files are rows (file_id, content binary); texts are rows (file_id, text). Scans give cues
(item_id, pos, start_s, end_s, text, style, raw_time, sep, fields).
"""

from __future__ import annotations

import codecs
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuegrid.functions.times import ass_clock, parse_clock, srt_clock
from cuegrid.sources.storage import written

# Candidate encodings in the order that breaks ties.
CANDIDATES = ("utf-8", "gb18030", "shift_jis", "euc-kr", "big5")
# The columns of a dialogue line where a file declares none.
DEFAULT_FORMAT = "Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text"
BOM = "﻿"
SKELETON = ["[Script Info]", "ScriptType: v4.00+", "", "[V4+ Styles]", "Format: Name, Fontname, Fontsize, Alignment", "Style: Default,Arial,20,2", "", "[Events]", f"Format: {DEFAULT_FORMAT}"]


# What a character of each class is worth when a text is tried in an encoding.
SCORES = (("[\u3040-\u30ff]", 2), ("\ufffd", -100), ("[\uff61-\uff9f]", -2), ("[\u4e00-\u9fff\uac00-\ud7a3]", 1))
_WORTH = tuple((re.compile(f"{c}+"), n) for c, n in SCORES)


def decoded(content: bytes, candidates: tuple[str, ...] = CANDIDATES) -> tuple[str, str]:
    """Text and label. A byte order mark decides; else the candidate of the best score, the earlier if they tie."""
    for mark, label in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16le"), (codecs.BOM_UTF16_BE, "utf-16be")):
        if content.startswith(mark):
            return content.decode(label, "replace").removeprefix(BOM), label
    best: tuple | None = None
    for label in candidates:
        text = content.decode(label, "replace")
        score = sum(n * sum(len(m) for m in rule.findall(text)) for rule, n in _WORTH)
        if best is None or score > best[0]:
            best = (score, text, label)
    return best[1].removeprefix(BOM), best[2]


def detect_charset(files: DataFrame, candidates: tuple[str, ...] = CANDIDATES) -> DataFrame:
    """file_id, text, label. A byte order mark decides; else the best score, ties to the earlier candidate.

    Every file is tried in all candidates in one pass where it is read; nothing is shuffled.
    """

    @F.pandas_udf("text string, label string")
    def found(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if c is None else decoded(c, candidates) for c in content], columns=["text", "label"])

    return files.select("file_id", found("content").alias("f")).select("file_id", "f.text", "f.label")


def detect_format(texts: DataFrame) -> DataFrame:
    t = F.col("text")
    return texts.withColumn("fmt", F.when(t.contains("[Events]") & t.contains("Dialogue:"), "ass").when(t.contains("-->"), "srt").otherwise("txt"))


def _unix(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, f"^{BOM}", ""), r"\r\n?", "\n")


def _cues(df: DataFrame, **columns: Column) -> DataFrame:
    none = {"style": F.lit(""), "raw_time": F.lit(None).cast("string"), "sep": F.lit(":"), "fields": F.lit(None).cast("array<string>")}
    order = ("start_s", "end_s", "text", "style", "raw_time", "sep", "fields")
    return df.select(F.col("file_id").alias("item_id"), F.col("pos").cast("long").alias("pos"), *[(none | columns)[k].alias(k) for k in order])


def read_srt(texts: DataFrame) -> DataFrame:
    """Blocks between blank lines: an optional counter, a clock line, the body. Others are skipped."""
    blocks = texts.select("file_id", F.posexplode(F.split(_unix(F.col("text")), r"\n\s*\n")).alias("pos", "block"))
    at = r"\d{1,3}:\d{1,2}:\d{1,2}[,.]\d{1,3}"
    rule = rf"(?s)^(?:[ \t]*\d+[ \t]*\n)?[ \t]*({at})\s*-->\s*({at})[^\n]*\n?(.*)$"
    good = blocks.filter(F.col("block").rlike(rule))
    part = lambda k: F.regexp_extract("block", rule, k)
    return _cues(good, start_s=parse_clock(part(1)), end_s=parse_clock(part(2)), text=F.regexp_replace(part(3), r"^\s+|\s+$", ""))


def read_ass(texts: DataFrame) -> DataFrame:
    """Dialogue lines of the events section by the columns its Format line declares; texts keep commas."""
    lines = texts.select("file_id", F.posexplode(F.split(_unix(F.col("text")), "\n")).alias("pos", "line"))
    w = Window.partitionBy("file_id").orderBy("pos")
    s = F.btrim("line", F.lit(" \t"))
    header = s.rlike(r"^\[.*\]$")
    known = lines.withColumn("_section", F.last(F.when(header, F.lower(s)), ignorenulls=True).over(w))
    inside = F.col("_section") == "[events]"
    declared = F.when(inside & s.rlike("(?i)^format:"), F.transform(F.split(F.regexp_replace(s, r"^[^:]*:", ""), ","), lambda c: F.btrim(c)))
    default = F.array(*[F.lit(c.strip()) for c in DEFAULT_FORMAT.split(",")])
    known = known.withColumn("_cols", F.coalesce(F.last(declared, ignorenulls=True).over(w), default))
    said = known.filter(inside & s.startswith("Dialogue:")).withColumn("_n", F.size("_cols"))
    body = F.regexp_replace("line", r"^[^:]*:\s*", "")
    parts = F.expr("split(_body, ',', _n)")
    said = said.withColumn("_body", body).withColumn("_parts", F.concat(parts, F.array_repeat(F.lit(""), F.col("_n") - F.size(parts))))
    index = lambda name, other: F.when(F.array_position("_cols", name) > 0, F.array_position("_cols", name)).otherwise(other).cast("int")
    field = lambda name, other: F.get("_parts", index(name, other) - 1)
    style = F.when(F.array_contains("_cols", "Style"), field("Style", F.lit(1))).otherwise("")
    return _cues(said, start_s=parse_clock(field("Start", F.lit(2))), end_s=parse_clock(field("End", F.lit(3))), text=field("Text", F.col("_n")), style=style, fields=F.col("_parts"))


def read_txt(texts: DataFrame) -> DataFrame:
    """``time:text`` or ``seconds text``; a line without a time continues the cue before, leading ones go."""
    lines = texts.select("file_id", F.posexplode(F.split(_unix(F.col("text")), "\n")).alias("pos", "line")).filter(F.btrim("line", F.lit(" \t")) != "")
    clock, bare = r"^\s*(\d{1,3}:\d{1,2}(?::\d{1,2})?(?:[.,]\d+)?)\s*([:：\s])(.*)$", r"^\s*(\d+(?:\.\d+)?)\s+(.*)$"
    has_clock, timed = F.col("line").rlike(clock), F.col("line").rlike(clock) | F.col("line").rlike(bare)
    x = lambda k, j: F.when(has_clock, F.regexp_extract("line", clock, k)).otherwise(F.regexp_extract("line", bare, j) if j else F.lit(" "))
    rows = lines.select(
        "file_id",
        "pos",
        F.sum(timed.cast("int")).over(Window.partitionBy("file_id").orderBy("pos")).alias("_cue"),
        F.when(timed, F.struct(x(1, 1).alias("raw_time"), x(2, None).alias("sep"))).alias("_t"),
        F.btrim(F.when(timed, x(3, 2)).otherwise(F.col("line")), F.lit(" \t")).alias("_text"),
    ).filter("_cue > 0")
    cues = rows.groupBy("file_id", "_cue").agg(F.min("pos").alias("pos"), F.max("_t").alias("_t"), F.array_sort(F.collect_list(F.struct("pos", "_text"))).alias("_rows"))
    text = F.regexp_replace(F.array_join(F.transform("_rows", lambda r: r["_text"]), "\n"), r"^\s+|\s+$", "")
    start = parse_clock(F.col("_t.raw_time"))
    return _cues(cues, start_s=start, end_s=start, text=text, raw_time=F.col("_t.raw_time"), sep=F.col("_t.sep"))


def read_cues(texts: DataFrame) -> DataFrame:
    """Cues of files of any of the three formats. Texts are written once, so that what they come from
    runs once and not for every format; only formats that occur are scanned."""
    marked = written(detect_format(texts.select("file_id", "text")), "texts")
    found = {r.fmt for r in marked.select("fmt").distinct().collect()}
    scans = [(fmt, scan) for fmt, scan in (("srt", read_srt), ("ass", read_ass), ("txt", read_txt)) if fmt in found or not found]
    out = None
    for fmt, scan in scans:
        part = scan(marked.filter(F.col("fmt") == fmt)).withColumn("fmt", F.lit(fmt))
        out = part if out is None else out.unionByName(part)
    return out


def _joined(cues: DataFrame, piece: Column, sep: str, lead: str = "", tail: str = "") -> DataFrame:
    # Cues are small when shuffled and large as texts: a fixed number of parts keeps Spark from putting them all into one task.
    parts = int(cues.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cues.repartition(parts, "item_id").withColumn("_n", F.row_number().over(Window.partitionBy("item_id").orderBy("pos"))).withColumn("_piece", piece)
    listed = rows.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("_n", "_piece"))).alias("_rows"))
    return listed.select("item_id", F.concat(F.lit(lead), F.array_join(F.transform("_rows", lambda r: r["_piece"]), sep), F.lit(tail)).alias("text"))


def to_srt(cues: DataFrame) -> DataFrame:
    """item_id, text: the SRT file of every item, with a byte order mark."""
    return _joined(cues, F.concat(F.col("_n").cast("string"), F.lit("\n"), srt_clock(F.col("start_s")), F.lit(" --> "), srt_clock(F.col("end_s")), F.lit("\n"), F.col("text"), F.lit("\n")), "\n", BOM)


def to_txt(cues: DataFrame) -> DataFrame:
    return _joined(cues, F.concat(F.coalesce("raw_time", F.format_string("%.2f", "start_s")), F.coalesce("sep", F.lit(":")), F.col("text")), "\n\n", tail="\n")


def to_ass(cues: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Where texts has the item's ASS source, its n-th dialogue line takes the n-th cue and all else stays; else a skeleton."""
    w = Window.partitionBy("item_id").orderBy("pos")
    numbered = cues.withColumn("_n", F.row_number().over(w))
    plain = F.concat(F.lit("Dialogue: 0,"), ass_clock(F.col("start_s")), F.lit(","), ass_clock(F.col("end_s")), F.lit(","), F.coalesce(F.nullif("style", F.lit("")), F.lit("Default")), F.lit(",,0,0,0,,"), F.replace("text", F.lit("\n"), F.lit("\\N")))
    if texts is None:
        return _joined(cues, plain, "\n", "\n".join(SKELETON) + "\n", "\n")
    source = texts.select(F.col("file_id").alias("item_id"), F.posexplode(F.split(_unix(F.col("text")), "\n")).alias("pos", "line"))
    spoken = F.ltrim("line").startswith("Dialogue:")
    source = source.withColumn("_n", F.when(spoken, F.sum(spoken.cast("int")).over(w)))
    count = F.size("fields")
    # The text is the last field; start and end are the second and third of the usual columns.
    fields = F.transform("fields", lambda x, i: F.when(i == 1, ass_clock(F.col("start_s"))).when(i == 2, ass_clock(F.col("end_s"))).when(i == count - 1, F.col("text")).otherwise(x))
    new = numbered.filter(count > 3).select("item_id", "_n", F.concat(F.lit("Dialogue: "), F.array_join(fields, ",")).alias("_new"))
    merged = source.join(new, ["item_id", "_n"], "left").withColumn("_line", F.coalesce("_new", "line"))
    listed = merged.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("pos", "_line"))).alias("_rows"))
    return listed.select("item_id", F.array_join(F.transform("_rows", lambda r: r["_line"]), "\n").alias("text"))


def convert(texts: DataFrame, out_fmt: str) -> DataFrame:
    """Files of any format as ``out_fmt``; times and texts stay."""
    cues = read_cues(texts)
    return {"srt": to_srt, "txt": to_txt, "ass": to_ass}[out_fmt](cues)


def write_files(rendered: DataFrame, path: str, buckets: int = 64) -> None:
    """One row per item under buckets of items, so that many small items make few files."""
    rendered.withColumn("bucket", F.pmod(F.xxhash64("item_id"), F.lit(buckets))).write.mode("overwrite").partitionBy("bucket").parquet(path)
