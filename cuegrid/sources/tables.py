"""Other scans and sinks: segments, glossaries, word lists, info, masks, logs, jobs, captions.

Scans take texts (file_id, text) or a path of text files; every row keeps its line number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuegrid.functions.text import shorten_dots, unify_quotes

SEGMENT_FILE = "segments array<struct<start:double, `end`:double, text:string, tr:string>>, comment string, long boolean"
MASK_FILE = "array<struct<start:double, `end`:double, x:int, y:int, w:int, h:int, effect:string, vol:double>>"
CAPTION_FILE = "struct<body:array<struct<`from`:double, `to`:double, content:string, is_comment:boolean>>>"
# The labels of an info file and the fields they open.
INFO_LABELS = {"原标题": "title", "原作者": "uploader", "投稿时间": "date", "原简介": "desc", "标签": "tags"}
JOB_COMMANDS = ("download", "run", "ocr", "translate", "render", "mask", "upload")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file_id"), "content")


def lines(texts: DataFrame) -> DataFrame:
    return texts.select("file_id", F.posexplode(F.split(F.regexp_replace("text", r"\r\n?", "\n"), "\n")).alias("line_no", "line"))


def read_segments(texts: DataFrame) -> DataFrame:
    data = texts.select("file_id", F.from_json("text", SEGMENT_FILE).alias("d"))
    rows = data.select(F.col("file_id").alias("item_id"), F.posexplode("d.segments").alias("seg_no", "s"), F.col("d.comment").alias("comment"), F.col("d.long").alias("long"))
    return rows.select("item_id", "seg_no", F.col("s.start").alias("start_s"), F.col("s.end").alias("end_s"), "s.text", "s.tr", "comment", "long")


def to_segment_files(segments: DataFrame) -> DataFrame:
    """file_id, text: JSON of every item in order; an empty target is left out, quotes are unified."""
    tr = unify_quotes(F.nullif(F.col("tr"), F.lit("")))
    row = F.struct("seg_no", F.col("start_s").alias("start"), F.col("end_s").alias("end"), "text", tr.alias("tr"))
    listed = segments.groupBy("item_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    body = F.transform("rows", lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), r["text"].alias("text"), r["tr"].alias("tr")))
    return listed.select(F.col("item_id").alias("file_id"), F.to_json(F.struct(body.alias("segments"))).alias("text"))


def read_glossary(texts: DataFrame, layer: int = 0) -> DataFrame:
    """layer, line_no, term, replacement: split at a tab, else at the first blank."""
    rule = r"^([^\t]*)\t(.*)$"
    line = F.btrim("line", F.lit(" \t"))
    rows = lines(texts).filter((line != "") & ~line.startswith("#"))
    tabbed = F.col("line").rlike(rule)
    part = lambda k, other: F.btrim(F.when(tabbed, F.regexp_extract("line", rule, k)).otherwise(F.regexp_extract(line, r"^(\S+)\s+(.*)$", other)))
    return rows.select(F.lit(layer).alias("layer"), "line_no", part(1, 1).alias("term"), part(2, 2).alias("replacement")).filter("term <> '' AND replacement <> ''")


def read_words(texts: DataFrame) -> DataFrame:
    """word, of the first source (by ``priority``) that has any."""
    rows = lines(texts).join(texts.select("file_id", "priority"), "file_id").withColumn("word", F.btrim("line", F.lit(" \t"))).filter("word <> '' AND word NOT LIKE '#%'")
    first = rows.agg(F.min("priority").alias("priority"))
    return rows.join(F.broadcast(first), "priority").select("word").distinct()


def read_info(texts: DataFrame) -> DataFrame:
    """item_id, url, title, uploader, date, desc, tags: the first line, then labelled lines, the last of
    each label; after its label the description takes every line without one, until the tags."""
    rule = rf"^({'|'.join(INFO_LABELS)}):(.*)$"
    w = Window.partitionBy("file_id").orderBy("line_no")
    label = F.nullif(F.regexp_extract("line", rule, 1), F.lit(""))
    opened = F.last(F.when(label.isin("原简介", "标签"), label), ignorenulls=True).over(w)
    rows = lines(texts).withColumns({"_label": label, "_open": opened, "_value": F.regexp_replace(F.regexp_extract("line", rule, 2), r"^\s+|\s+$", "")})
    said = F.when(F.col("_label") == "原简介", F.col("_value")).when(F.col("_label").isNull() & (F.col("_open") == "原简介"), F.col("line"))
    described = F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("line_no") > 0) & said.isNotNull(), F.struct("line_no", said.alias("x"))))), lambda r: r["x"]), "\n")
    last = lambda k: F.coalesce(F.max_by(F.when(F.col("_label") == k, F.col("_value")), F.when((F.col("_label") == k) & (F.col("line_no") > 0), F.col("line_no"))), F.lit(""))
    fields = {v: F.regexp_replace(described, r"^\s+|\s+$", "") if v == "desc" else last(k) for k, v in INFO_LABELS.items()}
    url = F.regexp_replace(F.max(F.when(F.col("line_no") == 0, F.col("line"))), r"^\s+|\s+$", "")
    wide = rows.groupBy("file_id").agg(url.alias("url"), *[c.alias(k) for k, c in fields.items()])
    tags = F.filter(F.transform(F.split("tags", ","), lambda x: F.btrim(x)), lambda x: x != "")
    return wide.select(F.col("file_id").alias("item_id"), "url", "title", "uploader", "date", "desc", tags.alias("tags"))


def read_masks(texts: DataFrame) -> DataFrame:
    rows = texts.select(F.col("file_id").alias("item_id"), F.explode(F.from_json("text", MASK_FILE)).alias("m"))
    return rows.select("item_id", F.col("m.start").alias("start_s"), F.col("m.end").alias("end_s"), "m.x", "m.y", "m.w", "m.h", "m.effect", F.coalesce("m.vol", F.lit(1.0)).alias("vol"))


def to_mask_files(masks: DataFrame) -> DataFrame:
    row = F.struct(F.col("start_s").alias("start"), F.col("end_s").alias("end"), "x", "y", "w", "h", "effect", F.nullif(F.col("vol"), F.lit(1.0)).alias("vol"))
    return masks.groupBy(F.col("item_id").alias("file_id")).agg(F.to_json(F.array_sort(F.collect_list(row))).alias("text"))


def read_run_log(texts: DataFrame) -> DataFrame:
    """ts, stage, evt, payload of lines ``[ts] {json}``; others are skipped."""
    rule = r"^\[([^\]]+)\]\s*(\{.*\})\s*$"
    rows = lines(texts).filter(F.col("line").rlike(rule)).select("file_id", "line_no", F.regexp_extract("line", rule, 1).try_cast("timestamp").alias("ts"), F.regexp_extract("line", rule, 2).alias("payload"))
    return rows.select("file_id", "line_no", "ts", F.get_json_object("payload", "$.stage").alias("stage"), F.get_json_object("payload", "$.evt").alias("evt"), "payload")


def read_jobs(texts: DataFrame) -> DataFrame:
    """line_no, command, args: comments stripped; a first token that is no command means download."""
    rows = lines(texts).withColumn("_line", F.btrim(F.regexp_replace("line", r"(^|\s)#.*$", ""))).filter("_line <> ''")
    tokens = F.split("_line", r"\s+")
    known = F.get(tokens, F.lit(0)).isin(*JOB_COMMANDS)
    return rows.select("line_no", F.when(known, F.get(tokens, F.lit(0))).otherwise("download").alias("command"), F.when(known, F.slice(tokens, 2, F.size(tokens))).otherwise(tokens).alias("args"))


def to_captions(segments: DataFrame) -> DataFrame:
    """file_id, text: caption JSON; dots shortened, one newline at most, empty ones dropped, 3 decimals."""
    text = F.btrim(F.regexp_replace(F.regexp_replace(shorten_dots(F.col("text")), r"^\s+|\s+$", ""), r"\n+", "\n"))
    text = F.concat(F.get(F.split(text, "\n", 2), F.lit(0)), F.coalesce(F.concat(F.lit("\n"), F.replace(F.get(F.split(text, "\n", 2), F.lit(1)), F.lit("\n"), F.lit(" "))), F.lit("")))
    rows = segments.withColumn("_t", text).filter("_t <> ''")
    row = F.struct("seg_no", F.round("start_s", 3).alias("from"), F.round("end_s", 3).alias("to"), F.col("_t").alias("content"))
    listed = rows.groupBy("item_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    body = F.transform("rows", lambda r: F.struct(r["from"].alias("from"), r["to"].alias("to"), r["content"].alias("content")))
    return listed.select(F.col("item_id").alias("file_id"), F.to_json(F.struct(body.alias("body"))).alias("text"))


def captions_to_cues(texts: DataFrame) -> DataFrame:
    rows = texts.select(F.col("file_id").alias("item_id"), F.posexplode(F.from_json("text", CAPTION_FILE)["body"]).alias("pos", "c"))
    good = rows.filter(~F.coalesce(F.col("c.is_comment"), F.lit(False)) & (F.btrim(F.coalesce("c.content", F.lit(""))) != ""))
    return good.select("item_id", F.col("pos").cast("long").alias("pos"), F.col("c.from").alias("start_s"), F.col("c.to").alias("end_s"), F.col("c.content").alias("text"))
