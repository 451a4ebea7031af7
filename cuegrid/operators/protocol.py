"""Batches, replies, edits, usage and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuegrid.functions.text import UNTRANSLATED, classify_response, clean_log_line, item_label

GROUP_BATCH = 20


def plan_batches(items: DataFrame) -> DataFrame:
    """items (item_id, pos, text) with group_no and batch_no: contiguous groups, more of them for more
    text (8 to 32), cut into batches of 20."""
    by = Window.partitionBy("item_id")
    chars, n = F.sum(F.char_length("text")).over(by), F.count("*").over(by)
    groups = F.greatest(F.lit(8), F.least(F.lit(32), F.bround(16 + (chars - 3792) * 8 / (5230 - 3792), 0))).cast("long")
    rows = items.withColumn("_i", F.row_number().over(by.orderBy("pos")) - 1).withColumn("_size", F.ceil(n / groups))
    return rows.withColumn("group_no", F.floor(F.col("_i") / F.col("_size"))).withColumn("batch_no", F.floor((F.col("_i") % F.col("_size")) / GROUP_BATCH)).drop("_i", "_size")


def attribute_by_marker(rows: DataFrame, sizes: DataFrame, marker: str = r"^[#【\[(]?(\d+)[】\])]?$") -> DataFrame:
    """batch_id, frame_no, text: rows (batch_id, row_no, words) belong to the last marker from 1 to n - 1
    before them. A batch of several frames with rows and no marker is void. sizes: batch_id, n."""
    w = Window.partitionBy("batch_id").orderBy("row_no")
    r = rows.join(sizes, "batch_id").withColumn("words", F.btrim("words"))
    number = F.regexp_extract(F.replace("words", F.lit(" "), F.lit("")), marker, 1).try_cast("int")
    r = r.withColumn("_mark", F.when((number > 0) & (number < F.col("n")), number))
    r = r.withColumn("frame_no", F.coalesce(F.last("_mark", ignorenulls=True).over(w), F.lit(0))).withColumn("_hits", F.count("_mark").over(Window.partitionBy("batch_id")))
    good = r.filter("n = 1 OR _hits > 0").filter("_mark IS NULL")
    listed = good.groupBy("batch_id", "frame_no").agg(F.array_sort(F.collect_list(F.struct("row_no", "words"))).alias("_rows"))
    return listed.select("batch_id", "frame_no", F.array_join(F.transform("_rows", lambda x: x["words"]), "\n").alias("text"))


def attribute_by_y(rows: DataFrame, sizes: DataFrame, frame_h: int, sep: int = 44) -> DataFrame:
    """batch_id, frame_no, text by the rows' top: those above the first frame go; below a frame, digits
    are the separator's number and go, other text belongs to the next frame if there is one."""
    stride = frame_h + sep
    r = rows.join(sizes, "batch_id").withColumn("words", F.btrim("words")).withColumn("_at", F.col("top") - sep).filter("_at >= 0")
    below = F.col("_at") % stride >= frame_h
    r = r.withColumn("_below", below).withColumn("_f", F.floor(F.col("_at") / stride) + below.cast("int"))
    r = r.filter(~(F.col("_below") & (F.col("words").rlike(r"^\d+$") | (F.col("_f") >= F.col("n")))))
    r = r.withColumn("frame_no", F.least(F.col("_f"), F.col("n") - 1))
    listed = r.groupBy("batch_id", "frame_no").agg(F.array_sort(F.collect_list(F.struct("row_no", "words"))).alias("_rows"))
    return listed.select("batch_id", "frame_no", F.array_join(F.transform("_rows", lambda x: x["words"]), "\n").alias("text"))


def reconcile(requests: DataFrame, replies: DataFrame) -> DataFrame:
    """batch_id, idx, src, dst. A reply counts only if it covers its batch exactly: by numbers 1 to n,
    else as a JSON array of n, else as n parts between %%; otherwise all its targets are null."""
    sizes = requests.groupBy("batch_id").agg(F.count("*").alias("n"))
    bare = F.regexp_replace("reply", r"```[a-zA-Z]*\n?|```", "")
    r = replies.join(sizes, "batch_id").withColumn("_bare", bare)
    rule = r"^\s*(\d+)\s*(?:\t|[.、。:：)）\]|]|\s)\s*(.+?)\s*$"
    lines = r.select("batch_id", "n", F.posexplode(F.split("_bare", r"\r?\n")).alias("_no", "_line")).withColumn("_line", F.btrim(F.btrim("_line"), F.lit("*`"))).filter(F.col("_line").rlike(rule))
    numbered = lines.select("batch_id", "n", "_no", F.regexp_extract("_line", rule, 1).try_cast("int").alias("idx"), F.regexp_extract("_line", rule, 2).alias("dst"))
    numbered = numbered.groupBy("batch_id", "n", "idx").agg(F.max_by("dst", "_no").alias("dst"))
    by = Window.partitionBy("batch_id")
    exact = numbered.withColumn("_ok", (F.count("*").over(by) == F.col("n")) & (F.min("idx").over(by) == 1) & (F.max("idx").over(by) == F.col("n"))).filter("_ok").select("batch_id", "idx", "dst")
    rest = r.join(exact.select("batch_id").distinct(), "batch_id", "left_anti")
    listed = F.from_json(F.regexp_extract("_bare", r"(?s)(\[.*\])", 1), "array<string>")
    parts = F.transform(F.split("_bare", "%{2,}"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    whole = F.size(parts) == F.col("n")
    chosen = F.when(F.size(listed) == F.col("n"), listed).when(whole & ~F.exists(parts, lambda x: x == ""), parts)
    others = rest.select("batch_id", F.posexplode(chosen).alias("_k", "dst")).select("batch_id", (F.col("_k") + 1).alias("idx"), "dst")
    return requests.join(exact.unionByName(others), ["batch_id", "idx"], "left").select("batch_id", "idx", "src", "dst")


def apply_proofread(segments: DataFrame, replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments with the replies' targets where there are any, and item_id, changed. Times stay."""
    new = segments.join(replies.select("item_id", "seg_no", F.nullif(F.btrim("reply"), F.lit("")).alias("_new")), ["item_id", "seg_no"], "left")
    changed = new.groupBy("item_id").agg(F.count_if(F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col("tr"))).alias("changed"))
    return new.withColumn("tr", F.coalesce("_new", "tr")).drop("_new"), changed


def apply_edits(segments: DataFrame, edits: DataFrame) -> DataFrame:
    """item_id, seg_no, start_s, end_s, text, tr after the edits: a blank target deletes, the marker
    keeps a row untranslated, a row without source takes its target as source; by start."""
    e = edits.select("item_id", "seg_no", *[F.col(c).alias(f"_{c}") for c in ("start_s", "end_s", "text", "tr")], F.lit(True).alias("_edited"))
    both = segments.join(e, ["item_id", "seg_no"], "full")
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    target = bare("_tr")
    gone = F.coalesce(F.col("_edited"), F.lit(False)) & (target == "")
    pick = lambda c: F.when(F.col("_edited"), F.coalesce(f"_{c}", c)).otherwise(F.col(c))
    out = both.filter(~gone).select(
        "item_id",
        "seg_no",
        pick("start_s").alias("start_s"),
        pick("end_s").alias("end_s"),
        F.when(F.col("_edited"), F.coalesce(F.nullif(bare(F.coalesce("_text", "text")), F.lit("")), target)).otherwise(F.col("text")).alias("text"),
        F.when(~F.coalesce(F.col("_edited"), F.lit(False)), F.col("tr")).when(target != UNTRANSLATED, target).alias("tr"),
    )
    w = Window.partitionBy("item_id").orderBy("start_s", "seg_no")
    return out.withColumn("seg_no", F.row_number().over(w) - 1)


def unpublished(items: DataFrame, ledger: DataFrame) -> DataFrame:
    return items.join(ledger.select("item_id").distinct(), "item_id", "left_anti")


def usage_totals(usage: DataFrame, prices: dict[str, float], *keys: str) -> DataFrame:
    """calls, tokens and cost; prices a million: hit (cached prompt), miss, output."""
    hit, miss, out = F.sum("cached_tokens"), F.sum(F.col("prompt_tokens") - F.col("cached_tokens")), F.sum("completion_tokens")
    total = usage.groupBy(*keys).agg(F.count("*").alias("calls"), hit.alias("hit_tokens"), miss.alias("miss_tokens"), out.alias("output_tokens"))
    cost = (F.col("hit_tokens") * prices["hit"] + F.col("miss_tokens") * prices["miss"] + F.col("output_tokens") * prices["output"]) / 1e6
    return total.withColumn("cost", F.round(cost, 6))


def run_summary(log: DataFrame) -> DataFrame:
    """stage, ok, failed of log rows (stage, evt)."""
    return log.groupBy("stage").agg(F.count_if(F.col("evt") == "ok").alias("ok"), F.count_if(F.col("evt") == "failed").alias("failed"))


def allocate(calls: DataFrame, quotas: DataFrame) -> DataFrame:
    """calls (call_id, ts) with month, endpoint: the k-th call of a month goes to the endpoint, by
    priority, whose cumulative monthly limit reaches k; null beyond all. quotas is a small list."""
    before = F.coalesce(F.sum("monthly").over(Window.orderBy("priority").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = quotas.select("endpoint", before.alias("_after"), (before + F.col("monthly")).alias("_to"))
    # Counted within each hour, and on from the hours before it: a month is never one task's.
    rows = calls.select("call_id", "ts", F.trunc("ts", "month").alias("month"), F.date_trunc("hour", "ts").alias("_hour"))
    hours = rows.groupBy("month", "_hour").agg(F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy("month").orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1))
    k = F.row_number().over(Window.partitionBy("month", "_hour").orderBy("ts", "call_id")) + F.col("_earlier")
    numbered = rows.join(hours.select("month", "_hour", F.coalesce(earlier, F.lit(0)).alias("_earlier")), ["month", "_hour"]).withColumn("k", k)
    return numbered.join(F.broadcast(ranges), (F.col("k") > F.col("_after")) & (F.col("k") <= F.col("_to")), "left").select("call_id", "month", "k", "endpoint")


def classify_responses(log: DataFrame) -> DataFrame:
    """endpoint, hour, class, n of log rows (ts, endpoint, code, body)."""
    rows = log.withColumn("class", classify_response(F.col("code"), F.col("body")))
    return rows.groupBy("endpoint", F.date_trunc("hour", "ts").alias("hour"), "class").agg(F.count("*").alias("n"))


def latest_progress(log: DataFrame) -> DataFrame:
    """item, stage, line: the latest cleaned line of log rows (ts, job, stage, line)."""
    rows = log.select("ts", item_label(F.col("job")).alias("item"), "stage", clean_log_line(F.col("line")).alias("line"))
    return rows.groupBy("item", "stage").agg(F.max_by("line", F.struct("ts", "line")).alias("line"))
