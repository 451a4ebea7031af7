"""Memo joins, pending work, glossaries, progress."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuegrid.functions.matching import any_hit, best_hit, word_slices
from cuegrid.functions.text import UNTRANSLATED, bad_target, key_nfkc, symbol_only, untranslated


def valid_memo(memo: DataFrame) -> DataFrame:
    """src, dst: one usable target per source, the least where several rows compete."""
    good = memo.filter(F.col("src").isNotNull() & ~untranslated(F.col("dst")))
    return good.groupBy("src").agg(F.min("dst").alias("dst"))


def _looked_up(segments: DataFrame, memo: DataFrame) -> DataFrame:
    return segments.join(valid_memo(memo).withColumnRenamed("dst", "_dst"), segments["text"] == F.col("src"), "left").drop("src")


def resolve(segments: DataFrame, memo: DataFrame) -> DataFrame:
    """The segments with target: their own unless blank or marked, else the memo's, else empty."""
    return _looked_up(segments, memo).withColumn("target", F.when(~untranslated(F.col("tr")), F.col("tr")).otherwise(F.coalesce("_dst", F.lit("")))).drop("_dst")


def pass_symbols(segments: DataFrame) -> DataFrame:
    """Texts of symbols alone are their own target."""
    return segments.withColumn("tr", F.when(symbol_only(F.col("text")) & bad_target(F.col("tr")), F.col("text")).otherwise(F.col("tr")))


def pending(segments: DataFrame, memo: DataFrame) -> DataFrame:
    """item_id, text, pos: each item's distinct texts that need a target, with the first place seen."""
    need = segments.filter((F.coalesce("text", F.lit("")) != "") & bad_target(F.col("tr")) & ~symbol_only(F.col("text")))
    left = need.join(valid_memo(memo).select(F.col("src").alias("text")), "text", "left_anti")
    return left.groupBy("item_id", "text").agg(F.min("pos").alias("pos"))


def backfill(segments: DataFrame, memo: DataFrame) -> DataFrame:
    """Missing targets from the memo."""
    return _looked_up(segments, memo).withColumn("tr", F.when(untranslated(F.col("tr")), F.coalesce("_dst", "tr")).otherwise(F.col("tr"))).drop("_dst")


def carry_over(new: DataFrame, old: DataFrame) -> DataFrame:
    """Old targets where start and end to a hundredth and the text agree; the last of repeated old rows."""
    key = lambda c: F.format_string("%.2f", c)
    kept = old.filter(~untranslated(F.col("tr"))).groupBy("item_id", key("start_s").alias("_s"), key("end_s").alias("_e"), "text").agg(F.max_by("tr", "pos").alias("_tr"))
    keyed = new.withColumn("_s", key("start_s")).withColumn("_e", key("end_s"))
    return keyed.join(kept, ["item_id", "_s", "_e", "text"], "left").withColumn("tr", F.coalesce("_tr", "tr")).drop("_s", "_e", "_tr")


NO_TEXT = "\x00"


def todo(frames: DataFrame, ocr_memo: DataFrame, meta: dict[str, object]) -> DataFrame:
    """Frames without a memo row of the same provenance. In version 1 an empty text means none was
    seen, in version 2 that the work was cut short."""
    same = F.lit(True)
    for name, value in meta.items():
        same &= F.col(name).eqNullSafe(F.lit(value))
    done = ocr_memo.filter(same & ((F.col("v") != 2) | (F.col("text") != "")))
    return frames.join(done.select("frame_key").distinct(), "frame_key", "left_anti")


def representatives(rows: DataFrame, coarse: str, fine: str, order: str) -> DataFrame:
    """rows with key and is_first: the coarse key, joined by the fine one where the coarse repeats."""
    n = F.count("*").over(Window.partitionBy(coarse))
    keyed = rows.withColumn("key", F.when(n == 1, F.struct(F.col(coarse).cast("string").alias("coarse"), F.lit(None).cast("string").alias("fine"))).otherwise(F.struct(F.col(coarse).cast("string").alias("coarse"), F.col(fine).cast("string").alias("fine"))))
    return keyed.withColumn("is_first", F.row_number().over(Window.partitionBy("key").orderBy(order)) == 1)


def expand(keyed: DataFrame, results: DataFrame) -> DataFrame:
    """Results (key, result) of the representatives back on all rows."""
    return keyed.join(results, keyed["key"].eqNullSafe(results["key"]), "left").drop(results["key"])


def rule_lookup(items: DataFrame, rules: DataFrame) -> DataFrame:
    """item_id, value: of the first rule (by rank) whose key occurs in the item's tags. Each slice of
    keys gives its best, the first of all wins."""
    hit = reduce(DataFrame.unionByName, [items.select("item_id", keys.udf(best_hit, "string")("tags").alias("_key")).filter("_key IS NOT NULL") for keys in word_slices(rules, "key", "rank")])
    met = hit.join(rules, hit["_key"] == rules["key"])
    return met.groupBy("item_id").agg(F.min_by("value", "rank").alias("value"))


def split_risky(items: DataFrame, glossary: DataFrame) -> DataFrame:
    """items with risky: does the text hold a glossary term. A pass over the texts for each slice of terms."""
    slices = list(word_slices(glossary, "term"))
    if len(slices) == 1:
        return items.withColumn("risky", F.coalesce(slices[0].udf(any_hit, "boolean")("text"), F.lit(False)))
    said = items.select("text").distinct()
    held = reduce(DataFrame.unionByName, [said.filter(s.udf(any_hit, "boolean")("text")) for s in slices]).distinct()
    return items.join(held.withColumn("risky", F.lit(True)), "text", "left").withColumn("risky", F.coalesce("risky", F.lit(False))).select(*items.columns, "risky")


def forget(memo: DataFrame, sources: DataFrame) -> DataFrame:
    return memo.join(sources.select("src").distinct(), "src", "left_anti")


def except_known(texts: DataFrame, memo: DataFrame) -> DataFrame:
    return texts.select("text").distinct().join(memo.select(F.col("src").alias("text")), "text", "left_anti")


def union_layers(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def overlay(layers: DataFrame) -> DataFrame:
    """term, replacement: the later layer wins, within one the later line."""
    return layers.groupBy("term").agg(F.max_by("replacement", F.struct("layer", "line_no")).alias("replacement"))


# The characters stripped from the ends of names; a letter and a backslash are among them.
_DECORATION = r"[\[\]\-一ー—\\s]"
_SPACE = " \t\n\r\x0b\x0c　"


def name_candidates(texts: DataFrame, top: int = 30) -> DataFrame:
    """name, n: short lines that look like names and occur twice or more, the most frequent first."""
    t = F.btrim(F.regexp_replace(F.btrim("text", F.lit(_SPACE)), f"^{_DECORATION}+|{_DECORATION}+$", ""), F.lit(_SPACE))
    rows = texts.select(t.alias("name")).filter((F.col("name") != "") & (F.char_length("name") <= 12) & ~F.col("name").rlike(r"[\s/：:、,，。「」『』\"'（）()\[\]{}！？!?…—\-]"))
    return rows.groupBy("name").agg(F.count("*").alias("n")).filter("n >= 2").orderBy(F.desc("n"), "name").limit(top)


def echo_ratio(pairs: DataFrame, limit: float = 0.6) -> DataFrame:
    """batch_id, ratio, void: how many targets (of sources of 2 characters or more) repeat the source."""
    long = (F.char_length(F.btrim("src")) >= 2) & (F.coalesce("dst", F.lit("")) != "")
    same: Column = F.when(long, (key_nfkc(F.col("src")) == key_nfkc(F.col("dst"))).cast("double"))
    out = pairs.groupBy("batch_id").agg(F.coalesce(F.avg(same), F.lit(0.0)).alias("ratio"))
    return out.withColumn("void", F.col("ratio") > limit)


def status(segments: DataFrame, memo: DataFrame) -> DataFrame:
    """item_id, segments, texts, missing: progress of every item."""
    totals = segments.groupBy("item_id").agg(F.count("*").alias("segments"), F.countDistinct(F.when(F.col("text") != "", F.col("text"))).alias("texts"))
    missing = pending(segments, memo).groupBy("item_id").agg(F.count("*").alias("missing"))
    return totals.join(missing, "item_id", "left").withColumn("missing", F.coalesce("missing", F.lit(0))).withColumn("done", F.col("texts") - F.col("missing"))


def inventory(items: DataFrame, segments: DataFrame, memo: DataFrame) -> DataFrame:
    """item_id, has_video, has_subtitle, untranslated."""
    open_ = resolve(segments, memo).groupBy("item_id").agg(F.count_if(F.col("target") == "").alias("untranslated"), F.lit(True).alias("has_subtitle"))
    return items.select("item_id", "has_video").join(open_, "item_id", "left").select("item_id", "has_video", F.coalesce("has_subtitle", F.lit(False)).alias("has_subtitle"), F.coalesce("untranslated", F.lit(0)).alias("untranslated"))


def failures(results: DataFrame) -> DataFrame:
    """src, pos: sources that failed, each once, with the first place seen."""
    return results.filter(F.coalesce("dst", F.lit(UNTRANSLATED)) == UNTRANSLATED).groupBy("src").agg(F.min("pos").alias("pos"))
