"""Text jobs over corpus tables, each one pass and grouped counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuegrid.functions import text as T
from cuegrid.functions.matching import in_slices, substitution
from cuegrid.functions.similarity import likeness
from cuegrid.functions.times import in_window, shift_time
from cuegrid.sources.storage import written

# Hosts of file shares.
FILE_SHARES = (
    r"(?i)(mega\.nz|drive\.google|docs\.google\.com|dropbox\.com|pan\.baidu\.com|1drv\.ms|onedrive\.live|mediafire|pixeldrain|gofile\.io|catbox\.moe"
    r"|0x0\.st|gigafile\.nu|firestorage|getuploader|fastlist|disk\.yandex|transfer\.sh|wetransfer|send\.space|file\.io|anonfiles"
    r"|krakenfiles|bagi\.co\.in|tmpfiles\.org|litterbox|pomf\.se|uguu\.se)"
)
LINE_BUDGET = 20


def text_variants(texts: DataFrame, key: str = "nfkc") -> DataFrame:
    """key, n, spellings, first_text of the texts that share a key."""
    expr = T.key_nfkc if key == "nfkc" else T.key_compare
    spelled = texts.groupBy("text").agg(F.count("*").alias("_n"), F.min(F.struct("item_id", "pos")).alias("_at")).withColumn("key", expr(F.col("text")))
    return spelled.groupBy("key").agg(F.sum("_n").alias("n"), F.count("*").alias("spellings"), F.min_by("text", "_at").alias("first_text"))


def near_pairs(cues: DataFrame, k: int = 1, threshold: float = 0.85) -> DataFrame:
    """item_id, a, b, by: rows up to k places apart that are alike, by length, prefix, ratio or subsequence."""
    w = Window.partitionBy("item_id").orderBy("pos")
    rows = cues.select("item_id", "pos", "text", F.row_number().over(w).alias("_i"))
    later = rows.select("item_id", F.col("pos").alias("b"), F.col("text").alias("_y"), F.explode(F.sequence(F.col("_i") - k, F.col("_i") - 1)).alias("_i"))
    met = rows.withColumnsRenamed({"pos": "a", "text": "_x"}).join(later, ["item_id", "_i"]).filter("_x <> '' AND _y <> ''")
    starts = F.startswith("_x", F.col("_y")) | F.startswith("_y", F.col("_x"))
    sure = met.filter(starts).withColumn("by", F.lit("prefix"))
    # One Arrow function for the rest: a pair costs no more than the tests that it needs.
    rest = met.filter(~starts).withColumn("by", likeness("_x", "_y", F.lit(threshold))).filter("by IS NOT NULL")
    return sure.unionByName(rest).select("item_id", "a", "b", "by")


def quality_audit(segments: DataFrame) -> DataFrame:
    """item_id, rule, n: rows of each item that break a rule of their target."""
    tr = F.coalesce("tr", F.lit(""))
    unbalanced = (F.regexp_count(tr, F.lit("「")) != F.regexp_count(tr, F.lit("」"))) | (F.regexp_count(tr, F.lit("『")) != F.regexp_count(tr, F.lit("』")))
    flags = {
        "empty": tr == "",
        "marker": F.btrim(tr) == T.UNTRANSLATED,
        "refusal": T.refusal(tr),
        "symbols": T.symbol_only(tr),
        "wide": T.display_width(tr) > LINE_BUDGET,
        "quotes": unbalanced,
    }
    counts = segments.groupBy("item_id").agg(*[F.count_if(c).alias(k) for k, c in flags.items()])
    return counts.unpivot("item_id", list(flags), "rule", "n").filter("n > 0")


STEPS = ("terms", "marks", "punct", "quotes", "dots", "layout")


def with_terms(segments: DataFrame, terms: DataFrame, source: str, target: str) -> DataFrame:
    """segments with ``target``: the text of ``source`` with the terms (term, replacement; one row a term)
    replaced one after the other, the longest first. A slice of terms at a time is on the driver and
    broadcast; the next begins where it ends, on what it has written."""
    ranked = terms.filter("term <> ''").select((-F.char_length("term")).alias("n"), "term", F.coalesce("replacement", F.lit("")).alias("replacement"))
    rows = segments.withColumn(target, F.col(source))
    for k, part in enumerate(in_slices(ranked, ["n", "term"])):
        rows = written(rows, "replaced") if k else rows
        rows = rows.withColumn(target, substitution(segments.sparkSession, [(r.term, r.replacement) for r in part])(F.col(target)))
    return rows


def clean_targets(segments: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments with cleaned tr, and step, changed. terms: term and replacement, one row a term."""
    rows = with_terms(segments.withColumn("_0", F.coalesce("tr", F.lit(""))), terms, "_0", "_1")
    todo = (T.strip_marks, T.full_width_punct, T.unify_quotes, T.shorten_dots, T.layout)
    for k, step in enumerate(todo, 1):
        rows = rows.withColumn(f"_{k + 1}", step(F.col(f"_{k}")))
    changed = rows.agg(*[F.count_if(F.col(f"_{k}") != F.col(f"_{k + 1}")).alias(s) for k, s in enumerate(STEPS)])
    cleaned = rows.withColumn("tr", F.col(f"_{len(STEPS)}")).select(*segments.columns)
    return cleaned, changed.unpivot([], list(STEPS), "step", "changed")


def clean_pages(pages: DataFrame, fallback_tags: list[str] | None = None) -> DataFrame:
    """page_id, url, title, tags, body: one row per canonical URL, the least page of it."""
    title = F.regexp_extract("body", r"(?is)<title[^>]*>(.*?)</title>", 1)
    tags = F.regexp_extract("body", r"(?is)<meta[^>]*name=[\"']keywords[\"'][^>]*content=[\"']([^\"']*)", 1)
    rows = pages.select(
        "page_id",
        T.canonical_url(F.col("url")).alias("url"),
        T.safe_title(title, F.col("page_id").cast("string")).alias("title"),
        T.parse_tags(tags, fallback_tags or []).alias("tags"),
        T.drop_lines(F.col("body"), FILE_SHARES).alias("body"),
    )
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy("url").orderBy("page_id"))).filter("_k = 1").drop("_k")


def repair_styles(styles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fixed styles, and field, repaired."""
    names = list(T.STYLE_DEFAULTS)
    fixed = styles.withColumn("_s", T.clean_style(*[F.col(c) for c in names]))
    counts = fixed.agg(*[F.count_if(~F.col(c).cast("string").eqNullSafe(F.col(f"_s.{c}").cast(styles.schema[c].dataType).cast("string"))).alias(c) for c in names])
    rest = [c for c in styles.columns if c not in names]
    return fixed.select(*rest, "_s.*"), counts.unpivot([], names, "field", "repaired")


def descriptions(info: DataFrame, templates: DataFrame) -> DataFrame:
    """item_id, text: the template of the item's kind filled, then the description of its info;
    parts without a value are left out. Templates are a small list, one a kind."""
    parts = T.describe(*[F.col(k) for k in ("title", "uploader", "date", "url", "desc")])
    met = info.join(F.broadcast(templates), "kind", "left")
    filled = T.fill_template(F.col("template"), {k: F.col(k) for k in ("title", "uploader", "date", "url")})
    return met.select("item_id", F.concat_ws("\n", filled, F.nullif(parts, F.lit(""))).alias("text"))


def retime(segments: DataFrame, offsets: DataFrame) -> DataFrame:
    """Segments inside their item's window (of start times), shifted; items without an offset stay."""
    rows = segments.join(offsets.select("item_id", "shift_s", "from_s", "to_s"), "item_id", "left").filter(in_window(F.col("start_s"), F.col("from_s"), F.col("to_s")))
    d = F.coalesce("shift_s", F.lit(0.0))
    return rows.withColumn("start_s", shift_time(F.col("start_s"), d)).withColumn("end_s", shift_time(F.col("end_s"), d)).drop("shift_s", "from_s", "to_s")


def find_replace(segments: DataFrame, query: str, replacement: str, in_source: bool = False) -> tuple[DataFrame, DataFrame]:
    """Segments with query replaced in the target (and the source), and item_id, hits."""
    q, r = F.lit(query), F.lit(replacement)
    columns = ["tr", "text"] if in_source else ["tr"]
    n = sum(F.coalesce(T.hits(F.col(c), q), F.lit(0)) for c in columns)
    hits = segments.groupBy("item_id").agg(F.sum(n).alias("hits")).filter("hits > 0")
    out = segments
    for c in columns:
        out = out.withColumn(c, T.find_replace(F.col(c), q, r))
    return out, hits
