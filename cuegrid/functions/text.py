"""Column expressions over texts. Arrow functions only where Spark has no built-in."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

UNTRANSLATED = "[[未译]]"
# Small kana and the full-size kana they are compared as.
SMALL_KANA = "ぁぃぅぇぉっゃゅょゎ"
BIG_KANA = "あいうえおつやゆよわ"
# What a refusal to translate looks like.
REFUSAL = (
    r"(?i)the request was rejected|high risk|content[_ ]?filter|safety system"
    r"|无法翻译|无法协助|不能翻译|不能协助|拒绝翻译|提供(其他|不含|别的)(文本|内容)"
    r"|can('?)t (assist|help|translate)|unable to (assist|help|translate)"
)
# Half-width marks and their full-width forms.
HALF_MARKS, FULL_MARKS = ",!?;:~", "，！？；：～"
# What counts as punctuation beside a quote.
QUOTE_NEIGHBOUR = r"[\s，。、！？：；…—·,.!?;:~()（）\[\]{}「」『』\"']"
# The brackets that straight quotes become.
CORNERS = {'"': "「」", "'": "『』"}
# The first wide character.
WIDE_FROM = 0x1100
_NEIGHBOUR, _STRAIGHT = re.compile(QUOTE_NEIGHBOUR), re.compile("[\"']")


def few_rows(parts: Iterator[pd.Series], rows: int = 256) -> Iterator[pd.Series]:
    """Arrow batches in smaller ones, so that what a task makes of whole texts at once stays small."""
    for s in parts:
        for k in range(0, len(s), rows):
            yield s.iloc[k : k + rows]


def _chars(holds: Callable[[str], bool], end: int = 0x110000) -> str:
    """What stands in a regular expression's brackets for the characters below ``end`` that ``holds`` is true of."""
    out, k = [], 0
    while k < end:
        first = k
        while k < end and not 0xD800 <= k < 0xE000 and holds(chr(k)):
            k += 1
        if k > first:
            out.append(rf"\x{{{first:x}}}-\x{{{k - 1:x}}}")
        k += 1
    return "".join(out)


@lru_cache(maxsize=1)
def _may_change() -> str:
    """A character that NFKC may change. Those below the combining marks that it keeps are kept in every text of them alone.
    The class has many ranges; no character up to U+009F needs to be tried against them."""
    return rf"(?=[^\x00-\x9f])[^{_chars(lambda c: unicodedata.normalize('NFKC', c) == c, 0x300)}]"


@lru_cache(maxsize=1)
def _narrow() -> str:
    """Characters that are not wide; none is wide below ``WIDE_FROM``."""
    return rf"[\x00-\x{{{WIDE_FROM - 1:x}}}]+|[^{_chars(lambda c: unicodedata.east_asian_width(c) in 'WF')}]"


@F.arrow_udf(StringType())
def _nfkc(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for s in parts:
        for k in range(0, len(s), 256):
            yield pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in s.slice(k, 256).to_pylist()], pa.string())


def nfkc(c: Column) -> Column:
    """Only texts that it may change leave the JVM, and tasks hold 256 of them as Python's at a time."""
    changes = c.rlike(_may_change())
    return F.when(changes, _nfkc(F.when(changes, c))).otherwise(c)


def key_nfkc(c: Column) -> Column:
    """NFKC without any white space."""
    return F.regexp_replace(nfkc(c), r"(?U)[\s\x1c-\x1f]+", "")


def key_compare(c: Column) -> Column:
    """NFKC, runs of dots as three, small kana as full-size ones."""
    return F.translate(F.regexp_replace(nfkc(c), r"\.{2,}", "..."), SMALL_KANA, BIG_KANA)


def is_name_line(c: Column) -> Column:
    t = F.btrim(c, F.lit(" \t\n\r\x0b\x0c　"))
    return (t != "") & ~t.contains("\n") & (F.char_length(t) <= 12)


def symbol_only(c: Column) -> Column:
    return (c != "") & ~c.rlike(r"[\p{L}\p{N}]")


def untranslated(c: Column) -> Column:
    return c.isNull() | (c == "") | (F.btrim(c, F.lit(" \t\n\r\x0b\x0c　")) == UNTRANSLATED)


def refusal(c: Column) -> Column:
    return F.coalesce(c.rlike(REFUSAL), F.lit(False))


def bad_target(c: Column) -> Column:
    return untranslated(c) | refusal(c) | F.coalesce(c.rlike(r"\[\[.+\]\]"), F.lit(False))


def layout(c: Column, space: bool = True, newline: bool = True) -> Column:
    """Blanks and newlines to \\N outside {} tags; none at the ends."""
    blanks = r"[ \t\r\n]+" if space and newline else r"[ \t]+" if space else r"\r?\n+"
    tokens = F.regexp_extract_all(c, F.lit(r"(?s)(\{[^}]*\}|[^{]+|\{)"), F.lit(1))
    out = F.array_join(F.transform(tokens, lambda t: F.when(t.rlike(r"^\{[^}]*\}$"), t).otherwise(F.regexp_replace(t, blanks, r"\\N"))), "")
    return F.regexp_replace(out, r"^(?:\\N)+|(?:\\N)+$", "")


def shorten_dots(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\.{6,}", "......"), "…{3,}", "……")


def display_width(c: Column) -> Column:
    """Wide characters count 1, others one half."""
    wide = F.char_length(F.regexp_replace(c, _narrow(), ""))
    return (F.char_length(c) + F.when(c.rlike(rf"[\x{{{WIDE_FROM:x}}}-\x{{10ffff}}]"), wide).otherwise(0)) / 2


def full_width_punct(c: Column) -> Column:
    """Three dots or more to a double ellipsis; half-width marks after a CJK character to full width."""
    out = F.regexp_replace(c, r"\.{3,}", "……")
    out = F.regexp_replace(out, "(?<=[　-鿿＀-￯「」『』—…·])([,!?;:~])", "$1")
    for half, full in zip(HALF_MARKS, FULL_MARKS):
        out = F.replace(out, F.lit("" + half), F.lit(full))
    return out


@F.pandas_udf(StringType())
def _straight_quotes(s: pd.Series) -> pd.Series:
    def word(c: str) -> bool:
        return bool(c) and not c.isspace() and not _NEIGHBOUR.match(c)

    def one(text: str | None) -> str | None:
        opens = {'"': True, "'": True}

        def mark(m: re.Match) -> str:
            at, c = m.start(), m.group()
            before, behind = word(text[at - 1 : at]), word(text[at + 1 : at + 2])
            now = behind if before != behind else opens[c]
            opens[c] = not now
            return CORNERS[c][0 if now else 1]

        return None if text is None else _STRAIGHT.sub(mark, text)

    return s.map(one)


def unify_quotes(c: Column) -> Column:
    """Curly and straight quotes to corner brackets. Straight ones close behind a word and open
    before one; where neighbours do not tell they alternate. Only the straight quotes of a text are
    visited, and only texts that have any leave the JVM."""
    curly = lambda x: F.translate(x, "“”‘’", "「」『』")
    return F.when(c.rlike("[\"']"), curly(_straight_quotes(F.when(c.rlike("[\"']"), c)))).otherwise(curly(c))


def substitute(c: Column, terms: Column, wrap: bool = True) -> Column:
    """terms: array of (term, replacement), longest first; replaced one after the other."""
    mark = (lambda r: F.concat(F.lit("⟦"), r, F.lit("⟧"))) if wrap else (lambda r: r)
    return F.aggregate(terms, c, lambda text, t: F.replace(text, t["term"], mark(t["replacement"])))


def strip_marks(c: Column) -> Column:
    return F.translate(c, "⟦⟧", "")


def drop_lines(c: Column, pattern: str) -> Column:
    return F.array_join(F.filter(F.split(c, "\n"), lambda x: ~x.rlike(pattern)), "\n")


# How the two kinds of video ids stand in links and alone.
WATCH_ID = r"(?i)(?:^|/watch/)((?:sm|nm)\d+)"
VIDEO_ID = r"(?:v=|youtu\.be/|shorts/|live/)([\w-]{6,})"


def canonical_url(c: Column) -> Column:
    """A link with a watch id to its clean form; others keep only the last v of their query."""
    watch = F.regexp_extract(c, WATCH_ID, 1)
    last_v = F.regexp_extract(c, r"^[^#]*[?&]v=([^&#]+)", 1)
    parts = [F.regexp_extract(c, r"^([^?#]*)", 1), F.when(last_v != "", F.concat(F.lit("?v="), last_v)).otherwise(""), F.regexp_extract(c, r"(#.*)$", 1)]
    return F.when(watch != "", F.concat(F.lit("https://www.nicovideo.jp/watch/"), watch)).otherwise(F.concat(*parts))


def safe_title(title: Column, fallback: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(F.btrim(title), r'[\\/:*?"<>|\x00-\x1f]', "_"), r"[. ]+$", "")
    return F.coalesce(F.nullif(F.substring(clean, 1, 100), F.lit("")), fallback)


def parse_tags(c: Column, fallback: list[str]) -> Column:
    tags = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[,，]"), lambda x: F.btrim(x)), lambda x: x != "")
    return F.when(F.size(tags) > 0, tags).otherwise(F.array(*map(F.lit, fallback)).cast("array<string>"))


STYLE_DEFAULTS = {"color": "#FFFFFF", "outline_color": "#000000", "outline_width": 2.0, "position": "bottom"}


def clean_style(color: Column, outline_color: Column, outline_width: Column, position: Column) -> Column:
    good = r"^#[0-9A-Fa-f]{6}$"
    pick = lambda c, k: F.when(c.rlike(good), F.upper(c)).otherwise(F.lit(STYLE_DEFAULTS[k]))
    return F.struct(
        pick(color, "color").alias("color"),
        pick(outline_color, "outline_color").alias("outline_color"),
        F.greatest(F.lit(0.0), F.least(F.lit(4.0), F.coalesce(outline_width.cast("double"), F.lit(STYLE_DEFAULTS["outline_width"])))).alias("outline_width"),
        F.when(position.isin("top", "bottom"), position).otherwise(F.lit(STYLE_DEFAULTS["position"])).alias("position"),
    )


# What a block page holds, and what an answer says of a spent quota or of censorship.
BLOCK_MARKERS = ("cloudflare", "cf-ray", "attention required", "just a moment", "checking your browser", "<title>access denied")
QUOTA_WORDS = ("insufficient", "quota", "balance", "arrears", "exceeded", "余额", "额度", "欠费", "充值")
CENSOR_WORDS = ("data_inspection_failed", "inappropriate content", "content_policy", "content_filter", "content policy", "内容审核", "内容不合规")


def classify_response(code: Column, body: Column) -> Column:
    """The class of a failed response: a block page first, then by code, then by what the body shows:
    200 characters of a page without its tags, 300 of another text."""
    text = F.regexp_replace(F.coalesce(body, F.lit("")), r"^\s+|\s+$", "")
    page = F.lower(F.substring(text, 1, 200)).rlike(r"^(<html|<!doctype|<head)")
    squeezed = lambda c: F.regexp_replace(c, r"\s+", " ")
    tagless = F.substring(F.btrim(squeezed(F.regexp_replace(text, "<[^>]+>", " "))), 1, 200)
    shown = F.lower(F.when(page, tagless).otherwise(F.substring(squeezed(text), 1, 300)))
    holds = lambda c, words: reduce(Column.__or__, [c.contains(w) for w in words])
    return (
        F.when(holds(F.lower(F.substring(text, 1, 2000)), BLOCK_MARKERS), "blocked")
        .when(code.isin(502, 503, 504), "gateway")
        .when(code == 401, "unauthorised")
        .when(code == 403, "forbidden")
        .when(code == 404, "not_found")
        .when(code == 429, "rate_limited")
        .when(holds(shown, QUOTA_WORDS), "quota")
        .when(holds(shown, CENSOR_WORDS), "censored")
        .when(page, "html")
        .otherwise("other")
    )


def clean_log_line(c: Column) -> Column:
    """Terminal codes removed; a progress bar cut to name, percent and count."""
    plain = F.regexp_replace(c, r"\x1b\[[0-9;?]*[A-Za-z]", "")
    bar = r"^(.*?):?\s*(\d+)%\|[^|]*\|\s*(\d+/\d+).*$"
    return F.btrim(F.when(plain.rlike(bar), F.regexp_replace(plain, bar, "$1 $2% $3")).otherwise(plain))


def item_label(c: Column) -> Column:
    """The label of a job line: a video id in it, else a bare number among its arguments, else the name
    of a local file there, else its first word; names are cut to 40 characters."""
    words = F.filter(F.split(c, r"\s+"), lambda x: x != "")
    arguments = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
    video = F.regexp_extract(c, r"\b(?:sm|so|nm)(\d{5,})", 1)
    bare = F.get(F.filter(arguments, lambda x: x.rlike(r"^\d{5,}$")), F.lit(0))
    name = lambda x: F.regexp_extract(x, r"([^/]*)/*$", 1)
    local = F.get(F.filter(arguments, lambda x: x.contains("/") | name(x).rlike(r"^.*[^.].*\.[^.]+$")), F.lit(0))
    cut = lambda x: F.when(F.char_length(x) <= 40, x).otherwise(F.concat(F.substring(x, 1, 37), F.lit("...")))
    first = F.coalesce(F.get(words, F.lit(0)), c)
    return F.when(video != "", F.concat(F.lit("sm"), video)).when(bare.isNotNull(), F.concat(F.lit("sm"), bare)).when(local.isNotNull(), cut(name(local))).otherwise(cut(first))


def item_stem(c: Column) -> Column:
    """A name without a video id at its end."""
    return F.regexp_replace(c, r"_[a-z]{2}\d+$", "")


def describe(title: Column, uploader: Column, date: Column, url: Column, desc: Column) -> Column:
    """A description: labelled lines of what is known, a blank line, the text; empty parts are skipped."""
    # The labels of the head.
    parts = (("原标题:", title), ("原作者:", uploader), ("投稿时间:", date), ("原视频:", url))
    head = F.concat_ws("\n", *[F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c)) for label, c in parts])
    return F.concat_ws("\n\n", F.nullif(head, F.lit("")), F.nullif(desc, F.lit("")))


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """{name} placeholders filled; unknown ones stay."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return template


def find_replace(c: Column, query: Column, replacement: Column) -> Column:
    return F.when(query != "", F.replace(c, query, replacement)).otherwise(c)


def hits(c: Column, query: Column) -> Column:
    """How often ``query`` occurs, not overlapping."""
    return F.when((query == "") | c.isNull(), 0).otherwise(((F.char_length(c) - F.char_length(F.replace(c, query, F.lit("")))) / F.char_length(query)).cast("long"))
