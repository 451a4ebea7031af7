"""Operator 8: quality rules with adaptive thresholds, in DataFrame functions alone.

Every document is measured; per language and source, each measure is counted in the cells of a
quantile sketch (whole numbers below 128 exactly, beyond that 7 leading bits, so within 1 %).
Sketches merge by adding counts: those of a language are the sums of its sources, used where a
source has few documents, and those of all documents where the language has few too.
A document passes if each measure lies within the fences of its group, which come from the sketch
alone. A rate's fence is the eighth decile (up to a fifth of a group may be noise) and ``reach``
times its distance from the median; word length has a low fence as well, by the second decile.
Symbols, repeated lines and repeated windows are single things, which most documents have none of:
their sketches are of two parts, the share of zeros and the rest. There the rate's fence is at least
a ``reach``-th of the lower decile of the rest, and a document fails only if its count stands apart too: it is
as large as that of a cluster of a fifth of the documents at most, with three octaves of counts
below it, above the median's, that are empty but for a twentieth of the cluster. So where counts
fall off one by one, as genuine ones do, none is an offence, and where nobody has any up to a jump,
those beyond it are. The table of fences is broadcast if it is small, and joined with salted keys
if not.

Null text has no words and fails the base rules; null language or source form a group of
their own. Texts of any length are measured whole, in one row each. Repeated rows count as often as
they occur; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuegrid.llm.common import BLANKS, written

MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
#: Groups of fewer documents use the sketch of their language, and then that of all.
MIN_DOCS = 100
REACH = 8
#: Measures, and what those count that are rates of single things: a window met twice has six words under it.
MEASURES = {"symbols": "n_symbols", "dup_lines": "n_dup_lines", "repeats": "n_repeat_words div 6", "capitals": None, "word_length": None}
#: Octaves of counts that are empty below a cluster that stands apart.
GAP = 3
#: Measures with a low fence.
LOW = ("word_length",)
#: Groups whose fences are broadcast at most, and the parts that keys are salted into beyond it.
MOST_GROUPS, SALTS = 200_000, 32
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Windows of three words by hash; those met twice, in the order of the text; words under them.
_REPEATS = """
CASE WHEN n_words < 3 OR size(array_distinct(_windows)) = size(_windows) THEN 0L ELSE
  transform(array(sort_array(transform(_windows, (t, i) -> struct(t, i)))), s ->
    aggregate(
      sort_array(transform(
        filter(s, (x, i) -> (i > 0 AND s[i - 1].t = x.t) OR (i < size(s) - 1 AND s[i + 1].t = x.t)),
        x -> x.i)),
      named_struct('last', -3, 'n', 0L),
      (a, x) -> named_struct('last', x, 'n', a.n + least(3, x - a.last)),
      a -> a.n))[0]
END
"""


def _without(text: Column, chars: str) -> Column:
    return F.char_length(F.translate(text, chars, ""))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_capitals, n_repeat_words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    full_line = lambda x: F.btrim(x, F.lit(BLANKS)) != ""
    counted = docs.select(
        "doc_id",
        F.coalesce("lang", F.lit("")).alias("lang"),
        F.coalesce("source", F.lit("")).alias("source"),
        F.array_remove(F.split(F.translate(text, BLANKS[1:], " " * (len(BLANKS) - 1)), " "), "").alias("_words"),
        _without(text, BLANKS).cast("long").alias("word_chars"),
        (F.char_length(text) - _without(text, SYMBOLS)).cast("long").alias("n_symbols"),
        (F.char_length(text) - _without(text, _CAPITALS)).cast("long").alias("n_capitals"),
        F.filter(F.split(text, "\n"), full_line).alias("_lines"),
    )
    shingled = counted.select(
        "*",
        F.size("_words").cast("long").alias("n_words"),
        F.expr("CASE WHEN size(_words) < 3 THEN array() ELSE transform(array(_words), w -> transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])))[0] END").alias("_windows"),
    )
    return shingled.select(
        "doc_id",
        "lang",
        "source",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_capitals",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr(_REPEATS).alias("n_repeat_words"),
    )


def base_failed(min_words: int = MIN_WORDS) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _rates() -> dict[str, Column]:
    per = lambda times, n, of: F.expr(f"{times} * {n} div greatest({of}, 1)")
    return {
        "symbols": per(1000, "n_symbols", "n_words"),
        "dup_lines": per(1000, "n_dup_lines", "n_lines"),
        "repeats": per(1000, "n_repeat_words", "n_words"),
        "capitals": per(1000, "n_capitals", "word_chars"),
        "word_length": per(100, "word_chars", "n_words"),
    }


def sketch(measured: DataFrame) -> DataFrame:
    """lang, source, measure, cell, n: the mergeable counts of each rate, and of the counts behind them (``symbols#``)."""
    values = _rates() | {f"{name}#": F.expr(count) for name, count in MEASURES.items() if count}
    long = measured.select("lang", "source", F.explode(F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*values.values()))).alias("measure", "value"))
    cell = F.expr("CASE WHEN value < 128 THEN value ELSE shiftleft(shiftright(value, length(bin(value)) - 7), length(bin(value)) - 7) END")
    return long.groupBy("lang", "source", "measure", cell.alias("cell")).agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, *keys: str) -> DataFrame:
    """The sketches added up over all but the keys."""
    return sketches.groupBy(*keys, "measure", "cell").agg(F.sum("n").alias("n"))


def deciles(sketches: DataFrame, *keys: str) -> DataFrame:
    """keys, measure, n_docs, low, mid, high: the cells that two, five and eight tenths reach; some: the one
    that a tenth of what is not zero reaches; most: the count below a cluster that stands apart, null if none does."""
    group = Window.partitionBy(*keys, "measure")
    up = group.orderBy("cell")
    octave = F.when(F.col("cell") == 0, 0).otherwise(F.length(F.bin("cell")))
    ranked = sketches.select(*keys, "measure", "cell", "n", octave.alias("_o"), F.sum("n").over(up.rowsBetween(Window.unboundedPreceding, 0)).alias("_to"), F.sum("n").over(group).alias("_all"), F.sum(F.when(F.col("cell") == 0, F.col("n")).otherwise(0)).over(group).alias("_zero"))
    by_octave = group.orderBy("_o")
    below, above = F.coalesce(F.sum("n").over(by_octave.rangeBetween(-GAP, -1)), F.lit(0)), F.sum("n").over(by_octave.rangeBetween(0, Window.unboundedFollowing))
    middle = F.min(F.when(2 * F.col("_to") >= F.col("_all"), F.col("_o"))).over(group)
    ranked = ranked.select("*", below.alias("_below"), above.alias("_above"), middle.alias("_middle"))
    apart = (20 * F.col("_below") <= F.col("_above")) & (5 * F.col("_above") <= F.col("_all")) & (F.col("_o") - GAP > F.col("_middle"))
    at = lambda k: F.min(F.when(10 * F.col("_to") >= k * F.col("_all"), F.col("cell")))
    some = F.min(F.when((F.col("cell") > 0) & (10 * (F.col("_to") - F.col("_zero")) >= F.col("_all") - F.col("_zero")), F.col("cell")))
    first = F.min(F.when(apart, F.col("_o")))
    out = ranked.groupBy(*keys, "measure").agg(F.max("_all").alias("n_docs"), at(2).alias("low"), at(5).alias("mid"), at(8).alias("high"), some.alias("some"), first.alias("_first"))
    return out.withColumn("most", F.expr("shiftleft(1L, _first - 1) - 1")).drop("_first")


_LEVELS = ("low", "mid", "high", "some", "most")


def thresholds(sketches: DataFrame, min_docs: int = MIN_DOCS, reach: int = REACH) -> DataFrame:
    """lang, source, and for each measure its high_ (and low_) fence of the rate and most_, the fence of its count."""
    own = deciles(sketches, "lang", "source")
    of_lang = deciles(merge(sketches, "lang"), "lang").select("lang", "measure", F.struct(*_LEVELS, "n_docs").alias("_lang"))
    of_all = deciles(merge(sketches)).select("measure", F.struct(*_LEVELS).alias("_all"))
    joined = own.join(of_lang, ["lang", "measure"]).join(F.broadcast(of_all), "measure")
    q = lambda k: F.when(F.col("n_docs") >= min_docs, F.col(k)).when(F.col("_lang.n_docs") >= min_docs, F.col(f"_lang.{k}")).otherwise(F.col(f"_all.{k}"))
    level = joined.select("lang", "source", "measure", *[q(k).alias(k) for k in _LEVELS])
    # A group has a row for each measure and count: eight.
    named = {m.replace("#", "_count"): m for m in (*MEASURES, *[f"{m}#" for m, count in MEASURES.items() if count])}
    wide = level.groupBy("lang", "source").agg(*[F.max(F.when(F.col("measure") == m, F.struct(*_LEVELS))).alias(f"_{name}") for name, m in named.items()])
    columns = []
    for name, count in MEASURES.items():
        low, mid, high, some = (F.col(f"_{name}.{k}") for k in ("low", "mid", "high", "some"))
        fence = high + reach * (high - mid)
        columns.append((F.greatest(fence, F.floor(F.coalesce(some, F.lit(0)) / reach)) if count else fence).alias(f"high_{name}"))
        if count:
            columns.append(F.col(f"_{name}_count.most").alias(f"most_{name}"))
        if name in LOW:
            columns.append((low - reach * (mid - low)).alias(f"low_{name}"))
    return wide.select("lang", "source", *columns)


def offends(name: str) -> Column:
    """Does a measure lie beyond its fences."""
    rate, count = _rates()[name], MEASURES[name]
    out = rate > F.col(f"high_{name}")
    if count:
        out &= F.coalesce(F.expr(count) > F.col(f"most_{name}"), F.lit(False))
    return out | (rate < F.col(f"low_{name}")) if name in LOW else out


def judge(docs: DataFrame, min_words: int = MIN_WORDS, min_docs: int = MIN_DOCS, reach: int = REACH) -> DataFrame:
    """The measures of every document, the fences of its group, base_failed and kept."""
    measured = written(measure(docs), "measured")
    fences = written(thresholds(written(sketch(measured), "sketch"), min_docs, reach), "fences")
    within = ~base_failed(min_words)
    for name in MEASURES:
        within &= ~offends(name)
    if fences.count() <= MOST_GROUPS:
        joined = measured.join(F.broadcast(fences), ["lang", "source"])
    else:
        salted = measured.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)))
        joined = salted.join(fences.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["lang", "source", "_salt"]).drop("_salt")
    return joined.withColumn("base_failed", base_failed(min_words)).withColumn("kept", F.coalesce(within, F.lit(False)))
