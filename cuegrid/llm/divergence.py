"""Operator 13: how far the sources of a language differ in their words, over run-length columns.

Terms are runs of letters and non-ASCII characters, A-Z lower-cased. A language keeps the terms that
are in at least ``MIN_DOCS`` of its documents. Each (language, source) group has a count for every
kept term, smoothed to a share p of whole numbers. Two shares differ by f = (p - q)^2 // (p + q).
For pairs of sources the vocabulary is reordered: terms with the same counts in all sources become
one column with a width, and columns are sorted by their counts, so that equal counts stand
together. The order is cut into blocks, in each of which the counts of every source are
run-length encoded. A pair meets at the union of the two sources' run boundaries, and every stretch
between them gives f times its length. Blocks are added up by pair.

Null text, language and source are empty; sources without terms are groups too. Repeated rows count
as often as they occur. Ids and other columns are not read. Texts of any length are counted whole. Ties of rank
go to the item of smaller UTF-8 bytes. An empty table gives no rows. Sources of a language are
held in one row each term and language, since the result has their square; blocks deal with tiles
of 256 by 256 sources.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuegrid.llm.common import slices, written

MIN_DOCS = 10
SHARE = 1_000_000_000
MOST_TERMS = 10
#: Columns to a block, sources to a tile, and the terms that a task counts before it hands them on.
BLOCK, TILE, HELD = 8192, 256, 200_000
#: A term's occurrences and documents in one whole number, its documents in the low bits.
DOCS = 40
MASK = (1 << DOCS) - 1
#: The bytes of ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+`` in UTF-8, lower-cased.
_TERM = re.compile(rb"[a-z\x80-\xff]+")


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs, of parts of the table: to be added up. A group also gives a row of null term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, dict[bytes | None, int]] = {}
        size = 0

        def rows() -> pa.RecordBatch:
            langs, sources = zip(*(g for g, terms in held.items() for _ in terms))
            terms = [t if t is None else t.decode() for own in held.values() for t in own]
            both = [x for own in held.values() for x in own.values()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(langs), pa.array(sources), pa.array(terms, pa.string()), pa.array([x >> DOCS for x in both], pa.int64()), pa.array([x & MASK for x in both], pa.int64())], names=["lang", "source", "term", "n", "docs"])

        for b in slices(batches):
            for lang, source, text in zip(b["lang"].to_pylist(), b["source"].to_pylist(), b["text"]):
                own = held.setdefault((lang, source), {None: 0})
                before, known = len(own), own.get
                for t, n in Counter(_TERM.findall(text.as_py().encode().lower())).items():
                    own[t] = known(t, 0) + (n << DOCS) + 1
                size += len(own) - before
                if size >= HELD:
                    yield rows()
                    size = 0
        if held:
            yield rows()

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return docs.select(empty("lang"), empty("source"), empty("text")).mapInArrow(run, "lang string, source string, term string, n long, docs long")


def vocabulary(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term, total and counts (source, n; sorted) of the kept terms."""
    by_source = counts.filter("term IS NOT NULL").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("counts"))
    return kept.filter(F.col("docs") >= min_docs).select("lang", "term", "total", "counts")


def groups(counts: DataFrame, terms: DataFrame) -> DataFrame:
    """lang, source, sid (its number in the language), base (N + 2 V) of each group, and lang_base of its language."""
    all_of = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("_all"))
    own = terms.select("lang", F.explode("counts").alias("c")).groupBy("lang", "c.source").agg(F.sum("c.n").alias("_n"))
    found = counts.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(all_of, "lang", "left")
    v2 = 2 * F.coalesce("v", F.lit(0))
    sid = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    return found.select("lang", "source", sid.alias("sid"), (F.coalesce("_n", F.lit(0)) + v2).alias("base"), (F.coalesce("_all", F.lit(0)) + v2).alias("lang_base"))


def share(n: Column, base: Column) -> Column:
    """1 + floor(SHARE * (n + 2) / base), in whole numbers of up to 38 digits."""
    whole = F.call_function("div", F.lit(SHARE).cast("decimal(10,0)") * (n + 2).cast("decimal(19,0)"), base.cast("decimal(19,0)"))
    return whole + 1


def distinctive_terms(terms: DataFrame, found: DataFrame, most: int = MOST_TERMS) -> DataFrame:
    """lang, source, item, value, rank: the terms of a group whose share is above the language's, by f."""
    rows = terms.select("lang", "term", "total", F.explode("counts").alias("c")).select("lang", "term", "total", "c.source", "c.n")
    both = rows.join(found, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), share(F.col("n"), F.col("base")).alias("p"), share(F.col("total"), F.col("lang_base")).alias("q"))
    valued = both.filter("p > q").select("lang", "source", "item", F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return valued.withColumn("rank", rank).filter(F.col("rank") <= most)


# ---- pairs of sources


def columns(terms: DataFrame, found: DataFrame) -> DataFrame:
    """lang, tiles, counts (sid, n; sorted) and width: terms of the same counts as one column."""
    sources = found.select("lang", "source", "sid")
    tiles = found.groupBy("lang").agg(F.floor((F.count("*") - 1) / TILE).cast("int").alias("last"))
    same = terms.groupBy("lang", "counts").agg(F.count("*").alias("width")).withColumn("_c", F.monotonically_increasing_id())
    named = written(same, "columns")
    numbered = named.select("lang", "_c", "width", F.explode("counts").alias("c")).select("lang", "_c", "width", F.col("c.source").alias("source"), F.col("c.n").alias("n")).join(sources, ["lang", "source"])
    listed = numbered.groupBy("lang", "_c").agg(F.first("width").alias("width"), F.array_sort(F.collect_list(F.struct("sid", "n"))).alias("counts"))
    return listed.join(tiles, "lang").select("lang", "last", "counts", "width")


def encoded(cols: DataFrame, block: int = BLOCK) -> DataFrame:
    """lang, i, j, width and runs (sid, starts, values): the run-length encoded sources of tiles i and j in
    each block of the sorted columns; sources without a count in a block are left out."""

    def encode(lang, last, counts: list, widths: list) -> Iterator[dict]:
        ends = np.cumsum(widths)
        begins = ends - widths
        by_source: dict[int, dict[int, int]] = {}
        for k, row in enumerate(counts):
            for c in row:
                by_source.setdefault(c["sid"], {})[k] = c["n"]
        runs: dict[int, list[dict]] = {}
        for sid in sorted(by_source):
            values = np.zeros(len(widths), np.int64)
            values[list(by_source[sid])] = list(by_source[sid].values())
            at = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
            runs.setdefault(sid // TILE, []).append({"sid": sid, "starts": begins[at].tolist(), "values": values[at].tolist()})
        for i in range(last + 1):
            for j in range(i, last + 1):
                yield {"lang": lang, "i": i, "j": j, "width": int(ends[-1]), "runs": runs.get(i, []) + (runs.get(j, []) if j > i else [])}

    schema = pa.schema([("lang", pa.string()), ("i", pa.int32()), ("j", pa.int32()), ("width", pa.int64()), ("runs", pa.list_(pa.struct([("sid", pa.int32()), ("starts", pa.list_(pa.int64())), ("values", pa.list_(pa.int64()))])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, counts, widths = None, 0, [], []
        for b in slices(batches):
            for lang, its_last, c, w in zip(*(b[k].to_pylist() for k in ("lang", "last", "counts", "width"))):
                if counts and (lang != now or len(counts) == block):
                    yield pa.RecordBatch.from_pylist(list(encode(now, last, counts, widths)), schema)
                    counts, widths = [], []
                now, last = lang, its_last
                counts.append(c)
                widths.append(w)
        if counts:
            yield pa.RecordBatch.from_pylist(list(encode(now, last, counts, widths)), schema)

    kind = "lang string, i int, j int, width long, runs array<struct<sid:int,starts:array<long>,values:array<long>>>"
    return cols.repartitionByRange("lang", "counts").sortWithinPartitions("lang", "counts").mapInArrow(run, kind)


def shares(n: np.ndarray, base: int) -> np.ndarray:
    """1 + SHARE * (n + 2) // base; beyond 63 bits in whole numbers of Python."""
    big = len(n) and int(n.max()) >= 9 * 10**9
    return np.array([1 + SHARE * (int(x) + 2) // base for x in n], np.int64) if big else 1 + SHARE * (n + 2) // base


def divergence(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], width: int) -> int:
    """The sum of f over a block of two sources' runs (starts, shares): the runs between the boundaries of either."""
    at = np.union1d(a[0], b[0])
    p = a[1][np.searchsorted(a[0], at, "right") - 1]
    q = b[1][np.searchsorted(b[0], at, "right") - 1]
    lengths = np.diff(np.append(at, width))
    return int(((p - q) * (p - q) // (p + q) * lengths).sum())


def pairs(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """lang, a, b, value: the sum of f over all kept terms for sources a < b of a language."""
    tile = F.floor(F.col("sid") / TILE).cast("int")
    tiles = found.groupBy("lang", tile.alias("tile")).agg(F.array_sort(F.collect_list(F.struct("sid", "base"))).alias("m"))
    side = lambda k: tiles.select("lang", F.col("tile").alias(k), F.col("m").alias(f"m{k}"))
    # A block of no width for each two tiles, so that pairs without terms have a row.
    empty = side("i").select("lang", "i").join(side("j").select("lang", "j"), "lang").filter("i <= j").select("lang", "i", "j", F.lit(0).cast("long").alias("width"), F.lit(None).cast(blocks.schema["runs"].dataType).alias("runs"))
    met = blocks.unionByName(empty).join(side("i"), ["lang", "i"]).join(side("j"), ["lang", "j"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 16):
            sums: dict[tuple, int] = {}
            for row in b.to_pylist():
                left, right, width = row["mi"], row["mj"], row["width"]
                base = {m["sid"]: m["base"] for m in (*left, *right)}
                runs = {sid: (np.zeros(1, np.int64), shares(np.zeros(1, np.int64), max(1, n))) for sid, n in base.items()}
                for r in row["runs"] or ():
                    runs[r["sid"]] = np.array(r["starts"]), shares(np.array(r["values"]), base[r["sid"]])
                for x in left:
                    for y in right:
                        if x["sid"] < y["sid"]:
                            key = (row["lang"], x["sid"], y["sid"])
                            sums[key] = sums.get(key, 0) + (divergence(runs[x["sid"]], runs[y["sid"]], width) if width else 0)
            langs, first, second = zip(*sums) if sums else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(first, pa.int32()), pa.array(second, pa.int32()), pa.array(list(sums.values()), pa.int64())], names=["lang", "a", "b", "value"])

    parts = met.select("lang", "width", "runs", "mi", "mj").mapInArrow(run, "lang string, a int, b int, value long")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank: for each group its divergence from the other sources of
    its language (part ``pair``), and the terms that set it apart from its language (``term``)."""
    counts = written(term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    terms = written(vocabulary(counts, min_docs), "terms")
    found = written(groups(counts, terms), "groups")
    distances = written(pairs(written(encoded(columns(terms, found), block), "runs"), found), "pairs")
    both = distances.unionByName(distances.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    name = lambda sid, as_: found.select("lang", F.col("sid").alias(sid), F.col("source").alias(as_))
    named = both.join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"])
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    columns_ = ["lang", "source", "part", "item", "value", "rank"]
    paired = named.withColumn("rank", rank).withColumn("part", F.lit("pair")).select(*columns_)
    return paired.unionByName(distinctive_terms(terms, found).withColumn("part", F.lit("term")).select(*columns_))
