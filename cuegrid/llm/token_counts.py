"""Operator 6: exact histogram of encoded lengths, with suffix sums for every context limit.

Null text counts as empty, of length 0. For a limit L the documents longer than L, the tokens
of all documents cut at L, and any quantile of the lengths follow from one row of the result.
Texts of any length are encoded whole. Repeated rows count each, null ids like others; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuegrid.llm.chunk_codec import codec
from cuegrid.llm.common import slices, texts, written
from cuegrid.llm.packing import BYTE_BPE, BYTE_RANKS

#: Lengths are summed within blocks of so many first, then over the blocks.
BLOCK = 1024


def encoded_lengths(docs: DataFrame, tokenizer_path: str = BYTE_BPE, ranks_path: str = BYTE_RANKS) -> DataFrame:
    """doc_id, n_tokens of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = codec(tokenizer_path, ranks_path)
        for b in slices(batches):
            n = pa.array([len(x) // 4 for x in enc.encode(b["text"].to_pylist())], pa.int64())
            yield pa.RecordBatch.from_arrays([b["doc_id"], n], names=["doc_id", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts(docs).mapInArrow(run, f"doc_id {kind}, n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row per length: n_docs of it, docs_at_least and tokens_at_least (suffix sums),
    tokens_truncated (of all documents cut at this length), and the shares of documents
    below this length and up to it.

    The sums run within blocks of lengths and then over the totals of the blocks, of which
    there are as many as the longest text has thousands of tokens.
    """
    hist = lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs")).withColumn("_block", F.floor(F.col("n_tokens") / BLOCK))
    hist = written(hist, "lengths")
    totals = hist.groupBy("_block").agg(F.sum("n_docs").alias("_docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("_tokens"))
    over = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select(
        "_block",
        F.coalesce(F.sum("_docs").over(over), F.lit(0)).alias("_docs_after"),
        F.coalesce(F.sum("_tokens").over(over), F.lit(0)).alias("_tokens_after"),
        F.sum("_docs").over(all_rows).alias("_all_docs"),
        F.sum("_tokens").over(all_rows).alias("_all_tokens"),
    )
    inside = Window.partitionBy("_block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    out = hist.join(totals, "_block").select(
        "n_tokens",
        "n_docs",
        (F.sum("n_docs").over(inside) + F.col("_docs_after")).alias("docs_at_least"),
        (F.sum(F.col("n_docs") * F.col("n_tokens")).over(inside) + F.col("_tokens_after")).alias("tokens_at_least"),
        "_all_docs",
        "_all_tokens",
    )
    return out.select(
        "n_tokens",
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        (F.col("_all_tokens") - F.col("tokens_at_least") + F.col("docs_at_least") * F.col("n_tokens")).alias("tokens_truncated"),
        (1 - F.col("docs_at_least") / F.col("_all_docs")).alias("docs_share_below"),
        ((F.col("_all_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("_all_docs")).alias("docs_share_up_to"),
    )


def at_limits(hist: DataFrame, limits: DataFrame) -> DataFrame:
    """For each ``context`` of limits: docs_cut (longer) and tokens_kept (cut at the limit)."""
    above = F.when(F.col("n_tokens") > F.col("context"), F.col("n_docs")).otherwise(0)
    kept = F.least("n_tokens", "context") * F.col("n_docs")
    return limits.select("context").distinct().crossJoin(hist.select("n_tokens", "n_docs")).groupBy("context").agg(F.sum(above).alias("docs_cut"), F.sum(kept).alias("tokens_kept"))


def quantile(hist: DataFrame, q: float) -> DataFrame:
    """n_tokens: the least length with a share q or more of the documents at or below it."""
    return hist.filter(F.col("docs_share_up_to") >= q - 1e-12).agg(F.min("n_tokens").alias("n_tokens"))
