"""From raw documents to packed sequences: classifier, line dedup, near-dedup, secrets, packing.

Each stage works on all its predecessor kept; all but the last return the columns of
documents. Null and empty texts pass the line dedup, the near-dedup and the secret scan as they
are, the classifier if it does not reject them, and are packed as empty documents.
Rows that repeat an id and a text are judged, shortened and scanned each; of copies the near-dedup keeps
the row of the least id, or all rows of that id. An empty table gives no rows in every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cuegrid.llm import classifier, jaccard, line_dedup, packing, secrets
from cuegrid.llm.common import discard, restored, table, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects, toxic ones among them, go."""
    judged = classifier.classify(docs, table(spark, sf_dir, "labels")).filter("kept")
    return judged.select(*restored(judged, docs))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines of 50 words or more that came before go; the documents stay."""
    return line_dedup.shortened(docs)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (Jaccard 0.8 over five words) the one of the least id stays."""
    return jaccard.representatives(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are masked; the documents stay."""
    return secrets.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 1024 tokens."""
    return packing.pack(packing.pieces(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_deduplication),
    ("simhash_near_dedup", near_deduplication),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: The classifier's floating-point weights, winnowing and tokens are beyond SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
