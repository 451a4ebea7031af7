"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word rule ``[^\x20\x09-\x0D]+``.
BLANKS = " \t\n\x0b\x0c\r"


def words(text: str) -> list[str]:
    """The matches of ``[^\\x20\\x09-\\x0D]+``; bytes.split() splits at just these blanks."""
    return [w.decode() for w in text.encode().split()]


def texts(df: DataFrame) -> DataFrame:
    """doc_id and text alone, null text as empty; other columns cannot clash."""
    return df.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def rest_of(docs: DataFrame) -> Column:
    """A struct of the columns but the text, beside which no name can clash."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")


def restored(df: DataFrame, docs: DataFrame) -> list[Column]:
    """The columns of ``docs`` from row and text; n_chars follows the text."""
    now = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        now["n_chars"] = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return [now.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns]


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local one only where all runs in one JVM."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="cuegrid-"))
    return sc.getCheckpointDir().rstrip("/")


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts lineage so that later jobs neither repeat the work nor depend on the
    executors that did it. The table goes with ``discard``, or when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    out = df.write.mode("overwrite")
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the written tables that ``df`` reads; nothing may read them any more."""
    shared = shared_dir(df.sparkSession)
    jvm = df.sparkSession._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        place = jvm.org.apache.hadoop.fs.Path(folder)
        if place.toUri().getPath().startswith(jvm.org.apache.hadoop.fs.Path(shared).toUri().getPath() + "/"):
            place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in smaller ones, so that what a task holds in Python objects stays small."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def keyed(rows: DataFrame, small: DataFrame, on: list[str], spread: Column, most: int, salts: int = 32) -> DataFrame:
    """rows with the columns of a written table of one row a key: broadcast if it has ``most`` rows at most, else by keys salted with ``spread``."""
    if small.count() <= most:
        return rows.join(F.broadcast(small), on)
    salted = rows.withColumn("_salt", F.pmod(spread, F.lit(salts)))
    return salted.join(small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))), [*on, "_salt"]).drop("_salt")
