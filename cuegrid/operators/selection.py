"""K1 to K3: preferred formats and files, snapshots of items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def pick_formats(formats: DataFrame, quality: str = "480p") -> DataFrame:
    """The one format of each video. By height: exact and normal, exact, at least and normal, at
    least, any; the smallest of the first tier that has one. ``best`` takes the largest normal
    one, ``lowest`` the smallest of the lowest variants."""
    size = F.coalesce("filesize", F.col("tbr") * 125 * F.greatest(F.coalesce("duration", F.lit(1)), F.lit(1)))
    normal = ~F.col("lowest")
    if quality in ("best", "lowest"):
        tier = F.when(normal if quality == "best" else F.col("lowest"), 1).otherwise(2)
        order = F.desc("size") if quality == "best" else F.asc("size")
    else:
        h = int(quality.rstrip("pP"))
        tall = F.coalesce("height", F.lit(0))
        tier = F.when((tall == h) & normal, 1).when(tall == h, 2).when((tall >= h) & normal, 3).when(tall >= h, 4).otherwise(5)
        order = F.asc("size")
    rows = formats.withColumn("size", size).withColumn("tier", tier)
    w = Window.partitionBy("video_id").orderBy("tier", order, "format_no")
    return rows.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def pick_file(files: DataFrame, processed: str = ".masked.") -> DataFrame:
    """item_id, name: the processed variant, else the one named as the item, else the first by name."""
    rank = F.when(F.contains("name", F.lit(processed)), 1).when(F.startswith("name", F.concat("item_id", F.lit("."))), 2).otherwise(3)
    w = Window.partitionBy("item_id").orderBy(rank, "name")
    return files.withColumn("_k", F.row_number().over(w)).filter("_k = 1").select("item_id", "name")


def write_snapshot(df: DataFrame, path: str, name: str) -> None:
    df.write.mode("overwrite").parquet(f"{path}/snapshot={name}")


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """snapshot, rows: newest first by name."""
    return spark.read.option("basePath", path).parquet(f"{path}/snapshot=*").groupBy(F.col("snapshot").cast("string").alias("snapshot")).agg(F.count("*").alias("rows")).orderBy(F.desc("snapshot"))


def restore(spark: SparkSession, path: str, name: str, new_name: str) -> DataFrame:
    """Snapshot ``name`` written again as ``new_name``, which is returned."""
    write_snapshot(spark.read.parquet(f"{path}/snapshot={name}"), path, new_name)
    return spark.read.parquet(f"{path}/snapshot={new_name}")
