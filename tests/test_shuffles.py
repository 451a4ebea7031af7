"""How often tables are read, shuffled and parted between the steps of an operator."""

from collections import Counter

from pyspark.sql import functions as F

from cuegrid.operators import frames
from cuegrid.sources import subtitles


def test_strip_static_shuffles_its_rows_once(spark, capsys):
    rows = [(k % 3, k % 7, f"w{k * k % 11}") for k in range(200)] + [(1, None, "w1"), (1, 2, None), (None, 1, "w1"), (9, 1, "alone"), (9, None, "w1")]
    df = spark.createDataFrame(rows, "item_id int, pos int, feature string")
    n = Counter(i for i, p in {(i, p) for i, p, _ in rows if p is not None})
    k = Counter((i, f) for i, p, f in set(rows) if p is not None)
    kept = [r for r in rows if r[0] is None or r[2] is None or n[r[0]] < 2 or not k[r[0], r[2]] > 0.5 * n[r[0]]]
    out = frames.strip_static(df, 0.5)
    capsys.readouterr()
    out.explain()
    assert capsys.readouterr().out.count("hashpartitioning(item_id") == 1
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(kept, key=repr) != sorted(rows, key=repr)


def test_read_cues_reads_its_texts_once(spark):
    read = spark.sparkContext.accumulator(0)

    def count(parts):
        for pdf in parts:
            read.add(len(pdf))
            yield pdf

    texts = [(1, "1\n00:00:01,000 --> 00:00:02,000\na\n"), (2, "[Events]\nDialogue: 0,0:00:01.00,0:00:02.00,Default,,0,0,0,,b\n"), (3, "0:01 c\n")]
    df = spark.createDataFrame(texts, "file_id int, text string").mapInPandas(count, "file_id int, text string")
    found = subtitles.read_cues(df).collect()
    assert sorted((r.item_id, r.fmt, r.text) for r in found) == [(1, "srt", "a"), (2, "ass", "b"), (3, "txt", "c")]
    assert read.value == 3
    assert subtitles.read_cues(df.filter("file_id < 0")).collect() == []


def test_small_cues_do_not_become_one_task(spark):
    cues = spark.range(400).select((F.col("id") % 40).alias("item_id"), F.col("id").alias("pos"), F.col("id").cast("double").alias("start_s"), (F.col("id") + 0.5).cast("double").alias("end_s"), F.lit("a").alias("text"))
    parts = subtitles.to_srt(cues).select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts == int(spark.conf.get("spark.sql.shuffle.partitions"))
