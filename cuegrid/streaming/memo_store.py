"""A memo of texts and their targets on shared storage, in buckets, for batches that ask and add.

Each batch adds one entry: a folder of Parquet files by hash bucket of the source, and a Bloom
filter for each of its buckets. An entry counts once its name is in the log, by a rename. A batch
reads the filters, and then only those buckets of those entries that may hold one of its texts.
Every so many entries are compacted into one, which names those it replaces; they go with the
compaction after that, so that a reader that began before is not disturbed and the log stays short. A batch that is
replayed finds itself in the log and does nothing; one that died before that writes its folder anew.
"""

from __future__ import annotations

import json
import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a filter's part (as Spark's bitmap functions have it), bits for each source and hashes of one.
PART, BITS, HASHES = 32768, 12, 4


class MemoStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, compact_every: int = 16):
        self.spark, self.path, self.buckets, self.compact_every = spark, path.rstrip("/"), buckets, compact_every
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *names: str):
        return self._hadoop.Path("/".join((self.path, *names)))

    # ---- the log

    def _read(self, name: str) -> dict:
        return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(self._fs.open(self._at("log", name)), "UTF-8"))

    def log(self) -> dict[str, dict]:
        """Every committed entry by its name."""
        if not self._fs.exists(self._at("log")):
            return {}
        names = [f.getPath().getName() for f in self._fs.listStatus(self._at("log"))]
        return {n: self._read(n) for n in names if re.match(r"(batch|compact)-\d+$", n)}

    def live(self) -> dict[str, dict]:
        """The entries that no other replaces."""
        log = self.log()
        gone = {old for e in log.values() for old in e["replaces"]}
        return {n: e for n, e in log.items() if n not in gone}

    def _commit(self, name: str, entry: dict) -> None:
        draft = self._at("log", f"_{name}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        self._fs.rename(draft, self._at("log", name))

    # ---- entries

    def _bucket(self, src: Column) -> Column:
        return F.pmod(F.xxhash64(src), F.lit(self.buckets)).cast("int")

    @staticmethod
    def _bit(src: Column, k: Column, parts: Column) -> Column:
        """The k-th place of a source in a filter of so many parts, from 1."""
        return F.pmod(F.xxhash64(src, k + 1), parts.cast("long") * PART) + 1

    def _write(self, name: str, rows: DataFrame, replaces: list[str]) -> None:
        place = f"{self.path}/data/{name}"
        marked = rows.select("src", "dst", self._bucket(F.col("src")).alias("bucket"))
        marked.repartition(self.buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(place)
        kept = self._rows(name)
        fullest = kept.groupBy("bucket").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        parts = max(1, math.ceil(BITS * fullest / PART))
        bits = kept.select("bucket", F.explode(F.transform(F.sequence(F.lit(0), F.lit(HASHES - 1)), lambda k: self._bit(F.col("src"), k, F.lit(parts)))).alias("bit"))
        filters = bits.groupBy("bucket", F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
        filters.write.mode("overwrite").parquet(f"{self.path}/filters/{name}")
        self._commit(name, {"parts": parts, "rows": kept.count(), "replaces": replaces})

    def _rows(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        rows = self.spark.read.schema("src string, dst string, bucket int").parquet(f"{self.path}/data/{name}")
        return rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))

    def add(self, batch_id: int, rows: DataFrame) -> None:
        """Add src and dst as the entry of a batch, unless it is there."""
        if not self.holds(batch_id):
            self._write(f"batch-{batch_id}", rows, [])
        live = self.live()
        if len(live) >= self.compact_every:
            self._compact(batch_id, live)

    def holds(self, batch_id: int) -> bool:
        """A compaction is named by the last of the batches that are in it."""
        return any(n == f"batch-{batch_id}" or (n.startswith("compact") and int(n.split("-")[1]) >= batch_id) for n in self.log())

    def _compact(self, number: int, live: dict[str, dict]) -> None:
        log = self.log()
        replaced = {old for e in log.values() for old in e["replaces"]}
        self._write(f"compact-{number}", self._all(live), sorted(live))
        for old in replaced:
            for kind in ("data", "filters", "log"):
                self._fs.delete(self._at(kind, old), True)

    def _all(self, live: dict[str, dict]) -> DataFrame:
        return reduce(DataFrame.unionByName, [self._rows(n).select("src", "dst") for n in live])

    # ---- asking

    def rows(self) -> DataFrame | None:
        """src and dst of all entries; None while there is none."""
        live = self.live()
        return self._all(live) if live else None

    def possible(self, texts: DataFrame) -> DataFrame | None:
        """text, entry and bucket where a filter says that the entry may hold the text; None without entries."""
        live = self.live()
        if not live:
            return None
        entries = self.spark.createDataFrame([(n, e["parts"]) for n, e in live.items()], "entry string, parts int")
        asked = texts.select("text").distinct().withColumn("bucket", self._bucket(F.col("text"))).join(F.broadcast(entries))
        ks = F.transform(F.sequence(F.lit(0), F.lit(HASHES - 1)), lambda k: self._bit(F.col("text"), k, F.col("parts")))
        bits = asked.select("text", "bucket", "entry", F.explode(ks).alias("bit"))
        bits = bits.select("text", "bucket", "entry", F.bitmap_bucket_number("bit").alias("part"), F.bitmap_bit_position("bit").alias("at"))
        filters = reduce(DataFrame.unionByName, [self.spark.read.schema("bucket int, part long, bits binary").parquet(f"{self.path}/filters/{n}").withColumn("entry", F.lit(n)) for n in live])
        byte = F.conv(F.hex(F.substring("bits", (F.col("at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        on = F.call_function("getbit", byte, (F.col("at") % 8).cast("int"))
        met = bits.join(filters, ["entry", "bucket", "part"]).filter(on == 1)
        return met.groupBy("text", "entry", "bucket").agg(F.count("*").alias("n")).filter(F.col("n") == HASHES).drop("n")

    def known(self, texts: DataFrame) -> DataFrame | None:
        """src and dst of the texts that the memo holds, read from the buckets that may hold them; None if no bucket may."""
        possible = self.possible(texts)
        if possible is None:
            return None
        # Entries times buckets at most.
        touched: dict[str, list[int]] = {}
        for r in possible.select("entry", "bucket").distinct().collect():
            touched.setdefault(r.entry, []).append(r.bucket)
        if not touched:
            return None
        rows = reduce(DataFrame.unionByName, [self._rows(n, b).select("src", "dst") for n, b in touched.items()])
        return rows.join(texts.select(F.col("text").alias("src")).distinct(), "src", "left_semi")
