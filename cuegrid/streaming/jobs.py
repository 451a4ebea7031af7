"""The same results kept up to date with Structured Streaming."""

from __future__ import annotations

import json
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import count
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cuegrid.functions.text import untranslated
from cuegrid.operators.segments import folding
from cuegrid.streaming.memo_store import MemoStore


def stream_memo(texts: DataFrame, memo_path: str, translate, checkpoint: str, buckets: int = 64, compact_every: int = 16):
    """Streaming query that asks ``translate(DataFrame of text) -> (src, dst)`` for new texts only.

    The memo is a store of hash buckets; a batch reads those that may hold its texts and adds one
    entry. A batch that is replayed after it was added asks nothing.
    """

    def fill(batch: DataFrame, batch_id: int) -> None:
        store = MemoStore(batch.sparkSession, memo_path, buckets, compact_every)
        if store.holds(batch_id):
            return
        fresh = batch.select("text").filter("text <> ''").distinct()
        known = store.known(fresh)
        if known is not None:
            fresh = fresh.join(known.select(F.col("src").alias("text")), "text", "left_anti")
        store.add(batch_id, translate(fresh).filter(~untranslated(F.col("dst"))).select("src", "dst"))

    return texts.writeStream.foreachBatch(fill).option("checkpointLocation", checkpoint)


def read_memo(spark: SparkSession, memo_path: str) -> DataFrame | None:
    """src, dst of all batches; None while there is none."""
    return MemoStore(spark, memo_path).rows()


def stream_loudness(stream: DataFrame, watermark: str = "1 second", size: str = "250 milliseconds") -> DataFrame:
    """item_id, window, db of rows (item_id, ts, db); rows later than the watermark are dropped and
    counted by the query's progress (numRowsDroppedByWatermark)."""
    power = F.avg(F.pow(F.lit(10.0), F.col("db") / 10))
    return stream.withWatermark("ts", watermark).groupBy("item_id", F.window("ts", size)).agg((10 * F.log10(power)).alias("db"))


def stream_islands(stream: DataFrame, frame_dur: float, watermark: str = "1 second") -> DataFrame:
    """item_id, start, end, n: activity with gaps of 2.5 frames at most. The rule includes its limit
    and the session does not, hence one microsecond more."""
    gap = f"{round(frame_dur * 2.5e6) + 1} microseconds"
    rows = stream.withWatermark("ts", watermark).groupBy("item_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.max("ts").alias("end"))
    return rows.select("item_id", F.col("w.start").alias("start"), "end", "n")


#: Waiting rows of an item to one entry of its state.
RUN = 64


class SegmentProcessor(StatefulProcessor):
    """Segments of one item: rows wait until the watermark has passed them and then go, in the order of
    time, into the fold of the batch form, whose open segments are all that is kept of them.

    State: the waiting rows in runs of ``RUN`` at most, by their first time, the open segments, and a timer
    for the next waiting row, or for the end of what is open. A batch adds its new rows as runs, takes out
    those that are due and cuts those that are due in part; every other run is known by its first time alone.
    """

    def __init__(self, frame_dur: float, threshold: float):
        self.frame_dur, self.threshold = frame_dur, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "t double, k int", "t array<double>, text array<string>, n array<int>")
        self.open = handle.getValueState("open", "segments string, last double")
        self.timer = handle.getValueState("timer", "at long")

    def _put(self, batches: Iterator[pd.DataFrame], passed: float) -> None:
        # Spark lets rows through that are late by the newest watermark but not by the one before.
        said = Counter((t, text) for pdf in batches for t, text in zip(pdf["t_s"].tolist(), pdf["text"].tolist()) if t > passed)
        new = sorted((*row, n) for row, n in said.items())
        taken = {tuple(key) for key in self.waiting.keys()} if new else set()
        for i in range(0, len(new), RUN):
            self._keep(new[i : i + RUN], taken)

    def _keep(self, run: list[tuple[float, str, int]], taken: set[tuple]) -> None:
        key = next((run[0][0], k) for k in count() if (run[0][0], k) not in taken)
        taken.add(key)
        self.waiting.updateValue(key, tuple(map(list, zip(*run))))

    def _advance(self, key: tuple, passed: float) -> Iterator[pd.DataFrame]:
        runs = {tuple(run) for run in self.waiting.keys()}
        due = []
        for run in sorted(r for r in runs if r[0] <= passed):
            rows = list(zip(*self.waiting.getValue(run)))
            at = bisect_right(rows, passed, key=itemgetter(0))
            due += rows[:at]
            self.waiting.removeKey(run)
            runs.remove(run)
            if at < len(rows):
                self._keep(rows[at:], runs)
        due.sort()
        held = self.open.get() if self.open.exists() else None
        state, last = (json.loads(held[0]), held[1]) if held else (None, None)
        fold, finish = folding(self.frame_dur, self.threshold)
        closed, state = fold(state, ((0, t, t, text) for t, text, n in due for _ in range(n)))
        last = due[-1][0] if due else last
        if last is not None and passed > (last + self.frame_dur) + self.frame_dur * 1.5:
            closed, state, last = closed + finish(state), None, None
        if last is None:
            self.open.clear()
        elif due:
            self.open.update((json.dumps(state, ensure_ascii=False), last))
        # The watermark at which the next row is due, or else at which the open segments can no longer grow.
        self._wake(min(runs)[0] if runs else None if last is None else last + 2.5 * self.frame_dur)
        if closed:
            yield pd.DataFrame([(key[0], *s) for s in closed], columns=["item_id", "start_s", "end_s", "text"])

    def _wake(self, t: float | None) -> None:
        before = self.timer.get()[0] if self.timer.exists() else None
        at = None if t is None else int(t * 1000) + 2
        if at == before:
            return
        if before is not None:
            self.handle.deleteTimer(before)
        if at is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() / 1000
        self._put(rows, passed)
        yield from self._advance(key, passed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.timer.clear()
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs() / 1000)

    def close(self) -> None:
        pass


#: Fixed value: the state store that state variables and timers need.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_segments(stream: DataFrame, frame_dur: float, watermark: str = "1 second", threshold: float = 0.85) -> DataFrame:
    """item_id, start_s, end_s, text of rows (item_id, ts, t_s, text), text normalised and not empty.

    ts is t_s as a timestamp. A segment is given once the watermark has passed what could still change
    it. Rows later than the watermark are dropped. Sets the session's state store to RocksDB.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    kind = stream.schema["item_id"].dataType.simpleString()
    keyed = stream.withWatermark("ts", watermark).groupBy("item_id")
    return keyed.transformWithStateInPandas(SegmentProcessor(frame_dur, threshold), f"item_id {kind}, start_s double, end_s double, text string", "Append", "EventTime")


def stream_first_seen(stream: DataFrame, key: str, watermark: str = "10 minutes") -> DataFrame:
    return stream.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["item_id", key])


def stream_usage(stream: DataFrame, prices: dict[str, float]) -> DataFrame:
    """Running totals by endpoint, for update mode."""
    hit, miss, out = F.sum("cached_tokens"), F.sum(F.col("prompt_tokens") - F.col("cached_tokens")), F.sum("completion_tokens")
    cost = (hit * prices["hit"] + miss * prices["miss"] + out * prices["output"]) / 1e6
    return stream.groupBy("endpoint").agg(F.count("*").alias("calls"), hit.alias("hit_tokens"), miss.alias("miss_tokens"), out.alias("output_tokens"), cost.alias("cost"))


def stream_log_counts(stream: DataFrame, watermark: str = "1 minute") -> DataFrame:
    """stage, evt, minute, n of log lines (value): ``[ts] {json}``. Only a newline ends a line."""
    rule = r"(?d)^\[([^\]]+)\]\s*(\{.*\})\s*$"
    rows = stream.filter(F.col("value").rlike(rule)).select(F.regexp_extract("value", rule, 1).try_cast("timestamp").alias("ts"), F.from_json(F.regexp_extract("value", rule, 2), "stage string, evt string").alias("p"))
    return rows.withWatermark("ts", watermark).groupBy(F.window("ts", "1 minute").alias("minute"), "p.stage", "p.evt").agg(F.count("*").alias("n"))
