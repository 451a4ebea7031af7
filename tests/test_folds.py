"""Set forms against plain sequential folds on random rows, and batch against stream."""

import random

import pandas as pd

import pytest
from pyspark.sql import functions as F

from cuegrid.operators import audio, cues, frames, masks, memo, segments
from cuegrid.streaming import jobs as streaming


def test_group_sealing_is_the_sequential_rule(spark):
    rng = random.Random(1)
    pool = ["拓也", "拓也が来た", "拓也が来た。走る", "別の長い文章がここにあります", "別の", ""]
    data = [(f"i{i}", k, k * 1.0, k * 1.0 + 0.5, rng.choice(pool), "") for i in range(40) for k in range(30)]
    df = spark.createDataFrame(data, "item_id string, pos long, start_s double, end_s double, text string, style string")
    flags = {(r.item_id, r.pos): r.m for r in cues.mergeable(df).collect()}
    got = {(r.item_id, r.pos): r.group_no for r in cues.grouped(df.repartition(7)).collect()}
    for i in range(40):
        sealed, group = False, 0
        for k in range(30):
            key, text = (f"i{i}", k), data[i * 30 + k][4]
            joins = k > 0 and not sealed and flags[key]
            group += not joins
            sealed = joins and 0 < len(text.strip()) <= 12
            assert got[key] == group, key


def test_segments_by_island_equal_one_fold(spark):
    rng = random.Random(2)
    pool = ["あ", "ああいう", "ああいうえお", "全然違う文", "全然違う文章だ", ""]
    data, t = [], 0.0
    for i in range(30):
        t = 0.0
        for k in range(40):
            t += rng.choice([0.5, 0.5, 0.5, 2.0])
            data.append((f"i{i}", k, t, rng.choice(pool)))
    df = spark.createDataFrame(data, "item_id string, frame_idx int, t_s double, text string")
    got = {}
    for r in segments.build_segments(df, 0.5, quotes=False).orderBy("item_id", "seg_no").collect():
        got.setdefault(r.item_id, []).append([r.start_s, r.end_s, r.text])
    for i in range(30):
        rows = [(x[2], x[2], x[3]) for x in data if x[0] == f"i{i}" and x[3]]
        assert got.get(f"i{i}", []) == segments.fold_segments(rows, 0.5, 0.85)


def test_quote_windows_are_the_sequential_rule(spark):
    rng = random.Random(3)
    pool = ["「開く", "続く", "閉じる」", "地の文。", "『二重", "』終"]
    data = [(f"i{i}", k, k * 1.0, k * 1.0 + rng.choice([0.9, 0.1]), rng.choice(pool)) for i in range(40) for k in range(20)]
    df = spark.createDataFrame(data, "item_id string, seg_no int, start_s double, end_s double, text string")
    got = {}
    for r in segments.merge_quotes(df, 0.5).orderBy("item_id", "seg_no").collect():
        got.setdefault(r.item_id, []).append(r.text)
    for i in range(40):
        out = []
        for _, _, s, e, t in (x for x in data if x[0] == f"i{i}"):
            depth = lambda x: sum(c in "「『" for c in x) - sum(c in "」』" for c in x)
            if out and depth(out[-1][1]) > 0 and not any(c in "「『" for c in t) and not t.endswith("。") and s <= out[-1][0] + 0.75:
                out[-1] = (max(out[-1][0], e), out[-1][1] + t)
            else:
                out.append((e, t))
        assert got[f"i{i}"] == [t for _, t in out]


def plain_spans(changed, max_run):
    """Runs of changed frames, cut every max_run; the key is the last still frame after the last cut's run."""
    out, i, n = [], 0, len(changed)
    while i < n:
        if not changed[i]:
            i += 1
            continue
        j = i
        while j < n and changed[j] and j - i < max_run:
            j += 1
        key = j - 1
        if j - i < max_run:
            while key + 1 < n and not changed[key + 1]:
                key += 1
        out.append((i, key))
        i = j
    return [(s, (out[k + 1][0] if k + 1 < len(out) else n) - 1, key) for k, (s, key) in enumerate(out)]


def test_spans_are_the_sequential_rule(spark):
    rng = random.Random(4)
    data = [(f"i{i}", k, float("inf") if k == 0 else rng.choice([0.0, 0.0, 9.0, 9.0, 9.0])) for i in range(60) for k in range(50)]
    df = spark.createDataFrame(data, "item_id string, frame_idx int, diff double")
    got = {}
    for r in frames.spans(df, 5.0, 4).orderBy("item_id", "span_no").collect():
        got.setdefault(r.item_id, []).append((r.start_idx, r.end_idx, r.key_idx))
    for i in range(60):
        assert got[f"i{i}"] == plain_spans([x[2] >= 5 for x in data if x[0] == f"i{i}"], 4)


def plain_speech(win, th, hyst, least, pad):
    cuts, quiet = [], None
    for t, db in win:
        if db >= th:
            if quiet is not None and t - quiet >= least:
                cuts.append((quiet, t))
            quiet = None
        elif db < th - hyst and quiet is None:
            quiet = t
    t0, t1 = win[0][0], win[-1][0] + 0.25
    if quiet is not None:
        cuts.append((quiet, t1))
    parts, cur = [], t0
    for s, e in [*cuts, (t1, t1)]:
        if s > cur:
            parts.append((cur, s))
        cur = max(cur, e)
    out = []
    for s, e in parts:
        s, e = s - pad, e + pad
        if e - s < 0.3:
            continue
        if out and s <= out[-1][1]:
            out[-1][1] = e
        else:
            out.append([max(s, t0), min(e, t1)])
    return out


def test_speech_is_the_sequential_rule(spark):
    rng = random.Random(5)
    data = []
    for i in range(40):
        level = -20.0
        for k in range(80):
            level = rng.choice([-20.0, -35.0, -60.0]) if rng.random() < 0.3 else level
            data.append((f"i{i}", k, k * 0.25, level))
    df = spark.createDataFrame(data, "item_id string, w long, t_s double, db double")
    th = df.select("item_id").distinct().withColumn("th", F.lit(-30.0))
    got = {}
    for r in audio.speech_segments(df, th).orderBy("item_id", "start_s").collect():
        got.setdefault(r.item_id, []).append([r.start_s, r.end_s])
    for i in range(40):
        want = plain_speech([(x[2], x[3]) for x in data if x[0] == f"i{i}"], -30.0, 10.0, 0.6, 0.2)
        assert [pytest.approx(x) for x in want] == got.get(f"i{i}", [])


def test_otsu_of_two_levels(spark):
    data = [("a", k, k * 0.25, -60.0 if k % 3 else -20.0) for k in range(60)] + [("b", k, k * 0.25, -30.0) for k in range(20)]
    got = {r.item_id: r.th for r in audio.otsu(spark.createDataFrame(data, "item_id string, w long, t_s double, db double")).collect()}
    assert -60 < got["a"] < -20 and got["b"] is None


def test_otsu_takes_the_first_of_equal_variances(spark):
    """Mirrored levels: two cuts are as good, but for the last bits of their sums."""
    rows = [(1, x) for x in (0.0, 0.0, 2.5, 3.0, 3.75, 4.125, 4.875, 5.375, 8.0, 8.0)]
    assert audio.otsu(spark.createDataFrame(rows, "item_id int, db double")).first().th == 3.125


def test_mask_merge_equals_one_fold(spark):
    rng = random.Random(6)
    data = [(f"i{i}", round(rng.uniform(0, 60), 1), 0.0, rng.choice([0, 5, 100]), 0, 50, 50, "blur:20", 1.0) for i in range(30) for _ in range(25)]
    data = [(a, s, s + round(rng.uniform(0.1, 3), 1), *r) for a, s, _, *r in data]
    df = spark.createDataFrame(data, "item_id string, start_s double, end_s double, x int, y int, w int, h int, effect string, vol double")
    got = {}
    for r in masks.merge_masks(df).collect():
        got.setdefault(r.item_id, []).append((r.start_s, r.end_s, r.x))
    for i in range(30):
        kept = []
        for m in sorted((m for m in data if m[0] == f"i{i}"), key=lambda m: m[1:7]):
            for o in kept:
                if max(m[1] - o[1], o[0] - m[2]) <= 1 and masks._rect_iou((o[2], 0, 50, 50), (m[3], 0, 50, 50)) >= 0.5:
                    o[0], o[1] = min(o[0], m[1]), max(o[1], m[2])
                    break
            else:
                kept.append([m[1], m[2], m[3]])
        assert sorted(got[f"i{i}"]) == sorted(map(tuple, kept))


def test_word_hits_and_tracks(spark):
    texts = spark.createDataFrame([("i", 0, "abcabdab"), ("i", 1, "zzz")], "item_id string, pos int, text string")
    words = spark.createDataFrame([("ab",), ("abc",), ("bd",), ("b",)], "word string")
    assert [(r.start, r.word) for r in masks.find_words(texts, words).orderBy("start").collect()] == [(0, "abc"), (3, "ab"), (6, "ab")]
    boxes = spark.createDataFrame([("i", k, k, 10 * k, 0, 40, 40) for k in range(12)] + [("i", 3, 99, 500, 0, 40, 40)], "item_id string, frame_idx int, box_id long, x int, y int, w int, h int")
    got = masks.merge_tracks(boxes, masks.track_edges(boxes), 1.0, 1000, 100).orderBy("start_s", "x").collect()
    assert [(r.start_s, r.end_s, r.x, r.w) for r in got] == [(0.0, 12.0, 0, 150), (3.0, 4.0, 500, 40)]


def test_representatives_and_expansion(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "a", "x"), (4, "b", "z")], "id int, coarse string, fine string")
    keyed = memo.representatives(df, "coarse", "fine", "id")
    assert {r.id for r in keyed.filter("is_first").collect()} == {1, 2, 4}
    results = keyed.filter("is_first").select("key", F.concat(F.lit("r"), "id").alias("result"))
    assert {r.id: r.result for r in memo.expand(keyed, results).collect()} == {1: "r1", 2: "r2", 3: "r1", 4: "r4"}


OBS = "item_id string, ts timestamp, t_s double, text string"


def _observations():
    rng = random.Random(7)
    rows = []
    for i in range(4):
        t = 1.0
        for _ in range(60):
            t += rng.choice([0.5, 0.5, 0.5, 3.0])
            rows.append((f"i{i}", t, rng.choice(["あ", "ああいう", "ああいうえお", "全然違う文"])))
    rows.append(("z", 500.0, "終"))
    return rows


def _stream(spark, tmp_path, rows, parts):
    """Rows as a file stream of ``parts`` files in the order of time."""
    rows = sorted(rows, key=lambda r: r[1])
    step = -(-len(rows) // parts)
    for k in range(parts):
        part = rows[k * step : (k + 1) * step]
        df = spark.createDataFrame(part, "item_id string, t_s double, text string").selectExpr("item_id", "timestamp_micros(cast(t_s * 1e6 as long)) AS ts", "t_s", "text")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(OBS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_streamed_segments_equal_batch(spark, tmp_path):
    rows = _observations()
    out = streaming.stream_segments(_stream(spark, tmp_path, rows, 4), 0.5, "100 seconds")
    q = out.writeStream.format("memory").queryName("t4").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {}
    for r in spark.sql("SELECT * FROM t4").orderBy("item_id", "start_s").collect():
        got.setdefault(r.item_id, []).append([r.start_s, r.end_s, r.text])
    for i in range(4):
        own = sorted((t, t, x) for k, t, x in rows if k == f"i{i}")
        assert got[f"i{i}"] == segments.fold_segments(own, 0.5, 0.85)


def test_streamed_segments_repeat_drop_and_close(spark, tmp_path):
    """Repeated rows count once more to no effect, rows behind the watermark are dropped, a silent item closes by its timer."""
    batches = [[("a", 10.0, "x"), ("a", 10.0, "x"), ("b", 11.0, "y")], [("a", 10.5, "xy"), ("z", 40.0, "z")], [("a", 9.0, "late"), ("z", 60.0, "z")], [("z", 90.0, "z")]]
    for k, part in enumerate(batches):
        df = spark.createDataFrame(part, "item_id string, t_s double, text string").selectExpr("item_id", "timestamp_micros(cast(t_s * 1e6 as long)) AS ts", "t_s", "text")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(OBS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming.stream_segments(stream, 0.5, "5 seconds").writeStream.format("memory").queryName("t4b").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = sorted(map(tuple, spark.sql("SELECT * FROM t4b").collect()))
    assert got == [("a", 10.0, 11.0, "xy"), ("b", 11.0, 11.5, "y"), ("z", 40.0, 40.5, "z"), ("z", 60.0, 60.5, "z")]


def test_waiting_rows_are_few_entries_of_state():
    """Rows of an item go into the state in runs, not one by one, and come out in the order of time."""

    class Map(dict):
        calls = 0

        def updateValue(self, k, v):  # noqa: N802
            Map.calls += 1
            self[k] = v

        def removeKey(self, k):  # noqa: N802
            Map.calls += 1
            del self[k]

        getValue = dict.get  # noqa: N815

    class Value:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, v):
            self.held = v

        def clear(self):
            self.held = None

    p = streaming.SegmentProcessor(0.5, 0.85)
    p.waiting, p.open, p.timer = Map(), Value(), Value()
    p.handle = type("Handle", (), {"registerTimer": lambda self, at: None, "deleteTimer": lambda self, at: None})()
    rng = random.Random(5)
    rows = [(rng.randrange(4000) / 4, rng.choice("abc") * 3) for _ in range(1000)] + [(7.0, "aaa")] * 5
    rng.shuffle(rows)
    got = []
    for k in range(4):
        p._put([pd.DataFrame(rows[k::4], columns=["t_s", "text"])], 0.0)
    assert Map.calls < 40
    for passed in (100.0, 100.1, 555.0, 2000.0):
        for pdf in p._advance((1,), passed):
            got += pdf[["start_s", "end_s", "text"]].values.tolist()
    assert not p.waiting and not p.open.exists() and Map.calls < 120
    assert got == segments.fold_segments([(t, t, x) for t, x in sorted(r for r in rows if r[0] > 0)], 0.5, 0.85)


def test_streamed_islands_loudness_and_first_seen(spark, tmp_path):
    rows = _observations()
    stream = _stream(spark, tmp_path, rows, 3)
    started = [
        streaming.stream_islands(stream, 0.5, "100 seconds").writeStream.format("memory").queryName("t3").outputMode("append").option("checkpointLocation", str(tmp_path / "a")).start(),
        streaming.stream_loudness(stream.withColumn("db", F.lit(-20.0)), "100 seconds").writeStream.format("memory").queryName("t2").outputMode("append").option("checkpointLocation", str(tmp_path / "b")).start(),
        streaming.stream_first_seen(stream, "text").writeStream.format("memory").queryName("t5").outputMode("append").option("checkpointLocation", str(tmp_path / "d")).start(),
    ]
    for q in started:
        q.processAllAvailable()
        q.stop()
    gaps = 0
    for i in range(4):
        t = sorted(x[1] for x in rows if x[0] == f"i{i}")
        gaps += 1 + sum(b - a > 1.25 for a, b in zip(t, t[1:]))
    assert spark.sql("SELECT * FROM t3").count() == gaps
    loud = {(x[0], int(x[1] / 0.25)) for x in rows if x[1] < 400}
    assert spark.sql("SELECT * FROM t2").count() == len(loud)
    assert all(r.db == pytest.approx(-20.0) for r in spark.sql("SELECT db FROM t2").collect())
    assert spark.sql("SELECT * FROM t5").count() == len({(x[0], x[2]) for x in rows})


def test_streamed_memo_usage_and_log(spark, tmp_path):
    rows = [("i", 1.0, "a"), ("i", 2.0, "b"), ("i", 3.0, "a"), ("i", 4.0, "c")]
    stream = _stream(spark, tmp_path, rows, 2)
    asked = []

    def translate(df):
        asked.extend(r.text for r in df.collect())
        return df.select(F.col("text").alias("src"), F.upper("text").alias("dst"))

    for _ in range(2):
        q = streaming.stream_memo(stream, str(tmp_path / "memo"), translate, str(tmp_path / "c")).start()
        q.processAllAvailable()
        q.stop()
    assert sorted(asked) == ["a", "b", "c"]
    assert {(r.src, r.dst) for r in streaming.read_memo(spark, str(tmp_path / "memo")).collect()} == {("a", "A"), ("b", "B"), ("c", "C")}
    usage = stream.selectExpr("'e' AS endpoint", "10 AS prompt_tokens", "2 AS completion_tokens", "5 AS cached_tokens")
    q = streaming.stream_usage(usage, {"hit": 1.0, "miss": 1.0, "output": 1.0}).writeStream.format("memory").queryName("t6").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    r = spark.sql("SELECT * FROM t6").first()
    assert (r.calls, r.miss_tokens, r.cost) == (4, 20, pytest.approx(48e-6))
    log = stream.select(F.concat(F.lit("["), F.col("ts").cast("string"), F.lit('] {"stage": "ocr", "evt": "ok"}')).alias("value"))
    q = streaming.stream_log_counts(log).writeStream.format("memory").queryName("t7").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) AS n FROM t7").first().n == 4
