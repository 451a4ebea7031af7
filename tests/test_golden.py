"""The literals of FIXTURES.md."""

import pytest
from pyspark.sql import functions as F

from cuegrid.functions import text as T
from cuegrid.functions.times import parse_clock, parse_time, sample_times, srt_clock
from cuegrid.operators import audio, cues, frames, jobs, masks, memo, protocol, segments
from cuegrid.sources import subtitles, tables


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def cue_rows(spark, data):
    return rows(spark, [("i", k, float(a), float(b), t, "") for k, (a, b, t) in enumerate(data)], "item_id string, pos long, start_s double, end_s double, text string, style string")


def one(spark, expr, value):
    return rows(spark, [(value,)], "c string").select(expr(F.col("c")).alias("r")).first().r


SRT = "1\n00:00:01,000 --> 00:00:03,000\nこんにちは世界\n\n2\n00:00:04,000 --> 00:00:06,000\n今日はいい天気ですね\n"


def test_charset_without_mark(spark):
    files = rows(spark, [(k, bytearray(SRT.encode(e))) for k, e in enumerate(("shift_jis", "utf-8", "utf-8-sig", "utf-16"))], "file_id int, content binary")
    got = {r.file_id: r for r in subtitles.detect_charset(files).collect()}
    assert got[0].label == "shift_jis" and got[1].label == "utf-8"
    assert all(r.text == SRT for r in got.values())
    read = subtitles.read_cues(subtitles.detect_charset(files)).filter("item_id = 0").orderBy("pos").collect()
    assert [r.text for r in read] == ["こんにちは世界", "今日はいい天気ですね"]


def test_growing_lines_become_one_group(spark):
    t = "これはとても長い台詞の前半部分です"
    (r,) = cues.merge_cues(cue_rows(spark, [(1, 2, t), (2.5, 3.5, t + "続き"), (3.8, 5, t + "続きもっと")])).collect()
    assert (r.n, r.start_s, r.end_s) == (3, 1.0, 5.0) and "もっと" in r.text


def test_gap_over_the_cap(spark):
    assert cues.merge_cues(cue_rows(spark, [(1, 2, "同じ台詞"), (10, 11, "同じ台詞")])).count() == 2


def test_sealing_after_a_name_line(spark):
    got = cues.merge_cues(cue_rows(spark, [(1, 2, "拓也が来た"), (2.2, 3, "拓也"), (3.2, 5, "拓也が走る")])).orderBy("pos").collect()
    assert [r.n for r in got] == [2, 1]


def test_layout(spark):
    assert one(spark, T.layout, "{\\pos(1,2)}第一行 第二行\n第三行") == "{\\pos(1,2)}第一行\\N第二行\\N第三行"


def test_import_and_sinks(spark):
    text = "1\n00:00:01,000 --> 00:00:03,000\nおはよう\n\n2\n00:00:04,000 --> 00:00:06,000\nこんばんは\n"
    texts = rows(spark, [("f", text)], "file_id string, text string")
    segs = cues.import_cues(texts).orderBy("seg_no").collect()
    assert [(r.start_s, r.end_s, r.text) for r in segs] == [(1.0, 3.0, "おはよう"), (4.0, 6.0, "こんばんは")]
    srt = subtitles.convert(texts, "srt").first().text
    assert srt.startswith("﻿1\n00:00:01,000 --> 00:00:03,000\nおはよう") and srt.count("-->") == 2
    ass = subtitles.convert(texts, "ass").first().text
    assert "Dialogue: 0,0:00:01.00,0:00:03.00,Default,,0,0,0,,おはよう" in ass
    again = subtitles.to_ass(subtitles.read_ass(rows(spark, [("f", ass)], "file_id string, text string")).withColumn("text", F.concat("text", F.lit(", too"))), rows(spark, [("f", ass)], "file_id string, text string")).first().text
    assert "おはよう, too" in again and again.count("\n") == ass.count("\n")


def test_txt(spark):
    t = "lost\n0:05 first\nmore\n\n7.5 second\n1:00:00:third"
    got = subtitles.read_txt(rows(spark, [("f", t)], "file_id string, text string")).orderBy("pos").collect()
    assert [(r.start_s, r.text) for r in got] == [(5.0, "first\nmore"), (7.5, "second"), (3600.0, "third")]


def test_glossary_substitution(spark):
    terms = rows(spark, [("拓也", "拓也"), ("拓", "X")], "term string, replacement string")
    segs = rows(spark, [("拓也が来た",), (None,)], "tr string")
    assert [r.o for r in jobs.with_terms(segs, terms, "tr", "o").collect()] == ["⟦⟦X⟧也⟧が来た", None]


def test_replies(spark):
    requests = rows(spark, [(b, i, s) for b in range(4) for i, s in ((1, "a"), (2, "b"))], "batch_id int, idx int, src string")
    replies = rows(spark, [(0, '```json\n["甲", "乙"]\n```'), (1, "甲%%乙"), (2, "1 甲\n2 乙"), (3, "1 甲\n3 乙")], "batch_id int, reply string")
    got = {}
    for r in protocol.reconcile(requests, replies).orderBy("batch_id", "idx").collect():
        got.setdefault(r.batch_id, []).append(r.dst)
    assert got == {0: ["甲", "乙"], 1: ["甲", "乙"], 2: ["甲", "乙"], 3: [None, None]}


def test_echo(spark):
    src = ["こんにちは", "世界です", "テスト"]
    data = [(0, s, s) for s in src] + [(1, s, d) for s, d in zip(src, ["你好", "世界", "测试"])]
    got = {r.batch_id: r.ratio for r in memo.echo_ratio(rows(spark, data, "batch_id int, src string, dst string")).collect()}
    assert got == {0: 1.0, 1: 0.0}


def test_resume(spark):
    segs = rows(spark, [("i", k, f"句{k}", None) for k in range(10)], "item_id string, pos int, text string, tr string")
    known = rows(spark, [(f"句{k}", f"x{k}") for k in range(10) if k not in (3, 4)], "src string, dst string")
    assert [r.text for r in memo.pending(segs, known).orderBy("pos").collect()] == ["句3", "句4"]


def test_proofread(spark):
    segs = rows(spark, [("i", k, 0.0, 1.0, "t", f"旧译{k}") for k in (1, 2, 3)], "item_id string, seg_no int, start_s double, end_s double, text string, tr string")
    new, changed = protocol.apply_proofread(segs, rows(spark, [("i", 1, "新译1")], "item_id string, seg_no int, reply string"))
    assert [r.tr for r in new.orderBy("seg_no").collect()] == ["新译1", "旧译2", "旧译3"] and changed.first().changed == 1


def test_usage(spark):
    usage = rows(spark, [(1000, 500, 200)], "prompt_tokens int, completion_tokens int, cached_tokens int")
    assert protocol.usage_totals(usage, {"hit": 0.02, "miss": 1.0, "output": 2.0}).first().cost == pytest.approx(0.001804)


def test_responses(spark):
    gateway = "<html><head><title>502 Bad Gateway</title></head><body><h1>502 Bad Gateway</h1></body></html>"
    block = "<!DOCTYPE html><html><head><title>Attention Required! | Cloudflare</title></head><body>cf-ray: abc123 Just a moment...</body></html>"
    cases = [(502, gateway, "gateway"), (403, block, "blocked"), (403, "<html>Denied</html>", "forbidden"), (429, "quota", "rate_limited"), (500, "oops", "other"), (200, "a wafer biscuit", "other")]
    cases += [(200, " <!doctype html><p>hello", "html"), (400, "insufficient balance", "quota"), (400, "content_policy", "censored"), (200, "x" * 400 + "quota", "other"), (401, None, "unauthorised"), (404, "", "not_found")]
    df = rows(spark, cases, "code int, body string, want string")
    assert [r.c for r in df.select(T.classify_response(F.col("code"), F.col("body")).alias("c")).collect()] == [c[2] for c in cases]


def test_terms_one_after_the_other(spark):
    """The Arrow function gives what the expression gives, replacements that hold terms included."""
    from cuegrid.functions.matching import substitution

    terms = [("abcd", "bc"), ("bc", "x"), ("cd", "⟦"), ("x", "y"), ("⟧d", "z")]
    texts = ["abcd bcd", "cdx", "", "nothing", "xabcdabcd bc", None]
    df = rows(spark, [(t,) for t in texts], "t string")
    listed = F.array(*[F.struct(F.lit(a).alias("term"), F.lit(b).alias("replacement")) for a, b in terms])
    got = df.select(substitution(spark, terms)("t").alias("a"), T.substitute(F.col("t"), listed).alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got]


def test_job_labels(spark):
    cases = [("run --fast sm1234567", "sm1234567"), ("run so1234567", "sm1234567"), ("run --fast 1234567", "sm1234567"), ("ocr --x dir/a.mp4 -y", "a.mp4"), ("ocr b.srt", "b.srt"), ("web", "web")]
    cases += [("ocr " + "n" * 50 + ".mp4", "n" * 37 + "..."), ("", ""), ("run sm123", "run")]
    assert [one(spark, T.item_label, c) for c, _ in cases] == [w for _, w in cases]
    assert one(spark, T.item_stem, "title_sm29889006") == "title"


def test_descriptions(spark):
    info = rows(spark, [("i", 0, "T", "", "2026-01-01", "d1\nd2", "u"), ("j", 1, "", "", "", "d", "")], "item_id string, kind int, title string, uploader string, date string, desc string, url string")
    got = {r.item_id: r.text for r in jobs.descriptions(info, rows(spark, [(0, "{title} {no}")], "kind int, template string")).collect()}
    assert got == {"i": "T {no}\n原标题:T\n投稿时间:2026-01-01\n原视频:u\n\nd1\nd2", "j": "d"}


def test_names(spark):
    data = [("拓也",)] * 3 + [("- 香織 ー",)] * 3 + [("これは長い文章ですから名前ではない",), ("走れメロス。",)]
    assert {r.name for r in memo.name_candidates(rows(spark, data, "text string")).collect()} == {"拓也", "香織"}


def test_markers(spark):
    data = [(0, 0, "メロス"), (0, 1, "走れ"), (1, 0, "1"), (1, 1, "走れ")]
    got = protocol.attribute_by_marker(rows(spark, data, "batch_id int, row_no int, words string"), rows(spark, [(0, 4), (1, 4)], "batch_id int, n int")).collect()
    assert [(r.batch_id, r.frame_no, r.text) for r in got] == [(1, 1, "走れ")]


def test_timeline(spark):
    obs = rows(spark, [("i", k, k * 0.5, f"第{k}句。次{k}。") for k in range(40)], "item_id string, frame_idx int, t_s double, text string")
    segs = segments.build_segments(obs, 0.5)
    got = segs.orderBy("seg_no").collect()
    starts = [r.start_s for r in got]
    assert starts == sorted(set(starts)) and starts[0] == 0 and got[-1].end_s >= 19
    assert audio.check_timeline(segs).count() == 0


def test_info_masks_segments_style(spark):
    info = "https://www.nicovideo.jp/watch/sm9\n原标题:测试标题\n原作者:某人\n投稿时间:2026-01-01\n原简介:简介第一行\n标签:测试,搬运\n"
    more = "u\n原简介: one\n\n作者: x\n原标题:T\ntwo \n标签:\nafter"
    got = {r.item_id: r for r in tables.read_info(rows(spark, [("f", info), ("g", more)], "file_id string, text string")).collect()}
    r = got["f"]
    assert (r.url, r.title, r.uploader, r.date, r.desc, r.tags) == ("https://www.nicovideo.jp/watch/sm9", "测试标题", "某人", "2026-01-01", "简介第一行", ["测试", "搬运"])
    r = got["g"]
    assert (r.url, r.title, r.uploader, r.desc, r.tags) == ("u", "T", "", "one\n\n作者: x\ntwo", [])
    m = '[{"start":1,"end":2,"x":1,"y":2,"w":3,"h":4,"effect":"blur:20"},{"start":0,"end":2,"x":1,"y":2,"w":3,"h":4,"effect":"color:000000"}]'
    assert [x.vol for x in tables.read_masks(rows(spark, [("f", m)], "file_id string, text string")).collect()] == [1.0, 1.0]
    s = '{"segments":[{"start":0,"end":1,"text":"a","tr":"b"},{"start":1,"end":2,"text":"c"}]}'
    assert [x.tr for x in tables.read_segments(rows(spark, [("f", s)], "file_id string, text string")).orderBy("seg_no").collect()] == ["b", None]
    fixed, _ = jobs.repair_styles(rows(spark, [("i", "red", "#000000", 99.0, "left")], "item_id string, color string, outline_color string, outline_width double, position string"))
    x = fixed.first()
    assert (x.color, x.outline_width, x.position) == ("#FFFFFF", 4.0, "bottom")


def test_text_functions(spark):
    assert one(spark, T.full_width_punct, "好,a,b!真!!好...") == "好，a,b!真！!好……"
    assert one(spark, T.unify_quotes, "他说\"好\" 和'不'，“是”") == "他说「好」 和『不』，「是」"
    assert one(spark, T.shorten_dots, "a....... b………… c...") == "a...... b…… c..."
    assert one(spark, T.key_nfkc, "ｱ ｲ\n1") == "アイ1"
    assert one(spark, T.key_compare, "ちょっ....と") == "ちよつ...と"
    assert one(spark, T.display_width, "あa") == 1.5
    assert one(spark, T.canonical_url, "https://a/watch/sm12?x=1") == "https://www.nicovideo.jp/watch/sm12"
    assert one(spark, T.canonical_url, "https://y/w?v=1&t=2&v=3#p") == "https://y/w?v=3#p"
    assert one(spark, lambda c: T.safe_title(c, F.lit("id")), " a/b:c. ") == "a_b_c"
    assert [one(spark, T.symbol_only, x) for x in ("!!", "……", "a", "")] == [True, True, False, False]
    assert [one(spark, T.bad_target, x) for x in (None, "[[未译]]", "x [[y]]", "The request was rejected", "好")] == [True, True, True, True, False]


def test_times(spark):
    assert [one(spark, parse_clock, x) for x in ("5", "1:05.5", "00:01:05,500", "x", "")] == [5.0, 65.5, 65.5, 0.0, 0.0]
    assert [one(spark, parse_time, x) for x in ("90", "11:41", "1:02:03", "11分41秒", "1时2分3秒", "1时41", "", "abc")] == [90.0, 701.0, 3723.0, 701.0, 3723.0, 6060.0, None, None]
    r = rows(spark, [(3661.2345, 0.3)], "a double, b double").select(srt_clock(F.col("a")).alias("s"), sample_times(F.lit(0.0), F.col("b")).alias("t")).first()
    assert r.s == "01:01:01,234" and r.t == pytest.approx([0.1])


def test_bands_and_boxes(spark):
    profile = rows(spark, [("i", y, 9) for y in (3, 4, 6, 7, 8, 20, 30, 31, 32, 33)], "item_id string, y int, n int")
    assert sorted((r.y0, r.y1) for r in frames.bands(profile, 5).collect()) == [(3, 9), (30, 34)]
    lines = rows(spark, [("i", 0.0, 0, "四文字だ"), ("i", 0.0, 1, "五文字だよ")], "item_id string, t_s double, line_no int, line string")
    boxes = rows(spark, [("i", 0.0, k, 0, 0, w, 20) for k, w in enumerate((80, 95, 400))], "item_id string, t_s double, box_no int, x int, y int, w int, h int")
    got = {r.line_no: r.box_no for r in masks.lines_to_boxes(lines, boxes).collect()}
    assert got == {0: 0, 1: 1}
