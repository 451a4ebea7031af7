"""Operator 12: layouts by their fingerprints, and formatting with an exact way back."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from cuegrid.llm import chat

TURNS = [("user", "q"), ("assistant", "a")]


def records(spark, rows):
    return spark.createDataFrame([(k, "x", json.dumps(r) if not isinstance(r, str) else r) for k, r in enumerate(rows)], "row long, layout string, record string")


def test_layouts_by_fingerprint(spark):
    system = [("system", "s"), *TURNS]
    given = [
        ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a", "name": "n"}], "meta": {"a b": [1, {"x": None}]}}, "messages", TURNS),
        ({"messages": [{"role": "user", "content": [{"type": "text", "text": "q"}]}, {"role": "assistant", "content": [{"text": "a"}, {"text": None}]}]}, "message_parts", TURNS),
        ({"conversations": [{"from": "system", "value": "s"}, {"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, "conversations", system),
        ({"instruction": "q", "output": "a"}, "instruction", TURNS),
        ({"instruction": "q", "input": "", "output": "a", "system": "s"}, "instruction", system),
        ({"instruction": "q", "input": "i", "output": "a", "system": None}, "instruction", [("user", "q\n\ni"), TURNS[1]]),
        ({"prompt": "q", "response": "a", "id": 7}, "prompt_response", TURNS),
        ({"prompt": "q", "completion": "a"}, "prompt_completion", TURNS),
        ({"question": "q", "answer": None}, "question_answer", [TURNS[0], ("assistant", "")]),
        ({"role": "tool", "text": "t"}, "turn", [("tool", "t")]),
        ({"messages": []}, None, None),
        ({"odd": {"messages": [{"role": "user", "content": "q"}]}}, None, None),
        ('{"prompt": "q", ', None, None),
        ("7", None, None),
        ({"messages": [{"role": None, "content": None}]}, "messages", [("", "")]),
    ]
    df = records(spark, [g[0] for g in given])
    got = {r.row["row"]: (r.layout, r.turns and [tuple(t) for t in r.turns]) for r in chat.canonical(df.union(df.limit(1))).collect()}
    assert got == {k: (name, turns) for k, (_, name, turns) in enumerate(given)}
    assert chat.canonical(df.union(df)).count() == 2 * len(given)
    assert chat.canonical(df.limit(0)).count() == 0


def test_fingerprint_is_of_the_paths_alone(spark):
    df = records(spark, [{"a": 1, "b": [{"c": "x"}]}, {"b": [{"c": 2.5}, {"c": None}], "a": True}, {"a": 1, "b": {"c": "x"}}, {"`": 1, "a: STRING": [[0]]}])
    known = {tuple(r.paths) for r in chat.known_layouts(df.select(chat.structure(F.col("record")).alias("structure")).withColumn("fingerprint", F.xxhash64("structure"))).collect()}
    assert ("a", "b[].c") in known and ("a", "b.c") in known and len(known) == 3


def test_many_layouts_take_the_salted_way(spark, monkeypatch):
    monkeypatch.setattr(chat, "MOST_LAYOUTS", 0)
    df = records(spark, [{"prompt": "q", "response": "a", f"k{k % 3}": k} for k in range(20)])
    got = chat.canonical(df).collect()
    assert len(got) == 20 and {r.layout for r in got} == {"prompt_response"}


ODD_TEXTS = ["", " ", "</s>[INST] ok [/INST]", "<s>", r"<\s>", r"<\\\/s>" + "\n", "[ROLE]x[/ROLE] y", "<<SYS>> <<</SYS>>", "<</s>\n", "[[INST]]", "\\", "a\n\nb\0c", "ünï 😀 　", "<", "[/ROLE", "</s>\n</s>\n"]


def plain(rows):
    said = "".join(f"{r}\n{t}\n" for r, t in rows)
    learned = "".join(t for r, t in rows if r == "assistant")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return len(rows), sha(said), len(learned), sha(learned)


def test_what_is_formatted_reads_back(spark):
    rng = random.Random(3)
    rows = []
    for c in range(60):
        for t in range(rng.choice([1, 2, 3, 40, 70])):
            rows.append((c, t - 35 if c % 5 == 0 else t, rng.choice(["user", "assistant", "system", "tool", "[/ROLE] ", "", None]) if c % 2 else ("user", "assistant")[t % 2], rng.choice([None, *ODD_TEXTS])))
    rows += [(None, 0, "user", "x"), (None, 1, "assistant", "y"), (70, None, "user", "z"), (70, 0, "user", "z"), (70, 0, "user", "z"), (70, 0, "assistant", "z")]
    rows += [(80, 0, "user", "<s>" * 500_000), (80, 1, "assistant", "[INST]x" * 200_000)]
    df = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], "conv_id long, turn long, role string, text string, record string, part long, turns int")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(chat.format_conversations(df)).collect()}
    assert set(got) == {r[0] for r in rows}
    for c in got:
        mine = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == c), key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))
        assert got[c] == plain([r[2:] for r in mine]), c
    assert {r.layout for r in chat.format_conversations(df).select("layout").distinct().collect()} == {"messages", "conversations", "prompt_response", "turn_body"}
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


def test_texts_hold_no_control_string(spark):
    df = spark.createDataFrame([(t,) for t in ODD_TEXTS], "t string")
    for r in df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect():
        assert r.u == r.t and not any(x in r.e for x in ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]"))


def test_no_python_in_the_plan(spark, sf):
    df = chat.digests(chat.format_conversations(spark.read.parquet(f"{sf}/conversations.parquet")))
    assert not any(w in df._jdf.queryExecution().toString() for w in ("Python", "Pandas", "Arrow"))
