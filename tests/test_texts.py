"""Text columns against plain Python on random characters, and what of them leaves the JVM."""

import random
import unicodedata

from pyspark.sql import functions as F

from cuegrid.functions import text as T


def _random_texts(n: int) -> list:
    rng = random.Random(3)
    ends = (0x80, 0x100, 0x300, 0x400, 0x3100, 0x10000, 0x110000)
    chars = lambda end: [c for c in (chr(rng.randrange(1, end)) for _ in range(rng.randrange(30))) if not 0xD800 <= ord(c) < 0xE000]
    marks = ["é", "가", "ｶﾞ", "ﬁ½", "²", "", None]
    return marks + ["".join(chars(rng.choice(ends))) for _ in range(n)]


def test_nfkc_and_width(spark):
    df = spark.createDataFrame(list(enumerate(_random_texts(2000))), "k int, t string")
    rows = df.select("t", T.nfkc(F.col("t")).alias("n"), T.display_width(F.col("t")).alias("w")).collect()
    assert len(rows) == 2007
    for r in rows:
        assert r.n == (None if r.t is None else unicodedata.normalize("NFKC", r.t))
        assert r.w == (None if r.t is None else sum(1.0 if unicodedata.east_asian_width(c) in "WF" else 0.5 for c in r.t))


def test_width_stays_in_the_jvm(spark, capsys):
    spark.createDataFrame([("あa",)], "t string").select(T.display_width(F.col("t"))).explain()
    assert "Python" not in capsys.readouterr().out


def test_texts_that_nfkc_keeps_stay_in_the_jvm(spark):
    """What NFKC cannot change goes to no function of Python's; what it may change comes in small parts."""
    df = spark.createDataFrame([("Grüße, ça va? àéîõü ß ø",), ("½",), ("e\u0301",)], "t string")
    assert [r.c for r in df.select(F.col("t").rlike(T._may_change()).alias("c")).collect()] == [False, True, True]
